"""Problem 1: personal information in free text, by a semi-Markov conditional random field over all token spans."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import personal_examples as examples
from parley.llm.tokens import TOKENIZER_DIR, pieces_of
from parley.llm.transcripts import HESITATION

TYPES = ("email", "phone", "id_number", "address", "name")
FIELDS = ("raw_text", "translated_text")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Longest spans of each type, in tokens; every span up to this length is scored.
LENGTHS = (18, 16, 18, 20, 6)
LONGEST = max(LENGTHS)
#: Made-up sentences to which the weights are fitted; the bound on the training set.
TRAINING_SENTENCES, EPOCHS, BATCH = 8000, 4, 80
#: Classes of tokens that the model tells apart.
MOST_CLASSES = 256
#: Words of the corpus count as common if they are at least one in so many.
COMMON_SHARE = 200_000
#: Score that a span must have beyond that of plain text, by type.
MARGIN = (0.0, 0.0, 0.0, 0.0, 0.5)
#: Tokens that are scored at a time, and characters after which a text is taken in parts that end with a sentence or word.
TOKENS_AT_ONCE, PART = 250_000, 200_000

# A token carries the blanks after it. A letter or short title with its full stop is one token.
_TOKEN = re.compile(r"(?:[^\W\d_]\.(?=\s)|(?:[Mm]rs?|Ms|[Dd]r|St|No|Nr|Str|Apt|Prof|Sra?|Mme|Mlle|pl)\.(?=\s)|(?:[^\W\d_]|[ऀ-ॣॱ-ॿ̀-ͯ])+|\d+|\S)\s*|\s+")
# Words by which spans are recognised, in lower case.
TITLES = frozenset("mr mrs ms miss dr prof doctor professor herr frau monsieur madame mme mlle señor señora señorita sr sra senhor senhora dom dona don doña shri smt sri श्री श्रीमती".split())
TOWN_WORDS = frozenset("floor stock étage piso andar gate park near opposite behind flat apartment apt house haus casa plot door suite unit block building no nr".split())
STREET_FIRST = frozenset("rue calle avenida rua travessa via chemin plaza praça impasse allée paseo largo boulevard avenue place".split())
STREET_TAIL = ("straße", "strasse", "gasse", "allee", "platz", "weg", "ring", "damm")
AT_WORDS, DOT_WORDS = frozenset("at arroba arobase".split()), frozenset("dot punkt punto ponto point dash underscore plus hyphen minus bindestrich guion".split())
COUNTING = frozenset("ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred double triple".split()) | frozenset(examples.TENS)
DIGIT_WORDS = frozenset(w for line in examples.DIGIT_NAMES.values() for w in line.split()) | {"oh", "double", "triple"}
ORGANISATION = frozenset(w.lower() for w in (*examples.LEGAL, *examples.PRODUCT)) | frozenset("team desk office branch helpline department line agency centre center unit".split())
CALENDAR = frozenset(w.lower() for w in examples.MONTHS) | frozenset("monday tuesday wednesday thursday friday saturday sunday".split())
REFERENCE = frozenset("ticket case order invoice form folio request reference ref version batch receipt serial tracking transaction application auftrag antrag bestellung rechnung formular commande facture dossier formulaire pedido factura solicitud formulario encomenda fatura formulário req tkt".split())
IDENTITY = frozenset("passport identity id ssn tax licence license aadhaar pan iban ausweis reisepass personalausweises personalausweis steuernummer ausweisnummer passeport identité fiscal pasaporte identidad cédula passaporte identidade pehchaan पहचान आधार पासपोर्ट card karte carte tarjeta cartão".split())
MONEY = frozenset("usd eur inr gbp rs dollars euros rupees percent rupaye".split()) | set("%€₹$£")

ARTICLES = frozenset("the an this that these our your their his her its der die das den dem des ein eine einen einem einer eines mein meine meinen meinem meiner dein deine unser unsere ihr ihre ihren ihrem le la les un une des du mon ma mes notre votre el los las una unos mi mis su sus del os as um uma seu sua meu minha do da dos das no na nos nas ao yeh yah woh is us यह वह इस उस".split())
PHONE_WORDS = frozenset("phone call ring dial mobile cell telephone text reach landline handynummer handy telefon anrufen rufen erreichen portable téléphone appelez joindre rappelez móvil teléfono llame llámeme llamarme telemóvel telefone ligue ligar फ़ोन कॉल whatsapp fax".split())
#: What the sentence of a span holds, each a bit.
FLAGS = (IDENTITY, PHONE_WORDS, REFERENCE)
#: Public vocabulary by which common words are told from rare ones.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

ROLES = ("inside", "begin", "end", "left1", "left2", "left3", "right1", "right2")
#: Counts over a span: digits; digit words; at-signs and words; dots and dot words; street words; listed names; words in lower case; capitalised words; commas.
COUNTS, COUNT_MOST = ("digits", "digit words", "ats", "dots", "streets", "listed", "lower", "upper", "commas", "letters and digits"), 20


class Gazetteer(dict):
    """The listed names in lower case: given or family."""


class Lexicon:
    """What is known of a token by itself: its class, its word number and what it adds to the counts of a span. Ids of classes and words are those of the fitted model."""

    def __init__(self, names: dict[str, str], common: frozenset[str] = frozenset(), path: str | None = None) -> None:
        self.names, self.common = names, common
        self.path = path or os.path.join(TOKENIZER_DIR, VOCABULARY)
        fixed = " ".join(examples.SLOT.sub(" ", p) for p in (*examples.LABELLED, *examples.PLAIN)).lower()
        words = sorted(set(re.findall(r"(?:[^\W\d_]|[ऀ-ॿ])+", fixed)) | TITLES | REFERENCE | IDENTITY | MONEY)
        self.word_of = {w: k + 1 for k, w in enumerate(words)}
        self.class_of: dict[str, int] = {"^": 0}

    def describe(self, token: str, listed: bool = True, taught: bool = True) -> tuple[int, int, tuple[int, ...], bool, int]:
        """(class, word, counts, whether it ends a sentence, bits of FLAGS) of a token; listed tells whether to look it up among the names, taught whether among the words of the training sentences."""
        t = token.rstrip()
        glued = len(t) == len(token)
        low = t.lower()
        counts = [0] * len(COUNTS)
        stop = False
        first = t[:1]
        if not t:
            kind = "blank"
        elif first.isdigit():
            counts[0] = min(len(t), COUNT_MOST)
            n = len(t)
            kind = f"d{n if n < 8 else 8 if n < 10 else n if n < 13 else 13}" + ("z" if first == "0" and n > 1 else "") + ("y" if n == 4 and t[:2] in ("19", "20") else "")
            counts[9] = 1
        elif first.isalpha() or "ऀ" <= first <= "ॿ":
            plain = low.rstrip(".")
            upper, title = t.isupper(), first.isupper()
            case = "u" if upper and len(plain) > 1 else "t" if title else "l"
            listed = self.names.get(plain) if listed else None
            if low.endswith(".") and len(low) == 2:
                kind = "initial"
            elif HESITATION.fullmatch(plain):
                kind = "hesitation"
            elif plain in TITLES:
                kind = "title"
            elif plain in ARTICLES:
                kind = "article " + case
                counts[6] = 1
            elif "ऀ" <= first <= "ॿ":
                kind = "hi known" if taught and plain in self.word_of else "hi"
            elif len(plain) == 1:
                kind = "letter " + case
                counts[9] = 1
            elif plain in examples.STREETS:
                kind = "street " + case
                counts[4] = 1
            elif plain in STREET_FIRST:
                kind = "street first"
                counts[4] = 1
            elif len(plain) > 6 and plain.endswith(STREET_TAIL):
                kind = "street tail " + case
                counts[4] = 1
            elif plain in AT_WORDS:
                kind = "at"
                counts[2] = 1
            elif plain in DOT_WORDS:
                kind = "dot"
                counts[3] = 1
            elif plain in DIGIT_WORDS:
                kind = "digit word " + case
                counts[1] = 1
            elif plain in COUNTING:
                kind = "number word"
            elif plain in TOWN_WORDS:
                kind = "town word"
            elif listed:
                kind = f"{listed} {case}" + (" known" if plain in self.word_of else "")
                counts[5] = 1
            elif plain in ORGANISATION:
                kind = "organisation " + case
            elif plain in CALENDAR:
                kind = "calendar " + case
            elif plain in REFERENCE:
                kind = "reference"
            elif plain in IDENTITY:
                kind = "identity"
            elif plain in MONEY:
                kind = "money"
            elif taught and plain in self.word_of:
                kind = "known " + case
            else:
                known = pieces_of(self.path)
                common = " " + plain in known or plain in self.common
                kind = ("common " if common else "capital " if " " + plain.capitalize() in known else "rare ") + case + (str(min(len(plain), 4)) if len(plain) < 4 else "") + (" mixed" if case == "t" and any(c.isupper() for c in t[1:]) else "")
            if case == "l" and kind not in ("at", "dot") and not counts[1]:
                counts[6] = 1
            elif case != "l":
                counts[7] = 1
        else:
            kind = t if t in ".,-@/()+_'’&:;#[]<>*\"" else "money" if t in MONEY else "sign"
            stop = (t in ".!?" and not glued) or t in "।॥\n"
            if stop:
                kind = "stop"
            counts[2] += t == "@"
            counts[3] += t in "._" and glued
            counts[8] += t == ","
        kind += "+" if glued else ""
        number = self.class_of.setdefault(kind, len(self.class_of)) if len(self.class_of) < MOST_CLASSES or kind in self.class_of else 0
        word = low.rstrip(".") if first.isalpha() or "ऀ" <= first <= "ॿ" else low
        return number, self.word_of.get(word, 0) if taught else 0, tuple(counts), stop, sum(1 << k for k, words in enumerate(FLAGS) if word in words)


class SemiMarkov:
    """Weights of whole-span features by type. A span's score is the sum over its tokens, its two ends, the pairs of classes inside and at its ends, three words to the left and two to the right, its length, and tables of what it holds (COUNTS). Plain text scores nothing.

    As nearly all features split into those of the first and those of the last token, all spans up to the longest are scored by few array operations.
    """

    def __init__(self, lexicon: Lexicon, classes: int = MOST_CLASSES) -> None:
        t, v = len(TYPES), len(lexicon.word_of) + 1
        self.lexicon, self.classes = lexicon, classes
        self.word = np.zeros((len(ROLES), v, t), dtype=np.float32)
        self.kind = np.zeros((len(ROLES), classes, t), dtype=np.float32)
        self.pair = np.zeros((3, classes, classes, t), dtype=np.float32)
        self.length = np.zeros((LONGEST + 1, t), dtype=np.float32)
        self.counts = np.zeros((len(COUNTS), COUNT_MOST + 1, t), dtype=np.float32)
        self.length[0] = -3.0
        self.flags = np.zeros((1 << len(FLAGS), t), dtype=np.float32)

    def tables(self) -> list[np.ndarray]:
        return [self.word, self.kind, self.pair, self.length, self.counts, self.flags]

    # -- fitting -------------------------------------------------------------------------------------------

    def fit(self, rows: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = EPOCHS, rate: float = 0.25, decay: float = 2e-4, seed: int = 3) -> SemiMarkov:
        """Maximises the likelihood of the labelled segmentations by mini-batches; the expected features come from forward and backward sums over all segmentations. A third of the words are hidden in turn, so that classes carry weight on their own."""
        random = np.random.default_rng(seed)
        data = []
        for text, gold in rows:
            made = self._training_row(text, gold, random)
            if made is not None:
                data.append(made)
        data.sort(key=lambda d: len(d[0]))
        batches = [data[k : k + BATCH] for k in range(0, len(data), BATCH)]
        squares = [np.full(w.shape, 1e-3, dtype=np.float32) for w in self.tables()]
        for _ in range(epochs):
            for k in random.permutation(len(batches)):
                for w, g, s in zip(self.tables(), self._gradient(batches[k], random), squares):
                    s += g * g
                    w += rate * g / np.sqrt(s) - rate * decay * w
        return self

    def _training_row(self, text: str, gold: list[tuple[int, int, str]], random: np.random.Generator) -> tuple | None:
        tokens = _TOKEN.findall(text)
        if not 1 < len(tokens) <= 44:
            return None
        starts = np.concatenate(([0], np.cumsum([len(x) for x in tokens])))
        begin = {int(a): k for k, a in enumerate(starts[:-1])}
        end = {int(a) + len(x.rstrip()): k for k, (a, x) in enumerate(zip(starts, tokens))}
        spans = []
        for a, b, kind in gold:
            t = TYPES.index(kind)
            if a not in begin or b not in end or end[b] - begin[a] + 1 > LENGTHS[t]:
                return None
            spans.append((begin[a], end[b] - begin[a] + 1, t))
        # a third of the listed names count as unlisted, a third of the words as unknown
        described = [self.lexicon.describe(x, *(random.random(2) > 0.33)) for x in tokens]
        flags = 0
        for d in described:
            flags |= d[4]
        return [d[0] for d in described], [d[1] for d in described], [d[2] for d in described], spans, flags

    def _gradient(self, batch: list[tuple], random: np.random.Generator) -> list[np.ndarray]:
        b, n, types = len(batch), max(len(d[0]) for d in batch), len(TYPES)
        pad = 3
        kind = np.zeros((b, n + 2 * pad), dtype=np.int64)
        word = np.zeros((b, n + 2 * pad), dtype=np.int64)
        count = np.zeros((b, n + 1, len(COUNTS)), dtype=np.int64)
        size = np.array([len(d[0]) for d in batch])
        flags = np.array([d[4] for d in batch])
        for k, (kinds, words, counts, _, _) in enumerate(batch):
            kind[k, pad : pad + len(kinds)] = kinds
            word[k, pad : pad + len(kinds)] = words
            count[k, 1 : len(kinds) + 1] = np.cumsum(counts, axis=0)
            count[k, len(kinds) + 1 :] = count[k, len(kinds)]
        word[random.random(word.shape) < 0.1] = 0
        at = slice(pad, pad + n)
        shift = lambda x, d: x[:, pad + d : pad + d + n]
        of = lambda role, d: self.word[role][shift(word, d)] + self.kind[role][shift(kind, d)]
        inside = of(0, 0)
        bigram = self.pair[2][shift(kind, -1), shift(kind, 0)]
        total = np.concatenate((np.zeros((b, 1, types), dtype=np.float32), np.cumsum(inside + bigram, axis=1)), axis=1)
        first = of(1, 0) + of(3, -1) + of(4, -2) + of(5, -3) + self.pair[0][shift(kind, -1), shift(kind, 0)] - bigram + self.flags[flags][:, None, :]
        last = of(2, 0) + of(6, 1) + of(7, 2) + self.pair[1][shift(kind, 0), shift(kind, 1)]
        score = np.full((b, n, LONGEST, types), -1e9, dtype=np.float32)
        held = np.zeros((b, n, LONGEST, len(COUNTS)), dtype=np.int8)
        for l in range(1, min(LONGEST, n) + 1):
            m = n - l + 1
            s = first[:, :m] + last[:, l - 1 :] + total[:, l : l + m] - total[:, :m] + self.length[l] + self.length[0]
            c = np.minimum(count[:, l : l + m] - count[:, :m], COUNT_MOST)
            held[:, :m, l - 1] = c
            for q in range(len(COUNTS)):
                s = s + self.counts[q][c[..., q]]
            s[(np.arange(m)[None, :] + l) > size[:, None]] = -1e9
            score[:, :m, l - 1] = s
        for t, most in enumerate(LENGTHS):
            score[:, :, most:, t] = -1e9
        weight = np.exp(np.minimum(score, 25.0))
        any_type = weight.sum(axis=3).astype(np.float64)
        forward, backward = np.ones((b, n + 1)), np.ones((b, n + 1))
        for j in range(1, n + 1):
            lengths = np.arange(1, min(LONGEST, j) + 1)
            forward[:, j] = forward[:, j - 1] + (forward[:, j - lengths] * any_type[:, j - lengths, lengths - 1]).sum(axis=1)
        for i in range(n - 1, -1, -1):
            lengths = np.arange(1, min(LONGEST, n - i) + 1)
            backward[:, i] = backward[:, i + 1] + (backward[:, i + lengths] * any_type[:, i, lengths - 1]).sum(axis=1)
        ends = np.minimum(np.arange(n)[:, None] + np.arange(1, LONGEST + 1)[None, :], n)
        g = -weight * (forward[:, :n, None] * backward[:, ends] / forward[:, n][:, None, None]).astype(np.float32)[..., None]
        for k, d in enumerate(batch):
            for i, l, t in d[3]:
                g[k, i, l - 1, t] += 1
        begin_m = g.sum(axis=2)
        end_m = np.zeros((b, n, types), dtype=np.float32)
        for l in range(1, min(LONGEST, n) + 1):
            end_m[:, l - 1 :] += g[:, : n - l + 1, l - 1]
        covered = np.cumsum(begin_m, axis=1) - np.concatenate((np.zeros((b, 1, types)), np.cumsum(end_m, axis=1)[:, :-1]), axis=1)
        gw, gk, gp = np.zeros_like(self.word), np.zeros_like(self.kind), np.zeros_like(self.pair)
        for role, d, marginal in ((0, 0, covered), (1, 0, begin_m), (2, 0, end_m), (3, -1, begin_m), (4, -2, begin_m), (5, -3, begin_m), (6, 1, end_m), (7, 2, end_m)):
            np.add.at(gw[role], shift(word, d), marginal)
            np.add.at(gk[role], shift(kind, d), marginal)
        gw[:, 0] = 0
        np.add.at(gp[0], (shift(kind, -1), shift(kind, 0)), begin_m)
        np.add.at(gp[1], (shift(kind, 0), shift(kind, 1)), end_m)
        np.add.at(gp[2], (shift(kind, -1), shift(kind, 0)), covered - begin_m)
        gl, gc = np.zeros_like(self.length), np.zeros_like(self.counts)
        gl[1:] = g.sum(axis=(0, 1))
        gl[0] = gl[1:].sum(axis=0)
        for t in range(types):
            flat = g[:, :, : LENGTHS[t], t].ravel()
            some = np.flatnonzero(np.abs(flat) > 1e-5)
            for q in range(len(COUNTS)):
                gc[q, :, t] = np.bincount(held[:, :, : LENGTHS[t], q].ravel()[some], flat[some], COUNT_MOST + 1)
        gf = np.zeros_like(self.flags)
        np.add.at(gf, flags, begin_m.sum(axis=1))
        return [gw, gk, gp, gl, gc, gf]


class Reader:
    """Finds the entities of many texts at once; keeps what it learns of tokens, bounded in number and size."""

    MOST_TOKENS, LONGEST_TOKEN = 400_000, 40

    def __init__(self, model: SemiMarkov) -> None:
        self.model = model
        self.pair = model.pair.astype(np.float32)
        self.best_counts = model.counts.max(axis=1).sum(axis=0)
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.zeros((4096, len(ROLES), len(TYPES)), dtype=np.float32)
        # class, whether it ends a sentence, flags, counts
        self.facts = np.zeros((4096, 3 + len(COUNTS)), dtype=np.int32)
        start = np.stack([self.model.kind[r][0] + self.model.word[r][0] for r in range(len(ROLES))])
        self.scores[0] = start
        self.facts[0, 1] = 1

    def _add(self, token: str) -> int:
        key = token
        first = token[:1]
        if first.isdigit():  # digits of one length and look are one token
            t = token.rstrip()
            y = len(t) == 4 and t[:2] in ("19", "20")
            key = ("0" if first == "0" else t[:2] if y else "9") + "9" * (len(t) - 1 - y) + (" " if len(t) < len(token) else "")
            if key in self.row:
                return self.row[key]
        kind, word, counts, stop, flags = self.model.lexicon.describe(key)
        if len(key) > self.LONGEST_TOKEN:  # kept by what it is, as what it says may be long
            key = repr((kind, word, counts, stop, flags))
            if key in self.row:
                return self.row[key]
        k = len(self.row) + 1
        if k >= len(self.scores):
            self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
            self.facts = np.concatenate((self.facts, np.zeros_like(self.facts)))
        self.scores[k] = np.stack([self.model.kind[r][kind] + self.model.word[r][word] for r in range(len(ROLES))])
        if stop:  # what follows a sentence begins one
            for r in (3, 4, 5):
                self.scores[k, r] = self.scores[0, r]
        self.facts[k] = (0 if stop else kind, stop, flags, *counts)
        self.row[key] = k
        return k

    def read(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, type) of the entities of each text, in order."""
        out: list[list] = [[] for _ in texts]
        held: list[tuple[int, int, list[str]]] = []
        n = 0
        for k, text in enumerate(texts):
            for at, part in _parts(text):
                tokens = _TOKEN.findall(part)
                held.append((k, at, tokens))
                n += len(tokens)
                if n > TOKENS_AT_ONCE:
                    self._flush(held, out)
                    held, n = [], 0
        self._flush(held, out)
        return out

    def spans(self, text: str, kind: int) -> list[tuple[int, int, float]]:
        """(first token, token after the last, score) of the spans of one type that score above plain text."""
        start, stop, types, score, _ = self._scored([(0, 0, _TOKEN.findall(text))])
        return [(a - 3, b - 3, s) for a, b, t, s in zip(start.tolist(), stop.tolist(), types.tolist(), score.tolist()) if t == kind]

    def read_spans(self, text: str) -> list[tuple[int, int, int]]:
        """(first token, token after the last, type) of the best segmentation."""
        tokens = _TOKEN.findall(text)
        at = {0: 0}
        for k, x in enumerate(tokens):
            at[sum(map(len, tokens[: k + 1]))] = k + 1
        out = []
        for a, b, kind in self.read([text])[0]:
            out.append((at[a], at[b + len(text[b:]) - len(text[b:].lstrip())], TYPES.index(kind)))
        return out

    def _scored(self, held: list) -> tuple:
        """Start, end, type and score of all spans that score above plain text, over the tokens of all parts in a row, and where the parts begin."""
        if len(self.row) > self.MOST_TOKENS:
            self._forget()
        get, add = self.row.get, self._add
        ids: list[int] = [0, 0, 0]
        begins = []
        for _, _, tokens in held:
            begins.append(len(ids))
            ids += [get(t) or add(t) for t in tokens]
            ids += (0, 0, 0)
        at = np.array(ids, dtype=np.int64)
        n = len(at)
        scores, facts = self.scores, self.facts
        kind = facts[at, 0]
        stops = np.concatenate(([0], np.cumsum(facts[at, 1])))
        counts = np.concatenate((np.zeros((1, len(COUNTS)), dtype=np.int64), np.cumsum(facts[at, 3:], axis=0)))
        # bits of the sentence around each token
        sentence = stops[:-1]
        around = np.zeros(int(stops[-1]) + 1, dtype=np.int64)
        flagged = np.flatnonzero(facts[at, 2])
        np.bitwise_or.at(around, sentence[flagged], facts[at[flagged], 2])
        around = around[sentence]
        found: list[tuple[np.ndarray, np.ndarray, int, np.ndarray]] = []
        before, after = np.roll(kind, 1), np.roll(kind, -1)
        for t in range(len(TYPES)):
            of = lambda role: scores[at, role, t]  # noqa: E731, B023
            bigram = self.pair[2, before, kind, t]
            total = np.concatenate(([0.0], np.cumsum((of(0) + bigram).astype(np.float64))))
            first = of(1) + np.roll(of(3), 1) + np.roll(of(4), 2) + np.roll(of(5), 3) + self.pair[0, before, kind, t] - bigram - total[:-1] + self.model.flags[around, t] + self.model.length[0, t] + self.best_counts[t] - MARGIN[t]
            last = of(2) + np.roll(of(6), -1) + np.roll(of(7), -2) + self.pair[1, kind, after, t] + total[1:]
            # no span begins or ends at the end of a sentence, or crosses it
            ending = facts[at, 1] > 0
            first[ending] = -1e9
            last[ending] = -1e9
            for l in range(1, LENGTHS[t] + 1):
                m = n - l + 1
                if m < 1:
                    break
                i = np.flatnonzero(first[:m] + last[l - 1 :] > -self.model.length[l, t])
                if not len(i):
                    continue
                i = i[stops[i + l] == stops[i]]
                s = first[i] + last[i + l - 1] + self.model.length[l, t] - self.best_counts[t]
                c = np.minimum(counts[i + l] - counts[i], COUNT_MOST)
                for q in range(len(COUNTS)):
                    s = s + self.model.counts[q, c[:, q], t]
                good = s > 0
                if good.any():
                    found.append((i[good], np.full(int(good.sum()), l), t, s[good]))
        if not found:
            return *[np.empty(0, dtype=np.int64)] * 4, begins
        start, length = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        return start, start + length, np.concatenate([np.full(len(f[0]), f[2]) for f in found]), np.concatenate([f[3] for f in found]), begins

    def _flush(self, held: list, out: list[list]) -> None:
        if not held:
            return
        start, stop, types, score, begins = self._scored(held)
        order = np.lexsort((types, start, stop))
        text = np.searchsorted(begins, start, side="right") - 1
        # the best segmentation: spans by their ends, at each end the best of what was and what a span adds
        order = order[np.argsort(text[order], kind="stable")]
        rows = list(zip(text[order].tolist(), start[order].tolist(), stop[order].tolist(), types[order].tolist(), score[order].tolist()))
        k = 0
        while k < len(rows):
            j = k
            while j < len(rows) and rows[j][0] == rows[k][0]:
                j += 1
            self._settle(rows[k:j], held[rows[k][0]], begins[rows[k][0]], out)
            k = j

    @staticmethod
    def _settle(spans: list[tuple], held: tuple, begin: int, out: list[list]) -> None:
        ends, values, back = [-1], [0.0], [None]
        for _, a, b, t, s in spans:
            lo, hi = 0, len(ends)
            while lo < hi:  # the last end that is not beyond a
                mid = (lo + hi) // 2
                if ends[mid] <= a:
                    lo = mid + 1
                else:
                    hi = mid
            value = values[lo - 1] + s
            if value > values[-1]:
                if ends[-1] == b:
                    values[-1], back[-1] = value, (a, b, t, lo - 1)
                else:
                    ends.append(b)
                    values.append(value)
                    back.append((a, b, t, lo - 1))
        chosen, k = [], len(back) - 1
        while k > 0:
            a, b, t, before = back[k]
            chosen.append((a - begin, b - begin, t))
            k = before
        if not chosen:
            return
        which, offset, tokens = held
        at, where = [0], 0
        for x in tokens:
            where += len(x)
            at.append(where)
        for a, b, t in reversed(chosen):
            out[which].append((offset + at[a], offset + at[b - 1] + len(tokens[b - 1].rstrip()), TYPES[t]))


def _parts(text: str) -> list[tuple[int, str]]:
    """text, or where it is very long its parts, cut after the end of a sentence, else after a blank, else where they are full."""
    if len(text) <= PART:
        return [(0, text)]
    out, at = [], 0
    while len(text) - at > PART:
        cut = max(text.rfind(x, at + PART // 2, at + PART) for x in (". ", "\n", "? ", "! ", "। "))
        if cut < 0:
            cut = text.rfind(" ", at + PART // 2, at + PART)
        cut = at + PART if cut < 0 else cut + 1
        out.append((at, text[at:cut]))
        at = cut
    out.append((at, text[at:]))
    return out


def gazetteer(known_names: DataFrame, most: int = 200_000) -> Gazetteer:
    """The names the desk knows, a short fixed list; most is the bound on what is sent to the executors, beyond which the names that come first by name_id count."""
    rows = known_names.select("name", "kind").where("name is not null").orderBy("name_id").limit(most).collect()
    return Gazetteer({r["name"].lower(): r["kind"] for r in rows})


def common_words(turns: DataFrame, share: int = COMMON_SHARE) -> frozenset[str]:
    """The words that stand in lower case at least seven times in ten, counted over both texts of all turns, and make up at least one word in share (thrice at least). So there are at most share of them, whatever the table."""
    texts = F.concat_ws("\n", *[F.col(f) for f in FIELDS])
    words = turns.select(F.explode(F.regexp_extract_all(texts, F.lit(r"\p{L}{3,30}"), F.lit(0))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).groupBy(F.lower("word").alias("low")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("word") == F.lower("word"), F.col("n")).otherwise(0)).alias("lower"))
    kept = counted.where("lower * 10 >= n * 7")
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    rows = kept.where(F.col("n") >= 3).select("low", "n", total.alias("total")).where(F.col("n") * share >= F.col("total")).select("low").collect()
    return frozenset(r[0] for r in rows)


def fit_model(names: dict[str, str], common: frozenset[str] = frozenset(), sentences: int = TRAINING_SENTENCES) -> SemiMarkov:
    """Fits the model to made-up sentences; names are listed ones, which fill half of the slots. common are words that the corpus writes in lower case."""
    return SemiMarkov(Lexicon(names, common)).fit(examples.rows(names, sentences))


def entities(texts: list[str | None], reader: Reader) -> list[list[tuple[int, int, str]]]:
    """(start, end, type) of the personal values of each text, in order; none for null and empty texts. Whole texts of any length are read."""
    once = dict.fromkeys(t or "" for t in texts)
    found = dict(zip(once, reader.read(list(once))))
    return [found[t or ""] for t in texts]


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """text with each span replaced by the placeholder of its type; all else is unchanged."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join(out) + text[at:]


def redacted(turns: DataFrame, model: SemiMarkov) -> DataFrame:
    """turns' id with both texts redacted and, for each, the sorted types that it held. Nulls stay null."""

    @F.pandas_udf("struct<text:string,types:array<string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader(model)
        for texts in batches:
            found = entities(list(texts), reader)
            yield pd.DataFrame({"text": [redact(t, e) for t, e in zip(texts, found)], "types": [sorted({k for _, _, k in e}) for e in found]})

    done = turns.select("id", *[run(F.col(f)).alias(f"__{f}") for f in FIELDS])
    return done.select("id", *[c for f in FIELDS for c in (F.col(f"__{f}.text").alias(f), F.col(f"__{f}.types").alias(f"{f}_types"))])


def found(turns: DataFrame, model: SemiMarkov) -> DataFrame:
    """(id, field, pii_type) for every text and type of which it holds a value."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(model)
        bit = {t: 1 << k for k, t in enumerate(TYPES)}
        for texts in batches:
            yield pd.Series([sum({bit[k] for _, _, k in e}) for e in entities(list(texts), reader)], dtype="int32")

    both = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])
    long = turns.select("id", F.explode(both).alias("f")).select("id", "f.field", "f.text").where(F.length("text") > 0)
    flagged = long.select("id", "field", run(F.col("text")).alias("bits")).where(F.col("bits") > 0)
    kinds = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(1 << k)) != 0, F.lit(t)) for k, t in enumerate(TYPES)]))
    return flagged.select("id", "field", F.explode(kinds).alias("pii_type"))
