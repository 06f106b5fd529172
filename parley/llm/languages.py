"""Problem 4: language of texts and of their segments, by segmentation-marginalised unigrams."""

from __future__ import annotations

import math
import os
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.tokens import TOKENIZER_DIR
from parley.llm.transcripts import _VOICED, _strip_marks

LANGUAGES = ("en", "de", "fr", "es", "pt", "hi")
#: Stands for all languages but these.
OTHER = "other"
#: The fixed public vocabulary; only its pieces are used, the probabilities are estimated here.
PIECES = "piece_bpe_32k.model"
#: At most so many labelled rows are read to estimate the piece probabilities, whatever the table holds.
SAMPLE_ROWS = 20_000
ROUNDS = 4
#: Log odds by which the recorded label speaks for itself when the sample's sentences are relabelled.
LABEL_BONUS = 5.0
#: Share of a word's occurrences that may stand under another language by mistake.
WRONG_LABELS = 0.04
_WORD = re.compile(r"[^\W\d_][\wऀ-ॿ']*|[ऀ-ॿ]+")
_BREAK = re.compile(r"[.!?।][\"'”»)\]]*\s+|\n+")
#: Shortened words whose full stop ends no sentence.
_SHORT = frozenset("mr mrs ms dr sr sra st no nr hr fr mme prof".split())
#: A sentence less certain than this takes the language of its neighbours.
SURE = 0.92
_MAY_HOLD_OTHER = re.compile(r"[@\[0-9]")
#: A run without blanks that holds a digit or @, from its begin, so that each is read once; names of notes; words in the group.
_OTHER_OR_WORD = re.compile(rf"(?<!\S)[^\s@\d]*+[@\d]\S*|\[\w+\]|({_WORD.pattern})")


@lru_cache(maxsize=2)
def pieces(path: str) -> frozenset[str]:
    """The pieces of the public vocabulary, in lower case; one beginning with the mark ▁ stands at the start of a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return frozenset(p.lower() for p in (model.id_to_piece(i) for i in range(model.get_piece_size())) if not (p.startswith("<") and p.endswith(">")))


@lru_cache(maxsize=2)
def longest_piece(path: str) -> int:
    return max(map(len, pieces(path)))


def default_path() -> str:
    return os.path.join(TOKENIZER_DIR, PIECES)


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of text. A full stop after an initial, a shortened title or another stop ends none."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        k = m.start()
        if text[k] == ".":
            j = k
            while j > at and k - j < 5 and text[j - 1].isalpha():
                j -= 1
            if text[k - 1 : k] == "." or (k - j == 1 or text[j:k].lower() in _SHORT) and (j == 0 or not text[j - 1].isalnum()):
                continue
        out.append((at, k if text[k] == "\n" else k + 1))
        at = m.end()
    out.append((at, len(text)))
    return out


class PieceModel:
    """Unigram probabilities of pieces for each language; a word's probability sums over all its segmentations.

    A character without a piece is one of its own. Words are independent given the language, so that the forward sum of a text is the product of those of its
    words, each of which is computed once and kept.
    """

    def __init__(self, path: str, languages: tuple[str, ...] = LANGUAGES) -> None:
        self.path, self.languages = path, languages
        self.table: dict[str, np.ndarray] = {}
        self.floor = np.full(len(languages), 1e-7)
        self.background: dict[tuple[int, bool], float] = {}
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.languages)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "rows": np.zeros((1024, len(self.languages)))}

    def _edges(self, word: str) -> list[list[tuple[int, str]]]:
        """For each end position the (start, piece) that reach it."""
        vocabulary = pieces(self.path)
        marked = "▁" + word
        n, longest = len(marked), longest_piece(self.path)
        out: list[list[tuple[int, str]]] = [[] for _ in range(n + 1)]
        for b in range(1, n + 1):
            for a in range(max(0, b - longest), b):
                piece = marked[a:b]
                if piece in vocabulary or b - a == 1:
                    out[b].append((a, piece))
        return out

    def fit(self, counts: dict[str, np.ndarray], rounds: int = ROUNDS, smoothing: float = 0.02) -> PieceModel:
        """Expectation-maximisation over all segmentations of the words; counts has the weight of each word in each language."""
        k = len(self.languages)
        lattice = {w: self._edges(w) for w in counts}
        start: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
        for w, c in counts.items():
            for edges in lattice[w]:
                for a, p in edges:
                    start[p] += c / len(w)
        self._set(start, smoothing)
        for _ in range(rounds):
            expected: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
            for w, c in counts.items():
                edges = lattice[w]
                n = len(edges) - 1
                f = np.zeros((n + 1, k))
                f[0] = 1
                for b in range(1, n + 1):
                    for a, p in edges[b]:
                        f[b] += f[a] * self.table[p]
                back = np.zeros((n + 1, k))
                back[n] = 1
                for b in range(n, 0, -1):
                    for a, p in edges[b]:
                        back[a] += back[b] * self.table[p]
                share = c / np.maximum(f[n], 1e-300)
                for b in range(1, n + 1):
                    for a, p in edges[b]:
                        expected[p] += share * f[a] * self.table[p] * back[b]
            self._set(expected, smoothing)
        self._forget()
        return self

    def _set(self, weights: dict[str, np.ndarray], smoothing: float) -> None:
        total = sum(weights.values(), np.zeros(len(self.languages))) + smoothing * (len(weights) + 1)
        self.table = {p: (v + smoothing) / total for p, v in weights.items()}
        self.floor = smoothing / total

    def word(self, word: str) -> np.ndarray:
        """Log probability of a word in each language: forward algorithm over its segmentations. Sums are scaled on the way, so that words of any length are read whole; of a long one only the sums within the reach of the longest piece are kept."""
        vocabulary, reach = pieces(self.path), longest_piece(self.path)
        marked = "▁" + word
        f = deque([np.ones(len(self.languages))], maxlen=reach)
        log = np.zeros(len(self.languages))
        for b in range(1, len(marked) + 1):
            total = np.zeros(len(self.languages))
            for k, before in enumerate(reversed(f)):
                piece = marked[b - 1 - k : b]
                if k == 0 or piece in vocabulary:
                    total += before * self.table.get(piece, self.floor)
            f.append(total)
            if b % 8 == 0:
                size = np.maximum(total, 1e-280)
                log += np.log(size)
                f = deque((x / size for x in f), maxlen=reach)
        return log + np.log(np.maximum(f[-1], 1e-300))

    def score(self, words: list[str]) -> list[float]:
        at = []
        for w in words:
            row = self.memo.get(w)
            if row is None:
                if len(self.memo) >= 300_000:
                    self._forget()
                    return self.score(words)
                row = self.memo[w] = len(self.memo)
                if row >= len(self.rows):
                    self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
                self.rows[row] = self.word(w)
            at.append(row)
        return self.rows[at].sum(axis=0).tolist()

    def calibrate(self, labelled: list[list[str]], share: float = 0.99, slack: float = 0.8) -> PieceModel:
        """Sets the background language, in which every character costs the same, for each language and script: what the characters of all but the oddest of the labelled sentences cost in their best language, and slack more."""
        costs: dict[tuple[int, bool], list[float]] = defaultdict(list)
        for words in labelled:
            n = sum(map(len, words))
            if n >= 20:
                s = self.score(words)
                costs[s.index(max(s)), latin(words)].append(-max(s) / n)
        self.background = {key: float(np.quantile(c, share)) + slack for key, c in costs.items() if len(c) >= 20}
        return self

    def best(self, words: list[str]) -> tuple[str, float]:
        """Language of the words and its posterior, tempered by their number, as words of one sentence are not independent. Where the background of the best language and script speaks louder it is OTHER; a script that the labelled sentences of that language are not written in has the least background of all."""
        s = self.score(words)
        top = max(s)
        k = s.index(top)
        cost = self.background.get((k, latin(words)), min(self.background.values(), default=math.inf))
        other = -cost * sum(map(len, words))
        cool = max(1.0, math.sqrt(len(words)))
        if other > top:
            return OTHER, 1 / (1 + sum(math.exp((x - other) / cool) for x in s))
        return self.languages[k], 1 / (sum(math.exp((x - top) / cool) for x in s) + math.exp((other - top) / cool))


def latin(words: list[str]) -> bool:
    return words[0][0] < "\u0250"


_SAME = bytes.maketrans(b"12345678", b"99999999")


def same_digits(text: str) -> str:
    """Which digits a text holds does not matter here; texts that differ in them alone are judged once."""
    return text.encode("utf-8", "surrogatepass").translate(_SAME).decode("utf-8", "surrogatepass")


def words_of(sentence: str) -> list[str]:
    """Words of a sentence in lower case, without numbers, addresses and, where the rest tells enough, capitalised names inside it; none for hesitations alone."""
    if _MAY_HOLD_OTHER.search(sentence):
        words = [w for w in _OTHER_OR_WORD.findall(sentence) if w]
    else:
        words = _WORD.findall(sentence)
    if len(words) <= 4:
        words = [w for w in words if not _VOICED.fullmatch(w)]
    if not words:
        return []
    low = [w.lower() for w in words]
    plain = [low[0], *[x for w, x in zip(words[1:], low[1:]) if w[0] == x[0]]]
    return plain if len(plain) >= 4 else low


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence that has any."""
    return [w for w in (words_of(text[a:b]) for a, b in sentence_spans(text)) if w]


def normal_label(label: Column) -> Column:
    """A recorded tag in lower case without region and blanks; empty where absent."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(label)), "[-_].*$", ""), F.lit(""))


def fit_model(turns: DataFrame, rows: int = SAMPLE_ROWS, path: str | None = None) -> PieceModel:
    """Estimates the model from a bounded hash sample of labelled rows, then once more after relabelling each sentence, as some labels are wrong and some texts are mixed."""
    share = max(1, -(-turns.count() // rows))
    tag = normal_label(F.col("metadata")["lang"])
    picked = turns.where(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(share)) == 0).select(tag.alias("lang"), "raw_text").where(tag.isin(*LANGUAGES)).limit(2 * rows).collect()
    model = PieceModel(path or default_path())
    index = {lang: k for k, lang in enumerate(LANGUAGES)}
    labelled = [(index[r[0]], s) for r in picked if r[1] for s in sentences(_strip_marks(r[1])[0])]
    for step in range(2):
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
        for lang, words in labelled:
            for w in words:
                counts[w][lang] += 1
        # a word's few occurrences under a language are put down to wrong labels where it is at home in another
        kept = {w: np.maximum(c - WRONG_LABELS * c.sum(), 0) for w, c in counts.items()}
        model = PieceModel(model.path).fit(kept)
        if step == 0:
            labelled = [(int(np.argmax([x + LABEL_BONUS * (k == lang) for k, x in enumerate(model.score(words))])), words) for lang, words in labelled]
    return model.calibrate([words for _, words in labelled])


def segments(text: str | None, model: PieceModel, memo: dict | None = None) -> list[tuple[str, float, int]]:
    """(language or OTHER, confidence, sentences) of each run of sentences in one language, in order; none for null and blank texts, hesitations and notes. memo keeps what was found for a sentence, and for the words of one, as sentences often differ in names and numbers alone."""
    if not text:
        return []
    scored = []
    plain = _strip_marks(same_digits(text))[0]
    for a, b in sentence_spans(plain):
        part = plain[a:b]
        if memo is not None and part in memo:
            found = memo[part]
        else:
            words = words_of(part)
            # a key of words begins with a line feed, which no sentence does: it would have ended the one before
            key = "\n" + " ".join(words)
            if memo is not None and key in memo:
                found = memo[key]
            else:
                found = model.best(words) if len(words) > 1 or (words and len(words[0]) > 3) else None
                if memo is not None and len(memo) < 200_000:
                    memo[key] = found
            if memo is not None and len(memo) < 200_000:
                memo[part] = found
        if found is not None:
            scored.append(found)
    if len(scored) == 1:
        return [(*scored[0], 1)]
    sure = [k for k, (_, c) in enumerate(scored) if c >= SURE]
    out: list[list] = []
    for k, (lang, c) in enumerate(scored):
        if c < SURE and sure:
            lang = scored[min(sure, key=lambda i: (abs(i - k), i))][0]
        if out and out[-1][0] == lang:
            out[-1][1] += c
            out[-1][2] += 1
        else:
            out.append([lang, c, 1])
    return [(lang, c / n, n) for lang, c, n in out]


FIELDS = {"raw_text": "lang", "translated_text": "translated_lang"}


def with_languages(turns: DataFrame, model: PieceModel) -> DataFrame:
    """(id, field, label, segments) for both texts of each turn: segments array<struct<lang, confidence, sentences>>, empty where there is no sentence."""

    @F.pandas_udf("array<struct<lang:string,confidence:double,sentences:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict = {}
        whole: dict = {}
        for texts in batches:
            out = []
            for t in texts:
                t = same_digits(t)
                row = whole.get(t)
                if row is None:
                    row = [{"lang": a, "confidence": round(b, 4), "sentences": n} for a, b, n in segments(t, model, memo)]
                    if len(whole) < 50_000:
                        whole[t] = row
                out.append(row)
            yield pd.Series(out)

    both = F.array(*[F.struct(F.lit(f).alias("field"), F.col("metadata")[tag].alias("label"), F.col(f).alias("text")) for f, tag in FIELDS.items()])
    long = turns.select("id", F.explode(both).alias("f")).select("id", "f.field", "f.label", "f.text").where(F.col("text").isNotNull())
    return long.select("id", "field", "label", run(F.col("text")).alias("segments"))


def found(turns: DataFrame, model: PieceModel) -> DataFrame:
    """(id, field, lang): every language of the fields whose label is absent, blank, another than the text's, or one while the text has several. Texts without a sentence in one of LANGUAGES have no rows."""
    lang = with_languages(turns, model).withColumn("langs", F.array_remove(F.array_distinct(F.transform("segments", lambda s: s["lang"])), OTHER))
    wrong = (F.size("langs") > 1) | (normal_label(F.col("label")) != F.element_at("langs", 1))
    return lang.where(F.size("langs") > 0).where(wrong).select("id", "field", F.explode("langs").alias("lang"))
