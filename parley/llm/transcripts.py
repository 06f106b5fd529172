"""Problem 2: speech transcripts into clean, ordered speaker turns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.speakers import ASSISTANT_NAMES, CUSTOMER_ALSO, CUSTOMER_NAMES, FOUR_NAMES, WORKER_ALSO, WORKER_NAMES, clean_speaker_role, epoch_seconds, session_key
from parley.llm.boosting import Boosted
from parley.operators.ordered import blocked_lag, blocked_running_sum
from parley.session import cut

#: At most so many rows are read to fit the two classifiers, whatever the table holds.
SAMPLE_ROWS = 20_000
#: Turns of one session are ordered in blocks of so many seconds.
BLOCK_SECONDS = 6 * 3600
KINDS = ("timestamp", "filler", "sound", "label", "speaker")

_CLOCK = r"\d{1,2}(?::\d{2}){1,2}(?:[.,]\d{1,3})?"
_TIME = re.compile(
    rf"\[\s*{_CLOCK}\s*\]|\(\s*{_CLOCK}\s*\)|\{{\s*{_CLOCK}\s*\}}|<\s*{_CLOCK}\s*>|<\s*t\s*=\s*[\d.:]+\s*>|@\d{{1,3}}m\d{{1,2}}s\b|@\d{{1,2}}h\d{{1,2}}m\d{{1,2}}s\b"
    rf"|\b{_CLOCK}\s*-->(?:\s*{_CLOCK})?|^\s*\d{{1,2}}:\d{{2}}:\d{{2}}(?:[.,]\d{{1,3}})?(?=\s*(?:,|-|\s|$))\s*[,-]?|(?<=[.!?।]\s)\d{{2}}:\d{{2}}:\d{{2}}\s*,"
)
_ROLE = "|".join(sorted(map(re.escape, (*CUSTOMER_NAMES, *CUSTOMER_ALSO, *WORKER_NAMES, *WORKER_ALSO, *ASSISTANT_NAMES, "unknown", "interviewer", "host", "moderator", "bot")), key=len, reverse=True)) + r"|(?:speaker|sprecher|spk|locuteur|hablante|falante|channel)[ _-]{0,2}\d{1,2}"
_LABEL = re.compile(
    rf"\[\s*(?P<a>{_ROLE})\s*:?\s*\]:?|\(\s*(?P<b>{_ROLE})\s*:?\s*\):?|<\s*v\s+(?P<c>[^<>]{{1,40}})>|\{{\s*(?P<d>{_ROLE})\s*\}}|(?<![\w@.-])(?P<e>{_ROLE})\s*(?:>>|:(?=\s|$))|(?:^|(?<=[.!?।]\s))\s*(?P<f>[^\W\d_][\w'-]*(?: [^\W\d_][\w'-]*){{0,2}})\s*>>|(?:^|(?<=[.!?।]\s))\s*(?P<g>{_ROLE})\s+[-–]\s|</v>",
    re.I,
)
#: Every label holds one of these, which are looked for in a fraction of the time.
_LABEL_SIGN = re.compile(r"[\[({<]|>>|:(?=\s|$)|[-–]\s")
#: Names of no known role that may mark who talks: up to three words with capitals before a colon, arrow or dash, or in brackets; the model of marks decides.
_MAYBE = re.compile(
    r"(?:^|(?<=[.!?।…]\s)|(?<=[.!?।…]\s\s))\s*(?:[\[(<{]\s*(?P<p>[^\W\d_][\w.'’-]{0,19}(?: [^\W_][\w.'’-]{0,19}){0,2})\s*:?\s*[\])>}]:?|(?P<q>[^\W\d_][\w.'’-]{0,19}(?: [^\W_][\w.'’-]{0,19}){0,2})\s*(?::(?=\s|$)|>>|[-–](?=\s)))"
)
#: Words of which a bracketed note on what was heard is made.
_HEARD = (
    r"nois|geräusch|bruit|ru[ií]do|rausch|music|musik|musique|música|laugh|lach|lacht|rire|risa|riso|sigh|seufz|soupir|suspir|cough|hust|tous|tos|silen|stille|pau[sz]|inaudi|unclear|unverständlich|incompr|beep|piep|breath|atm|crosstalk|static|"
    r"bark|bell|ring|applau|click|chuckl|giggl|snort|groan|gasp|whisper|yawn|sob|cries|crying|cheer|hum(?:s|ming)|kicher|stöhn|flüster|gähn|ricane|sanglot|murmure|susurr|bostez|chora|llora|clears? throat|throat|sniff|typing|hold|phone|door|background|शोर|हँसी|खाँसी|संगीत|मौन|चुप्पी"
)
_NOTE = re.compile(rf"\(\([^()]*\)\)|\[(?:[^\[\]]*?(?:{_HEARD})[^\[\]]*)\]|\((?:[^()]{{0,18}}?(?:{_HEARD})[^()]{{0,18}})\)|<(?:[^<>]*?(?:{_HEARD})[^<>]*)>|\*[^*\n]{{2,30}}\*|\{{[^{{}}]*?(?:{_HEARD})[^{{}}]*\}}|--\s*(?:{_HEARD})\w*\s*--|[♪♫♬]+", re.I)
_PHRASE = re.compile(r"(?:^\s*|(?<=[.!?।…]\s)\s*|(?<=,\s))(?:you\s+know|i\s+mean|o\s+sea|weißt\s+du|tu\s+sais|tu\s+vois|quer\s+dizer|sag\s+ich\s+mal)\s*(?:,|\.{3}|…)\s*|,\s*(?:you\s+know|i\s+mean|o\s+sea|weißt\s+du|tu\s+sais|tu\s+vois|quer\s+dizer)\s*(?=[.!?।]|$)", re.I)
_MARKS = re.compile(r"[\[\](){}<>*@♪♫♬]|--|>>|:| [-–] ")
#: Sounds of hesitation look like this: one vowel drawn out, breath and hum, nothing else.
_SOUND = r"u+h+m*|u+m+|e+h+m*|e+r+m*|e+m+|a+h+m*|aa+h*|ä+h+m*|ö+h+m*|ü+h+m*|ã+h+|h+ã+|h+m+|h+u+m+|mm+|m+[- ]?h+m+|h*eu+h*|h+e+u+|h+e+i+n+|ह+म्+म+|उम्+म?्?म?|अं+|अह+म*"
_VOICED = re.compile(rf"(?:^|(?<=\s))[^\w\s]*(?P<form>{_SOUND})[^\w\s]*(?=\s|$)", re.I)
HESITATION = re.compile(_SOUND, re.I)
_SPOKEN = re.compile(r"[^\W_]")
_SENTENCE = re.compile(r"[.!?।]+(?=\s)")
_WORDS = re.compile(r"[^\W\d_]+")
_STOP = {
    w: lang
    for lang, words in {
        "en": "the is are was of and to my this that with for have has from not you it i in on when a he said be by before",
        "de": "der die das und ist ich nicht mir wie den dem auf mit von hat noch heute sich um für wenn sie vom am zu",
        "fr": "le la les est que vous mon une pas pour sur avec je du des au en de et cette un",
        "es": "el los que del mi con por una hoy lo y las se para no sin de en un la si cuando",
        "pt": "o os que do da meu com por uma hoje não para em um no na e de se ao dos quando",
        "hi": "hai mein ka ki ke ko se kya main aap nahin aur yeh par है में का की के को से क्या मैं आप नहीं और यह पर",
    }.items()
    for w in words.split()
    if w not in {"um", "a", "de", "en", "que", "un", "la", "se", "no", "in", "e", "o", "y", "con", "par"}
}


def sentence_language(words: list[str]) -> str:
    """A quick vote of function words; enough to tell a hesitation from a word of another language."""
    votes = Counter(_STOP[w] for w in words if w in _STOP)
    return votes.most_common(1)[0][0] if votes else ""


_DRAWN = re.compile(r"(.)\1+")


def _occurrences(text: str) -> list[tuple[str, str, bool, int, int]]:
    """Candidate hesitations of text: (form without drawn-out letters, language around it, marked off, start, end). Marked off: between dots, before a comma, or alone in its sentence."""
    found = list(_VOICED.finditer(text))
    if not found:
        return []
    ends = [m.end() for m in _SENTENCE.finditer(text) if not text.startswith("...", m.start())]
    out, languages = [], {}
    for m in found:
        a = max((e for e in ends if e <= m.start()), default=0)
        b = min((e for e in ends if e >= m.end()), default=len(text))
        form = m["form"].lower()
        around = text[a : m.start()] + " " + text[m.end() : b]
        if (a, form) not in languages:
            languages[a, form] = sentence_language([w for w in _WORDS.findall(around.lower()) if w != form])
        marked = "..." in m[0] or "…" in m[0] or m[0].endswith(",") or not _WORDS.search(around)
        out.append((_DRAWN.sub(r"\1", form), languages[a, form], marked, m.start(), m.end()))
    return out


class FillerModel:
    """Token-level decision between a hesitation and a word of the same form, for each form and language.

    Every (form, language) is a mixture: hesitations are marked off by dots or commas at one rate, words at another. Expectation-maximisation over the counts of all turns
    gives both rates and the share of hesitations of each form, with one prior for all. A form unseen, as a new one may be, gets the prior.
    """

    def __init__(self) -> None:
        self.share: dict[tuple[str, str], float] = {}
        self.marked, self.plain, self.prior = 0.6, 0.03, 0.8

    def fit(self, seen: dict[tuple[str, str], list[int]]) -> FillerModel:
        """seen has, for each form and language, how often it stands unmarked and marked off."""
        share = dict.fromkeys(seen, 0.5)
        for _ in range(25):
            hes = [1e-3, 1e-3]
            word = [1e-3, 1e-3]
            for key, (plain, marked) in seen.items():
                # all occurrences of one form in one language are of one kind, for the most part
                odds = np.log(share[key] / (1 - share[key])) + marked * np.log(self.marked / self.plain) + plain * np.log((1 - self.marked) / (1 - self.plain))
                p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
                for k, n in ((0, plain), (1, marked)):
                    hes[k] += p * n
                    word[k] += (1 - p) * n
                self.share[key] = float(p)
            self.marked = min(max(hes[1] / sum(hes), 0.2), 0.95)
            self.plain = min(max(word[1] / sum(word), 0.005), 0.15)
        return self

    def is_filler(self, form: str, lang: str, marked: bool) -> bool:
        p = self.share.get((form, lang))
        if p is None:
            p = self.prior if lang else 0.9
        p = min(max(p, 1e-4), 1 - 1e-4)
        odds = p / (1 - p) * (self.marked / self.plain if marked else (1 - self.marked) / (1 - self.plain))
        return odds > 1


def _strip_marks(text: str, marks: MarkModel | None = None) -> tuple[str, bool, bool, list[tuple[int, str]]]:
    """Text without time marks, notes and labels; whether it had time marks, notes; and the labels with their places in the new text. Names of no known role are labels where the model of marks says so."""
    if not _MARKS.search(text):
        return text, False, False, []
    plain, n_time = _TIME.subn(" ", text)
    plain, n_note = _NOTE.subn(" ", plain)
    found = [(m.start(), m.end(), next((g for g in m.groups() if g), "")) for m in _LABEL.finditer(plain)] if _LABEL_SIGN.search(plain) else []
    if marks is not None:
        found = sorted(found + [(m.start(), m.end(), m["p"] or m["q"]) for m in marks.accepted(plain, found)])
    labels: list[tuple[int, str]] = []
    out, at, size = [], 0, 0
    for a, b, name in found:
        out.append(plain[at:a])
        size += a - at
        labels.append((size, name))
        at = b
    if labels:
        plain = "".join(out) + plain[at:]
    return plain, n_time > 0, n_note > 0, labels


def _mark_features(text: str, a: int, b: int, name: str, others: int) -> list[float]:
    """How a mark looks and stands, without what the name says: kind of mark, place, case, length, gap to the text after it, what follows, and how many more marks the text has."""
    mark, after = text[a:b], text[b:].lstrip()
    return [
        "[" in mark or "(" in mark or "<" in mark or "{" in mark, ":" in mark, ">>" in mark, mark.rstrip().endswith(("-", "–")), not text[:a].strip(), name.isupper(), name.istitle(), name.count(" "), len(name), any(c.isdigit() for c in name),
        after[:1].isupper(), after[:1].islower(), after[:1].isdigit(), min(others, 4), after.find(".") if "." in after[:80] else 80, len(text) - len(after) < 4,
    ]


class MarkModel:
    """Whether a new segment, with another one talking, begins at a mark: boosted trees over how the mark looks and stands. What it is trained on are marks whose names are known roles against those whose names are common words of the corpus in lower case; the names themselves are hidden from it."""

    def __init__(self, boosted: Boosted, threshold: float = 0.5) -> None:
        self.boosted, self.threshold = boosted, threshold

    def accepted(self, text: str, known: list[tuple[int, int, str]]) -> list[re.Match]:
        maybe = [m for m in _MAYBE.finditer(text) if not any(m.start() < y and x < m.end() for x, y, _ in known)]
        if not maybe:
            return []
        rows = [_mark_features(text, m.start(), m.end(), m["p"] or m["q"], len(maybe) + len(known) - 1) for m in maybe]
        return [m for m, p in zip(maybe, self.boosted.predict(np.array(rows, dtype=float))) if p >= self.threshold]


def _tidy(text: str) -> str:
    text = re.sub(r"\s+", " ", text).strip()
    return re.sub(r"^[,;.…\s]+(?=\w)|\s+([,.!?;।])", r"\1", text)


def analyse(text: str | None, model: Models, want_segments: bool = True) -> tuple[int, list[tuple[str, str]], bool]:
    """Bits of the kinds found (timestamp 1, filler 2, sound 4, label 8), the labelled segments of clean text, and whether a word is spoken. Nothing for null."""
    if not text:
        return 0, [], False
    plain, time, note, labels = _strip_marks(text, model.marks)
    bits = time + 4 * note + 8 * bool(labels)
    drop = [m.span() for m in _PHRASE.finditer(plain)] if "," in plain or ".." in plain or "…" in plain else []
    drop += [(a, b) for form, lang, marked, a, b in _occurrences(plain) if model.fillers.is_filler(form, lang, marked)]
    bits += 2 * bool(drop)
    if not want_segments and not drop:
        return bits, [], bool(_SPOKEN.search(plain))
    cuts = [0, *(p for p, _ in labels), len(plain)]
    names = ["", *(n for _, n in labels)]
    segments, drop = [], sorted(drop)
    for a, b, name in zip(cuts, cuts[1:], names):
        piece, at = [], a
        for x, y in drop:
            if a <= x < b and x >= at:
                piece.append(plain[at:x])
                at = min(y, b)
        piece.append(plain[at:b])
        clean = " ".join(piece)
        if _SPOKEN.search(clean):
            segments.append((name, _tidy(clean) if want_segments else ""))
    return bits, segments, bool(segments)


@dataclass
class Models:
    """What is fitted before texts are read."""

    fillers: FillerModel
    marks: MarkModel | None = None


#: Texts with a candidate hesitation, told on the JVM.
_MAY_HESITATE = "(?iU)" + _VOICED.pattern.replace("(?P<form>", "(?:")


def fit_fillers(turns: DataFrame, text: str = "raw_text") -> FillerModel:
    """Fits the filler model to counts over all turns; one row for each form and language comes to the driver, and forms have no drawn-out letters, so that they are few."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for frame in frames:
            for t in frame["__text"]:
                seen.update(x[:3] for x in _occurrences(_strip_marks(t)[0]))
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["form", "lang", "marked", "n"])

    texts = turns.select(F.col(text).alias("__text")).where(F.col("__text").rlike(_MAY_HESITATE))
    rows = texts.mapInPandas(count, "form string, lang string, marked boolean, n long").groupBy("form", "lang", "marked").agg(F.sum("n").alias("n")).collect()
    seen: dict[tuple[str, str], list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["form"], r["lang"], r["marked"])):
        seen.setdefault((r["form"], r["lang"]), [0, 0])[r["marked"]] += r["n"]
    return FillerModel().fit(seen)


def fit_marks(turns: DataFrame, text: str = "raw_text", rows: int = SAMPLE_ROWS) -> MarkModel:
    """Trains the model of marks on a hash sample of at most rows texts with a mark. A name counts as a label if it is a known role, as none if it is a word that the sampled texts also write in lower case; other names teach nothing."""
    marked = turns.select(F.col(text).alias("t"), F.xxhash64(text).alias("h")).where(F.col("t").rlike(r"[:>\]\)\}]|\s[-–]\s"))
    share = max(1, -(-marked.count() // rows))
    texts = [r[0] for r in marked.where(F.pmod("h", F.lit(share)) == 0).orderBy("h", "t").limit(2 * rows).collect()]
    plain = [_NOTE.sub(" ", _TIME.sub(" ", t)) for t in texts]
    lower = {w for t in plain for w in _WORDS.findall(t) if w.islower()}
    x, y = [], []
    for t in plain:
        known = [(m.start(), m.end(), next((g for g in m.groups() if g), "")) for m in _LABEL.finditer(t)]
        maybe = [(m.start(), m.end(), m["p"] or m["q"]) for m in _MAYBE.finditer(t) if not any(m.start() < b and a < m.end() for a, b, _ in known)]
        for target, found in ((1, known), (0, [m for m in maybe if m[2].split()[0].lower() in lower])):
            for a, b, name in found:
                x.append(_mark_features(t, a, b, name, len(known) + len(maybe) - 1))
                y.append(target)
    return MarkModel(Boosted().fit(np.array(x, dtype=float).reshape(len(x), 16), np.array(y, dtype=float)))


def fit_models(turns: DataFrame) -> Models:
    return Models(fit_fillers(turns), fit_marks(turns))


def segmented(rows: DataFrame, model: Models, text: str) -> DataFrame:
    """The columns of rows without text, once for every clean segment of it, with part (from 0), label and segment. Texts without a word have none."""
    kept = [f for f in rows.schema.fields if f.name != text]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            where, part, label, clean = [], [], [], []
            for k, t in enumerate(frame[text]):
                for n, (name, piece) in enumerate(analyse(t, model)[1]):
                    where.append(k)
                    part.append(n)
                    label.append(name)
                    clean.append(piece)
            out = frame[[f.name for f in kept]].iloc[where].reset_index(drop=True)
            yield out.assign(part=np.array(part, dtype=np.int32), label=pd.Series(label, dtype=object), segment=pd.Series(clean, dtype=object))

    return rows.mapInPandas(run, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kept], "part int", "label string", "segment string"]))


def with_bits(turns: DataFrame, model: Models, text: str = "raw_text") -> DataFrame:
    """Adds bits alone, plus 16 where a word is spoken."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, int] = {}
        for texts in batches:
            out = []
            for t in texts:
                bits = memo.get(t)
                if bits is None:
                    marks, _, spoken = analyse(t, model, want_segments=False)
                    bits = marks + 16 * spoken
                    if len(memo) < 50_000:
                        memo[t] = bits
                out.append(bits)
            yield pd.Series(out, dtype="int32")

    return turns.withColumn("bits", run(F.col(text)))


def found(turns: DataFrame, model: Models) -> DataFrame:
    """(id, kind) for every turn and kind of dirt that the operator meets; null and empty texts have none, except that of their speaker. Labels are the marks at which the segments of a text begin: known roles, and other names where the boosted model puts a boundary."""
    flagged = with_bits(turns.select("id", "speaker", "raw_text"), model)
    bit = F.col("bits")
    kinds = F.array_compact(
        F.array(
            *[F.when(bit.bitwiseAND(F.lit(1 << k)) != 0, F.lit(kind)) for k, kind in enumerate(KINDS[:4])],
            F.when(F.coalesce(F.col("speaker"), F.lit("")).isin(*FOUR_NAMES), F.lit(None)).otherwise(F.lit("speaker")),
        )
    )
    return flagged.select("id", F.explode(kinds).alias("kind"))


#: What the boundary model sees of each segment and the one before.
FEATURES = ("same", "gap", "within", "size", "prev_size", "prev_asks", "asks", "prev_ends", "small_first")


def fit_boundaries(pairs: DataFrame, rows: int = SAMPLE_ROWS) -> Boosted:
    """Trains on a hash sample of at most rows pairs of adjacent segments, both with a label marked in their texts. The target is whether these labels name different roles; they are hidden from the features, which see the speakers that the rows record, the gap and the context."""
    known = pairs.where("has_prev and marked_role <> 'Unknown' and prev_marked_role <> 'Unknown'").select("id", "part", *FEATURES, (F.col("marked_role") != F.col("prev_marked_role")).cast("double").alias("target"))
    known = cut(known)
    share = max(1, -(-known.count() // rows))
    frame = known.where(F.pmod(F.xxhash64("id", "part"), F.lit(share)) == 0).limit(2 * rows).toPandas().sort_values(["id", "part"], kind="stable")
    return Boosted().fit(frame[list(FEATURES)].to_numpy(dtype=float).reshape(len(frame), len(FEATURES)), frame["target"].to_numpy(dtype=float))


def segments_in_order(turns: DataFrame, model: Models) -> DataFrame:
    """Clean segments (session, block, time, id, part, role, marked_role, text) with FEATURES over each and the segment before it in the session, and has_prev.

    A turn sent again under a new id (same trace_id, else none) counts once, under its lowest id. Null times sort first. Segments without a word are dropped. Of the segment before only a few numbers are carried, never its text.
    """
    trace = F.coalesce(F.nullif(F.col("metadata")["trace_id"], F.lit("")), F.concat(F.lit("id:"), F.col("id").cast("string")))
    first = turns.select("id", "session_id", "speaker", "raw_text", "ts", trace.alias("__trace"))
    # a trace is one record; its copies are few
    first = first.withColumn("__session", session_key(F.col("session_id"))).groupBy("__session", "__trace").agg(F.min_by(F.struct("id", "speaker", "raw_text", "ts"), "id").alias("r")).select(F.col("__session").alias("session"), "r.*")
    time = F.coalesce(epoch_seconds(F.col("ts")), F.lit(0.0))
    rows = first.select("session", F.floor(time / BLOCK_SECONDS).alias("block"), time.alias("time"), "id", clean_speaker_role(F.col("speaker")).alias("row_role"), "raw_text")
    label_role = F.when(F.col("label") != "", clean_speaker_role(F.col("label"))).otherwise("Unknown")
    parts = segmented(rows, model, "raw_text")
    ends, first_char = F.substring(F.rtrim("segment"), -1, 1), F.substring("segment", 1, 1)
    parts = parts.select(
        "session", "block", "time", "id", "part", "row_role", label_role.alias("marked_role"), F.col("segment").alias("text"), F.length("segment").alias("size"), ends.isin("?").cast("int").alias("asks"), ends.isin(".", "!", "?", "।").cast("int").alias("ends"),
        ((first_char == F.lower(first_char)) & (first_char != F.upper(first_char))).cast("int").alias("small_first"),
    )
    # both sides of the lag, training and scoring read the segments
    parts = cut(parts)
    seen = blocked_lag(parts, ["session"], "block", ["time", "id", "part"], F.struct("id", "time", "row_role", "marked_role", "size", "asks", "ends"), "prev")
    known = (F.col("row_role") != "Unknown") & (F.col("prev.row_role") != "Unknown")
    return seen.withColumns(
        {
            "has_prev": F.col("prev").isNotNull(), "prev_marked_role": F.coalesce("prev.marked_role", F.lit("Unknown")), "same": F.when(known, F.when(F.col("row_role") == F.col("prev.row_role"), 1).otherwise(-1)).otherwise(0),
            "gap": F.log1p(F.least(F.greatest(F.coalesce(F.col("time") - F.col("prev.time"), F.lit(0.0)), F.lit(0.0)), F.lit(1e6))), "within": F.coalesce(F.col("prev.id") == F.col("id"), F.lit(False)).cast("int"),
            "prev_size": F.coalesce("prev.size", F.lit(0)), "prev_asks": F.coalesce("prev.asks", F.lit(0)), "prev_ends": F.coalesce("prev.ends", F.lit(0)),
            "role": F.when(F.col("marked_role") != "Unknown", F.col("marked_role")).otherwise(F.col("row_role")), "prev_role": F.coalesce(F.nullif("prev.marked_role", F.lit("Unknown")), "prev.row_role", F.lit("Unknown")),
        }
    ).drop("prev")


def clean_turns(segments: DataFrame, boundaries: Boosted, threshold: float = 0.5) -> DataFrame:
    """(session, turn_no, part_no, speaker, text, started_at, ended_at, n_segments, first_id): adjacent segments without a boundary between them make one turn, in order of time.

    A boundary lies where two known roles differ, and elsewhere where the boosted trees say so. The speaker of a turn is the first known one among its segments, else Unknown. A turn that runs through several
    blocks of time comes out as so many ordered parts (part_no from 0), so that no row and no task holds more than the segments of one block.
    """

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(boundaries.predict(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

    differ = (F.col("role") != "Unknown") & (F.col("prev_role") != "Unknown") & (F.col("role") != F.col("prev_role"))
    starts = segments.withColumn("start", F.when(~F.col("has_prev") | differ | (score(*FEATURES) >= threshold), 1).otherwise(0)).select("session", "block", "time", "id", "part", "role", "text", "start")
    numbered = blocked_running_sum(starts, ["session"], "block", ["time", "id", "part"], F.col("start"), "turn_no")
    known = F.when(F.col("role") != "Unknown", F.col("role"))
    place = F.struct("time", "id", "part")
    parts = numbered.groupBy("session", "block", "turn_no").agg(
        F.min(F.when(known.isNotNull(), F.struct("time", "id", "part", "role"))).alias("first_known"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("time", "id", "part", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.min("time").alias("started_at"), F.max("time").alias("ended_at"), F.count(F.lit(1)).alias("n_segments"), F.min("id").alias("first_id"),
    )
    # few turns lie in several blocks: only their small rows meet
    several = cut(parts.select("session", "turn_no", "block", "first_known").groupBy("session", "turn_no").agg(F.min("first_known").alias("known"), F.array_sort(F.collect_list("block")).alias("blocks")).where(F.size("blocks") > 1))
    joined = parts.join(several, ["session", "turn_no"], "left")
    part_no = F.coalesce(F.array_position("blocks", F.col("block")) - 1, F.lit(0)).cast("int")
    return joined.select("session", "turn_no", part_no.alias("part_no"), F.coalesce("known.role", "first_known.role", F.lit("Unknown")).alias("speaker"), "text", "started_at", "ended_at", "n_segments", "first_id")
