"""Problem 7: repair text from scanned pages into continuous paragraphs, with windows and corpus statistics.

A chunk is one row throughout. Its lines are looked at within the row's partition; only counts (of header keys, words and pairs of words) and the few findings are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.ordered import made_once

KINDS = ("hyphen", "chars", "header", "page_number")
# Glyphs that scanners take for one another, each brought to one form; longer ones first.
CONFUSED_RUNS = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("li", "h"), ("ii", "u"))
#: A form must be so many times rarer than the one it is taken for; less if it mixes letters with digits or signs.
RARER, RARER_MIXED = 8, 2
#: Longest line that may be a header, in characters, and longest that may be a page number.
HEADER_CHARS, NUMBER_CHARS = 100, 28
_NUMBER = r"\d{1,4}"
_PAGE = (
    rf"^(?:[-–—~•]\s*({_NUMBER})\s*[-–—~•]|[\[(<]\s*({_NUMBER})\s*[\])>]|(?:p|pg|page|seite|página|pagina|pág|folio|s)\.?\s*({_NUMBER})(?:\s*(?:of|/|von|de|sur|out of)\s*\d+)?|({_NUMBER})(?:\s*/\s*\d+)?)$"
)
#: A capital first, or a sign that a scanner may take for one before small letters.
_HEADERLIKE = r"^[^\p{L}]*(?:\p{Lu}|[|$!†€0-9]\p{Ll}{2})"
_FIGURES = r"^[\d.,%₹$€\s]+$"
_TOKEN = r"[\p{L}\p{M}\p{Nd}†|$€]+(?:[-'’][\p{L}\p{M}\p{Nd}†|$€]+)*"


def skeleton(word: Column, runs=CONFUSED_RUNS) -> Column:
    """The word with all confusable glyphs in one form, in lower case; two readings of one word have the same skeleton."""
    out = F.lower(word)
    out = F.translate(out, "01|!5$8†€", "olllssbte")
    for a, b in runs:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, "lce", "iee")


@dataclass
class Scanned:
    """What the steps over one table of chunks come to."""

    reflowed: DataFrame  # chunk_id, text, hyphens, header, page_number, tokens
    fixes: DataFrame  # chunk_id, bad, good


def read_lines(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, page_start, page_end, pos, t): the lines of each chunk, blanks squeezed; a chunk given twice counts once. Null texts have no lines. A chunk without doc_id belongs to its document_id where the table has one, else it stands alone."""
    fields = ["doc_id", *[c for c in ("document_id",) if c in chunks.columns], "text", "page_start", "page_end"]
    once = chunks.groupBy("chunk_id").agg(F.min_by(F.struct(*fields), F.struct("text", "page_start", "page_end", *fields)).alias("c")).select("chunk_id", "c.*")
    document = F.coalesce(*[F.nullif(c, F.lit("")) for c in fields[:-3]], F.concat(F.lit("chunk "), "chunk_id"))
    squeezed = F.transform(F.split("text", "\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return once.where(F.col("text").isNotNull()).select("chunk_id", document.alias("doc_id"), "page_start", "page_end", F.posexplode(squeezed).alias("pos", "t"))


def candidates(lines: DataFrame) -> DataFrame:
    """One row per chunk: chunk_id, doc_id, page_start, page_end and lines, an array of (pos, t, number, beside, key, title) in order.

    number tells that the line is a page number by itself: it stands alone in one of the usual forms, within the pages of the chunk where these are known. key is given for lines that may be headers: no end of a
    sentence, not too long, capitals first; it is the line without a number at its end or beginning, with digits masked and confusable glyphs in one form. beside is that number, title whether its words are capitalised.
    """
    t = F.col("t")
    w = Window.partitionBy("chunk_id").orderBy("pos")
    seen = lines.withColumns({"before": F.lag(t).over(w), "after": F.lead(t).over(w)})
    low = F.lower(t)
    short = (F.length(t) <= NUMBER_CHARS) & t.rlike(r"\d")
    number = F.when(short, F.coalesce(*[F.nullif(F.regexp_extract(low, _PAGE, k), F.lit("")) for k in range(1, 5)]).try_cast("int"))
    known = F.coalesce(F.col("page_start"), F.lit(0)) > 0
    within = lambda n: n.between(F.col("page_start"), F.greatest("page_start", "page_end"))
    lonely = ~F.coalesce(F.col("before"), F.lit("")).rlike(_FIGURES) & ~F.coalesce(F.col("after"), F.lit("")).rlike(_FIGURES)
    seen = seen.withColumn("n", number)
    alone = F.col("n").isNotNull() & F.when(known, within(F.col("n"))).otherwise(~t.rlike(rf"^{_NUMBER}$") | lonely)
    seen = seen.withColumn("number", F.coalesce(alone, F.lit(False)))
    likely = ~F.col("number") & (F.length(t) <= HEADER_CHARS) & (F.length(t) > 0) & t.rlike(_HEADERLIKE) & ~t.rlike(r"[.!?।;:,]$|^#|^[-*•]\s") & t.rlike(r"\p{L}{2}.*\p{L}")
    core = F.regexp_replace(F.regexp_replace(t, r"^(?:[-\[(]?\s*(?:[Pp]\.|[Pp][Aa][Gg][Ee])?\s*\d{1,4}\s*[-\])]?\s*[|·•–—-]?\s+)(?=\S*\p{L})", ""), r"(?<=\S)\s+[|·•–—-]?\s*(?:[Pp]\.|[Pp][Aa][Gg][Ee])?\s*[-\[(]?\s*\d{1,4}\s*[-\])]?$", "")
    seen = seen.withColumn("core", F.when(likely, F.when(t.rlike(r"\d"), core).otherwise(t)))
    key = F.trim(skeleton(F.regexp_replace(F.regexp_replace("core", r"\d", "0"), r"[^\p{L}\p{Nd}†|$]+", " ")))
    words = F.filter(F.split(F.regexp_replace("core", r"[^\p{L}\p{M}]+", " "), " "), lambda x: F.length(x) >= 3)
    title = F.size(F.filter(words, lambda x: x.rlike(r"^\p{Lu}"))) * 10 >= F.size(words) * 6
    after = F.regexp_extract(t, r"(?:^|\s)[-\[(]?\s*(\d{1,4})\s*[-\])]?$", 1).try_cast("int")
    ahead = F.regexp_extract(t, r"^[-\[(]?\s*(?:[Pp]\.\s*|[Pp][Aa][Gg][Ee]\s*)?(\d{1,4})\s*[-\])]?\s", 1).try_cast("int")
    beside = F.when(F.col("core") != t, F.coalesce(after, ahead))
    beside = F.when(F.when(known, within(beside)).otherwise(True), beside)
    line = F.struct("pos", "t", "number", beside.isNotNull().alias("beside"), F.when(F.col("core").isNotNull(), key).alias("key"), F.when(F.col("core").isNotNull(), title).alias("title"))
    return seen.groupBy("chunk_id").agg(F.first("doc_id").alias("doc_id"), F.first("page_start").alias("page_start"), F.first("page_end").alias("page_end"), F.array_sort(F.collect_list(line)).alias("lines"))


def headers(marked: DataFrame) -> DataFrame:
    """(chunk_id, keys): the keys of the running headers in each chunk that has any.

    A key is a header if it comes back in at least two chunks and a sixth of the chunks of its document, or half of them if its words are not capitalised; or, capitalised, in three chunks and half of those
    between its first and last page, as a chapter's or a left page's header does. A document may have any number of headers; keys hardly different from one are headers as well.
    """
    page = F.when(F.coalesce(F.col("page_start"), F.lit(0)) > 0, F.col("page_start")).otherwise(0)
    own = marked.select("chunk_id", "doc_id", page.alias("page"), F.explode(F.filter("lines", lambda x: x["key"].isNotNull())).alias("x")).groupBy("chunk_id", "doc_id", "page", F.col("x.key").alias("key")).agg(F.bool_or("x.title").alias("title"))
    seen = own.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"), F.bool_or("title").alias("title"), F.min("page").alias("first"), F.max("page").alias("last"))
    # chunks by page, so that those between two pages are a difference of running counts
    pages = marked.groupBy("doc_id", page.alias("page")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("doc_id").orderBy("page")
    pages = pages.select("doc_id", "page", F.sum("n").over(upto).alias("upto"), F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, -1)).alias("below"), F.sum("n").over(Window.partitionBy("doc_id")).alias("chunks"))
    first = pages.select("doc_id", F.col("page").alias("first"), F.coalesce("below", F.lit(0)).alias("below"), "chunks")
    last = pages.select("doc_id", F.col("page").alias("last"), "upto")
    span = F.when(F.col("first") > 0, F.col("upto") - F.col("below")).otherwise(F.col("chunks"))
    back = seen.where("n >= 2").join(first, ["doc_id", "first"]).join(last, ["doc_id", "last"]).withColumn("span", span)
    heads = back.where("n * 6 >= chunks and (title or n >= 3 and n * 2 >= chunks) or title and n >= 3 and n * 2 >= span").select("doc_id", "key")
    # equal keys by a join; others are compared with the headers of their document once each, not line by line
    near = (F.length("head") >= 12) & (F.abs(F.length("head") - F.length("key")) <= 4) & (F.levenshtein("head", "key", 4) >= 0) & (F.levenshtein("head", "key", 4) * 6 <= F.length("head"))
    alike = seen.select("doc_id", "key").join(heads.withColumnRenamed("key", "head"), "doc_id").where((F.col("head") == F.col("key")) | near).select("doc_id", "key").distinct()
    return own.select("chunk_id", "doc_id", "key").join(alike, ["doc_id", "key"]).groupBy("chunk_id").agg(F.collect_list("key").alias("keys"))


def vocabulary(marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """(word, n): how often each wanted word stands whole inside a line, in lower case."""
    inner = marked.select(F.explode("lines").alias("x")).select(F.regexp_replace("x.t", r"\S*[-\x{00AD}]$|^\S+", "").alias("inner"))
    return inner.select(F.explode(F.regexp_extract_all(F.lower("inner"), F.lit(_TOKEN), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(wanted, "word", "left_semi")


def body(marked: DataFrame, heads: DataFrame) -> DataFrame:
    """One row per chunk: chunk_id, header, page_number and pieces, an array of (pos, t, separator, left, right, soft) of the lines that are no page furniture, in order. left and right are the parts of a word that the end of the line may divide; a blank line begins a paragraph unless the sentence runs on."""
    w = Window.partitionBy("chunk_id").orderBy("pos")
    lines = marked.join(heads, "chunk_id", "left").select("chunk_id", "keys", F.explode("lines").alias("x")).select("chunk_id", "keys", "x.*")
    lines = lines.withColumn("header", F.coalesce(F.col("key").isNotNull() & F.array_contains(F.coalesce("keys", F.array().cast("array<string>")), F.coalesce("key", F.lit(""))), F.lit(False)))
    lines = lines.withColumn("page_number", F.col("number") | (F.col("header") & F.col("beside"))).withColumn("blanks", F.sum(F.when(F.col("t") == "", 1).otherwise(0)).over(w))
    kept = ~(F.col("t") == "") & ~F.col("header") & ~F.col("page_number")
    # furniture sorts behind the text of its chunk, so that lag and lead are those of the kept lines
    v = Window.partitionBy("chunk_id").orderBy(F.desc("kept"), "pos")
    lines = lines.withColumn("kept", kept).withColumns({"next": F.lead(F.when(F.col("kept"), F.col("t"))).over(v), "next_blanks": F.lead("blanks").over(v)})
    t, following = F.col("t"), F.col("next")
    left = F.when(t.rlike(r"[-\x{00AD}]$"), F.regexp_extract(t, r"([\p{L}\p{M}][\p{L}\p{M}\p{Nd}†|$'’-]*)[-\x{00AD}]$", 1))
    right = F.when(t.rlike(r"[-\x{00AD}]$"), F.regexp_extract(following, r"^([\p{L}\p{M}\p{Nd}†|$]+(?:-[\p{L}\p{M}]+)*)", 1))
    lines = lines.withColumns({"left": left, "right": right})
    divided = (F.col("left") != "") & F.col("right").rlike(r"^[\p{Ll}\p{Lo}†0-9|$]")
    runs_on = ~t.rlike(r"[.!?।:][\"'”»)\]]*$") & following.rlike(r"^[\p{Ll}\p{Lo}]") & ~t.startswith("#")
    figures = r"^[\d.,%₹$€\s/-]+$|^#|^[-*•]\s"
    separator = F.when(following.isNull(), "").when((F.col("next_blanks") > F.col("blanks")) & ~runs_on, "\n\n").when(t.rlike(figures) | following.rlike(figures), "\n").otherwise(" ")
    piece = F.struct("pos", "t", separator.alias("separator"), F.when(divided, F.col("left")).alias("left"), F.when(divided, F.col("right")).alias("right"), t.endswith("­").alias("soft"))
    return lines.groupBy("chunk_id").agg(F.bool_or("header").alias("header"), F.bool_or("page_number").alias("page_number"), F.array_sort(F.collect_list(F.when(F.col("kept"), piece))).alias("pieces"))


def _dashed(x: Column) -> Column:
    return F.lower(F.concat_ws("-", x["left"], x["right"]))


def compounds(bodies: DataFrame, marked: DataFrame) -> DataFrame:
    """(chunk_id, compounds): of the words that line ends divide in each chunk, those that the corpus writes with the hyphen more often than without."""
    split = bodies.select("chunk_id", F.explode(F.filter("pieces", lambda x: x["left"].isNotNull() & ~x["soft"])).alias("x")).select("chunk_id", F.lower(F.concat("x.left", "x.right")).alias("whole"), _dashed(F.col("x")).alias("dashed"))
    pairs = split.select("whole", "dashed").distinct()
    wanted = pairs.select(F.explode(F.array("whole", "dashed")).alias("word")).distinct()
    words = vocabulary(marked, wanted)
    often = pairs.join(words.select(F.col("word").alias("dashed"), F.col("n").alias("n_dashed")), "dashed").join(words.select(F.col("word").alias("whole"), F.col("n").alias("n_whole")), "whole", "left")
    kept = often.where(F.col("n_dashed") > F.coalesce("n_whole", F.lit(0))).select("whole", "dashed")
    return split.join(kept, ["whole", "dashed"], "left_semi").groupBy("chunk_id").agg(F.collect_set("dashed").alias("compounds"))


def reflow(bodies: DataFrame, kept: DataFrame) -> DataFrame:
    """(chunk_id, text, hyphens, header, page_number, tokens): the chunk's text in paragraphs, without furniture, with divided words made whole and the number of these, and its words in order."""
    joined = bodies.join(kept, "chunk_id", "left").withColumn("compounds", F.coalesce("compounds", F.array().cast("array<string>")))
    whole = lambda x, c: x["left"].isNotNull() & (x["soft"] | ~F.array_contains(c, _dashed(x)))
    piece = lambda x, c: F.concat(F.when(whole(x, c), F.regexp_replace(x["t"], r"[-\x{00AD}]$", "")).otherwise(x["t"]), F.when(x["left"].isNotNull(), "").otherwise(x["separator"]))
    c = F.col("compounds")
    made = joined.select("chunk_id", F.array_join(F.transform("pieces", lambda x: piece(x, c)), "").alias("text"), F.size(F.filter("pieces", lambda x: whole(x, c))).alias("hyphens"), "header", "page_number")
    return made_once(made, tokens=F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)))


def corrections(reflowed: DataFrame, stage=lambda df: df) -> DataFrame:
    """(chunk_id, bad, good): the words of each chunk that are misread.

    Words are grouped by skeleton over the whole corpus. A form of a group may stand for another if it is RARER times as frequent, or RARER_MIXED times for forms that mix letters with digits or signs. In its
    place the form is chosen that follows the word before most often elsewhere in the corpus, then the most frequent; forms that are not mixed need such support, as they may be words of their own.
    """
    tokens = F.col("tokens")
    counted = reflowed.select(F.explode(tokens).alias("form")).groupBy(F.lower("form").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    has_letter = F.col("word").rlike(r"\p{L}{2}")
    # codes and numbers are no words: letters must prevail
    wordlike = has_letter & (F.length(F.regexp_replace("word", r"[^\p{L}]", "")) * 2 > F.length("word")) & (F.length("word") >= 3)
    # runs that overlap, as in cli, are read in either order
    both = F.array_distinct(F.array(skeleton(F.col("word")), skeleton(F.col("word"), tuple(reversed(CONFUSED_RUNS)))))
    groups = counted.where(wordlike).withColumn("skeleton", F.explode(both))
    plain = groups.where(~F.col("word").rlike(r"[\d†|$€]")).select("skeleton", F.col("word").alias("good"), F.col("n").alias("good_n"))
    mixed = F.col("bad").rlike(r"[\d†|$€]")
    pairs = stage(
        groups.withColumnRenamed("word", "bad").join(plain, "skeleton").where("bad <> good").withColumn("mixed", mixed)
        .where(F.when(F.col("mixed"), F.col("good_n") >= RARER_MIXED * F.col("n")).otherwise(F.col("good_n") >= RARER * F.col("n")))
        .select("bad", "good", "good_n", "mixed").distinct()
    )
    # each token with the one before it, within the row
    placed = reflowed.select("chunk_id", tokens.alias("k")).select("chunk_id", F.explode(F.transform("k", lambda x, i: F.struct(x.alias("form"), F.lower(x).alias("word"), F.when(i > 0, F.lower(F.get("k", i - 1))).otherwise("").alias("before")))).alias("p")).select("chunk_id", "p.*")
    hits = stage(placed.join(pairs, placed["word"] == pairs["bad"]).groupBy("chunk_id", "form", "before", "good", "good_n", "mixed").agg(F.count(F.lit(1)).alias("c")))
    # written, so that its bytes are known where the tokens of the corpus meet it
    asked = stage(hits.select("before", "good").distinct())
    support = placed.join(asked, (placed["word"] == asked["good"]) & (placed["before"] == asked["before"]), "left_semi").groupBy("before", F.col("word").alias("good")).agg(F.count(F.lit(1)).alias("times"))
    rated = hits.join(support, ["before", "good"], "left").where(F.col("mixed") | F.col("times").isNotNull())
    chosen = rated.groupBy("chunk_id", "form").agg(F.max_by("good", F.struct(F.coalesce("times", F.lit(0)), "good_n", "good")).alias("good"))
    upper = F.col("form") == F.upper("form")
    cased = F.when(upper & (F.length("form") > 2), F.upper("good")).when(F.substring("form", 1, 1) != F.lower(F.substring("form", 1, 1)), F.concat(F.upper(F.substring("good", 1, 1)), F.expr("substring(good, 2)"))).otherwise(F.col("good"))
    return chosen.select("chunk_id", F.col("form").alias("bad"), cased.alias("good"))


def repair(chunks: DataFrame, stage=lambda df: df) -> Scanned:
    """All steps; stage may write a step that is read more than once."""
    marked = stage(candidates(read_lines(chunks)))
    bodies = stage(body(marked, stage(headers(marked))))
    reflowed = stage(reflow(bodies, stage(compounds(bodies, marked))))
    return Scanned(reflowed, corrections(reflowed, stage))


def repaired_text(done: Scanned) -> DataFrame:
    """(chunk_id, text, n_fixed): continuous paragraphs with misread words put right, each word once, whatever comes out for it."""
    per = done.fixes.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("bad", "good"))).alias("fixes"))
    tokens, between = F.col("tokens"), F.split("text", _TOKEN, -1)
    put = F.transform(tokens, lambda x: F.coalesce(F.element_at("fixes", x), x))
    fixed = F.array_join(F.zip_with(between, put, lambda b, x: F.concat(b, F.coalesce(x, F.lit("")))), "")
    joined = done.reflowed.join(per, "chunk_id", "left")
    return joined.select("chunk_id", F.when(F.col("fixes").isNull(), F.col("text")).otherwise(fixed).alias("text"), F.coalesce(F.size("fixes"), F.lit(0)).alias("n_fixed"))


def found(done: Scanned) -> DataFrame:
    """(chunk_id, kind), each once. Chunks without text have none."""
    r = done.reflowed
    kinds = F.array_compact(F.array(F.when(F.col("hyphens") > 0, F.lit("hyphen")), F.when(F.col("header"), F.lit("header")), F.when(F.col("page_number"), F.lit("page_number"))))
    return r.select("chunk_id", F.explode(kinds).alias("kind")).unionByName(done.fixes.select("chunk_id").distinct().select("chunk_id", F.lit("chars").alias("kind")))
