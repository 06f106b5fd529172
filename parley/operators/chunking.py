"""Sections, chunks and their merging over ordered blocks of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import size_estimate
from parley.operators.ordered import blocked_lag, blocked_running_sum

# Fixed values of the chunkers.
FLOOR = 100
SEMANTIC_MIN, SEMANTIC_MAX, BREAK, STRONG_BREAK, STRONG_MIN = 100, 700, 0.58, 0.42, 50
REFINE_ABOVE, REFINE_MIN, OVERLAP = 600, 100, 60
#: Blocks of one document are ordered in stretches of so many.
STRETCH = 512


def formatted_block(kind: Column, text: Column) -> Column:
    """Markdown of a block by its type; tables and figures give the empty string here."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(kind == "section_heading", F.concat(F.lit("## "), t)).when(kind == "list_item", F.concat(F.lit("- "), t)).when(kind == "equation", F.concat(F.lit("$$ "), t, F.lit(" $$")))
        .when(kind == "caption", F.concat(F.lit("_Caption: "), t, F.lit("_"))).when(kind.isin("table", "figure"), "").otherwise(t)
    )


def sections(blocks: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Adds section_no to blocks (doc_id, ord, type, ...): one more at each heading; what stands before the first heading is section 0. Long documents are numbered in stretches."""
    marked = blocks.withColumn("__stretch", F.floor(F.col("ord") / stretch))
    return blocked_running_sum(marked, ["doc_id"], "__stretch", ["ord"], F.when(F.col("type") == "section_heading", 1).otherwise(0), "section_no").drop("__stretch")


def section_chunks(blocks: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row per section of blocks with section_no: text, pages, block count, histogram of types, ids in order. A section that runs through several stretches of a document, as one without headings may, comes out as so many ordered parts (part_no from 0), so that no row holds more than a stretch."""
    item = F.struct("ord", formatted_block(F.col("type"), F.col("text")).alias("t"), F.col("block_id").alias("id"), "type")
    grouped = blocks.groupBy("doc_id", "section_no", F.floor(F.col("ord") / stretch).alias("__stretch")).agg(F.array_sort(F.collect_list(item)).alias("items"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count(F.lit(1)).alias("block_count"))
    first = blocks.groupBy("doc_id", "section_no").agg(F.min(F.floor(F.col("ord") / stretch)).alias("__first"))
    kinds = F.array_distinct(F.transform("items", lambda x: x["type"]))
    return grouped.join(first, ["doc_id", "section_no"]).select(
        "doc_id", "section_no", (F.col("__stretch") - F.col("__first")).cast("int").alias("part_no"), "page_start", "page_end", "block_count",
        F.array_join(F.filter(F.transform("items", lambda x: x["t"]), lambda t: t != ""), "\n\n").alias("text"),
        F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter("items", lambda x: x["type"] == k)))).alias("block_types"),
        F.transform("items", lambda x: x["id"]).alias("source_block_ids"),
    )


def section_extracts(chunks: DataFrame, most: int = 12000, stretch: int = STRETCH) -> DataFrame:
    """(doc_id, section, extract): the text of each section, or where it is longer than most characters its head and its tail.

    Lengths are summed in stretches of order first; only chunks that reach into the head or the tail are brought together, so that a section with most of the rows is no large value.
    """
    half = most // 2
    text = F.coalesce("text", F.lit(""))
    sized = chunks.select("doc_id", "section", "ord", "chunk_id", text.alias("t"), (F.length(text) + 2).alias("__n"), F.floor(F.coalesce("ord", F.lit(0)) / stretch).alias("__stretch"))
    summed = blocked_running_sum(sized, ["doc_id", "section"], "__stretch", ["ord", "chunk_id"], F.col("__n"), "__end")
    totals = sized.groupBy("doc_id", "section").agg((F.sum("__n") - 2).alias("__total"))
    near = summed.join(totals, ["doc_id", "section"]).withColumn("__begin", F.col("__end") - F.col("__n"))
    head, tail = F.col("__begin") < half + 2, F.col("__end") > F.col("__total") - half - 2
    item = F.struct("ord", "chunk_id", "t")
    kept = near.where(head | tail).groupBy("doc_id", "section").agg(F.first("__total").alias("total"), F.array_sort(F.collect_list(F.when(head, item))).alias("heads"), F.array_sort(F.collect_list(F.when(tail, item))).alias("tails"), F.array_sort(F.collect_list(item)).alias("all"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["t"]), "\n\n")
    extract = F.when(F.col("total") <= most, joined("all")).otherwise(F.concat(F.substring(joined("heads"), 1, half), F.lit("\n[...]\n"), F.right(joined("tails"), F.lit(half))))
    return kept.select("doc_id", "section", extract.alias("extract"))


def floor_groups(chunks: DataFrame, doc: str = "doc_id", ord_: str = "ord", tokens: str = "token_count", floor: int = FLOOR) -> DataFrame:
    """Adds group_no: a chunk below the floor joins the group before it, the first of a document stays. Null sizes count as 0."""
    size = F.coalesce(F.col(tokens), F.lit(0))
    marked = chunks.withColumn("__stretch", F.floor(F.col(ord_) / STRETCH))
    seen = blocked_lag(marked, [doc], "__stretch", [ord_], F.col(ord_), "__before")
    return blocked_running_sum(seen, [doc], "__stretch", [ord_], F.when((size >= floor) | F.col("__before").isNull(), 1).otherwise(0), "group_no").drop("__stretch", "__before")


def merged_groups(grouped: DataFrame, doc: str = "doc_id", ord_: str = "ord") -> DataFrame:
    """One row per group: joined text, its size anew, first page start, greatest page end, ids merged."""
    items = F.array_sort(F.collect_list(F.struct(ord_, F.coalesce("text", F.lit("")).alias("t"), "chunk_id", "page_start")))
    g = grouped.groupBy(doc, "group_no").agg(items.alias("items"), F.max("page_end").alias("page_end"))
    text = F.array_join(F.transform("items", lambda x: x["t"]), "\n\n")
    return g.select(doc, "group_no", F.element_at("items", 1)["chunk_id"].alias("chunk_id"), F.element_at("items", 1)["page_start"].alias("page_start"), "page_end", text.alias("text"), size_estimate(text).alias("token_count"), F.transform("items", lambda x: x["chunk_id"]).alias("merged_from"))


def linked(chunks: DataFrame, doc: str = "doc_id", stretch: int = STRETCH) -> DataFrame:
    """Adds prev_id and next_id by ord, then chunk_id, within the document."""
    marked = chunks.withColumn("__stretch", F.floor(F.coalesce("ord", F.lit(0)) / stretch))
    back = blocked_lag(marked, [doc], "__stretch", ["ord", "chunk_id"], F.col("chunk_id"), "prev_id")
    return blocked_lag(back, [doc], "__stretch", ["ord", "chunk_id"], F.col("chunk_id"), "next_id", ahead=True).drop("__stretch")


def refined_pieces(folds: DataFrame, budget: int = OVERLAP) -> DataFrame:
    """(chunk_id, source_chunk_id, doc_id, ord, part, text, overlap_sentences): the pieces of chunks with sentences, sizes and cuts (each after so many sentences). A piece repeats the sentences before its cut that fit the budget; a chunk without cuts stays as it is."""
    bounds = F.concat(F.array(F.lit(0)), F.col("cuts"), F.array(F.size("sentences")))
    parts = folds.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda k: F.struct(F.get(bounds, k).alias("a"), F.get(bounds, k + 1).alias("b")))).alias("part", "x"))
    back = F.when(F.col("part") > 0, trailing_overlap(F.col("sizes"), F.col("x.a"), budget)).otherwise(0).cast("int")
    told = parts.withColumn("overlap_sentences", back)
    text = F.array_join(F.slice("sentences", F.col("x.a") - F.col("overlap_sentences") + 1, F.col("x.b") - F.col("x.a") + F.col("overlap_sentences")), " ")
    name = F.when(F.size("cuts") > 0, F.concat_ws("#", "chunk_id", F.col("part").cast("string"))).otherwise(F.col("chunk_id"))
    return told.select(name.alias("chunk_id"), F.col("chunk_id").alias("source_chunk_id"), "doc_id", "ord", "part", text.alias("text"), "overlap_sentences")


def greedy_groups(sims: Column, tokens: Column, least: int = SEMANTIC_MIN, most: int = SEMANTIC_MAX, weak: float = BREAK, strong: float = STRONG_BREAK, strong_least: int = STRONG_MIN) -> Column:
    """Number of the group of each sentence, from the similarities of neighbours and the sentence sizes of one section.

    A new group begins where the next sentence would pass most tokens, where the group has at least least tokens and the similarity is below weak, and where it has strong_least and it is below strong.
    """
    step = F.struct(F.lit(0).alias("no"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("out"))

    def fold(acc: Column, i: Column) -> Column:
        here = F.get(tokens, i)
        sim = F.get(sims, i - 1)
        new = (i > 0) & ((acc["size"] + here > most) | ((acc["size"] >= least) & (sim < weak)) | ((acc["size"] >= strong_least) & (sim < strong)))
        no = F.when(new, acc["no"] + 1).otherwise(acc["no"])
        return F.struct(no.alias("no"), F.when(new, here).otherwise(acc["size"] + here).cast("int").alias("size"), F.concat(acc["out"], F.array(no)).alias("out"))

    return F.when(F.size(tokens) > 0, F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1), step, fold)["out"]).otherwise(F.array().cast("array<int>"))


def semantic_floor_merge(sizes: Column, least: int = SEMANTIC_MIN) -> Column:
    """Sizes after merging: a chunk joins the one before where either is below the floor; sizes add up."""

    def fold(acc: Column, size: Column) -> Column:
        n = F.size(acc)
        merge = (n > 0) & ((size < least) | (F.element_at(acc, -1) < least))
        return F.when((n > 0) & merge, F.concat(F.slice(acc, 1, F.greatest(n - 1, F.lit(0))), F.array(F.element_at(acc, -1) + size))).otherwise(F.concat(acc, F.array(size)))

    return F.aggregate(sizes, F.array().cast("array<int>"), lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(fold(acc, s)))


def smoothed(sims: Column) -> Column:
    """Mean of three neighbours, with zeros beyond the ends."""
    at = lambda i: F.coalesce(F.get(sims, i), F.lit(0.0))
    return F.when(F.size(sims) > 0, F.transform(F.sequence(F.lit(0), F.size(sims) - 1), lambda i: (F.when(i > 0, at(i - 1)).otherwise(0.0) + at(i) + at(i + 1)) / 3)).otherwise(F.array().cast("array<double>"))


def split_points(sims: Column) -> Column:
    """Inner strict minima of the smoothed similarities, deepest first, earlier first on ties; none for fewer than three."""
    s = smoothed(sims)
    at = F.transform(s, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    low = F.filter(at, lambda x: (x["i"] > 0) & (x["i"] < F.size(s) - 1) & (x["v"] < F.get(s, x["i"] - 1)) & (x["v"] < F.get(s, x["i"] + 1)))
    return F.when(F.size(sims) >= 3, F.transform(F.array_sort(low), lambda x: x["i"])).otherwise(F.array().cast("array<int>"))


def accepted_splits(points: Column, sizes: Column, least: int = REFINE_MIN) -> Column:
    """Of the points, in their order, those after which every piece still has at least least tokens; sorted. A point i cuts after sentence i."""

    def total(a: Column, b: Column) -> Column:
        return F.aggregate(F.slice(sizes, a + 1, b - a), F.lit(0), lambda s, x: s + x)

    def fold(acc: Column, p: Column) -> Column:
        cut = p + 1
        below = F.coalesce(F.array_max(F.filter(acc, lambda x: x < cut)), F.lit(0))
        above = F.coalesce(F.array_min(F.filter(acc, lambda x: x > cut)), F.size(sizes))
        return F.when((total(below, cut) >= least) & (total(cut, above) >= least), F.concat(acc, F.array(cut))).otherwise(acc)

    return F.array_sort(F.aggregate(points, F.array().cast("array<int>"), fold))


def trailing_overlap(sizes: Column, boundary: Column, budget: int = OVERLAP) -> Column:
    """How many sentences before the boundary are repeated after it: from the nearest back while they fit the budget, one at least."""
    back = F.reverse(F.slice(sizes, 1, boundary))
    step = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"), F.lit(False).alias("stop"))

    def fold(acc: Column, x: Column) -> Column:
        take = ~acc["stop"] & ((acc["n"] == 0) | (acc["sum"] + x <= budget)) & (acc["sum"] < budget)
        return F.struct(F.when(take, acc["n"] + 1).otherwise(acc["n"]).alias("n"), F.when(take, acc["sum"] + x).otherwise(acc["sum"]).cast("int").alias("sum"), (acc["stop"] | ~take).alias("stop"))

    return F.when(boundary > 0, F.aggregate(back, step, fold)["n"]).otherwise(0)


def size_distribution(chunks: DataFrame, size: str) -> DataFrame:
    """One row: n, total, min, upper median, integer mean, max, below 100, above 1000. The median comes from counts by size, not from all rows in one array."""
    per = chunks.where(F.col(size).isNotNull()).groupBy(F.col(size).alias("s")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(F.lit(0)).orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(F.lit(0)))).agg(
        F.sum("c").alias("n"), F.sum(F.col("s") * F.col("c")).alias("total"), F.min("s").alias("min"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("s"))).alias("upper_median"),
        F.floor(F.sum(F.col("s") * F.col("c")) / F.sum("c")).cast("bigint").alias("mean"), F.max("s").alias("max"), F.coalesce(F.sum(F.when(F.col("s") < 100, F.col("c"))), F.lit(0)).alias("below_100"), F.coalesce(F.sum(F.when(F.col("s") > 1000, F.col("c"))), F.lit(0)).alias("above_1000"),
    )
