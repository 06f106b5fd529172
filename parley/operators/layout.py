"""Layout blocks of parsed documents: margins, captions, equations and section paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import caption_anchor
from parley.operators.chunking import STRETCH
from parley.operators.ordered import blocked_last

# Fixed values of the page geometry, in points.
MARGIN_BAND, STRIP_HEIGHT, PAGE_HEIGHT = 40.0, 25.0, 792.0
#: Order in which kinds of assets are tried for a caption without anchor.
ASSET_KINDS = ("figure", "table", "equation")


def box_centre(box: Column) -> Column:
    ok = F.size(box) == 4
    return F.struct(F.when(ok, (F.get(box, 0) + F.get(box, 2)) / 2).otherwise(0.0).alias("x"), F.when(ok, (F.get(box, 1) + F.get(box, 3)) / 2).otherwise(0.0).alias("y"))


def box_distance(a: Column, b: Column) -> Column:
    p, q = box_centre(a), box_centre(b)
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def in_margin(box: Column, height: Column | float = PAGE_HEIGHT) -> Column:
    """Whether a low strip lies in the band at the top or the bottom of its page. Boxes are left, top, right, bottom with the origin at the lower left."""
    top, bottom = F.greatest(F.get(box, 1), F.get(box, 3)), F.least(F.get(box, 1), F.get(box, 3))
    return F.coalesce((F.size(box) == 4) & (top - bottom < STRIP_HEIGHT) & ((bottom >= F.lit(height) - MARGIN_BAND) | (top <= MARGIN_BAND)), F.lit(False))


def retype_margins(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("type", F.when((F.col("type") == "figure") & in_margin(F.col("bbox")), "page_marginal").otherwise(F.col("type")))


def attach_captions(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attached, orphans): each caption goes to the nearest asset of its page, of the kind its anchor names if any; ties by kind, then order. An asset near several captions takes the last."""
    captions = blocks.where("type = 'caption'").select("doc_id", "page", F.col("ord").alias("c_ord"), F.col("text").alias("caption"), F.col("bbox").alias("c_box"), caption_anchor(F.col("text"))["kind"].alias("kind"))
    rank = F.array_position(F.array(*map(F.lit, ASSET_KINDS)), F.col("type"))
    assets = blocks.where(F.col("type").isin(*ASSET_KINDS)).select("doc_id", "page", "type", F.col("ord").alias("a_ord"), F.col("block_id").alias("asset_id"), F.col("bbox").alias("a_box"), rank.alias("rank"))
    near = captions.join(assets, ["doc_id", "page"]).where(F.col("kind").isNull() | (F.col("kind") == F.col("type"))).withColumn("distance", box_distance(F.col("c_box"), F.col("a_box")))
    best = near.groupBy("doc_id", "page", "c_ord", "caption").agg(F.min_by("asset_id", F.struct("distance", "rank", "a_ord")).alias("asset_id"))
    attached = best.groupBy("doc_id", "asset_id").agg(F.max_by("caption", "c_ord").alias("caption"))
    orphans = captions.join(best.select("doc_id", "c_ord"), ["doc_id", "c_ord"], "left_anti").select("doc_id", "page", "c_ord", "caption")
    return attached, orphans


def equation_neighbours(blocks: DataFrame, most: int = 400) -> DataFrame:
    """For each equation the nearest paragraph or list item before and after it on its page, cut to most characters."""
    page = Window.partitionBy("doc_id", "page").orderBy("ord")
    text = F.when(F.col("type").isin("paragraph", "list_item"), F.col("text"))
    seen = blocks.withColumn("before", F.last(text, ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first(text, ignorenulls=True).over(page.rowsBetween(1, Window.unboundedFollowing)))
    return seen.where("type = 'equation'").select("doc_id", "page", "ord", F.substring("before", 1, most).alias("before"), F.substring("after", 1, most).alias("after"))


def section_paths(blocks: DataFrame, levels: int = 6) -> DataFrame:
    """Adds section_path: the headings in force at each block, outer first. A heading ends those of its own and deeper levels."""
    heading = F.col("type") == "section_heading"
    last = {f"__h{k}": F.when(heading & (F.col("level") == k), F.struct("ord", "text")) for k in range(1, levels + 1)}
    out = blocked_last(blocks.withColumn("__stretch", F.floor(F.col("ord") / STRETCH)), ["doc_id"], "__stretch", ["ord"], last).drop("__stretch")
    alive = []
    for k in range(1, levels + 1):
        mine = F.col(f"__h{k}")
        ended = F.lit(False)
        for outer in range(1, k):
            ended = ended | F.coalesce(F.col(f"__h{outer}.ord") > mine["ord"], F.lit(False))
        alive.append(F.when(mine.isNotNull() & ~ended, mine["text"]))
    return out.withColumn("section_path", F.array_compact(F.array(*alive))).drop(*[f"__h{k}" for k in range(1, levels + 1)])


def equation_quality(text: Column) -> Column:
    """How readable the text of an equation is: empty -100, glyph names -50, replacement signs -30, operators +10, mathematical signs +5, very long -10."""
    t = F.coalesce(text, F.lit(""))
    points = [(t.rlike(r"/[A-Z][a-z]+"), -50), (t.contains("�"), -30), (t.rlike(r"[=+\-/*<>]"), 10), (t.rlike(r"[\x{0370}-\x{03FF}∑∫√∞≤≥≠±×÷∂∇]"), 5), (F.length(t) > 500, -10)]
    return F.when(F.trim(t) == "", F.lit(-100)).otherwise(sum((F.when(c, v).otherwise(0) for c, v in points), F.lit(0)))


def table_markdown(rows: Column) -> Column:
    """Rows of cells as a pipe table, the first as header; cells in one line, pipes escaped, short rows filled up. Empty for no rows."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: cell(F.get(r, i))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.when((F.size(rows) > 0) & (width > 0), F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))), "\n")).otherwise("")


def markdown_table(text: Column) -> Column:
    """The first block of at least two pipe lines, code fences left out; null where there is none."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.trim(s)), lambda s: ~s.startswith("```"))
    found = F.regexp_extract(F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n")), r"\n((?:\|[^\n]*\n){2,})", 1)
    return F.nullif(F.regexp_replace(found, r"\n$", ""), F.lit(""))


def section_tree(chunks: DataFrame, path: str = "section_path") -> DataFrame:
    """(doc_id, path, page_start, page_end, chunks): every section with the pages of all that lies below it. A chunk counts once for each of its sections; partial sums are made before the shuffle."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(F.col(path), F.lit(1), n))
    own = chunks.where(F.size(path) > 0).select("doc_id", "page_start", "page_end", F.explode(prefixes).alias("path"))
    return own.groupBy("doc_id", "path").agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.count(F.lit(1)).alias("chunks"))


def equation_label(text: Column) -> Column:
    """The number in brackets at the end of an equation, as 12 or 12a; null where there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"\((\d+[a-z]?)\)\s*$", 1), F.lit(""))


def equation_marks(text: Column) -> Column:
    """What equation_quality looks at, one by one: glyph names, replacement signs, operators, mathematical signs."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(t.rlike(r"/[A-Z][a-z]+").alias("glyph_names"), t.contains("�").alias("replaced"), t.rlike(r"[=+\-/*<>]").alias("operators"), t.rlike(r"[\x{0370}-\x{03FF}∑∫√∞≤≥≠±×÷∂∇]").alias("mathematical"))


def repaired_equation(first: Column, second: Column, margin: int = 5) -> Column:
    """(text, source) of the better reading of an equation: the second only if its quality is more than margin higher."""
    better = equation_quality(second) > equation_quality(first) + margin
    return F.when(better, F.struct(second.alias("text"), F.lit("second").alias("source"))).otherwise(F.struct(first.alias("text"), F.lit("first").alias("source")))


def figure_class(annotations: Column) -> Column:
    """The first class among the annotations (kind, class) of a figure; null for none."""
    return F.get(F.filter(annotations, lambda a: a["kind"] == "classification"), 0)["class"]


def is_logo(annotations: Column) -> Column:
    return F.coalesce(F.exists(annotations, lambda a: (a["kind"] == "classification") & F.lower(a["class"]).isin("logo", "icon")), F.lit(False))
