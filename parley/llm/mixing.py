"""Problem 9: mix sources to target weights by hierarchical budgeting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import cut

#: Records that one hash range of a leaf is to hold; the number of ranges follows the counts, so that no task sorts a whole leaf.
RANGE_ROWS = 50_000


def domain_of(source: Column, domains: dict[str, tuple[str, ...]]) -> Column:
    """The domain that names the source among its members, else other."""
    out = F.lit("other")
    for name, members in domains.items():
        out = F.when(source.isin(*members), F.lit(name)).otherwise(out)
    return out


def language_of(lang: Column) -> Column:
    """The recorded label in lower case without region; blank, null and und give und."""
    plain = F.regexp_replace(F.lower(F.trim(lang)), "[-_].*$", "")
    return F.when(plain.isNull() | plain.isin("", "und"), F.lit("und")).otherwise(plain)


def _pour(leaves: DataFrame, *within: str) -> DataFrame:
    """Hands the tokens that leaves lack to leaves with room of the same group, in proportion to their room. Sums by group are partial aggregates that meet the leaves again, so that no task sees all leaves."""
    keys = list(within) or ["__all"]
    lack = F.greatest(F.col("want") - F.col("cap"), F.lit(0.0))
    room = F.greatest(F.col("cap") - F.col("want"), F.lit(0.0))
    marked = leaves.withColumn("__all", F.lit(0))
    sums = marked.groupBy(*keys).agg(F.sum(lack).alias("__lack"), F.sum(room).alias("__room"))
    given = F.least("__lack", "__room")
    moved = F.col("want") - F.when(F.col("__lack") > 0, lack * given / F.col("__lack")).otherwise(0.0) + F.when(F.col("__room") > 0, room * given / F.col("__room")).otherwise(0.0)
    return marked.join(sums, keys).withColumn("want", moved).select(*leaves.columns)


def leaf_budgets(leaves: DataFrame, total: int) -> DataFrame:
    """Token budget of every leaf (domain, lang, source, have, cap, weight): column want.

    The weight of a domain is that of its languages, theirs that of their sources. A leaf that lacks tokens passes what is missing to its siblings, the sources of the same
    language and domain, then to the domain's other languages, and last to other domains. Budgets add up to total unless all leaves together hold less.
    """
    weights = leaves.agg(F.sum("weight").alias("__weights"))
    out = leaves.crossJoin(weights).withColumn("want", F.when(F.col("__weights") > 0, F.col("weight") / F.col("__weights") * F.lit(float(total))).otherwise(0.0)).drop("__weights")  # one row
    for within in (("domain", "lang"), ("domain",), ()):
        out = _pour(out, *within)
    return out.withColumn("want", F.least("want", "cap"))


def mix(docs: DataFrame, targets: DataFrame, total: int, domains: dict[str, tuple[str, ...]] | None = None, seed: int = 7, key: str = "doc_id", tokens: str = "n_tokens", range_rows: int = RANGE_ROWS) -> DataFrame:
    """The chosen records: key, source, lang, domain, tokens, times (1 to max_repeats).

    docs has key (unique), source, lang and tokens; targets has source, target_share and max_repeats; domains names the sources of each domain. Records without tokens, and of sources without target, are not chosen. Within
    a leaf each epoch is an order of its records by a seeded hash; whole epochs are taken, and of the next the prefix that stays within the
    budget, never more than max_repeats epochs; records larger than what the last epoch may take are passed over in it. What the leaves of a source leave open goes to its records next in order.
    Sums run over hash ranges first, as many for a leaf as its records need, so that a leaf with most of the rows is spread over all tasks. Sums by leaf and by range are written, so that Spark knows their bytes
    and sends them to the records or lets both meet by key. Empty inputs give an empty result.
    """
    base = (
        docs.join(targets.select("source", "target_share", "max_repeats"), "source")
        .where(F.col(tokens) > 0)
        .select(F.col(key).alias("__key"), "source", language_of(F.col("lang")).alias("lang"), domain_of(F.col("source"), domains or {}).alias("domain"), F.col(tokens).cast("long").alias("tokens"), "target_share", "max_repeats")
    )
    leaf = ["domain", "lang", "source"]
    have = cut(base.groupBy(*leaf, "target_share", "max_repeats").agg(F.sum("tokens").alias("have"), F.count(F.lit(1)).alias("rows")))
    of_source = have.groupBy("source").agg(F.sum("have").alias("__of_source"), F.sum("rows").alias("__source_rows"))
    ranges = lambda rows: F.greatest(F.lit(1), F.ceil(rows / range_rows)).cast("int")
    leaves = (
        have.join(of_source, "source").withColumn("weight", F.col("target_share") * F.col("have") / F.col("__of_source")).withColumn("cap", (F.col("have") * F.col("max_repeats")).cast("double"))
        .withColumn("ranges", ranges(F.col("rows"))).withColumn("source_ranges", ranges(F.col("__source_rows"))).drop("__of_source", "__source_rows", "rows")
    )
    plan = cut(leaf_budgets(leaves, total).withColumn("epochs", F.least(F.floor(F.col("want") / F.col("have")), F.col("max_repeats")).cast("int")).withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("want") - F.col("epochs") * F.col("have")).otherwise(0.0)))
    small = plan.select(*leaf, "epochs", "rest", "ranges", "source_ranges")
    ranged = base.join(small, leaf).withColumn("__at", F.xxhash64(F.col("__key"), F.lit(seed), F.col("epochs"))).withColumn("__range", F.pmod(F.shiftrightunsigned("__at", 20), F.col("ranges")).cast("long"))
    chosen = cut(_prefix(ranged, leaf, F.col("rest")).withColumn("times", F.col("epochs") + F.col("extra")).select("__key", *leaf, "tokens", "max_repeats", "times", "__at", "source_ranges"))
    # what the leaves of a source leave open goes to its records next in order, those used least first, smaller ones in the second round
    wanted = plan.groupBy("source").agg(F.sum("want").alias("__want"))
    for _ in range(2):
        taken = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("__taken"))
        gap = cut(wanted.join(taken, "source", "left").select("source", (F.col("__want") - F.coalesce("__taken", F.lit(0))).alias("__gap")))
        open_ = chosen.join(gap, "source", "left").withColumn("__gap", F.when(F.col("times") < F.col("max_repeats"), F.col("__gap")).otherwise(0.0))
        fewest_first = open_.withColumn("__range", F.col("times").cast("long") * F.col("source_ranges") + F.pmod(F.shiftrightunsigned("__at", 20), F.col("source_ranges")))
        chosen = cut(_prefix(fewest_first, ["source"], F.col("__gap")).withColumn("times", F.col("times") + F.col("extra")).drop("extra", "__gap", "__range"))
    return chosen.where("times > 0").select(F.col("__key").alias(key), "source", "lang", "domain", "tokens", F.col("times").cast("int").alias("times"))


def _prefix(rows: DataFrame, group: list[str], room: Column) -> DataFrame:
    """Adds extra: 1 for the records of each group, in the order of __range and __at, that stay within its room together, passing over those larger than it; else 0.

    Sums by range come first; only the ranges that the room reaches are sorted.
    """
    marked = rows.withColumn("__room", F.coalesce(room, F.lit(0.0))).withColumn("__fits", F.col("tokens") <= F.col("__room"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.where("__fits").groupBy(*group, "__range").agg(F.sum("tokens").alias("__sum"))
    offsets = cut(sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).select(*group, "__range", "__before"))
    placed = marked.join(offsets, [*group, "__range"], "left").withColumn("__open", F.coalesce(F.col("__fits") & (F.col("__before") < F.col("__room")), F.lit(False)))
    running = F.sum("tokens").over(Window.partitionBy(*group, "__range").orderBy("__at", "__key")) + F.col("__before")
    near = placed.where("__open").withColumn("extra", F.when(running <= F.col("__room"), 1).otherwise(0))
    return near.unionByName(placed.where("not __open").withColumn("extra", F.lit(0))).drop("__room", "__fits", "__before", "__open")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Reached share of every target source: records, distinct records, tokens, share, target_share."""
    per = mixed.groupBy("source").agg(F.sum("times").alias("records"), F.count(F.lit(1)).alias("distinct_records"), F.sum(F.col("tokens") * F.col("times")).alias("tokens"))
    joined = targets.select("source", "target_share").join(per, "source", "left").fillna(0, ["records", "distinct_records", "tokens"])
    whole = joined.agg(F.sum("tokens").alias("__whole"))  # one row
    return joined.crossJoin(whole).withColumn("share", F.when(F.col("__whole") > 0, F.col("tokens") / F.col("__whole")).otherwise(0.0)).drop("__whole")
