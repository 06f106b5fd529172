"""Problem 8: fill fixed-capacity containers, mixture-controlled by deficit round-robin."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.ordered import blocked_running_sum

#: Tokens that one packing partition is to hold. The number of partitions follows the data, their size does not.
PARTITION_TOKENS = 4_000_000
#: Of each queue so many items from its head may be served, so that a window can be filled without leaving the order of the queue far behind.
LOOK_AHEAD = 128
#: Partitions whose sums are added up in one block.
STRETCH = 4096


class _Queue:
    """The items of one source in order; the first LOOK_AHEAD of them are at hand, sorted by size."""

    def __init__(self, sizes: list[int], where: list[int]) -> None:
        self.rest = deque(zip(sizes, where))
        self.hand: list[tuple[int, int]] = []
        while self.rest and len(self.hand) < LOOK_AHEAD:
            insort(self.hand, self.rest.popleft())

    def least(self) -> int:
        return self.hand[0][0]

    def serve(self, room: int) -> tuple[int, int]:
        """The largest item at hand within room; of equal ones the last."""
        item = self.hand.pop(bisect_right(self.hand, (room, 1 << 62)) - 1)
        if self.rest:
            insort(self.hand, self.rest.popleft())
        return item


def fill(items: pd.DataFrame, capacity: int, shares: dict[str, float], carried: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Container numbers (from 0) of the items, which have columns source and tokens (1 to capacity), and for each item the gap of its container: how far the mix up to and with it is from the target.

    Deficit round-robin: each window, one container, adds a quantum of share x capacity tokens to the counter of every source that still has items; shares of sources that have run out go to the others in
    proportion. The source with the largest counter that has an item at hand small enough serves next and pays its size. What remains of the counters is carried into the next window. A
    window ends when no source has an item at hand that fits. Ties go to the source first by name. The gap is half the sum of all counters' sizes over the tokens served so far: 0 if the running mix is the target, and at most the size of an item or two for each source over those tokens.
    """
    queues: dict[str, _Queue] = {}
    for source, part in items.reset_index(drop=True).groupby("source", sort=True):
        queues[source] = _Queue(part["tokens"].tolist(), part.index.tolist())
    counter = {s: carried.get(s, 0.0) for s in queues}
    out, gaps, window, served = np.empty(len(items), dtype=np.int64), [], 0, 0
    while queues:
        room = capacity
        whole = sum(shares.get(s, 0.0) for s in queues)
        for s in queues:
            counter[s] += (shares.get(s, 0.0) / whole if whole > 0 else 1 / len(queues)) * capacity
        while True:
            ready = [s for s, q in queues.items() if q.least() <= room]
            if not ready:
                break
            s = max(ready, key=lambda x: counter[x])
            size, where = queues[s].serve(room)
            out[where] = window
            counter[s] -= size
            room -= size
            if not queues[s].hand:
                del queues[s]
        # room that stays empty is no one's deficit
        served += capacity - room
        for s in queues:
            counter[s] -= (shares.get(s, 0.0) / whole if whole > 0 else 1 / len(queues)) * room
        gaps.append(sum(abs(counter[s]) for s in queues) / 2 / served)
        window += 1
    return out, np.array(gaps)[out] if len(out) else np.empty(0)


def pack(docs: DataFrame, budgets: DataFrame, key: str = "doc_id", source: str = "source", tokens: str = "n_tokens", partition_tokens: int = PARTITION_TOKENS, targets: DataFrame | None = None) -> DataFrame:
    """Assigns every document to a container of every budget.

    docs has key (unique), source (null counts as a source of its own) and tokens; budgets has budget_id and max_tokens; targets, if given, has source and target_share, else each source's target is its share
    of all tokens, so that every window mirrors the whole. As every document is packed, targets hold as long as all sources last; then the sources left share among themselves. Documents without tokens need no room and come out with
    container_id null. A document above the capacity is split: its full parts have containers of their own and the rest is an item like others. No other document is split.

    The documents are hashed by key into partitions of about partition_tokens tokens, which fill their containers apart from each other in the order of a hash of the key. A partition begins with the deficits that those before it leave:
    the target's tokens of all before it less the tokens they had of the source, which is what their counters end with, since each serves all it has. These are sums by partition and source, joined by both. Only sizes are shuffled. Result:
    budget_id, container_id, key, part, source, tokens, gap (see fill). An empty input gives an empty result.
    """
    sized = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(source), F.lit("(none)")).alias("__source"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("__tokens"))
    total = sized.agg(F.sum("__tokens")).first()[0] or 0
    n_parts = max(1, -(-total // partition_tokens))
    sized = sized.withColumn("__pack", F.pmod(F.xxhash64("__key"), F.lit(n_parts)).cast("int"))
    sums = sized.groupBy("__pack", "__source").agg(F.sum("__tokens").alias("have"))
    if targets is None:
        shares = sums.groupBy("__source").agg((F.sum("have") / F.lit(float(max(1, total)))).alias("share"))
    else:
        shares = targets.groupBy(F.coalesce(F.col("source"), F.lit("(none)")).alias("__source")).agg(F.sum("target_share").alias("share"))
    parts_all = sums.groupBy("__pack").agg(F.sum("have").alias("all")).withColumn("__one", F.lit(0)).withColumn("__stretch", F.floor(F.col("__pack") / STRETCH))
    upto = blocked_running_sum(parts_all, ["__one"], "__stretch", ["__pack"], F.col("all"), "upto").select("__pack", (F.col("upto") - F.col("all")).alias("all_before"))
    own = blocked_running_sum(sums.withColumn("__stretch", F.floor(F.col("__pack") / STRETCH)), ["__source"], "__stretch", ["__pack"], F.col("have"), "own_upto").withColumn("own_before", F.col("own_upto") - F.col("have"))
    carried = (
        own.join(shares, "__source", "left").join(upto, "__pack").withColumn("share", F.coalesce("share", F.lit(0.0)))
        .groupBy("__pack").agg(F.collect_list(F.struct("__source", "share", (F.col("share") * F.col("all_before") - F.col("own_before")).cast("double").alias("carry"))).alias("__sources"))
    )
    caps = budgets.select(F.col("budget_id").cast("int").alias("budget_id"), F.col("max_tokens").cast("long").alias("__cap"))
    caps_here = [(r["budget_id"], r["__cap"]) for r in caps.orderBy("budget_id").collect()]  # a short fixed table
    each_cap = F.inline(F.array(*[F.struct(F.lit(i).alias("budget_id"), F.lit(c).cast("long").alias("__cap")) for i, c in caps_here]))
    each = sized.where(F.col("__tokens") > 0).select("*", each_cap)
    n_full = F.floor((F.col("__tokens") - 1) / F.col("__cap")).cast("int")
    parts = each.select("*", n_full.alias("__full"), F.explode(F.sequence(F.lit(0), n_full)).alias("part")).withColumn(
        "tokens", F.when(F.col("part") < F.col("__full"), F.col("__cap")).otherwise(F.col("__tokens") - F.col("__full") * F.col("__cap"))
    )
    # partitions are few: their carried deficits go to each budget
    starts = carried.select(F.col("__pack").alias("__right"), "__sources", each_cap).select("__right", "__sources", F.col("budget_id").alias("__budget"))
    kind = docs.schema[key].dataType.simpleString()

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"budget_id": [], "container_id": [], "__key": [], "part": [], "__source": [], "tokens": [], "gap": []})
        sources = list(right["__sources"].iloc[0]) if len(right) else []
        left = left.sort_values(["__order", "__key", "part"], kind="stable").reset_index(drop=True)
        number, gap = fill(left.rename(columns={"__source": "source"})[["source", "tokens"]], int(left["__cap"].iloc[0]), {r["__source"]: r["share"] for r in sources}, {r["__source"]: r["carry"] for r in sources})
        left["container_id"] = f"{left['__pack'].iloc[0]:06d}-" + pd.Series(number).map("{:08d}".format)
        left["gap"] = gap
        return left[["budget_id", "container_id", "__key", "part", "__source", "tokens", "gap"]]

    schema = f"budget_id int, container_id string, __key {kind}, part int, __source string, tokens long, gap double"
    ordered = parts.withColumn("__order", F.xxhash64("__key", F.lit(11)))
    placed = ordered.groupBy("budget_id", "__pack").cogroup(starts.groupBy("__budget", "__right")).applyInPandas(work, schema)
    rest = sized.where(F.col("__tokens") <= 0).select("*", each_cap).select("budget_id", F.lit(None).cast("string").alias("container_id"), "__key", F.lit(0).alias("part"), "__source", F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("double").alias("gap"))
    return placed.unionByName(rest).select("budget_id", "container_id", F.col("__key").alias(key), "part", F.col("__source").alias("source"), "tokens", "gap")


def containers(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """One row per container: its items, tokens, unused room, number of sources, and the gap between the running mix and the target."""
    per = packed.where(F.col("container_id").isNotNull()).groupBy("budget_id", "container_id").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"), F.countDistinct("source").alias("sources"), F.max("gap").alias("gap"))
    return per.join(budgets.select("budget_id", "max_tokens"), "budget_id").select("budget_id", "container_id", "items", "tokens", (F.col("max_tokens") - F.col("tokens")).cast("long").alias("unused"), "sources", F.round("gap", 6).alias("gap"))
