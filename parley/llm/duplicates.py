"""Problem 3: near-duplicate records with small edits, by dual traversal of signature trees; exact, without comparing all pairs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.components import connected_components
from parley.session import cut

THRESHOLD = "0.82"
#: Words are counted in so many hash buckets, which bounds what is broadcast whatever the vocabulary. The counts order the words; any order gives the same result.
COUNT_BUCKETS = 1 << 17
#: A signature has a column of 64 bits for so many words of a record of mean size.
WORDS_PER_COLUMN = 48
#: A node of the trees has so many children; so many pairs of nodes are looked at in one step.
FAN, PAIRS_AT_ONCE = 8, 10_000
#: A prefix group that may hold more records is cut into blocks, of which every two meet in a task of their own.
BLOCK = 8192
#: Keys of candidates that are broadcast, in bytes as written.
KEY_BYTES = 8 << 20
_WORD = re.compile(r"\w+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _hashes(texts: pd.Series, memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of all texts, one text after the other, and where each text begins (one entry more, the end)."""
    flat: list[int] = []
    ends = [0]
    for t in texts:
        for w in words_of(t):
            h = memo.get(w)
            if h is None:
                h = xxhash.xxh64_intdigest(w)
                if len(memo) < 500_000:
                    memo[w] = h
            flat.append(h)
        ends.append(len(flat))
    return np.array(flat, dtype=np.uint64), np.array(ends, dtype=np.int64)


def _digests(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set of words, in two parts, whatever the order of its words. Every set has a word."""
    mixed = (codes ^ (codes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return np.bitwise_xor.reduceat(mixed, ends[:-1]).view(np.int64), np.add.reduceat(codes * (codes | np.uint64(1)), ends[:-1]).view(np.int64)


def _fresh(h1: np.ndarray, h2: np.ndarray, seen: set) -> np.ndarray:
    """Which digests this task meets for the first time; seen is kept."""
    return np.array([(pair not in seen and not seen.add(pair)) for pair in zip(h1.tolist(), h2.tolist())], dtype=bool)


def survey(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, np.ndarray, int]:
    """One pass over all texts: (key, h1, h2) with the digest of each record's words, the sets in which a word of each bucket occurs, and the words of a set of mean size. A set counts once a task, however many records have it.

    Texts that are null or hold no word are left out.
    """
    kind = docs.schema[key].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the last place counts the sets themselves
        total, memo, seen = np.zeros(COUNT_BUCKETS + 1, dtype=np.int64), {}, set()
        for frame in frames:
            codes, ends = _hashes(frame[text], memo)
            some = np.diff(ends) > 0
            if not len(codes):
                continue
            h1, h2 = _digests(codes, np.concatenate((ends[:-1][some], ends[-1:])))
            new = _fresh(h1, h2, seen)
            fresh = np.repeat(new, np.diff(ends)[some])
            total += np.bincount((codes[fresh] % np.uint64(COUNT_BUCKETS)).astype(np.int64), minlength=COUNT_BUCKETS + 1)
            total[-1] += new.sum()
            yield pd.DataFrame({"key": frame[key].to_numpy()[some], "h1": h1, "h2": h2, "bucket": -1, "n": 0})
        at = np.flatnonzero(total)
        yield pd.DataFrame({"key": pd.Series([None] * len(at), dtype=object), "h1": 0, "h2": 0, "bucket": at, "n": total[at]})

    both = cut(docs.where(F.col(text).isNotNull()).select(key, text).mapInPandas(work, f"key {kind}, h1 long, h2 long, bucket int, n long"))
    marked = both.where("bucket < 0").select("key", "h1", "h2")
    rows = both.where("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNT_BUCKETS + 1, dtype=np.int64)
    counts[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
    return marked, counts[:-1], max(1, int(counts[:-1].sum()) // max(1, int(counts[-1])))


def _prefix_lengths(n: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """How many of its rarest words a record of n words must show as the smaller and as either member of a pair above t."""
    probe = n - n * t.numerator // t.denominator  # overlap > t n
    twice = 2 * t / (1 + t)
    index = n - n * twice.numerator // twice.denominator
    return np.clip(index, 1, n), np.clip(probe, 1, n)


def prefix_rows(docs: DataFrame, text: str, counts: np.ndarray, columns: int, t: Fraction) -> DataFrame:
    """(token, pair, h1, h2, meta, s0...): a row for each of the rarest words of each set of words; meta is twice the number of words, and one more where the word counts for the smaller member, and in its upper half the words that are rarer.

    A set comes once a task, however many records have it. A word's group that may outgrow BLOCK is cut into blocks by digest; its rows come once for every other block.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    sig = [f"s{i}" for i in range(columns)]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, memo, seen = shared.value, {}, set()
        for frame in frames:
            codes, ends = _hashes(frame[text], memo)
            size = np.diff(ends)
            if not len(codes):
                continue
            some = size > 0
            starts = np.concatenate((ends[:-1][some], ends[-1:]))
            size = size[some]
            h1, h2 = _digests(codes, starts)
            fresh = _fresh(h1, h2, seen)
            record = np.repeat(np.arange(len(size)), size)
            often = count[(codes % np.uint64(COUNT_BUCKETS)).astype(np.int64)]
            order = np.lexsort((codes, often, record))
            place = np.arange(len(codes)) - np.repeat(starts[:-1], size)
            index, probe = _prefix_lengths(size, t)
            bit = (codes >> np.uint64(40)) % np.uint64(64 * columns)
            mask = np.uint64(1) << (bit % np.uint64(64))
            signs = [np.bitwise_or.reduceat(np.where(bit // np.uint64(64) == i, mask, np.uint64(0)), starts[:-1]).view(np.int64) for i in range(columns)]
            keep = (place < probe[record]) & fresh[record]
            who, at, where = record[keep], order[keep], place[keep]
            blocks = np.maximum(1, -(-often[at] // BLOCK))
            copies = np.repeat(np.arange(len(at)), blocks)
            other = np.arange(len(copies)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            mine = (h1.view(np.uint64)[who] % blocks.astype(np.uint64)).astype(np.int64)[copies]
            who, at, where = who[copies], at[copies], where[copies]
            yield pd.DataFrame(
                {"token": codes[at].view(np.int64), "pair": np.minimum(mine, other) * (1 << 31) + np.maximum(mine, other), "h1": h1[who], "h2": h2[who], "meta": (where << 32) + size[who] * 2 + (where < index[who])}
                | {c: v[who] for c, v in zip(sig, signs)}
            )

    return docs.where(F.col(text).isNotNull()).select(text).mapInPandas(rows, "token long, pair long, h1 long, h2 long, meta long, " + ", ".join(f"{c} long" for c in sig))


@dataclass
class Level:
    """Nodes of one level of the trees of many groups, group by group: the OR of the bitmaps below, the range of sizes, the most words that a record below has beyond the bits of its bitmap, and the most that it has from the word of the group on. Level 0 holds the records."""

    union: np.ndarray
    low: np.ndarray
    high: np.ndarray
    slack: np.ndarray
    rest: np.ndarray
    first_child: np.ndarray
    children: np.ndarray


def trees(group: np.ndarray, size: np.ndarray, sig: np.ndarray, rest: np.ndarray | None = None) -> tuple[list[Level], list[np.ndarray]]:
    """The levels from the records up, and for each level the nodes that are roots; rows are in the order of groups. Every FAN neighbours of a group have a parent until the group has one node, its root, which stands at the level where that comes about."""
    none = np.empty(0, np.int64)
    levels, roots = [Level(sig, size, size, size - np.bitwise_count(sig).sum(axis=1, dtype=np.int64), size if rest is None else rest, none, none)], [none]
    open_ = np.arange(len(group))  # nodes of the last level whose group has more than one
    while len(open_):
        below, group = levels[-1], group[open_]
        place = np.arange(len(group))
        begins = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        place -= np.repeat(begins, np.diff(np.append(begins, len(group))))
        starts = np.flatnonzero(place % FAN == 0)
        levels.append(
            Level(
                np.bitwise_or.reduceat(below.union[open_], starts, axis=0), np.minimum.reduceat(below.low[open_], starts), np.maximum.reduceat(below.high[open_], starts), np.maximum.reduceat(below.slack[open_], starts), np.maximum.reduceat(below.rest[open_], starts),
                open_[starts], np.diff(np.append(starts, len(group))),
            )
        )
        group = group[starts]
        alone = np.concatenate(([True], group[1:] != group[:-1])) & np.concatenate((group[1:] != group[:-1], [True]))
        roots.append(np.flatnonzero(alone))
        open_ = np.flatnonzero(~alone)
    return levels, roots


def _may_meet(level: Level, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
    """Which pairs of nodes may hold a similar pair. The sizes must allow it, and the overlap that is possible at most must reach the one that is needed at least: words that two records share set bits of both bitmaps, so there are no more of them than common bits and words beyond the bits of the record. Nor are there more than words from that of the group on, where it is the rarest that both have; where it is not, they meet in another group."""
    keep = (level.high[i] > level.low[j] * t) & (level.high[j] > level.low[i] * t)
    needed = (level.low[i] + level.low[j]) * (t / (1 + t))
    keep &= np.minimum(level.rest[i], level.rest[j]) > needed
    i, j, needed, at = i[keep], j[keep], needed[keep], np.flatnonzero(keep)
    possible = np.minimum(level.slack[i], level.slack[j])
    for w in range(level.union.shape[1]):
        possible += np.bitwise_count(level.union[i, w] & level.union[j, w])
    keep[at] = possible > needed
    return keep


def _children(level: Level, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of pairs of nodes, each unordered pair once."""
    n = level.children[i] * level.children[j]
    of = np.repeat(np.arange(len(i)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    a, b = level.first_child[i[of]] + k // level.children[j[of]], level.first_child[j[of]] + k % level.children[j[of]]
    keep = (a <= b) | (i != j)[of]
    return a[keep], b[keep]


class _Records:
    """The records of the lowest nodes, as blocks of FAN that are compared whole."""

    def __init__(self, lowest: Level, size: np.ndarray, sig: np.ndarray, t: float) -> None:
        slot = lowest.first_child[:, None] + np.arange(FAN)[None, :]
        self.there = np.arange(FAN)[None, :] < lowest.children[:, None]
        self.slot = np.where(self.there, slot, 0)
        self.size = np.where(self.there, size[self.slot], -1).astype(np.float32)
        self.sig = [np.where(self.there, sig[self.slot, w], np.uint64(0)) for w in range(sig.shape[1])]
        self.high = self.size.max(axis=1)
        self.t = np.float32(t)
        # rounding must lose no pair
        self.share = np.float32((1 - t) / (1 + t) * (1 + 1e-6))

    def pairs(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Records of two nodes whose sizes fit and whose bitmaps differ in few enough bits; each unordered pair once. The first column of bits rules out nearly all; the others are looked at for what it leaves."""
        most = np.minimum((self.high[i] + self.high[j]) * self.share, 64).astype(np.uint8)
        p, x, y = np.nonzero(np.bitwise_count(self.sig[0][i][:, :, None] ^ self.sig[0][j][:, None, :]) <= most[:, None, None])
        x, y, same = (i[p], x), (j[p], y), (i == j)[p]
        differ = np.zeros(len(p), dtype=np.int64)
        for sig in self.sig:
            differ += np.bitwise_count(sig[x] ^ sig[y])
        a, b = self.size[x], self.size[y]
        keep = (differ <= (a + b) * self.share) & (np.maximum(a, b) * self.t < np.minimum(a, b) * np.float32(1 + 1e-6))
        x, y = self.slot[x][keep], self.slot[y][keep]
        once = (x < y) | ~same[keep]
        return x[once], y[once]


def tree_pairs(group: np.ndarray, size: np.ndarray, sig: np.ndarray, first: np.ndarray, t: float, rest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (smaller, larger) of the pairs of rows of one group whose similarity may exceed t, by dual traversal of the signature trees of all groups at once.

    From each root paired with itself the traversal goes down to pairs of children, and leaves out every pair of nodes whose sizes or bitmaps rule a similar pair out. Of the records that are left, the bits in which two
    differ must be few enough; the smaller one must show the word of the group among its rarest (first). rest has each record's words from that of the group on, in the order that all records share; a pair comes out at least
    in the group of the rarest word that both have.
    """
    size = size.astype(np.int64)
    rest = size if rest is None else rest.astype(np.int64)
    # records of one size with as many words left are neighbours, then those that share their first bits
    order = np.lexsort((sig[:, 0], rest, size, group))
    size, sig, first, rest = size[order], sig[order], first[order], rest[order]
    levels, roots = trees(group[order], size, sig, rest)
    # a root and itself always may meet
    todo = [(depth, r[at : at + PAIRS_AT_ONCE], r[at : at + PAIRS_AT_ONCE], True) for depth, r in enumerate(roots) for at in range(0, len(r), PAIRS_AT_ONCE)]
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    records = _Records(levels[1], size, sig, t) if len(levels) > 1 else None
    while todo:
        depth, i, j, sure = todo.pop()
        if not sure:
            keep = _may_meet(levels[depth], i, j, t)
            i, j = i[keep], j[keep]
        if depth > 1:
            a, b = _children(levels[depth], i, j)
            todo += [(depth - 1, a[at : at + PAIRS_AT_ONCE], b[at : at + PAIRS_AT_ONCE], False) for at in range(0, len(a), PAIRS_AT_ONCE)]
            continue
        i, j = records.pairs(i, j)
        i, j = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
        keep = (size[j] * t < size[i]) & (first[i] | (first[j] & (size[i] == size[j])))
        out_a.append(order[i[keep]])
        out_b.append(order[j[keep]])
    return np.concatenate(out_a), np.concatenate(out_b)


def candidate_pairs(rows: DataFrame, t: Fraction) -> DataFrame:
    """Pairs of digests (a1, a2, b1, b2) that the trees of the prefix groups leave, smaller one first, each once.

    Rows are hashed by group and sorted; a task reads its groups one after the other, and none outgrows two blocks and the copies of a set by task.
    """
    limit = float(t)
    sig_names = [c for c in rows.columns if c.startswith("s") and c[1:].isdigit()]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def pairs(frame: pd.DataFrame) -> pd.DataFrame:
            token, pair = frame["token"].to_numpy(), frame["pair"].to_numpy()
            cuts = np.flatnonzero((token[1:] != token[:-1]) | (pair[1:] != pair[:-1])) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(frame)]))
            meta = frame["meta"].to_numpy()
            size, first = (meta & 0xFFFFFFFF) // 2, meta % 2 == 1
            left = size - (meta >> 32)
            h1, h2 = frame["h1"].to_numpy(), frame["h2"].to_numpy()
            sig = np.column_stack([frame[c].to_numpy().view(np.uint64) for c in sig_names])
            # a word of one set alone brings nobody together
            n = ends - starts
            rows = np.flatnonzero(np.repeat(n > 1, n))
            if not len(rows):
                return pd.DataFrame({"a1": h1[:0], "a2": h2[:0], "b1": h1[:0], "b2": h2[:0]})
            i, j = tree_pairs(np.repeat(np.arange(len(n)), n)[rows], size[rows], sig[rows], first[rows], limit, left[rows])
            i, j = rows[i], rows[j]
            other = (h1[i] != h1[j]) | (h2[i] != h2[j])
            i, j = i[other], j[other]
            turned = (h1[i] > h1[j]) | ((h1[i] == h1[j]) & (h2[i] > h2[j]))
            i, j = np.where(turned, j, i), np.where(turned, i, j)
            return pd.DataFrame({"a1": h1[i], "a2": h2[i], "b1": h1[j], "b2": h2[j]}).drop_duplicates()

        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = (frame["token"].to_numpy() == frame["token"].iloc[-1]) & (frame["pair"].to_numpy() == frame["pair"].iloc[-1])
            done = len(frame) - int(last.sum())  # sorted, so that the last group is at the end
            if done:
                yield pairs(frame.iloc[:done])
            rest = frame.iloc[done:].reset_index(drop=True)
        if rest is not None and len(rest) > 1:
            yield pairs(rest)

    grouped = rows.repartition("token", "pair").sortWithinPartitions("token", "pair")
    return grouped.mapInPandas(work, "a1 long, a2 long, b1 long, b2 long").distinct()


def similar_pairs(docs: DataFrame, key: str = "chunk_id", text: str = "text", threshold: str = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, similarity) of class representatives whose word sets have a Jaccard similarity above threshold, and members (key, rep, n) of all classes of equal sets, n their size.

    key is unique and not null; rep is the least key of its class; threshold is a decimal above 0.5. Every pair above the threshold comes out: no candidate is lost, and the last check compares the words themselves. Null texts and
    texts without words are in no class and no pair. Other columns are not read.
    """
    t = Fraction(threshold)
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    marked, counts, mean = survey(base, "key", "text")
    reps = marked.groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n"))
    columns = min(16, -(-mean // WORDS_PER_COLUMN))
    candidates = candidate_pairs(prefix_rows(base, "text", counts, columns, t), t)
    named = (
        candidates.join(reps.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("rep").alias("x")), ["a1", "a2"])
        .join(reps.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("rep").alias("y")), ["b1", "b2"])
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )
    ends = cut(named).select("a", "b", F.explode(F.array("a", "b")).alias("key"))
    # the written keys have a known size in bytes: few are sent to the texts, else both sides meet by key
    keys = cut(ends.select("key").distinct())
    few = int(str(keys._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= KEY_BYTES
    near = base.join(F.broadcast(keys) if few else keys, "key", "left_semi")
    texts = ends.join(near, "key").groupBy("a", "b").agg(F.min("text").alias("x"), F.max("text").alias("y"))

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: str, q: str) -> float:
            u, v = words_of(p), words_of(q)
            k = len(u & v)
            return k / (len(u) + len(v) - k) if Fraction(k, len(u) + len(v) - k) > t else 0.0

        return pd.Series([one(p, q) for p, q in zip(x, y)])

    pairs = texts.select("a", "b", jaccard("x", "y").alias("similarity")).where("similarity > 0")
    return pairs, marked.join(reps, ["h1", "h2"]).select("key", "rep", "n")


def found(docs: DataFrame) -> DataFrame:
    """(chunk_id_a, chunk_id_b): all pairs of rows above the threshold, copies of one set of words included."""
    pairs, members = similar_pairs(docs)
    copies = members.where("n > 1")
    left = copies.select(F.col("rep").alias("a"), F.col("key").alias("x"))
    right = copies.select(F.col("rep").alias("b"), F.col("key").alias("y"))
    across = pairs.select("a", "b").join(left, "a", "left").join(right, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    within = left.join(right, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b"))


def versions(docs: DataFrame) -> DataFrame:
    """(chunk_id, class_id, version_of, links): one row per record with words; class_id joins equal word sets, version_of all that are linked, links counts the linked other classes."""
    pairs, members = similar_pairs(docs)
    pairs = cut(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    groups = connected_components(pairs).select(F.col("node").alias("rep"), "component")
    return (
        members.join(groups, "rep", "left").join(ends, "rep", "left").select(F.col("key").alias("chunk_id"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("version_of"), F.coalesce("links", F.lit(0)).alias("links"))
    )
