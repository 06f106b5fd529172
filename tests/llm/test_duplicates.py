import itertools
import random

import numpy as np
import pytest

from parley.llm import duplicates as D


def brute(rows):
    sets = {k: D.words_of(t) for k, t in rows if t and D.words_of(t)}
    return sorted((a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) * 100 > 82 * len(sets[a] | sets[b]))


def make(seed, n=160):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        if rows and r.random() < 0.6:
            base = r.choice(rows)[1].split()
            for _ in range(r.choice((0, 1, 2, 4, 8, 12))):
                what = r.random()
                if what < 0.4 and len(base) > 3:
                    base.pop(r.randrange(len(base)))
                elif what < 0.8:
                    base.insert(r.randrange(len(base) + 1), r.choice(words))
                else:
                    r.shuffle(base)
            text = " ".join(base)
        else:
            text = " ".join(r.sample(words, r.choice((2, 5, 20, 60, 90))))
        rows.append((f"id{k:04d}", text))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block", [8192, 7])
def test_all_pairs_as_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(D, "BLOCK", block)
    rows = make(seed) + [("n1", None), ("n2", ""), ("n3", " ... "), ("u1", "Größe ÄÖ ist WICHTIG"), ("u2", "größe äö ist wichtig")]
    got = D.found(spark.createDataFrame(rows, "chunk_id string, text string")).collect()
    assert sorted((r.chunk_id_a, r.chunk_id_b) for r in got) == brute(rows)


@pytest.mark.parametrize("fan, step", [(2, 7), (3, 40_000), (64, 5)])
def test_trees_of_any_shape(spark, monkeypatch, fan, step):
    monkeypatch.setattr(D, "FAN", fan)
    monkeypatch.setattr(D, "PAIRS_AT_ONCE", step)
    rows = make(9, 120)
    got = D.found(spark.createDataFrame(rows, "chunk_id string, text string")).collect()
    assert sorted((r.chunk_id_a, r.chunk_id_b) for r in got) == brute(rows)


def test_traversal_loses_no_pair_and_prunes():
    """One group with all records: what the dual traversal leaves holds all similar pairs, and is a small part of all."""
    r = np.random.default_rng(5)
    base = [set(r.choice(5000, 60, replace=False).tolist()) for _ in range(120)]
    sets = [s if k % 2 else (s - set(list(s)[:3])) | set(r.choice(5000, 2).tolist()) for s in base for k in range(2)]
    size = np.array([len(s) for s in sets])
    sig = np.zeros((len(sets), 3), dtype=np.uint64)
    for k, s in enumerate(sets):
        for w in s:
            bit = w * 2654435761 % 192
            sig[k, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
    a, b = D.tree_pairs(np.zeros(len(sets), dtype=np.int64), size, sig, np.ones(len(sets), dtype=bool), 0.82)
    left = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    true = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) > 0.82 * len(sets[i] | sets[j])}
    assert true and true <= left and len(left) < 0.05 * len(sets) ** 2 / 2
    levels, roots = D.trees(np.repeat([0, 1], [len(sets) - 3, 3]), size, sig)
    assert len(levels[-1].low) == 1 and [len(r) for r in roots] == [0, 1, 0, 1]


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "KEY_BYTES", 0)
    rows = make(4, 100)
    got = D.found(spark.createDataFrame(rows, "chunk_id string, text string")).collect()
    assert sorted((r.chunk_id_a, r.chunk_id_b) for r in got) == brute(rows)


def test_many_copies_and_extra_columns(spark):
    rows = [(f"c{k:03d}", "the same words in every one", "x", "y") for k in range(60)] + [("z", "quite another text here", "x", "y")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, key string, rep string")
    assert D.found(df).count() == 60 * 59 // 2
    v = D.versions(df).collect()
    assert len(v) == 61 and {r.class_id for r in v} == {"c000", "z"} and {r.links for r in v} == {0}


def test_versions_join_chains(spark):
    base = [f"w{k}" for k in range(40)]
    rows = [(f"c{k}", " ".join(base[k:] + [f"v{j}" for j in range(k)])) for k in range(12)]
    v = {r.chunk_id: r for r in D.versions(spark.createDataFrame(rows, "chunk_id string, text string")).collect()}
    assert {r.version_of for r in v.values()} == {"c0"} and v["c0"].links == 3


def test_empty(spark):
    assert D.found(spark.createDataFrame([], "chunk_id string, text string")).count() == 0
    assert D.versions(spark.createDataFrame([], "chunk_id string, text string")).count() == 0


def test_pairs_meet_where_their_rarest_common_word_is():
    """Words 0, 1, 2 are the rarest in this order; in the group of word 2 only records that share no rarer word are compared."""
    n = 40
    size, sig, first = np.full(4, n), np.full((4, 1), (1 << 40) - 1, dtype=np.uint64), np.ones(4, dtype=bool)
    few = D._prefix_lengths(np.array([n]), D.Fraction("0.82"))[0][0]
    rest = np.array([n, n, n - few, n - few - 1])
    a, b = D.tree_pairs(np.zeros(4, dtype=np.int64), size, sig, first, 0.82, rest)
    needed = 2 * n * 0.82 / 1.82
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} >= {(0, 1)}
    levels, roots = D.trees(np.zeros(4, dtype=np.int64), size, sig, rest[[3, 3, 3, 3]])
    assert (levels[1].rest <= needed).all() and not D._may_meet(levels[1], np.array([0]), np.array([0]), 0.82).any()
