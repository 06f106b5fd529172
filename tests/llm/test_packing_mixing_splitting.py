import random
from collections import defaultdict

import pytest

from parley.llm import mixing, packing, splitting, tokens


def docs(spark, n=300, seed=1, extra=()):
    r = random.Random(seed)
    rows = [(k, r.choice(["a", "a", "a", "b", "c"]), r.choice(["en", "EN", None, "de-DE"]), r.randint(1, 700)) for k in range(n)]
    return spark.createDataFrame(rows + list(extra), "doc_id long, source string, lang string, n_tokens int")


def budgets(spark):
    return spark.createDataFrame([(1, 512), (2, 1000)], "budget_id int, max_tokens int")


@pytest.mark.parametrize("partition_tokens", [10_000, 10_000_000])
def test_packing_places_all_and_splits_only_oversized(spark, partition_tokens):
    given = docs(spark, extra=[(1000, "b", "en", 2500), (1001, None, None, 0), (1002, "b", "en", None)])
    out = packing.pack(given, budgets(spark), partition_tokens=partition_tokens).collect()
    sizes = {r.doc_id: r.n_tokens or 0 for r in given.collect()}
    for budget, cap in ((1, 512), (2, 1000)):
        mine = [r for r in out if r.budget_id == budget]
        room, placed, parts = defaultdict(int), defaultdict(int), defaultdict(int)
        for r in mine:
            placed[r.doc_id] += r.tokens
            parts[r.doc_id] += 1
            if r.container_id is None:
                assert r.tokens == 0
            else:
                room[r.container_id] += r.tokens
        assert placed == sizes
        assert max(room.values()) <= cap
        assert all(parts[d] == max(1, -(-n // cap)) for d, n in sizes.items())
    if partition_tokens > 10_000:
        used = [r for r in out if r.budget_id == 2 and r.container_id]
        count = len({r.container_id for r in used})
        assert sum(r.tokens for r in used) / (count * 1000) > 0.97


def test_packing_windows_follow_the_mix(spark):
    rows = [(k, "big" if k % 4 else "small", "en", 50) for k in range(4000)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens int"), spark.createDataFrame([(1, 2000)], "budget_id int, max_tokens int")).collect()
    share = defaultdict(lambda: [0, 0])
    for r in out:
        share[r.container_id][r.source == "small"] += r.tokens
    full = [s for s in share.values() if sum(s) == 2000]
    assert len(full) >= 95 and all(abs(s[1] / 2000 - 0.25) <= 0.05 for s in full)


def test_packing_follows_targets_while_sources_last(spark):
    rows = [(k, "abc"[k % 3], "en", 20 + k % 60) for k in range(6000)]
    given = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens int")
    want = spark.createDataFrame([("a", 0.6), ("b", 0.3), ("c", 0.1)], "source string, target_share double")
    out = packing.pack(given, spark.createDataFrame([(1, 2000)], "budget_id int, max_tokens int"), targets=want).collect()
    by_window = defaultdict(lambda: defaultdict(int))
    for r in out:
        by_window[r.container_id][r.source] += r.tokens
    windows = [by_window[c] for c in sorted(by_window)]
    early = windows[: len(windows) // 3]
    off = [sum(abs(w[s] / sum(w.values()) - t) for s, t in (("a", 0.6), ("b", 0.3), ("c", 0.1))) / 2 for w in early]
    assert sum(off) / len(off) < 0.05 and max(off) < 0.2
    gaps = {r.container_id: r.gap for r in out}
    assert gaps[sorted(gaps)[len(windows) // 4]] < 0.01


def test_packing_carries_deficits_over_partitions(spark):
    """Summed up over partitions, each source is never far behind its target."""
    rows = [(k, "a" if k % 5 else "b", "en", 100) for k in range(5000)]
    given = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens int")
    out = packing.pack(given, spark.createDataFrame([(1, 1000)], "budget_id int, max_tokens int"), partition_tokens=50_000).collect()
    seen = defaultdict(int)
    for r in sorted(out, key=lambda r: r.container_id):
        seen[r.source] += r.tokens
        assert abs(seen["b"] - 0.2 * sum(seen.values())) < 6000


def test_packing_empty(spark):
    assert packing.pack(docs(spark, 0), budgets(spark)).count() == 0
    assert packing.containers(packing.pack(docs(spark, 0), budgets(spark)), budgets(spark)).count() == 0


def targets(spark):
    return spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)], "source string, target_share double, max_repeats int")


@pytest.mark.parametrize("range_rows", [50_000, 100])
def test_mix_reaches_shares(spark, range_rows):
    chosen = mixing.mix(docs(spark, 3000), targets(spark), 60_000, {"x": ("a", "b")}, range_rows=range_rows)
    rows = {r.source: r for r in mixing.shares(chosen, targets(spark)).collect()}
    assert all(abs(r.share - r.target_share) < 0.02 for r in rows.values())
    assert chosen.count() == chosen.select("doc_id").distinct().count()


def test_mix_repeats_and_shortage(spark):
    rows = [(k, "a", "en", 100) for k in range(1000)] + [(5000 + k, "b", "en", 100) for k in range(10)]
    given = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens int")
    want = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    out = mixing.mix(given, want, 20_000).collect()
    assert {r.times for r in out if r.source == "b"} == {3} and sum(r.tokens * r.times for r in out if r.source == "b") == 3000
    assert sum(r.tokens * r.times for r in out) == 20_000
    partial = mixing.mix(given, want, 3_000).collect()
    assert sum(r.tokens * r.times for r in partial if r.source == "b") == 1500 and max(r.times for r in partial) == 2
    assert mixing.mix(given.limit(0), want, 100).count() == 0


def test_mix_is_the_same_again(spark):
    a = mixing.mix(docs(spark, 500), targets(spark), 9_000).select("doc_id", "times").collect()
    b = mixing.mix(docs(spark, 500).repartition(7), targets(spark), 9_000).select("doc_id", "times").collect()
    assert sorted(a) == sorted(b)


TEXTS = [None, "", "   \n", "short text", "word " * 1500, "x" * 5000, "a b.\n\n" * 700, "नमस्ते दुनिया। " * 600, "- - - " * 900]


@pytest.mark.parametrize("tokenizer", [None, tokens.default_path()])
def test_pieces_fit_cover_and_overlap(spark, tokenizer):
    given = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    out = defaultdict(list)
    for r in splitting.split_oversized(given, [(7, 200, 20)], tokenizer=tokenizer).orderBy("doc_id", "piece_no").collect():
        out[r.doc_id].append(r)
    whole = {r.doc_id: r.n_tokens for r in tokens.with_token_count(given).collect()} if tokenizer else {r.doc_id: r.n for r in given.select("doc_id", tokens.word_count(given["text"]).alias("n")).collect()}
    for k, text in enumerate(TEXTS):
        assert (k in out) == (whole[k] > 200)
        pieces = out.get(k, [])
        for p in pieces:
            assert p.piece_text == text[p.char_start : p.char_end] and p.n_tokens <= 200 and p.budget_id == 7
            assert p.n_tokens == (len(tokens.encoding(tokenizer).encode_ordinary(p.piece_text)) if tokenizer else len(splitting._WORD.findall(p.piece_text)))
        if pieces:
            assert pieces[0].char_start == 0 and pieces[-1].char_end == len(text)
            for a, b in zip(pieces, pieces[1:]):
                shared = text[b.char_start : a.char_end]
                assert b.char_start <= a.char_end and b.shared_tokens <= 20
                if tokenizer is None:
                    assert len(splitting._WORD.findall(shared)) == 20
    assert sorted(r.doc_id for r in splitting.found(given, 200, 20).collect()) == sorted(k for k in range(len(TEXTS)) if (len(splitting._WORD.findall(TEXTS[k] or "")) > 200))


def test_cuts_are_at_paragraphs(spark):
    text = ("one two three four five. " * 8 + "\n\n") * 6
    spans = splitting.bisect(text, 100, 0)
    assert all(text[:a].endswith("\n\n") for a, *_ in spans[1:])
    spans = splitting.bisect(text, 100, 0, tokens.default_path())
    assert len(spans) > 1 and all(text[:a].endswith("\n\n") for a, *_ in spans[1:])


def test_all_budgets_in_one_pass(spark):
    given = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    path = tokens.default_path()
    both = splitting.split_oversized(given, [(1, 200, 20), (2, 900, 0)], tokenizer=path)
    for budget, limit, overlap in ((1, 200, 20), (2, 900, 0)):
        alone = splitting.split_oversized(given, [(budget, limit, overlap)], tokenizer=path)
        assert sorted(both.where(f"budget_id = {budget}").collect()) == sorted(alone.collect())
