import math
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from parley.functions.text import text_similarity
from parley.operators import chunking, components, conversation, fusion, layout, lexical, nearest, ordered, signals, storage


def test_blocked_windows_equal_plain_ones(spark):
    r = random.Random(1)
    rows = [(r.choice("aaab"), r.randint(0, 40), i, r.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int").withColumn("b", F.floor(F.col("t") / 7))
    lagged = {x.i: x.out for x in ordered.blocked_lag(df, ["k"], "b", ["t", "i"], F.col("v"), "out").collect()}
    summed = {x.i: x.out for x in ordered.blocked_running_sum(df, ["k"], "b", ["t", "i"], F.col("v"), "out").collect()}
    for k in "ab":
        last, total = None, 0
        for _, _, i, v in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2])):
            total += v
            assert lagged[i] == last and summed[i] == total
            last = v


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (20, 20), (None, 1)] + [(k, k + 1) for k in range(100, 140)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[4] == 1 and got[11] == 10 and got[20] == 20 and got[140] == 100
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_long_paths(spark):
    shuffled = random.Random(7).sample(range(1000, 1400), 400)
    falling = [0, *range(200, 0, -1)]
    edges = [*zip(shuffled, shuffled[1:]), *zip(falling, falling[1:])]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1000 for k in range(1000, 1400)} | {k: 0 for k in range(201)}


def test_rank_fusion(spark):
    lists = {"semantic": [(1, "a", 1), (1, "b", 2), (1, "c", 3)], "bm25": [(1, "b", 1), (1, "d", 2)]}
    dfs = {n: spark.createDataFrame(rows, "query_id int, id string, rank int") for n, rows in lists.items()}
    rows = fusion.fused_order(fusion.reciprocal_rank_fusion(dfs, "id"), list(dfs), "id", 10).orderBy("final_rank").collect()
    assert [(x.id, x.score) for x in rows] == [("b", 0.032522), ("a", 0.016393), ("d", 0.016129), ("c", 0.015873)]
    assert (rows[0].semantic_rank, rows[0].bm25_rank) == (2, 1)


def test_effective_score_passes_over_zero(spark):
    assert spark.range(1).select(fusion.effective_score(F.lit(0.0), F.lit(0.03), F.lit(None).cast("double")).alias("x")).first().x == 0.03


def _ranked(spark, rows):
    return spark.createDataFrame([Row(query_id=1, chunk_id=c, doc_id=d, source_filename=None, section_path=["s"], page_start=p, page_end=p, text=t, score=s) for c, d, p, t, s in rows], "query_id int, chunk_id string, doc_id string, source_filename string, section_path array<string>, page_start int, page_end int, text string, score double")


def test_context_budget_skips_and_drops_duplicates(spark):
    words = lambda n, w: " ".join(f"{w}{k}" for k in range(n))
    rows = [("a", "1", 1, words(960, "a"), 0.9), ("b", "2", 1, words(1460, "b"), 0.8), ("c", "3", 1, words(560, "c"), 0.7), ("d", "4", 1, words(160, "d"), 0.6), ("e", "1", 2, words(960, "a"), 0.5), ("f", "5", 9, None, 0.4)]
    got = fusion.budgeted_context(_ranked(spark, rows)).orderBy("position").collect()
    assert [x.chunk_id for x in got] == ["a", "b", "d", "f"]
    assert sum(x.context_tokens for x in got) <= 2800
    big = fusion.budgeted_context(_ranked(spark, [("a", "1", 1, words(5000, "a"), 0.9), ("b", "1", 1, "x", 0.8)])).collect()
    assert [(x.chunk_id, x.context_tokens) for x in big] == [("a", 2800)]
    assert fusion.budgeted_context(_ranked(spark, [])).count() == 0


def test_bm25_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "red house red"), (2, None), (3, ""), (4, "blue house")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "red"), (2, None), (3, "nothing"), (4, "house house")], "query_id int, query string")
    made = lexical.index(docs, "doc_id", "text")
    got = {(x.query_id, x.doc_id): x.score for x in lexical.bm25_best(made, queries, 10).collect()}
    assert set(got) == {(1, 1), (4, 1), (4, 4)}
    single = lexical.bm25_best(made, spark.createDataFrame([(9, "house")], "query_id int, query string"), 10).where("doc_id = 4").first().score
    assert abs(got[4, 4] - 2 * single) < 2e-6
    of_pairs = {(x.query_id, x.doc_id): x.score for x in lexical.bm25_of_pairs(made, queries, spark.createDataFrame([(4, 4), (1, 4), (1, 1)], "query_id int, doc_id int")).collect()}
    assert set(of_pairs) == {(4, 4), (1, 1)} and all(abs(of_pairs[k] - got[k]) < 1e-6 for k in of_pairs)
    assert lexical.bm25_best(made, queries.limit(0), 3).count() == 0 and lexical.bm25_best(lexical.index(docs.limit(0), "doc_id", "text"), queries, 3).count() == 0


@pytest.mark.parametrize("terms, pairs", [(1_000_000, 4_000_000), (3, 2)])
def test_bm25_in_blocks_equals_brute_force(spark, monkeypatch, terms, pairs):
    monkeypatch.setattr(lexical, "QUERY_TERMS", terms)
    monkeypatch.setattr(lexical, "PAIRS_AT_ONCE", pairs)
    r = random.Random(6)
    words = [f"w{chr(97 + k)}" for k in range(20)]
    texts = [" ".join(r.choice(words[: r.choice((3, 20))]) for _ in range(r.randint(0, 15))) for _ in range(60)]
    asked = [" ".join(r.choice(words) for _ in range(r.randint(0, 5))) for _ in range(7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    tokens = [t.split() for t in texts]
    avg = sum(map(len, tokens)) / len(tokens)
    want = []
    for q, query in enumerate(asked):
        scored = []
        for d, ts in enumerate(tokens):
            s = 0.0
            for t in query.split():
                df, tf = sum(t in x for x in tokens), ts.count(t)
                s += math.log(1 + (60 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avg))
            if s > 0:
                scored.append((-round(s, 6), d))
        want += [(q, d, -s, k + 1) for k, (s, d) in enumerate(sorted(scored)[:5])]
    got = sorted((x.query_id, x.doc_id, x.score, x["rank"]) for x in lexical.bm25_best(lexical.index(docs, "doc_id", "text"), queries, 5).collect())
    assert [g[:2] + g[3:] for g in sorted(got, key=lambda g: (g[0], g[3]))] == [w[:2] + w[3:] for w in want] and all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(sorted(got, key=lambda g: (g[0], g[3])), want))


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    rows = [(k, [float(v) for v in x[k]], k % 3) for k in range(120)] + [(500, None, 0), (501, [0.0] * 8, 1), (502, [1.0], 2)]
    v = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int")
    q = v.where("vec_id % 10 = 0 and vec_id < 120").withColumnRenamed("vec_id", "query_id")
    got = nearest.nearest(v, q, 4, same="label").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(0, 120, 10):
        mates = [j for j in range(120) if j % 3 == k % 3]
        want = sorted(mates, key=lambda j: (-round(float(u[k].astype(float) @ u[j].astype(float)), 6), j))[:4]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == k), key=lambda r: r["rank"])] == want
    assert nearest.nearest(v, q.limit(0), 3).count() == 0


def test_chunk_folds(spark):
    def run(column):
        return spark.range(1).select(column.alias("x")).first().x

    array = lambda *v: F.array(*[F.lit(a) for a in v])
    assert run(chunking.semantic_floor_merge(array(50, 120, 30, 90, 200))) == [290, 200]
    assert run(chunking.greedy_groups(array(0.9, 0.5), array(60, 60, 60))) == [0, 0, 1]
    assert run(chunking.greedy_groups(array(0.41), array(50, 10))) == [0, 1]
    assert run(chunking.split_points(array(0.9, 0.9, 0.1, 0.1, 0.1, 0.9, 0.9))) == [3]
    assert run(chunking.split_points(array(0.1, 0.2))) == []
    assert run(chunking.accepted_splits(array(1, 0), array(100, 60, 100, 40))) == [2]
    assert run(chunking.trailing_overlap(array(10, 30, 25, 40), F.lit(3))) == 2
    assert run(chunking.trailing_overlap(array(10, 90), F.lit(2))) == 1


def test_floor_groups(spark):
    rows = [("d", k, f"c{k}", "x", 1, 1, n) for k, n in enumerate([40, 120, 30, 99, 100, 20])]
    df = spark.createDataFrame(rows, "doc_id string, ord int, chunk_id string, text string, page_start int, page_end int, token_count int")
    groups = chunking.merged_groups(chunking.floor_groups(df)).orderBy("group_no").collect()
    assert [x.merged_from for x in groups] == [["c0"], ["c1", "c2", "c3"], ["c4", "c5"]]


def _turns(spark, rows):
    return conversation.ordered_turns(spark.createDataFrame([(i, "s", sp, t, float(1000 + i)) for i, (sp, t) in enumerate(rows)], "id int, session_id string, speaker string, raw_text string, ts double"))


def test_speaker_runs_and_questions(spark):
    runs = conversation.speaker_runs(_turns(spark, [("Customer", "a"), ("Customer", "b"), ("Worker", "c"), ("Customer", " "), ("Customer", "d")])).orderBy("run_no").collect()
    assert [(x.role, x.text) for x in runs] == [("Customer", "a b"), ("Worker", "c"), ("Customer", "d")]
    made = conversation.question_turns(_turns(spark, [("Worker", "hi"), ("Customer", "q1"), ("Assistant", "a1"), ("Assistant", "a2"), ("Worker", "w1"), ("Worker", "w2"), ("Customer", "q2")])).orderBy("turn_no").collect()
    assert [(x.customer, x.assistant, x.worker) for x in made] == [("", "", "hi"), ("q1", "a2", "w1\nw2"), ("q2", "", "")]


def test_merge_partials(spark):
    got = spark.range(1).select(conversation.merge_partials(F.array(*map(F.lit, ["I want", "I want to", "I want", "buy", "buy", " "]))).alias("x")).first().x
    assert got == ["I want to", "buy"]


def test_storage(spark):
    old = spark.createDataFrame([("a", 1, "x"), (None, 2, "y")], "k string, v int, keep string")
    new = spark.createDataFrame([("a", 9, "z"), ("b", 3, "w"), (None, 7, "q")], "k string, v int, keep string")
    got = {x.k: (x.v, x.keep) for x in storage.upsert(old, new, ["k"], keep=("keep",)).collect()}
    assert got == {"a": (9, "x"), "b": (3, "w"), None: (7, "y")}
    assert [x.k for x in storage.insert_or_ignore(old, new.where("k is not null"), ["k"]).collect()] == ["b"]
    assert storage.last_by_key(new.limit(0), ["k"], F.col("v")).count() == 0
    assert storage.unexpired(spark.createDataFrame([(1, 100.0), (2, None), (3, -1e9)], "i int, c double"), F.col("c"), F.lit(200.0), 1).count() == 1


def test_echoes_equal_brute_force(spark):
    rows = [(1, "s", 10.0, "I want to pay"), (2, "s", 12.6, "want to pay"), (3, "s", 12.4, "I want to pay now"), (4, "t", 12.0, "I want to pay")]
    df = spark.createDataFrame(rows, "id int, session string, time double, text string")
    got = signals.echoes(df.where("id in (2, 3)"), df.where("id in (1, 4)")).collect()
    assert [(x.id, x.matched_id, x.kind) for x in got] == [(3, 1, "weak")]
    same = spark.range(1).select(F.round(text_similarity(F.lit(rows[2][3]), F.lit(rows[0][3])), 6).alias("x")).first().x
    assert got[0].similarity == same


def test_channel_activity(spark):
    assert spark.range(1).select(signals.channel_activity(F.lit(100.0), F.lit(101.0), 100.0).alias("x")).first().x == "worker_only"


def test_layout(spark):
    schema = "doc_id string, ord int, block_id string, type string, page int, text string, bbox array<double>, level int"
    rows = [
        ("d", 0, "h1", "section_heading", 1, "One", None, 1), ("d", 1, "p1", "paragraph", 1, "before", None, None), ("d", 2, "e1", "equation", 1, "a = b", [0.0, 100.0, 50.0, 120.0], None), ("d", 3, "h2", "section_heading", 1, "Sub", None, 2),
        ("d", 4, "p2", "paragraph", 1, "after", None, None), ("d", 5, "t1", "table", 1, "", [0.0, 300.0, 50.0, 400.0], None), ("d", 6, "c1", "caption", 1, "Table 1 x", [0.0, 410.0, 50.0, 420.0], None), ("d", 7, "c2", "caption", 2, "free", None, None),
        ("d", 8, "f1", "figure", 1, "", [0.0, 780.0, 50.0, 790.0], None), ("d", 9, "h3", "section_heading", 2, "Two", None, 1), ("d", 10, "p3", "paragraph", 2, "x", None, None),
    ]
    blocks = spark.createDataFrame(rows, schema)
    assert layout.retype_margins(blocks).where("block_id = 'f1'").first().type == "page_marginal"
    attached, orphans = layout.attach_captions(blocks)
    assert [(x.asset_id, x.caption) for x in attached.collect()] == [("t1", "Table 1 x")]
    assert [x.caption for x in orphans.collect()] == ["free"]
    e = layout.equation_neighbours(blocks).first()
    assert (e.before, e.after) == ("before", "after")
    paths = {x.block_id: x.section_path for x in layout.section_paths(blocks).collect()}
    assert paths["p2"] == ["One", "Sub"] and paths["p3"] == ["Two"]
    table = spark.range(1).select(layout.table_markdown(F.expr("array(array('a', 'b|c'), array('1'))")).alias("x")).first().x
    assert table == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    found = spark.range(1).select(layout.markdown_table(F.lit("x\n```\n| a |\n| - |\n```\ny")).alias("x")).first().x
    assert found == "| a |\n| - |"


def test_bm25_keeps_the_best_of_a_whole_task(spark, monkeypatch):
    """What a task returns does not grow with its records, however many batches and tiles they come in; ties go by key."""
    docs = spark.range(600, numPartitions=2).select((599 - F.col("id")).alias("doc_id"), F.expr("'common word x' || char(97 + id % 11)").alias("text"))
    queries = spark.range(9).select(F.col("id").alias("query_id"), F.expr("'common x' || char(97 + id)").alias("query"))
    seen, against = [], lexical.against
    monkeypatch.setattr(lexical, "against", lambda *a, **k: seen.append(against(*a, **k)) or seen[-1])
    made = lexical.index(docs, "doc_id", "text")
    got = lexical.bm25_best(made, queries, 3)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        assert seen[0].count() <= made.terms.rdd.getNumPartitions() * 9 * 3
        best = {q: [r.doc_id for r in got.where(f"query_id = {q}").orderBy("rank").collect()] for q in (0, 8)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert best == {q: sorted(599 - i for i in range(600) if i % 11 == q)[:3] for q in (0, 8)}


def test_best_of_tiles_as_brute_force():
    r = np.random.default_rng(3)
    score, keys = r.integers(0, 6, (5, 400)).astype(float), np.array([f"k{n:03d}" for n in r.permutation(400)], dtype=object)
    kept = lexical._Best(5, 4)
    for low in range(0, 400, 16):
        order = low + np.argsort(keys[low : low + 16])
        kept.tile(score[:, order], keys[order], 6)
    kept.settle()
    assert list(zip(kept.q.tolist(), (-kept.score).tolist(), kept.keys)) == [(q, *x) for q in range(5) for x in sorted((-s, k) for s, k in zip(score[q], keys) if s > 0)[:4]]


def test_frequencies_are_counted_before_tokens_are_shuffled(spark):
    """What is sent for a term is one count of each task, not a row of each record that holds it."""
    docs = spark.range(400, numPartitions=2).select(F.col("id").alias("doc_id"), F.expr("case when id % 4 = 0 then 'common common rare' when id % 4 = 1 then null else 'common' end").alias("text"))
    queries = spark.createDataFrame([(1, "common common absent"), (2, "rare"), (3, None)], "query_id int, query string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        terms = lexical.weighted_terms(lexical.index(docs, "doc_id", "text"), queries, "query_id", "query")
        plan = terms._jdf.queryExecution().executedPlan().toString().split("\n")
        rows = sorted((x.query_id, x.times, round(x.idf, 9)) for x in terms.collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    exploded = next(n for n, line in enumerate(plan) if "Generate explode(array_distinct" in line)
    above = next(line for line in reversed(plan[:exploded]) if "Exchange" in line or "HashAggregate" in line)
    assert "HashAggregate" in above and "partial_count" in above
    assert rows == [(q, n, round(math.log(1 + (400 - df + 0.5) / (df + 0.5)), 9)) for q, n, df in ((1, 2, 300), (2, 1, 100))]
