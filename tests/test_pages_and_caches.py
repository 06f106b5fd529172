"""Operators of layout, caches and blocks on small cases."""

import pytest
from pyspark.sql import functions as F

from parley import session
from parley.operators import chunking, conversation, layout, nearest, signals, storage
from parley.operators.ordered import made_once
from parley.plans import pages


def _row(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_equations_and_figures(spark):
    notes = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("class")) for k, c in (("x", "logo"), ("classification", "chart"), ("classification", "Icon"))])
    r = _row(spark, layout.figure_class(notes).alias("c"), layout.is_logo(notes).alias("l"), layout.is_logo(F.lit(None).cast("array<struct<kind:string,class:string>>")).alias("n"), layout.equation_label(F.lit("a = b (12a) ")).alias("e"), layout.equation_label(F.lit(None)).alias("f"))
    assert (r.c, r.l, r.n, r.e, r.f) == ("chart", True, False, "12a", None)
    better = _row(spark, layout.repaired_equation(F.lit("/Sigma a"), F.lit("Σ a = b")).alias("x"), layout.repaired_equation(F.lit("a = b"), F.lit("a = c")).alias("y"))
    assert (better.x.source, better.y.source, better.y.text) == ("second", "first", "a = b")
    assert _row(spark, signals.packet_bytes(4096, 3).alias("b")).b == 24576


def test_markdown_lines_keep_their_digits(spark):
    text = "intro\n| 0a | 1 |\n| 2 | 3 |\n|4|5|\n"
    assert _row(spark, layout.markdown_table(F.lit(text)).alias("t")).t == "| 0a | 1 |\n| 2 | 3 |\n|4|5|"


def test_similar_cache(spark):
    asked = spark.createDataFrame([(1, "s", 1000.0, [1.0, 0.0]), (2, "s", 10.0, [1.0, 0.0]), (3, "t", 1000.0, [1.0, 0.0]), (4, None, 5.0, None)], "query_id int, session string, at double, vector array<double>")
    entries = spark.createDataFrame(
        [(10, "s", 900.0, [1.0, 0.0]), (11, "s", 950.0, [1.0, 0.0]), (12, "s", 960.0, [0.6, 0.8]), (13, "s", 1000.0, [1.0, 0.0]), (14, "s", 970.0, [1.0]), (15, "s", 800.0, [1.0, 0.0]), (16, "s", 980.0, None)], "entry_id int, session string, at double, vector array<double>"
    )
    got = {r.query_id: (r.entry_id, r.similarity) for r in storage.similar_cached(asked, entries, max_age=150.0).collect()}
    assert got == {1: (11, 1.0), 2: (None, None), 3: (None, None), 4: (None, None)}
    assert storage.similar_cached(asked.limit(0), entries).count() == 0


def test_nearest_in_blocks_equals_one_block(spark, monkeypatch):
    v = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * k + k).cast("float") for k in range(1, 5)]).alias("embedding"), (F.col("id") % 3).alias("label"))
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    one = sorted(tuple(r) for r in nearest.nearest(v, q, 4, same="label").collect())
    monkeypatch.setattr(nearest, "BLOCK", 4)
    assert sorted(tuple(r) for r in nearest.nearest(v, q, 4, same="label").collect()) == one and len(one) == 60


def test_long_sections_are_cut_to_head_and_tail(spark):
    rows = [("d", "s", k, f"c{k:03d}", f"{k:03d}" + "x" * 97) for k in range(300)] + [("d", "u", 1, "a", "short"), ("d", "u", 2, "b", None)]
    got = {r.section: r.extract for r in chunking.section_extracts(spark.createDataFrame(rows, "doc_id string, section string, ord int, chunk_id string, text string"), stretch=64).collect()}
    whole = "\n\n".join(r[4] for r in rows[:300])
    assert got["s"] == whole[:6000] + "\n[...]\n" + whole[-6000:] and got["u"] == "short\n\n"


def test_runs_over_blocks_come_in_parts(spark):
    rows = [(k, "s", "Customer", 21600.0 * (k // 2) + k, f"t{k}") for k in range(6)]
    turns = spark.createDataFrame(rows, "id int, session string, role string, time double, text string").withColumn("block", F.floor(F.col("time") / 21600))
    runs = conversation.speaker_runs(turns).orderBy("part_no").collect()
    assert [(r.run_no, r.part_no, r.text) for r in runs] == [(1, 0, "t0 t1"), (1, 1, "t2 t3"), (1, 2, "t4 t5")]
    assert {(r.turn_no, r.part_no) for r in conversation.question_turns(turns).collect()} == {(k + 1, 0) for k in range(6)}


def test_paired_and_mixed(spark):
    a = spark.createDataFrame([("k", 1, 0), ("k", 5, 0), ("l", 2, 0)], "key string, at int, b int")
    b = spark.createDataFrame([("k", 3, 0), ("m", 4, 0)], "key string, at int, b int")
    assert [(r.key, r.n, r.l["at"], r.r["at"]) for r in signals.paired_in_order(a, b, "key", ["at"], "b").collect()] == [("k", 1, 1, 3)]
    both = {r.key: (r.left, r.right) for r in signals.mixed(a.where("at <> 5"), b, ["key"], "at").collect()}
    assert both == {"k": (1, 3), "l": (2, 0), "m": (0, 4)}


def test_columns_are_made_once(spark):
    df = made_once(spark.range(3), x=F.when(F.col("id") > 0, F.concat(F.lit("n"), F.col("id").cast("string"))))
    assert sorted(r.x for r in df.where("x is not null and x <> 'n2'").collect()) == ["n1"]


def test_steps_need_a_shared_folder_on_a_cluster(spark):
    class Context:
        applicationId, master = "other", "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
    assert session.cut(spark.range(4)).count() == 4 and session.cut(spark.range(0)).count() == 0


def test_streamed_sessions_of_parts_and_of_a_file(spark, small, tmp_path):
    turns = session.table(spark, small, "transcript_turns")
    turns.repartition(3).write.parquet(f"{tmp_path}/parts/transcript_turns.parquet")
    turns.limit(0).write.parquet(f"{tmp_path}/none/transcript_turns.parquet")
    one = sorted(r.session for r in pages.streamed_sessions(spark, small).collect())
    assert one and sorted(r.session for r in pages.streamed_sessions(spark, f"{tmp_path}/parts").collect()) == one
    assert pages.streamed_sessions(spark, f"{tmp_path}/none").count() == 0
