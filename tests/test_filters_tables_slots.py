import base64
import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import tables
from parley.operators import chunking, filters, slots


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name, want", [("abc", {"source_filename": "abc.pdf"}), ("abc.pdf", {"source_filename": "abc.pdf"}), ("0ca77128-1ff5-4d43-b09d-227eb373f3f5", {"doc_id": "0ca77128-1ff5-4d43-b09d-227eb373f3f5"}), (" ", {}), (None, {})])
def test_document_filter(name, want):
    assert filters.document_filter(name) == want


def test_predicate(spark):
    df = spark.createDataFrame([(1, "u", 2, 4), (2, None, 5, 6), (3, "u", None, None)], "i int, user_id string, page_start int, page_end int")
    pick = lambda f: [r.i for r in df.where(filters.retrieval_predicate(f)).orderBy("i").collect()]
    assert pick({}) == [1, 2, 3] and pick({"user_id": "u"}) == [1, 3] and pick({"user_id": "u", "page_start": 4, "page_end": 9}) == [1] and pick({"page_start": 5}) == [2]


def test_limits_and_gates(spark):
    assert [one(spark, filters.candidate_limit(F.lit(q))) for q in ("a b c", "a b c d e f g h", "a b c d e f g h i", "")] == [8, 10, 12, 8]
    assert one(spark, filters.sends_audio(F.lit(5.0), F.lit(True), 5.0)) is False and one(spark, filters.sends_audio(F.lit(0.0), F.lit(True), 0.0)) is True
    assert one(spark, filters.sends_worker_audio(F.lit(3), F.lit(True))) is False
    assert one(spark, filters.possible_bleed(F.lit(250.0), F.lit(100.0))) is True and one(spark, filters.possible_bleed(F.lit(None).cast("double"), F.lit(1.0))) is False


def test_tables(spark):
    assert one(spark, tables.without_trailing_rules(F.lit("| a |\n|---|\n| 1 |\n|---|\n\n"))) == "| a |\n|---|\n| 1 |"
    assert one(spark, tables.without_trailing_rules(F.lit("| a |\n|---|"))) == "| a |\n|---|"
    assert tuple(one(spark, tables.row_and_column_count(F.lit("| a | b |\n|---|---|\n| 1 | 2 |")))) == (2, 2)
    assert one(spark, tables.modal_width(F.expr("array(array('a'), array('b', 'c'), array('d', 'e'), array('f'))"))) == 1
    assert one(spark, tables.has_header(F.expr("array(array('name'), array('a rather long cell of text'))"))) is True
    assert one(spark, tables.without_repeated_tail(F.lit("x\ny\ny\ny\ny"))) == "x\ny"
    assert one(spark, tables.without_repeated_tail(F.lit("so it goes on and on and on and on"))) == "so it goes on and on"
    assert one(spark, tables.without_repeated_tail(F.lit(None).cast("string"))) is None


def test_wave_header(spark):
    pcm = np.array([1, -2, 3], dtype="<i2").tobytes()
    raw = base64.b64decode(one(spark, tables.wav_base64(F.lit(pcm))))
    with wave.open(io.BytesIO(raw)) as w:
        assert (w.getframerate(), w.getnchannels(), w.readframes(9)) == (16000, 1, pcm)


def test_box_downsampling(spark):
    samples = F.array(*[F.lit(float(v)) for v in (0, 2, 4, 6)])
    assert one(spark, tables.box_downsampled(samples, 2, 1)) == [1.0, 5.0]
    with pytest.raises(ValueError):
        tables.box_downsampled(samples, 1, 2)


def test_embedding_slot(spark):
    got = [r.embedding for r in slots.embedded(spark.createDataFrame([("red house",), (None,), ("red house",)], "t string"), "t").collect()]
    assert got[0] == got[2] and abs(np.linalg.norm(got[0]) - 1) < 1e-6 and not any(got[1])


def plain_groups(sims, sizes, least, most):
    groups, size = [0], sizes[0]
    for i in range(1, len(sizes)):
        if size + sizes[i] > most or (size >= least and sims[i - 1] < 0.58) or (size >= 50 and sims[i - 1] < 0.42):
            groups.append(groups[-1] + 1)
            size = sizes[i]
        else:
            groups.append(groups[-1])
            size += sizes[i]
    return groups


def test_greedy_groups_as_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        n = int(rng.integers(1, 30))
        rows.append((k, [float(v) for v in rng.random(max(0, n - 1))], [int(v) for v in rng.integers(1, 90, n)]))
    df = spark.createDataFrame(rows, "k int, sims array<double>, sizes array<int>").withColumn("g", chunking.greedy_groups(F.col("sims"), F.col("sizes"), least=100, most=300))
    for r in df.collect():
        assert r.g == plain_groups(r.sims, r.sizes, 100, 300)
