import math
import uuid
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from parley.functions import speakers, text as T, vector as V


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in TYPES.items() if k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


TYPES = {"t": "string", "u": "string", "v": "array<double>", "w": "array<double>", "d": "double"}


def test_keyword_tokens(spark):
    assert one(spark, T.keyword_tokens(F.col("t")), t="AB123 état 2024-05-06 3.14 K-9") == ["ab", "123", "tat", "2024-05-06", "3.14", "k-9"]
    assert one(spark, T.keyword_tokens(F.col("t")), t=None) == []


def test_echo_and_similarity(spark):
    assert one(spark, T.echo_words(F.col("t")), t="Um, OK I'll pay") == "i ll pay"
    pairs = [("I want to pay now", "pay now", len("pay now") / len("i want to pay now")), ("", "x", 0.0), (None, "x", 0.0), ("the blue house", "a blue horse", SequenceMatcher(None, "the blue house", "a blue horse").ratio())]
    for a, b, want in pairs:
        assert math.isclose(one(spark, T.text_similarity(F.col("t"), F.col("u")), t=a, u=b), want)


def test_caption_anchor(spark):
    for text, want in (("Fig. 3a: x", ("figure", 3)), ("Tab 2", ("table", 2)), ("Figurehead 1", None), (None, None)):
        got = one(spark, T.caption_anchor(F.col("t")), t=text)
        assert (tuple(got) if got else None) == want


def test_forms(spark):
    assert one(spark, T.stable_uuid(F.col("t")), t="chunk-1") == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk-1"))
    assert one(spark, T.slug(F.col("t")), t="  What is / that? ") == "what_is_that"
    assert one(spark, T.json_object(F.col("t")), t='x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert one(spark, T.excerpt(F.col("t"), 9), t="alpha beta gamma") == "alpha..."
    assert one(spark, T.sentences(F.col("t")), t="One.  Two!\nThree") == ["One.", "Two!", "Three"]
    assert one(spark, T.refine_sentences(F.col("t")), t="# A. B.\n- c. d\ne. f") == ["# A. B.", "- c. d", "e.", "f"]


def test_reference_like(spark):
    assert one(spark, T.reference_like(F.lit("References"), F.lit("x")))
    assert not one(spark, T.reference_like(F.lit(None).cast("string"), F.lit(None).cast("string")))
    cited = "A, 1999 doi: 10.1/x\nB, 2001 doi: 10.1/y\nC, 2003\nD, 2004"
    assert one(spark, T.reference_like(F.lit(""), F.lit(cited)))


def test_speakers(spark):
    for name, plain, clean in (("RM", "Worker", "Worker"), ("Customer:", "Unknown", "Customer"), (" cust. ", "Unknown", "Customer"), (None, "Unknown", "Unknown"), ("", "Unknown", "Unknown")):
        assert one(spark, speakers.speaker_role(F.col("t")), t=name) == plain
        assert one(spark, speakers.clean_speaker_role(F.col("t")), t=name) == clean
    assert one(spark, speakers.epoch_seconds(F.col("d")), d=1735702174795.0) == 1735702174.795


def test_vectors(spark):
    assert one(spark, V.cosine(F.col("v"), F.col("w")), v=[3.0, 4.0], w=[3.0, 4.0]) == 1.0
    assert one(spark, V.cosine(F.col("v"), F.col("w")), v=[0.0], w=[1.0]) == 0.0
    assert math.isclose(one(spark, V.root_mean_square(F.col("v")), v=[3.0, 4.0]), 3.5355339059)
    assert one(spark, V.root_mean_square(F.col("v")), v=[]) == 0.0
    assert one(spark, V.pcm16(F.col("v")), v=[-2.0, -0.5, 0.5, 2.0]) == [-32768, -16384, 16383, 32767]
    assert one(spark, V.interleaved(F.col("v"), F.col("w")), v=[1.0, 2.0, 9.0], w=[3.0, 4.0]) == [1.0, 3.0, 2.0, 4.0]
    assert one(spark, V.deinterleaved(F.col("v"), 1), v=[1.0, 3.0, 2.0, 4.0, 5.0]) == [3.0, 4.0]
    assert one(spark, V.resampled(F.col("v"), F.lit(2), F.lit(1)), v=[0.0, 1.0, 2.0, 3.0]) == [0.0, 2.0]
    assert one(spark, V.resampled(F.col("v"), F.lit(1), F.lit(2)), v=[0.0, 1.0]) == [0.0, 0.5, 1.0, 1.0]
