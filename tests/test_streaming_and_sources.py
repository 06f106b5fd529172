import json

import pytest
from pyspark.sql import functions as F

from parley.sources import readers, sinks
from parley.streaming import utterances, windows


def _packets():
    rows = []
    for call in ("a", "b"):
        for k in range(40):
            text = {1: "hello", 2: "hello there", 3: "how", 20: "again"}.get(k)
            level = 150.0 if k in (1, 2, 3, 4, 20, 21) else 100.0 if k == 6 else 20.0
            rows.append((call, 1_700_000_000 + k * 0.192, level, 200.0 if 2 <= k <= 5 else 0.0, text))
    return rows


def test_step_closes_on_silence():
    state, out = utterances.step("c", utterances._EMPTY, [(t, level, other, text) for _, t, level, other, text in _packets()[:40]])
    assert [(x[1], x[2], x[4], x[5]) for x in out] == [("c:1", "hello there how", True, "silence"), ("c:2", "again", False, "silence")]
    assert state[3] < 0


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(_packets(), "call_id string, ts double, level double, other_level double, transcript string").withColumn("ts", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    want = sorted((x.utterance_id, x.text, x.n_packets, x.reason) for x in utterances.utterances(df).collect())
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "10 seconds")
    query = utterances.utterances_stream(stream).writeStream.format("memory").queryName("utt").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((x.utterance_id, x.text, x.n_packets, x.reason) for x in spark.table("utt").collect()) == want


def test_windows_on_stream(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    want = {(str(x.start), x.event_type): x.n for x in windows.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")), "1 day", ["event_type"]).collect()}
    stream = windows.event_time(spark.readStream.schema(events.schema).parquet(f"{small}/events.parquet*"), lateness="1 day")
    query = windows.tumbling(stream, "1 day", ["event_type"]).writeStream.format("memory").queryName("tumble").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(str(x.start), x.event_type): x.n for x in spark.table("tumble").collect()} == want


def test_readers(spark, tmp_path):
    (tmp_path / "a.chunks.json").write_text(json.dumps({"chunks": [{"chunk_id": "1", "doc_id": "d", "text": "", "content": "c"}, {"chunk_id": "2", "document_id": "e", "doc_id": "d", "text": "t", "page_start": 3}]}))
    got = {x.chunk_id: x for x in readers.chunk_files(spark, str(tmp_path)).collect()}
    assert (got["1"].text, got["1"].doc_id, got["1"].page_start, got["1"].source_filename) == ("c", "d", 0, "a.pdf")
    assert (got["2"].doc_id, got["2"].page_end) == ("e", 3)
    lines = spark.createDataFrame([('{"body": {"call_id": "c", "transcript": "hi", "timestamp": "12.5"}}',), ('{"call_id": "d"}',), ("nonsense",), (None,)], "value string")
    assert [(x.call_id, x.ts, x.ok) for x in readers.turn_envelopes(lines).collect()] == [("c", 12.5, True), ("d", None, True), (None, None, False), (None, None, False)]


@pytest.mark.parametrize("url, want", [("ws://h/x?session_id=s&call_id=c", "c"), ("ws://h/x?conversation_id=k", "k"), ("ws://h/x", None), (None, None)])
def test_call_id_of_url(spark, url, want):
    assert spark.range(1).select(readers.call_id_of_url(F.lit(url).cast("string")).alias("x")).first().x == want


def test_messages(spark):
    row = spark.range(1).select(
        readers.audio_meta(F.lit('{"type": "AUDIO_CHUNK_META", "chunk_index": 4}')).alias("a"), readers.audio_meta(F.lit('{"type": "X"}')).alias("b"), readers.energy_of_log(F.lit("t system_rms=0.5 mic_rms=0.001")).alias("e"), readers.call_id_of_message(F.lit('{"session_id": "s"}')).alias("m")
    ).first()
    assert row.a.chunk_index == 4 and row.b is None and row.e.system_active and not row.e.mic_active and row.m == "s"


def test_sinks_are_repeatable(spark, tmp_path):
    df = spark.createDataFrame([(k, "u" if k % 2 else "v", "red house") for k in range(20)], "doc_id int, user_id string, text string")
    for _ in range(2):
        sinks.write_partitioned(df, str(tmp_path / "t"), ["user_id"], 4)
        sinks.write_index(df, str(tmp_path / "i"), "doc_id", "text", 2)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20
    assert spark.read.parquet(str(tmp_path / "i/postings")).count() == 40
