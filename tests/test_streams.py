"""Streams give what the batch forms give."""

from __future__ import annotations

import uuid

from inkwell.operators import edits
from inkwell.streaming import chunks, counts


_ANSWER = '{"edits":[{"original":"a {x}","replacement":"b \\"q\\"","reason":"r"},{"original":"only"},{"original":"c","replacement":"d","reason":""}]}'


def _as_stream(spark, df, folder, schema):
    """df in three files, read one file a micro-batch."""
    for k in range(3):
        df.where(f"seq % 3 = {k}" if k else "seq % 3 = 0").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_parser(spark, tmp_path):
    texts = spark.createDataFrame([(1, _ANSWER), (2, _ANSWER[:60])], "attempt_id bigint, text string")
    cut = chunks.cut(texts, 200)
    stream = _as_stream(spark, cut, tmp_path / "in", cut.schema)
    found = counts.drained(chunks.parsed_stream(stream), f"p{uuid.uuid4().hex}")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, chunks.parsed(cut).collect()))


def test_collector(spark, tmp_path):
    rows = [(1, 0, "go go 12% go", "go", "a"), (1, 1, "go go 12% go", "12%", "13%"), (1, 2, "go go 12% go", "go", "b"), (2, 0, "x", "y", "z")]
    df = spark.createDataFrame(rows, "attempt_id bigint, seq bigint, text string, original string, replacement string")
    for k in range(3):
        df.where(f"seq = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = edits.collected(df).select("attempt_id", "seq", "id", "reason", "start", "end")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    found = counts.drained(chunks.collected_stream(stream), f"c{uuid.uuid4().hex}")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_sessions(spark, sf):
    stream = counts.event_stream(spark, sf, "events.parquet")
    found = counts.drained(counts.sessions(stream), f"s{uuid.uuid4().hex}", "complete")
    assert found.selectExpr("sum(n)").first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
