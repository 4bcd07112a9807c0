"""Writers of passages, vocabularies, artifacts, reports and event lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reasons a model gives for stopping; any other is reported as "other".
STOP_REASONS = ("end_turn", "max_tokens", "stop_sequence", "tool_use", "pause_turn", "refusal")


def passages(rows: DataFrame, path: str) -> None:
    """JSON Lines, in place of what was there."""
    rows.write.mode("overwrite").json(path)


def vocabulary(words: DataFrame, path: str) -> None:
    """One word a line, sorted, in one file: a vocabulary has at most tens of thousands of words."""
    words.select("word").coalesce(1).sortWithinPartitions("word").write.mode("overwrite").text(path)


def quantized(rows: DataFrame, path: str) -> DataFrame:
    """Codes and scales as Parquet, and a manifest row (rows, checksum over all codes) that a reader can hold them against."""
    rows.write.mode("overwrite").parquet(path)
    back = rows.sparkSession.read.parquet(path)
    each = F.conv(F.substring(F.sha2(F.to_json(F.struct("id", "codes", "scale")), 256), 1, 12), 16, 10).cast("bigint")
    return back.agg(F.count("*").alias("rows"), F.bit_xor(each).alias("checksum"))


def embedder(rows: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """An embedder's artifacts: codes and scales by token, the tokenizer's text, and (name, rows, checksum) of both as the manifest."""
    spark = rows.sparkSession
    table = quantized(rows, f"{folder}/table").withColumn("name", F.lit("table"))
    spark.createDataFrame([(tokenizer,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/tokenizer")
    text = spark.createDataFrame([("tokenizer", 1, tokenizer)], "name string, rows bigint, t string").select("name", "rows", F.sha2("t", 256).alias("checksum"))
    manifest = table.select("name", "rows", F.col("checksum").cast("string").alias("checksum")).unionByName(text)
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def event_line(kind: Column, payload: Column) -> Column:
    """One event of a stream as a line of JSON; `type` comes first, empty fields are left out."""
    return F.to_json(F.struct(kind.alias("type"), payload.alias("payload")))


def report_line(stop_reason: Column, **numbers: Column) -> Column:
    """One attempt as a line of JSON: numbers rounded, the stop reason from a closed list."""
    reason = F.when(stop_reason.isNull() | stop_reason.isin(*STOP_REASONS), stop_reason).otherwise("other")
    return F.to_json(F.struct(reason.alias("stop_reason"), *[F.round(c).cast("bigint").alias(k) for k, c in numbers.items()]))


def vector_fixture(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(line): texts with their vectors to six decimals; an error for a row without one."""
    checked = F.coalesce(F.col(vector), F.raise_error(F.concat(F.lit("no vector: "), F.col(key).cast("string"))).cast("array<double>"))
    return rows.select(F.to_json(F.struct(key, F.transform(checked, lambda x: F.round(x, 6)).alias("vector"))).alias("line"))
