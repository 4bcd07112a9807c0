"""Sharding by weighted rendezvous hashing (native).

Every shard draws a number for a record from md5 of (key, shard); the record goes to the shard whose weight-scaled draw is
largest (-weight / ln(draw)). Draws of other shards do not change when a shard is added, so a record moves only into the new one.

Defined results: a null key is a key of its own; a null text has size 1 and the CRC of no bytes; rows that are equal in every
column get slots of their own; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm import base

SHARDS = 8
#: Hexadecimal digits of the key's md5 that name the bucket in which a row is numbered; the table of bucket sizes has shards x 4096 rows.
BUCKET_DIGITS = 3
#: Equal rows that are numbered in one piece.
PIECE = 10_000


def _named(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def _draw(key: Column, shard: int) -> Column:
    """A number in (0, 1): the first 52 bits of md5 of the key and the shard."""
    text = F.concat(_named(key), F.lit(f"/{shard}"))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key under weights; a shard of weight 0 gets nothing. Of equal scores the lower shard wins."""
    if not any(w > 0 for w in weights) or min(weights) < 0:
        raise ValueError("weights must be 0 or more, and one more than 0")
    scores = [F.struct((F.lit(-float(w)) / F.ln(_draw(key, i))).alias("score"), F.lit(-i).alias("rank")) for i, w in enumerate(weights) if w > 0]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["rank"]).cast("int")


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each record: key, size, text_crc32, law, shard, slot (0, 1, ... in each shard) and grown_shard.

    Rows are first counted by what identifies them, map-side, so that a key that a third of the rows have is one row when it is
    shuffled. A shard's rows are numbered in 4096 buckets of the key's hash; where a bucket begins comes from a count by
    bucket that reads only the key. Nothing is numbered by shard in one task.
    """
    shard, bucket = shard_of(F.col(key), weights), F.substring(F.md5(_named(F.col(key)).cast("binary")), 1, BUCKET_DIGITS)
    counts = docs.groupBy(F.col(key)).count().select(shard.alias("shard"), bucket.alias("bucket"), "count").groupBy("shard", "bucket").agg(F.sum("count").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # at most len(weights) * 4096 rows

    payload = F.coalesce(F.col(text), F.lit(""))
    same = docs.select(F.col(key), (F.octet_length(payload) + 1).cast("bigint").alias("size"), F.crc32(F.encode(payload, "UTF-8")).alias("text_crc32")).groupBy(key, "size", "text_crc32").count()
    rows = same.select("*", shard.alias("shard"), shard_of(F.col(key), grown).alias("grown_shard"), bucket.alias("bucket"))
    ahead = Window.partitionBy("shard", "bucket").orderBy(F.col(key).asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("count").over(ahead), F.lit(0))).join(F.broadcast(starts), ["shard", "bucket"])
    first = F.col("start") + F.col("ahead")
    lone = placed.where("count = 1").withColumn("slot", first)
    pieces = placed.where("count > 1").withColumn("from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1, F.lit(PIECE).cast("bigint"))))
    many = pieces.repartition(F.col(key), F.col("from")).withColumn("slot", F.explode(F.sequence(first + F.col("from"), first + F.least(F.col("from") + PIECE, F.col("count")) - 1)))
    columns = [F.col(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint"), "grown_shard"]
    return lone.select(*columns).unionByName(many.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(base.read(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def _best(shards: int) -> str:
    """DuckDB: the shard among `shards` equal ones."""
    draw = "(('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || '/' || i), 1, 13))::bigint + 0.5) / 4503599627370496.0"
    return f"(SELECT arg_max(i, (-1.0 / ln({draw}), -i)) FROM range({shards}) r(i))::int"


ORACLE = f"""
WITH crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c
    FROM (SELECT range AS b FROM range(256)))
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_best(SHARDS)} AS shard, {_best(SHARDS + 1)} AS grown_shard FROM documents
), bytes AS (
  SELECT doc_id, text, shard, grown_shard, hex(encode(text)) AS h FROM d
), crc AS (
  SELECT bytes.*, xor(4294967295::bigint, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(strlen(text)), lambda i: ('0x' || substr(h, (2 * i + 1)::int, 2))::bigint)),
    lambda c, b: xor(t[xor(c % 256, b) + 1], c // 256))) AS text_crc32
  FROM bytes, crc_table
)
SELECT doc_id, (strlen(text) + 1)::bigint AS size, text_crc32::bigint AS text_crc32, 'key' AS law, shard, grown_shard,
  (row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(doc_id::varchar, 'null')), 1, {BUCKET_DIGITS}), doc_id) - 1)::bigint AS slot FROM crc
"""
