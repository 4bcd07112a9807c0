"""Queries whose result is lines for a sink, or rows made for a test."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import vectors as V
from inkwell.operators import corpus
from inkwell.sources import readers, writers
from inkwell.sources.tables import table


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """One attempt report for each event: rounded numbers, and a stop reason from the closed list."""
    events = table(spark, d, "events")
    reason = F.when(F.col("event_type") == "click", "end_turn").when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("event_type"))
    return events.select("event_id", writers.report_line(reason, value=F.col("value")).alias("line"))


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    return turns.select("conv_id", "turn", writers.event_line(F.when(F.col("turn") == 0, "start").otherwise("edit"), F.col("role")).alias("line"))


def synthetic_rows(spark: SparkSession, d: str) -> DataFrame:
    made = readers.synthetic(spark, 1000, 16)
    return made.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.min(V.norm(F.col("embedding"))), 6).alias("least_norm"), F.round(F.max(V.norm(F.col("embedding"))), 6).alias("most_norm"))


def accepted_bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", readers.body_accepted("text", 5000).alias("accepted"))


def curated_books(spark: SparkSession, d: str) -> DataFrame:
    """A hand-written list of nations that all must exist and be in a region."""
    listed = spark.createDataFrame([(3,), (6,), (7,)], "n_nationkey bigint")
    nations = table(spark, d, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("bigint"))
    return corpus.curated(listed, nations, "n_nationkey", F.col("n_regionkey").isNotNull()).select("n_nationkey", "n_name")


QUERIES = {f.__name__: f for f in (report_lines, event_lines, synthetic_rows, accepted_bodies, curated_books)}
ORACLES = {
    "report_lines": """SELECT event_id, '{' || CASE WHEN event_type = 'view' THEN '' ELSE '"stop_reason":"' || CASE WHEN event_type = 'click' THEN 'end_turn' ELSE 'other' END || '",' END || '"value":' || round(value)::bigint || '}' AS line FROM events""",
    "event_lines": """SELECT conv_id, turn, '{"type":"' || CASE WHEN turn = 0 THEN 'start' ELSE 'edit' END || '","payload":"' || role || '"}' AS line FROM conversations""",
    "synthetic_rows": "SELECT lang, 500::bigint AS n, 1.0::double AS least_norm, 1.0::double AS most_norm FROM (VALUES ('en'), ('fr')) t(lang)",
    "accepted_bodies": "SELECT doc_id, strlen(text) <= 5000 AS accepted FROM documents",
    "curated_books": "SELECT n_nationkey::bigint AS n_nationkey, n_name FROM nation WHERE n_nationkey IN (3, 6, 7)",
}
