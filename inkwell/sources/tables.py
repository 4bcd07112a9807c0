"""The driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name, through Spark's reader only, so that sf_dir may be in any store Spark can open."""
    if name not in NAMES:
        raise ValueError(f"no table {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores, where a few files are read in fewer parts than there are cores; else as they are.

    A file of one row group is one task's work however many cores there are; what is costly for each row is worth one shuffle then.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    few = cores > 1 and 2 * len(rows.inputFiles()) <= cores
    # parts of a scan that have rows: a count that reads no column
    return rows.repartition(cores) if few and rows.select(F.spark_partition_id().alias("part")).distinct().count() < cores else rows
