"""One place for the session settings that results depend on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that change results or plans; cluster sizing is left to the caller.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, name: str = "inkwell", **more: str) -> SparkSession:
    """A session with SETTINGS; `more` holds further settings with `_` for `.`, for example spark_driver_memory="8g"."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in more.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local(cpus: int | None = None, **more: str) -> SparkSession:
    """A session on this machine for tests and the benchmark: a shuffle partition for each thread."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(f"local[{n}]", **{"spark_ui_enabled": "false", "spark_ui_showConsoleProgress": "false", "spark_driver_memory": "8g", **more})
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return spark
