"""The registered queries of this package and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from inkwell.llm import op1_url_filters, op2_media, op3_bpe, op4_jaccard, op5_quality_rules, op6_sharding, op7_licenses, op8_quality, op9_toxicity, op10_mixing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters.query,
    "op2_media": op2_media.query,
    "op3_bpe": op3_bpe.query,
    "op4_jaccard": op4_jaccard.query,
    "op5_quality_rules": op5_quality_rules.query,
    "op6_sharding": op6_sharding.query,
    "op7_licenses": op7_licenses.query,
    "op8_quality": op8_quality.query,
    "op9_toxicity": op9_toxicity.query,
    "op10_mixing": op10_mixing.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op1_url_filters": op1_url_filters.ORACLE,
    "op5_quality_rules": op5_quality_rules.ORACLE,
    "op6_sharding": op6_sharding.ORACLE,
    "op7_licenses": op7_licenses.ORACLE,
}
