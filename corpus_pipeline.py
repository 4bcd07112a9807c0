"""The training-data pipeline: from `documents` to token counts and digests of a clean, deduplicated, mixed corpus.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of documents.

Defined results: null, empty and blank texts fail the base rules and go; of rows with equal words one stays, the one with the
smallest id; ties and repeated rows are settled by the stages' own rules; an empty table gives an empty result; further columns
travel along to the last stage, which returns its own. The table that a stage wrote is deleted when the next one's is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import base, op3_bpe, op4_jaccard, op5_quality_rules, op8_quality, op10_mixing

#: The classifier rejects, the rules reject, one document of each group of near copies stays, sources are mixed, texts are encoded.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", op8_quality.stage),
    ("quality_rules", op5_quality_rules.stage),
    ("jaccard_join", op4_jaccard.stage),
    ("mixing", op10_mixing.stage),
    ("bpe", op3_bpe.stage),
]

#: SQL cannot express the classifier, the schedule or the encoder; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; what a stage returns is written to the shared folder for the next."""
    docs, before = base.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = base.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            base.deleted(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
