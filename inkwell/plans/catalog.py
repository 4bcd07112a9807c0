"""All queries of the library proper, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.plans import corpus, edits, ledger, lines, requests, retrieval, tables

MODULES = (corpus, retrieval, ledger, tables, edits, lines, requests)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
