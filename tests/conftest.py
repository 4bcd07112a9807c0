"""One small session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from inkwell.session import local

    session = local(4, spark_sql_shuffle_partitions="4")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


@pytest.fixture(scope="session")
def oracle():
    """Runs DuckDB SQL over the tables of a folder: (columns, rows)."""
    import duckdb

    def run(sql: str, folder: str = SF):
        db = duckdb.connect()
        for path in Path(folder).glob("*.parquet"):
            db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        found = db.sql(sql)
        return found.columns, found.fetchall()

    return run
