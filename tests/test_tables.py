"""Upserts, sampling and caps: what must not depend on order or partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import corpus, tables
from inkwell.sources import readers, writers


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    batch = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, at int")
    once = tables.upserted(target, batch, "id", "at")
    twice = tables.upserted(once, batch, "id", "at")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "y"), (3, "z")]


def test_spread_is_deterministic(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    picks = [sorted(r["id"] for r in corpus.spread(rows.repartition(n), ["g"], ["id"], 5).collect()) for n in (1, 7)]
    assert picks[0] == picks[1] and len(picks[0]) == 15
    assert corpus.spread(rows.where("id < 6"), ["g"], ["id"], 5).count() == 6


def test_dedupe_twice_changes_nothing(spark):
    rows = spark.createDataFrame([(1, "A b c"), (2, "a-b, c!"), (3, "other")], "id int, p string")
    once = corpus.deduplicated(rows, "p", ["id"])
    assert sorted(r["id"] for r in corpus.deduplicated(once, "p", ["id"]).collect()) == [1, 3]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert corpus.passages(empty).count() == corpus.vocabulary(empty).count() == corpus.capped(empty, ["lang"], ["doc_id"], 3).count() == 0


def test_catalog(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('Text#,Type,Issued,Title,Language,Authors,Subjects,LoCC,Bookshelves\n1,Text,x,"Emma: A ""Novel""\nmore",en,"Austen, Jane, 1775-1817",,,\n2,Sound,x,S,en,X,,,\n1,Text,x,Emma II,en,"Austen, Jane, 1775-1817",,,\n')
    rows = readers.catalog(spark, str(path)).collect()
    assert [(r["id"], r["title"], r["author"], r["death"], r["public_domain"]) for r in rows] == [(1, "Emma II", "Jane Austen", 1817, True)]


def test_passage_files(spark, tmp_path):
    path = str(tmp_path / "p")
    writers.passages(spark.createDataFrame([("a", "été", 3)], "id string, text string, n_words int"), path)
    (row,) = readers.passages(spark, path).collect()
    assert (row["text"], row["source"], row["year"]) == ("été", "gutenberg", None)


def test_artifact_checksum(spark, tmp_path):
    import hashlib

    import pytest

    path = tmp_path / "w.bin"
    path.write_bytes(b"abc")
    assert readers.artifact(spark, str(path), hashlib.sha256(b"abc").hexdigest()).first()["content"] == b"abc"
    with pytest.raises(Exception, match="checksum differs"):
        readers.artifact(spark, str(path), "0").collect()


def test_evenly():
    assert readers.evenly([f"{i:02}" for i in range(10)], 4) == ["00", "02", "05", "08"]
