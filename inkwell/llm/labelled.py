"""Bounded training samples and scoring passes that the two classifiers share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import base
from inkwell.llm.features import indicators

#: Texts whose scores are handed to Spark at once.
BATCH = 2048
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def held_out(key: Column) -> Column:
    """The fold whose labels are never learned from; a row without a key is in no fold and has no label."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def known_labels(labels: DataFrame, name: str) -> DataFrame:
    """Distinct (doc_id, grp) of the labels 0 and 1 outside the held-out fold."""
    return labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(name).isin(0, 1)).select("doc_id", F.col(name).cast("int").alias("grp")).distinct()


def first_by_hash(rows: DataFrame, n: int) -> DataFrame:
    """n rows that depend on nothing but the keys: those with the smallest md5 of doc_id."""
    return rows.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(n)


def sampled(docs: DataFrame, chosen: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """Table (doc_id, grp, found): the indicators of the chosen (doc_id, grp) rows' texts; chosen is of bounded size.

    An id that several rows have is learned from once, by the text that comes first in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH // 8):
                own = batch.slice(at, BATCH // 8)
                found = [indicators(t.as_py(), families) for t in own.column(2)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.ListArray.from_arrays(ends, np.concatenate([*found, np.empty(0, np.int32)]))], names=["doc_id", "grp", "found"])

    chosen = base.stored(chosen, "chosen")
    ids = F.broadcast(chosen.select("doc_id").distinct())
    once = docs.select("doc_id", "text").join(ids, "doc_id")
    if docs.select("doc_id").join(ids, "doc_id").groupBy("doc_id").count().where("count > 1").limit(1).count():
        once = once.groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = once.join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("bigint"), F.col("grp").cast("int"), "text")
    table = base.stored(base.mapped(rows, run, "doc_id bigint, grp int, found array<int>"), "sample")
    base.deleted(chosen)
    return table


def gathered(sample: DataFrame, most: int) -> list[tuple[int, np.ndarray]]:
    """(grp, indicators) of a sample in the order of doc_id, on the driver: of each group as many rows, by md5, as have `most` indicators together."""
    sizes = sample.select("doc_id", "grp", F.size("found").alias("n"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h")).collect()
    held, taken = {}, set()
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"], r["grp"])):
        held[r["grp"]] = held.get(r["grp"], 0) + r["n"]
        if held[r["grp"]] <= most:
            taken.add((r["doc_id"], r["grp"]))
    if len(taken) < len(sizes):
        wanted = sample.sparkSession.createDataFrame(sorted(taken), "doc_id bigint, grp int")
        sample = sample.join(F.broadcast(wanted), ["doc_id", "grp"], "left_semi")
    table = sample.select("doc_id", "grp", "found").toArrow()
    rows = [(g, np.asarray(f.values, np.int32)) for g, f in zip(table["grp"].to_pylist(), table["found"], strict=True)]
    return [rows[i] for i in pc.sort_indices(table, [("doc_id", "ascending"), ("grp", "ascending")]).to_pylist()]  # views: only their order is made anew


def scored(docs: DataFrame, families: tuple[str, ...], weights: np.ndarray, shift: float, squash: Callable[[float], float], least: float, normal: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row's whole text: squash(shift + the sum of its indicators' weights)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            keys, folds, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i in range(0, len(keys), BATCH):
                scores = []
                for t in texts[i : i + BATCH]:
                    found = indicators(t.as_py(), families)
                    total = float(table[found].sum())
                    scores.append(squash(shift + (total / max(1.0, len(found)) ** 0.5 if normal else total)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + BATCH], pa.int64()), pa.array(folds[i : i + BATCH], pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= least) for s in scores], pa.int32())], schema=SCORES)

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return base.mapped(rows, run, "doc_id bigint, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, families: tuple[str, ...], weights: np.ndarray, shift: float, squash: Callable[[float], float], least: float, normal: bool = False) -> DataFrame:
    """The rows of docs that score least or more, with all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            good = []
            for t in batch.column(at):
                found = indicators(t.as_py(), families)
                total = float(table[found].sum())
                good.append(squash(shift + (total / max(1.0, len(found)) ** 0.5 if normal else total)) >= least)
            yield batch.filter(pa.array(good, pa.bool_()))

    return base.mapped(docs, run, docs.schema)
