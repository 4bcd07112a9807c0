"""Vector retrieval: exact top-k, thresholds, one per author, and an index with measured recall."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import vectors as V

# How many passages are looked at and kept, and how similar they must be.
CANDIDATES, FLOOR, KEEP = 10, 0.2, 3


def clamped(n: int | None, most: int = CANDIDATES) -> int:
    return min(max(most if n is None else n, 0), most)


def top_k(passages: DataFrame, query: Sequence[float], k: int | None = CANDIDATES, vector: str = "embedding", key: str = "id", where: Column | None = None) -> DataFrame:
    """The k passages nearest to a vector, after the filter, with `similarity`. Each task keeps k rows (TakeOrderedAndProject)."""
    kept = passages if where is None else passages.where(where)
    return kept.withColumn("similarity", V.similarity_to(F.col(vector), query)).where("similarity is not null").orderBy(F.desc("similarity"), key).limit(clamped(k))


#: Queries that are compared with all passages in one pass; more go in several.
BLOCK = 20_000


def _blocks(queries: DataFrame, vector: str, key: str) -> Iterator[tuple[list, np.ndarray]]:
    """(keys, unit vectors) of the queries, BLOCK at a time, by a hash of their keys."""
    parts = -(-queries.count() // BLOCK)
    for k in range(parts):
        own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)
        rows = own.select(key, vector).toArrow()
        if rows.num_rows:
            found = np.array(rows[vector].to_pylist(), np.float64)
            yield rows[key].to_pylist(), found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)


def _nearest(passages: DataFrame, keys: list, queries: np.ndarray, k: int, vector: str, key: str, query_key: str) -> DataFrame:
    """(query_key, key, similarity): k rows, or more where similarities tie, of each batch of passages for each query, by one matrix product."""
    shared = passages.sparkSession.sparkContext.broadcast((keys, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, matrix = shared.value
        for batch in batches:
            whole = batch.filter(batch.column(1).is_valid())
            if not whole.num_rows:
                continue
            values = np.asarray(whole.column(1).flatten(), np.float64).reshape(whole.num_rows, -1)
            norms = np.linalg.norm(values, axis=1)
            good = np.flatnonzero(norms > 0)
            if not len(good):
                continue
            scores = matrix @ (values[good] / norms[good, None]).T
            if len(good) > k:
                bound = np.partition(scores, len(good) - k, axis=1)[:, len(good) - k]
                q, p = np.nonzero(scores >= bound[:, None] - 1e-9)
            else:
                q, p = np.indices(scores.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array([asked[i] for i in q], pa.int64()), whole.column(0).take(pa.array(good[p])).cast(pa.int64()), pa.array(scores[q, p])], names=[query_key, key, "similarity"])

    return passages.select(F.col(key).cast("bigint"), F.col(vector).cast("array<double>")).mapInArrow(run, f"{query_key} bigint, {key} bigint, similarity double")


def top_k_each(passages: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "id", query_vector: str = "query", query_key: str = "query_id") -> DataFrame:
    """(query_key, key, similarity, rank): the k passages nearest to each of a stated set of queries, whose keys are whole numbers.

    Queries go to all tasks in blocks of BLOCK; a batch of passages meets a block in one matrix product and hands on k rows a query.
    Similarities are rounded to twelve places before they are ranked, so that their order does not depend on batches.
    """
    found = [_nearest(passages, keys, matrix, k, vector, key, query_key) for keys, matrix in _blocks(queries, query_vector, query_key)]
    if not found:
        return passages.limit(0).select(F.lit(0).cast("bigint").alias(query_key), F.col(key).cast("bigint"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
    best = Window.partitionBy(query_key).orderBy(F.desc("similarity"), key)
    rounded = reduce(DataFrame.unionByName, found).withColumn("similarity", F.round("similarity", 12))
    return rounded.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def above_floor(found: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Applied to what top_k found, so it never brings further rows in."""
    return found.where(F.col("similarity") >= floor)


def one_per_author(found: DataFrame, author: str, key: str, keep: int = KEEP) -> DataFrame:
    """The best passage of each author, best first, `keep` at most."""
    first = Window.partitionBy(author).orderBy(F.desc("similarity"), key)
    return found.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank").orderBy(F.desc("similarity"), key).limit(keep)


def references(passages: DataFrame, query: Sequence[float] | None, where: Column | None, author: str, key: str, vector: str = "embedding") -> DataFrame:
    """Candidates, floor, one per author; nothing for a text that has no vector."""
    if query is None:
        return passages.limit(0).withColumn("similarity", F.lit(0.0))
    return one_per_author(above_floor(top_k(passages, query, CANDIDATES, vector, key, where)), author, key)


def mean_vector(rows: DataFrame, groups: list[str], vector: str) -> DataFrame:
    """groups and the mean of their vectors at length 1 (null for a zero mean), by sums of each dimension."""
    long = rows.select(*groups, F.posexplode(vector).alias("dim", "x"))
    means = long.groupBy(*groups, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = means.groupBy(*groups).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("mean"))
    return packed.withColumn("mean", V.unit(F.col("mean")))


def bag_embedded(rows: DataFrame, key: str, tokens: Column, dim: int = 64) -> DataFrame:
    """A text's stand-in embedding: each token adds 1 or -1 to a dimension that its md5 names; length 1, null without tokens."""
    drawn = rows.select(key, F.explode(tokens).alias("t")).select(key, F.conv(F.substring(F.md5(F.col("t").cast("binary")), 1, 6), 16, 10).cast("bigint").alias("h"))
    sign = F.when(F.pmod(F.floor(F.col("h") / dim), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    sums = drawn.groupBy(key, F.pmod("h", F.lit(dim)).alias("d")).agg(F.sum(sign).alias("x")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("at"))
    filled = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(dim - 1).cast("bigint")), lambda d: F.coalesce(F.col("at")[d], F.lit(0.0)))
    return rows.select(key).join(sums.select(key, V.unit(filled).alias("embedding")), key, "left")


#: Levels of a code on either side of 0, and how many codes are opened for each answer that is wanted.
LEVELS, OPENED = 7, 4


def index_codes(passages: DataFrame, vector: str = "embedding", key: str = "id") -> DataFrame:
    """(key, code): the index, a byte for each dimension of every passage, of which four bits are used; a quarter of the vectors' bytes.

    Partitions of the space do not help where vectors point everywhere alike: there a fifth of the cells of a clustering holds two
    thirds of the nearest passages. Codes are read for every passage instead, and whole vectors are opened for a few.
    """
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    code = F.transform(vector, lambda x: F.round(x.cast("double") / F.col("_top") * LEVELS).cast("tinyint"))
    return passages.withColumn("_top", top).where("_top > 0").select(F.col(key).cast("bigint").alias(key), code.alias("code"))


def approximate_top_k(passages: DataFrame, index: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "id", query_vector: str = "query", query_key: str = "query_id") -> DataFrame:
    """top_k_each over the index: codes name OPENED * k candidates a query, and only their vectors are opened and compared exactly."""
    near = top_k_each(index, queries, OPENED * k, "code", key, query_vector, query_key).select(query_key, key)
    opened = near.join(queries.select(query_key, query_vector), query_key).join(passages.select(F.col(key).cast("bigint").alias(key), vector), key)
    scored = opened.select(query_key, key, F.round(V.similarity(F.col(vector), F.col(query_vector)), 12).alias("similarity")).where("similarity is not null")
    best = Window.partitionBy(query_key).orderBy(F.desc("similarity"), key)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def searched(tickets: DataFrame, searches: DataFrame, passages: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """Searches (search_id, account, ticket, query_id, lang, ts) by tickets (ticket, account, state): (search_id, code) of all, and what each allowed one finds.

    A search needs a started ticket of its own account that has not been searched with: of several with one ticket the first is
    allowed. Others are refused with 42501, without an account with 28000. Passages are filtered by language; a query that many
    searches ask is answered once for each language.
    """
    own = searches.join(tickets.select("ticket", F.col("account").alias("_owner"), "state"), "ticket", "left")
    usable = F.coalesce((F.col("_owner") == F.col("account")) & (F.col("state") == "started"), F.lit(False))
    first = own.where(usable).groupBy("ticket").agg(F.min_by("search_id", F.struct("ts", "search_id")).alias("_first"))
    judged = own.withColumn("_usable", usable).join(first, "ticket", "left")
    code = F.when(F.col("account").isNull(), "28000").when(~F.col("_usable") | (F.col("search_id") != F.col("_first")), "42501").otherwise("ok")
    codes = judged.select("search_id", "query_id", "lang", code.alias("code"))
    allowed = codes.where("code = 'ok'")
    langs = [r["lang"] for r in allowed.select("lang").distinct().where("lang is not null").limit(100).collect()]  # a closed list of languages
    found = [top_k_each(passages.where(F.col("lang") == lang), queries.join(allowed.where(F.col("lang") == lang).select("query_id").distinct(), "query_id", "left_semi"), clamped(k)).withColumn("lang", F.lit(lang)) for lang in langs]
    if not found:
        return codes.select("search_id", "code"), allowed.limit(0).select("search_id", F.lit(0).cast("bigint").alias("id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
    return codes.select("search_id", "code"), allowed.join(reduce(DataFrame.unionByName, found), ["query_id", "lang"]).select("search_id", "id", "similarity", "rank")
