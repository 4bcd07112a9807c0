"""Queries over embeddings: exact search, one per group, means, quantization, and the recall of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions import vectors as V
from inkwell.operators import retrieval, tables
from inkwell.sources.tables import table


def _query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    """The stated query: one row's vector."""
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.top_k(_passages(spark, d), _query_vector(spark, d), 10, where=F.col("label") == 3)
    return found.select("id", F.round("similarity", 6).alias("similarity"))


def vector_floor(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.above_floor(retrieval.top_k(_passages(spark, d), _query_vector(spark, d), 25, where=F.col("id") != 0), 0.05)
    return found.select("id", F.round("similarity", 6).alias("similarity"))


def topk_one_per_group(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.references(_passages(spark, d), _query_vector(spark, d), F.col("id") != 0, "label", "id")
    return found.select("id", "label", F.round("similarity", 6).alias("similarity"))


def topk_each_query(spark: SparkSession, d: str) -> DataFrame:
    queries = _passages(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    found = retrieval.top_k_each(_passages(spark, d), queries, 3)
    return found.select("query_id", "id", F.col("rank").cast("bigint"), F.round("similarity", 6).alias("similarity"))


def vector_mean_norm(spark: SparkSession, d: str) -> DataFrame:
    means = retrieval.mean_vector(_passages(spark, d), ["label"], "embedding")
    return means.select("label", F.posexplode("mean").alias("dim", "x")).select("label", F.col("dim").cast("bigint"), F.round("x", 6).alias("x"))


def quantize_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    q = _passages(spark, d).select("id", "embedding", V.quantized(F.col("embedding")).alias("q"))
    error = F.array_max(F.transform(F.arrays_zip(F.col("embedding").alias("a"), V.restored(F.col("q.codes"), F.col("q.scale")).alias("b")), lambda p: F.abs(p["a"].cast("double") - p["b"])))
    total = F.aggregate("q.codes", F.lit(0), lambda s, c: s + c.cast("int"))
    return q.select("id", F.round("q.scale", 9).alias("scale"), total.cast("bigint").alias("code_sum"), (error <= F.col("q.scale") / 2 + 1e-12).alias("within_half"))


def vector_literals(spark: SparkSession, d: str) -> DataFrame:
    shown = _passages(spark, d).select("id", V.literal(F.col("embedding")).alias("literal"))
    return shown.select("id", "literal", F.size(V.from_literal(F.col("literal"))).cast("bigint").alias("n"))


def text_embedding(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    made = retrieval.bag_embedded(docs, "doc_id", T.words(F.lower("text")), 16)
    weighed = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return made.select("doc_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(weighed, 5).alias("weighed"))


def _asked(passages: DataFrame) -> DataFrame:
    return passages.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """The index of codes against the exact search, over all queries of the stated set: whether recall is 0.9 or more, and at most a fifth of the vectors were opened."""
    passages = _passages(spark, d).select("id", "embedding")
    queries, k = _asked(passages), 10
    exact = retrieval.top_k_each(passages, queries, k).select("query_id", "id")
    near = retrieval.approximate_top_k(passages, retrieval.index_codes(passages), queries, k).select("query_id", "id", F.lit(1).alias("hit"))
    recall = exact.join(near, ["query_id", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count("*").alias("n"))
    opened = F.lit(retrieval.OPENED * k) / F.lit(passages.count())
    return recall.select((F.col("recall") >= 0.9).alias("good_recall"), (opened <= 0.2).alias("few_opened"), "n")


def ann_top1(spark: SparkSession, d: str) -> DataFrame:
    """Each query's nearest passage by the index, which is the query itself."""
    passages = _passages(spark, d).select("id", "embedding")
    found = retrieval.approximate_top_k(passages, retrieval.index_codes(passages), _asked(passages), 1)
    return found.select("query_id", "id", F.round("similarity", 6).alias("similarity"))


def stored_results(spark: SparkSession, d: str) -> DataFrame:
    """What searches found, stored as JSON in one column each, read again in order and joined with the passages."""
    passages = _passages(spark, d)
    found = retrieval.top_k_each(passages, _asked(passages), 5).select("query_id", "rank", "id", F.round("similarity", 6).alias("similarity"))
    stored = tables.nested(found, "query_id", ["rank"], ["id", "similarity"])
    read = tables.unnested(stored, "query_id", "results", "id bigint, similarity double")
    return read.join(passages.select("id", "label"), "id").select("query_id", "place", "id", "label", "similarity")


def search_by_ticket(spark: SparkSession, d: str) -> DataFrame:
    """Every event searches with the ticket of its account's latest signup or view, which a view has started: refusals, and the number of passages found."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    tickets = events.where("event_type IN ('signup', 'view')").select(F.col("event_id").alias("ticket"), F.col("user_id").alias("account"), F.when(F.col("event_type") == "view", "started").otherwise("reserved").alias("state"))
    n = F.lit(table(spark, d, "embeddings").count())
    searches = events.select(F.col("event_id").alias("search_id"), F.when(F.col("event_id") % 9 != 0, F.col("user_id")).alias("account"), (F.col("event_id") - F.col("event_id") % 3).alias("ticket"), F.pmod("event_id", n).alias("query_id"), F.when(F.col("event_id") % 2 == 0, "en").otherwise("fr").alias("lang"), "ts")
    passages = _passages(spark, d).withColumn("lang", F.when(F.col("id") % 2 == 0, "en").otherwise("fr"))
    queries = passages.select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    codes, found = retrieval.searched(tickets, searches, passages, queries, 10)
    best = found.groupBy("search_id").agg(F.count("*").alias("n"), F.round(F.max("similarity"), 6).alias("best"))
    return codes.join(best, "search_id", "left").select("search_id", "code", F.coalesce("n", F.lit(0)).alias("n"), "best")


QUERIES = {f.__name__: f for f in (vector_topk, vector_floor, topk_one_per_group, topk_each_query, vector_mean_norm, quantize_roundtrip, vector_literals, text_embedding, ann_recall, ann_top1, stored_results, search_by_ticket)}

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_RANKED = f"SELECT b.vec_id AS query_id, a.vec_id AS id, a.label, round({_COS}, 6) AS similarity, row_number() OVER (PARTITION BY b.vec_id ORDER BY round({_COS}, 12) DESC, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0"
ORACLES = {
    "ann_recall": "SELECT true AS good_recall, true AS few_opened, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) * 10 AS n",
    "ann_top1": "SELECT vec_id AS query_id, vec_id AS id, 1.0::double AS similarity FROM embeddings WHERE vec_id % 20 = 0",
    "stored_results": f"SELECT query_id, rank - 1 AS place, id, label, similarity FROM ({_RANKED}) WHERE rank <= 5",
    "search_by_ticket": f"""
WITH s AS (SELECT event_id AS search_id, CASE WHEN event_id % 9 <> 0 THEN user_id END AS account, event_id - event_id % 3 AS ticket, event_id % (SELECT count(*) FROM embeddings) AS query_id, event_id % 2 AS side, ts FROM events),
j AS (SELECT s.*, coalesce(s.account = t.user_id AND t.event_type = 'view', false) AS usable FROM s LEFT JOIN events t ON t.event_id = s.ticket AND t.event_type IN ('signup', 'view')),
k AS (SELECT *, CASE WHEN account IS NULL THEN '28000' WHEN NOT usable THEN '42501' WHEN row_number() OVER (PARTITION BY ticket, usable ORDER BY ts, search_id) > 1 THEN '42501' ELSE 'ok' END AS code FROM j),
b AS (SELECT b.vec_id AS query_id, a.vec_id % 2 AS side, least(count(*), 10) AS n, round(max({_COS}), 6) AS best FROM embeddings a, embeddings b GROUP BY ALL)
SELECT search_id, code, CASE WHEN code = 'ok' THEN n ELSE 0 END AS n, CASE WHEN code = 'ok' THEN best END AS best FROM k JOIN b USING (query_id, side)""",
    "vector_topk": f"SELECT a.vec_id AS id, round({_COS}, 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.label = 3 ORDER BY {_COS} DESC, 1 LIMIT 10",
    "vector_floor": f"SELECT * FROM (SELECT a.vec_id AS id, round({_COS}, 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.vec_id <> 0 ORDER BY {_COS} DESC, 1 LIMIT 10) WHERE similarity >= 0.05",
    "topk_one_per_group": f"SELECT id, label, similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, id) AS k FROM (SELECT a.vec_id AS id, a.label, {_COS} AS s, round({_COS}, 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.vec_id <> 0 ORDER BY s DESC, id LIMIT 10) WHERE s >= 0.2) WHERE k = 1 ORDER BY s DESC, id LIMIT 3",
    "topk_each_query": f"SELECT query_id, id, rank::bigint AS rank, similarity FROM (SELECT b.vec_id AS query_id, a.vec_id AS id, round({_COS}, 6) AS similarity, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COS} DESC, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0) WHERE rank <= 3",
    "vector_mean_norm": "WITH l AS (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), m AS (SELECT label, dim, avg(x) AS x FROM l GROUP BY ALL) SELECT label, dim::bigint AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m",
    "quantize_roundtrip": "WITH s AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127 AS scale FROM embeddings) SELECT id, round(scale, 9) AS scale, list_sum(list_transform(e, lambda x: greatest(-127, least(127, round_even(x / scale, 0)))))::bigint AS code_sum, true AS within_half FROM s",
    "vector_literals": "SELECT vec_id AS id, '[' || array_to_string(list_transform(embedding::DOUBLE[], lambda x: printf('%.6f', x)), ',') || ']' AS literal, len(embedding)::bigint AS n FROM embeddings",
    "text_embedding": r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+(?:[''’-]\p{L}+)*')) AS w FROM documents),
h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 6))::bigint AS h FROM t),
s AS (SELECT doc_id, h % 16 AS d, sum(CASE WHEN (h // 16) % 2 = 0 THEN 1 ELSE -1 END)::double AS x FROM h GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm, sum(x * (d + 1)) AS weighed FROM s GROUP BY 1)
SELECT doc_id, CASE WHEN norm > 0 THEN 1.0::double END AS norm, CASE WHEN norm > 0 THEN round(weighed / norm, 5) END AS weighed FROM documents LEFT JOIN n USING (doc_id)""",
}
