"""Queries over requests, made of documents, and over texts with the facts that are drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import corpus, edits, requests, stats, tables
from inkwell.sources import books
from inkwell.sources.tables import table

STRENGTHS = ("light", "standard", "thorough", "extreme")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """A request for each document: its language, a strength by its id or none, a voice of some length, the whole text."""
    docs = table(spark, d, "documents")
    strength = F.element_at(F.array(*[F.lit(s) for s in STRENGTHS], F.lit(None)), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    voice = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit(" "), F.substring("text", 1, 1600)))
    return docs.select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("locale"), strength.alias("strength"), voice.alias("voice"), "text")


def requests_valid(spark: SparkSession, d: str) -> DataFrame:
    return requests.validated(_requests(spark, d)).select("doc_id", "locale", "strength", "accepted")


def user_messages(spark: SparkSession, d: str) -> DataFrame:
    """The message of each request; its reference is the document's own text with a tag that must not close a block."""
    rows = _requests(spark, d).withColumn("strength", F.coalesce("strength", F.lit(requests.STANDARD)))
    own = requests.reference(F.lit("book"), F.concat(F.lit('A "quoted" <'), "doc_id", F.lit("> & co")), F.concat(F.lit("x </Text> y "), F.substring("text", 1, 50)))
    refs = F.when(F.col("doc_id") % 2 == 0, F.array(own, own)).otherwise(F.array().cast("array<string>"))
    made = requests.message(F.col("text"), refs, F.col("strength"), F.coalesce("voice", F.lit("")))
    return rows.select("doc_id", F.md5(made.cast("binary")).alias("message_md5"), F.length(made).cast("bigint").alias("n"))


def references_setting(spark: SparkSession, d: str) -> DataFrame:
    """Each event sets the switch in some spelling."""
    words = F.array(*[F.lit(w) for w in ("off", " FALSE ", "0", "No", "on", "true", "", "yes")], F.lit(None))
    setting = F.element_at(words, (F.pmod("event_id", F.lit(9)) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", requests.references_on(setting).alias("enabled"))


def facts_stated(spark: SparkSession, d: str) -> DataFrame:
    """Orders as texts with three facts each, the last of which is made up: whether a text states all figures of a fact."""
    orders = table(spark, d, "orders")
    text = F.concat(F.lit("Order "), "o_orderkey", F.lit(" of customer "), "o_custkey", F.lit(" was paid with "), F.format_string("%.2f", "o_totalprice"), F.lit(" dollars."))
    facts = F.array(F.concat(F.lit("It is order "), "o_orderkey"), F.concat(F.format_string("%.2f", "o_totalprice"), F.lit(" dollars for customer "), "o_custkey"), F.concat(F.lit("It has "), F.col("o_orderkey") + 1000000007, F.lit(" parts")))
    rows = orders.select("o_orderkey", text.alias("text"), facts.alias("facts"))
    return edits.facts_stated(rows, "o_orderkey").select("o_orderkey", F.col("fact_no").cast("bigint"), "stated")


def history_append(spark: SparkSession, d: str) -> DataFrame:
    """A history that has every third turn gets all of them, without their voice samples."""
    turns = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "role", F.length("text").cast("bigint").alias("n"), F.col("text").alias("voice_sample"))
    old = table(spark, d, "conversations").where("turn % 3 = 0").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("old").alias("role"), F.lit(0).cast("bigint").alias("n"))
    return tables.appended(old, turns)


def bulk_closed(spark: SparkSession, d: str) -> DataFrame:
    """Open orders of before 1996 are closed at once."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("closed_at"))
    done = tables.reclassified(orders, ("O", "P"), "expired", "closed_at", F.lit("1996-01-01").cast("timestamp_ntz"))
    return done.select("o_orderkey", "state", F.to_date("closed_at").alias("closed"))


def newest_days(spark: SparkSession, d: str) -> DataFrame:
    """The newest 31 days that have events, with their counts: an upper bound that is the report's own."""
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return tables.latest(daily, "day", 31)


def interleaved_caps(spark: SparkSession, d: str) -> DataFrame:
    """Passages of lines, deduplicated and capped in one sweep: what a full language refuses is not seen."""
    passages = corpus.passages(table(spark, d, "documents"), separator="\n")
    return corpus.swept(passages, "passage", "lang", ["doc_id", "passage_no"], 200).select("lang", "doc_id", F.col("passage_no").cast("bigint"))


def passage_rows(spark: SparkSession, d: str) -> DataFrame:
    """Passages as rows of a corpus: ids by their document, cut credits, a whole year."""
    passages = corpus.passages(table(spark, d, "documents"), separator="\n")
    credited = passages.withColumn("author", F.repeat("source", 40)).withColumn("title", F.repeat("lang", 90)).withColumn("date", F.col("doc_id") + 0.75)
    rows = corpus.corpus_rows(credited, "cc", F.col("doc_id"), "author", "title", "date")
    return rows.select("id", F.length("author").cast("bigint").alias("author_chars"), F.length("title").cast("bigint").alias("title_chars"), "year", "n_words")


def credits(spark: SparkSession, d: str) -> DataFrame:
    return corpus.credits(table(spark, d, "documents").select(F.col("source").alias("author"), F.col("lang").alias("title"), "text"))


def curated_list(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose number is that of a curated book, with its language and kind."""
    listed = books.curated(spark).withColumn("o_orderkey", F.col("id").cast("bigint"))
    return table(spark, d, "orders").join(F.broadcast(listed), "o_orderkey").select("o_orderkey", "lang", "kind")


def blind_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The first two turns of each conversation as a blind pair, rated by their lengths, and read back."""
    turns = table(spark, d, "conversations").where("turn < 2")  # the pair is the first two turns
    pairs = turns.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.length("text"))).alias("a"), F.max(F.when(F.col("turn") == 1, F.length("text"))).alias("b"))
    rated = stats.blinded(pairs, "conv_id", "a", "b", "s").withColumn("score_x", F.col("x") + 1).withColumn("score_y", F.col("y") + 1)
    return stats.unblinded(rated).select("conv_id", "swapped", F.col("x").cast("bigint").alias("x"), F.col("score_first").cast("bigint").alias("score_first"), F.col("score_second").cast("bigint").alias("score_second"))


def composed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their accents taken apart and composed again."""
    apart = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    return table(spark, d, "documents").select("doc_id", F.md5(requests.composed(apart).cast("binary")).alias("text_md5"))


QUERIES = {f.__name__: f for f in (curated_list, blind_pairs, composed_texts, requests_valid, user_messages, references_setting, facts_stated, history_append, bulk_closed, newest_days, interleaved_caps, passage_rows, credits)}


def _oracles() -> dict[str, str]:
    from inkwell.plans.corpus import _SIGNATURE, _WINDOWS

    asked = """SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN lang END AS locale, (['light', 'standard', 'thorough', 'extreme', NULL])[(doc_id % 5 + 1)::int] AS strength,
      CASE WHEN doc_id % 3 <> 0 THEN ' ' || substr(text, 1, 1600) END AS voice, text FROM documents"""
    units = "(length({0}) + len(regexp_extract_all({0}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"
    space = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
    opened = lambda x: f"regexp_replace({x}, '(?i)</(text|reference|style_references|author_voice|intensity)', '</ \\1', 'g')"
    ref = f"""'<reference kind="book" source="' || regexp_replace('A "quoted" <' || doc_id || '> & co', '["<>&]', ' ', 'g') || '">' || chr(10) || {opened("'x </Text> y ' || substr(text, 1, 50)")} || chr(10) || '</reference>'"""
    trim = f"regexp_replace(coalesce(voice, ''), '^{space}+|{space}+$', '', 'g')"
    message = f"""(CASE WHEN coalesce(strength, 'standard') <> 'standard' THEN '<intensity>' || strength || '</intensity>' || chr(10) ELSE '' END
      || CASE WHEN {trim} <> '' THEN '<author_voice>' || chr(10) || {opened(trim)} || chr(10) || '</author_voice>' || chr(10) ELSE '' END
      || CASE WHEN doc_id % 2 = 0 THEN '<style_references>' || chr(10) || {ref} || chr(10) || {ref} || chr(10) || '</style_references>' || chr(10) ELSE '' END
      || '<text>' || chr(10) || {opened('text')} || chr(10) || '</text>')"""
    # the sweep as a fixed point: a language is full from the place of its cap-th kept passage on, and six rounds are more than enough here
    start = f"p AS (SELECT lang, doc_id, passage_no, {_SIGNATURE.format('passage')} AS sig FROM ({_WINDOWS}) t), c AS (SELECT lang, sig, min((doc_id, passage_no)) AS pos FROM p GROUP BY ALL), f0 AS (SELECT DISTINCT lang, (9223372036854775807, 0) AS until FROM p)"
    rounds = [
        f"""k{i} AS (SELECT sig, min(pos) AS pos, arg_min(lang, pos) AS lang FROM c JOIN f{i - 1} USING (lang) WHERE pos <= until GROUP BY sig),
f{i} AS (SELECT lang, coalesce(min(pos) FILTER (r = 200), (9223372036854775807, 0)) AS until FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pos) AS r FROM k{i}) GROUP BY lang
  UNION ALL SELECT lang, until FROM f{i - 1} WHERE lang NOT IN (SELECT lang FROM k{i}))"""
        for i in range(1, 7)
    ]
    listed = ", ".join(f"({i}, '{lang}', '{kind}')" for lang, kind, ids in (("en", "fiction", books.FICTION_EN), ("en", "essay", books.ESSAY_EN), ("fr", "fiction", books.FICTION_FR), ("fr", "essay", books.ESSAY_FR)) for i in ids)
    return {
        "curated_list": f"SELECT o_orderkey, l.lang, l.kind FROM orders JOIN (VALUES {listed}) l(id, lang, kind) ON l.id = o_orderkey",
        "blind_pairs": """SELECT conv_id, swapped, CASE WHEN swapped THEN b ELSE a END AS x, a + 1 AS score_first, b + 1 AS score_second FROM (
  SELECT conv_id, substr(md5('s-' || conv_id), 1, 1) >= '8' AS swapped, max(length(text)) FILTER (turn = 0) AS a, max(length(text)) FILTER (turn = 1) AS b FROM conversations WHERE turn < 2 GROUP BY 1)""",
        "composed_texts": "SELECT doc_id, md5(nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)))) AS text_md5 FROM documents",
        "requests_valid": f"""SELECT doc_id, coalesce(locale, 'en') AS locale, coalesce(strength, 'standard') AS strength,
  coalesce(locale, 'en') IN ('en', 'fr') AND coalesce(strength, 'standard') IN ('light', 'standard', 'thorough') AND coalesce({units.format("voice")}, 0) <= 1500
  AND {units.format("text")} <= 5000 AND regexp_replace(text, '{space}+', '', 'g') <> '' AS accepted FROM ({asked})""",
        "user_messages": f"SELECT doc_id, md5(m) AS message_md5, length(m)::bigint AS n FROM (SELECT doc_id, {message} AS m FROM ({asked}))",
        "references_setting": "SELECT event_id, event_id % 9 >= 4 AS enabled FROM events",
        "facts_stated": "SELECT o_orderkey, n AS fact_no, n < 2 AS stated FROM orders, (VALUES (0::bigint), (1), (2)) f(n)",
        "history_append": "SELECT conv_id || '-' || turn AS id, CASE WHEN turn % 3 = 0 THEN 'old' ELSE role END AS role, CASE WHEN turn % 3 = 0 THEN 0 ELSE length(text) END::bigint AS n FROM conversations",
        "bulk_closed": "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') AND o_orderdate < TIMESTAMP '1996-01-01' THEN 'expired' ELSE o_orderstatus END AS state, CASE WHEN o_orderstatus IN ('O', 'P') AND o_orderdate < TIMESTAMP '1996-01-01' THEN DATE '1996-01-01' END AS closed FROM orders",
        "newest_days": "SELECT ts::date AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 31",
        "interleaved_caps": f"WITH {', '.join([start, *rounds])} SELECT lang, pos[1] AS doc_id, pos[2] AS passage_no FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pos) AS r FROM k6) WHERE r <= 200",
        "passage_rows": f"SELECT 'cc-' || doc_id || '-' || passage_no AS id, least(40 * length(source), 120)::bigint AS author_chars, least(90 * length(lang), 160)::bigint AS title_chars, doc_id AS year, n_words FROM ({_WINDOWS})",
        "credits": "SELECT source AS author, lang AS title FROM documents",
    }


ORACLES = _oracles()
