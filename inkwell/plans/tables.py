"""Queries over relational tables: histories, deletes, upserts, constraints, joins, summaries and web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import metadata as M
from inkwell.functions import text as T
from inkwell.operators import stats, tables, web
from inkwell.sources.tables import table


def history_newest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'user'")
    return tables.newest(rows, "conv_id", "turn", "turn", 2).select("conv_id", "turn", F.col("total").cast("bigint"), F.col("place").cast("bigint"))


def history_search(spark: SparkSession, d: str) -> DataFrame:
    page = tables.newest(table(spark, d, "conversations"), "conv_id", "turn", "turn", 3)
    return tables.found_in(page, "text", "  The ").select("conv_id", "turn")


def history_owned(spark: SparkSession, d: str) -> DataFrame:
    return tables.owned(table(spark, d, "events"), 7).select("event_id", "event_type")


def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    changed = orders.where("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.lit("X")).withColumn("at", F.lit(1))
    later = orders.where("o_orderkey % 14 = 0").withColumn("o_orderstatus", F.lit("Y")).withColumn("at", F.lit(2))
    new = orders.where("o_orderkey % 5 = 0").withColumn("o_orderkey", -F.col("o_orderkey")).withColumn("at", F.lit(1))
    merged = tables.upserted(orders, changed.unionByName(later).unionByName(new), "o_orderkey", "at")
    return merged.select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


def bounded_purge(spark: SparkSession, d: str) -> DataFrame:
    left = tables.purged(table(spark, d, "events"), "event_id", "ts", F.lit("2024-01-10").cast("timestamp_ntz"))
    return left.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def account_deletion(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    left = tables.account_deleted({"events": events, "usage_global": events}, 7)
    return left["events"].agg(F.count("*").alias("n")).withColumn("name", F.lit("events")).unionByName(left["usage_global"].agg(F.count("*").alias("n")).withColumn("name", F.lit("usage_global")))


def send_batches(spark: SparkSession, d: str) -> DataFrame:
    numbered = tables.batches(table(spark, d, "customer").select("c_custkey"), ["c_custkey"])
    return numbered.groupBy("batch_no").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"))


def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    checks = {"long": F.col("n_chars") <= 5000, "lang": F.col("lang").isin("en", "fr"), "words": F.col("n_chars") > 0}
    return tables.violations(table(spark, d, "documents"), checks).select("doc_id", F.array_join("broken", ",").alias("broken"))


def orders_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    big = orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    some = customers.join(big, "c_custkey", "left_semi").select("c_custkey", F.lit("some").alias("orders"))
    return some.unionByName(customers.join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", F.lit("none").alias("orders")))


def listagg_roles(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "region").select(F.col("r_name").alias("role"), "r_regionkey")
    nations = table(spark, d, "nation")
    granted = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).select("role", F.lit("table").alias("object"), F.col("n_name").alias("privilege"))
    return tables.privileges(regions.select("role"), spark.createDataFrame([("table",), ("view",)], "object string"), granted)


def median_and_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    middle = stats.medians(items, ["l_returnflag"], "l_extendedprice").select("l_returnflag", F.round("median", 6).alias("median"))
    return middle.join(stats.nearest_ranks(items, ["l_returnflag"], "l_extendedprice", {"upper_middle": 50, "p95": 95}), "l_returnflag")


def area_status_pivot(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("area", F.date_format("ts", "yyyy-MM-dd"))
    return stats.pivoted(events, "area", "event_type", ["view", "click", "error"])


def first_seen_issues(spark: SparkSession, d: str) -> DataFrame:
    return stats.first_seen(table(spark, d, "events"), "event_type", "props", "user_id", "event_id")


def paired_comparison(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("turn < 2")
    rated = turns.select("conv_id", F.when(F.col("turn") == 0, "on").otherwise("off").alias("condition"), F.pmod(F.length("text"), F.lit(5)).alias("naturalness"), F.pmod(F.length("text"), F.lit(3)).alias("errors"))
    return stats.paired(rated, "conv_id", "condition", "naturalness", "errors")


def detector_auroc(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return stats.auroc(rows, "n_chars", "quality").select(F.round("auroc", 6).alias("auroc"))


def host_domains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", M.host(F.col("url")).alias("host"), M.registered_domain(F.col("url")).alias("domain"))


def listed_sites(spark: SparkSession, d: str) -> DataFrame:
    """Addresses made of each page's: of a listed site, of a subdomain of one, of a host that only looks like one, and of none."""
    path, k = F.regexp_extract("url", r"^[a-z]+://[^/]*(.*)$", 1), F.pmod("page_id", F.lit(6))
    url = F.when(k == 0, F.concat(F.lit("https://www.bbc.co.uk"), path)).when(k == 1, F.concat(F.lit("http://blogs.lemonde.fr"), path)).when(k == 2, F.concat(F.lit("https://nytimes.com.evil.example"), path)).when(k == 3, "not a url").when(k == 4, F.concat(F.lit("https://www.theguardian.com"), path))
    return table(spark, d, "pages").select("page_id", M.registered_domain(url).alias("domain"), M.matching_site(url, web.SITES["en"] + web.SITES["fr"]).alias("site"))


def allowed_pages(spark: SparkSession, d: str) -> DataFrame:
    sites = spark.createDataFrame([("example.com",), ("example.org",)], "site string")
    return web.on_sites(table(spark, d, "pages").select("page_id", "url"), sites).groupBy("site").agg(F.count("*").alias("n"))


def article_clean(spark: SparkSession, d: str) -> DataFrame:
    made = web.articles(table(spark, d, "pages").select("page_id", "html"))
    return made.select("page_id", F.col("n_words").cast("bigint"), F.md5(F.col("body").cast("binary")).alias("body_md5"), web.is_usable().alias("usable"))


QUERIES = {f.__name__: f for f in (
    history_newest, history_search, history_owned, merge_upsert, bounded_purge, account_deletion, send_batches, constraint_violations, orders_semi_anti, listagg_roles, median_and_nearest_rank,
    area_status_pivot, first_seen_issues, paired_comparison, detector_auroc, host_domains, listed_sites, allowed_pages, article_clean,
)}

def _article_sql() -> str:
    """DuckDB: a page's text, by the same steps in RE2, and the article's lines."""
    from inkwell.plans.corpus import _PAGE, _TOKENS, _WS

    block = "p|div|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|br"
    text = f"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script(?:\\s[^>]*)?>.*?</script>|<style(?:\\s[^>]*)?>.*?</style>|<head(?:\\s[^>]*)?>.*?</head>|<!--.*?-->', '', 'g'), '(?i)<(?:/?(?:{block})(?:\\s[^>]*)?/?)>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for entity, char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        text = f"replace({text}, '{entity}', {char})"
    return f"""
WITH l AS (SELECT page_id, list_filter(list_transform(string_split(replace({text}, chr(13), ''), chr(10)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') AS lines FROM pages),
f AS (SELECT page_id, lines, coalesce(list_position(list_transform(lines, lambda x: regexp_matches(x, '(?i)^(related|read more|more from|you may also|lire aussi|à lire aussi)')), true), len(lines) + 1) AS foot FROM l),
b AS (SELECT page_id, array_to_string(list_filter(list_slice(lines, 1, foot - 1), lambda x: len({_TOKENS.format('x')}) >= {T.PAGE_LINE_WORDS} OR NOT regexp_matches(x, '{_PAGE}')), chr(10) || chr(10)) AS body FROM f)
SELECT page_id, len({_TOKENS.format('body')})::bigint AS n_words, md5(body) AS body_md5, len({_TOKENS.format('body')}) BETWEEN {M.MIN_ARTICLE_WORDS} AND {M.MAX_ARTICLE_WORDS} AS usable FROM b"""


ORACLES = {
    "article_clean": _article_sql(),
    "history_newest": "SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations WHERE role = 'user' QUALIFY place <= 2",
    "history_search": "SELECT conv_id, turn FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) WHERE contains(lower(text), 'the')",
    "history_owned": "SELECT event_id, event_type FROM events WHERE user_id = 7",
    "merge_upsert": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 14 = 0 THEN 'Y' WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey <> 0",
    "bounded_purge": "SELECT ts::date AS day, count(*) AS n FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 200) GROUP BY 1",
    "account_deletion": "SELECT 'events' AS name, count(*) AS n FROM events WHERE user_id IS DISTINCT FROM 7 UNION ALL SELECT 'usage_global', count(*) FROM events",
    "send_batches": "SELECT batch_no, count(*) AS n, min(c_custkey) AS first_key FROM (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS batch_no FROM customer) GROUP BY 1",
    "constraint_violations": "SELECT * FROM (SELECT doc_id, concat_ws(',', CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN lang NOT IN ('en', 'fr') THEN 'lang' END, CASE WHEN n_chars <= 0 THEN 'words' END) AS broken FROM documents) WHERE broken <> ''",
    "orders_semi_anti": "SELECT c_custkey, 'some' AS orders FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) UNION ALL SELECT c_custkey, 'none' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "listagg_roles": "SELECT r_name AS role, o.object, coalesce(CASE WHEN o.object = 'table' THEN (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) END, '') AS privileges FROM region, (VALUES ('table'), ('view')) o(object)",
    "median_and_nearest_rank": "SELECT l_returnflag, round(median(l_extendedprice), 6) AS median, list_sort(list(l_extendedprice))[1 + least(count(*) - 1, floor(0.5 * count(*)))::bigint] AS upper_middle, list_sort(list(l_extendedprice))[1 + least(count(*) - 1, (95 * count(*)) // 100)::bigint] AS p95 FROM lineitem GROUP BY 1",
    "area_status_pivot": "SELECT strftime(ts, '%Y-%m-%d') AS area, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1",
    "first_seen_issues": "SELECT event_type, props, arg_min(user_id, event_id) AS first_at, count(*) AS times FROM events GROUP BY 1, 2",
    "paired_comparison": "SELECT *, CASE WHEN pairs < 10 THEN 'no answer' WHEN errors_on <= errors_off AND gain >= 0.5 THEN 'keep' ELSE 'leave off' END AS decision FROM (SELECT count(*) AS pairs, sum(length(a.text) % 3)::bigint AS errors_on, sum(length(b.text) % 3)::bigint AS errors_off, median(length(a.text) % 5 - length(b.text) % 5)::double AS gain FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1)",
    "detector_auroc": "WITH r AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)), p AS (SELECT n_chars FROM r WHERE quality = 1), n AS (SELECT n_chars FROM r WHERE quality = 0) SELECT round(avg(CASE WHEN p.n_chars > n.n_chars THEN 1.0 WHEN p.n_chars = n.n_chars THEN 0.5 ELSE 0.0 END), 6) AS auroc FROM p, n",
    "host_domains": "SELECT page_id, host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)), '^www\\.', '') AS host FROM pages)",
    "listed_sites": "SELECT page_id, (['bbc.co.uk', 'lemonde.fr', 'evil.example', '', 'theguardian.com', ''])[(page_id % 6 + 1)::int] AS domain, (['bbc.co.uk', 'lemonde.fr', NULL, NULL, 'theguardian.com', NULL])[(page_id % 6 + 1)::int] AS site FROM pages",
    "allowed_pages": "SELECT site, count(*) AS n FROM pages, (VALUES ('example.com'), ('example.org')) s(site) WHERE regexp_matches(url, '://([^/]*\\.)?' || replace(site, '.', '\\.') || '([/:?#]|$)') GROUP BY 1",
}
