"""URL filters: a temporal list join.

A list is a table of dated entries: on a day, a pattern is set to "deny" or "allow", or is taken off the list ("remove"). The entries of
one pattern, in the order of their dates, become validity intervals [from, until) that do not overlap. A capture has a few possible
patterns: its host's domains, down to the last label, and its host with the first parts of the path, as many as the deepest entry has. They are joined with the intervals as of the capture's
own fetch time, and the most specific active entry decides.

Defined results: a row for each capture; verdict "unlisted" where no entry is active at the fetch time, where the URL is null or has
no host, or where the fetch time is null. Of entries of one pattern and date the last by action wins ("remove" over "deny" over
"allow"). Repeated captures give repeated rows; an empty list leaves all unlisted; an empty table gives an empty result; other
columns of both tables are ignored. Hosts are compared as a browser would ask for them: without blanks around the URL, with or
without a scheme, with backslashes for slashes, percent escapes read, Unicode names in ASCII, in lower case and without a dot at the
end. Ports, users, queries and fragments are not part of patterns; entries that are null or blank list nothing.

Captures that are equal in what is read are one row while they are joined. The list is broadcast while it is small; beyond, the
join shuffles on the pattern, and adaptive execution splits a host that holds a third of the captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm import base

#: Parts of a path that the patterns of test_entries may name, for the SQL; `evaluate` takes entries of any depth.
PATH_PARTS = 2
#: What precedes the host, with any number of slashes after a scheme of the web; the host and port, and the path.
SCHEME = r"^(?:(?i:https?|ftp|wss?):/*|(?:[A-Za-z][A-Za-z0-9+.-]*:)?//+)"
#: The same for URLs that are spelled plainly, as those of the test tables are, for the SQL.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def _plain_host(host: Column) -> Column:
    """A host in one spelling: percent escapes read, letters beyond ASCII in their ASCII form, lower case, no dot at its end."""
    read = F.coalesce(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))), host)
    ascii_ = F.when(read.rlike(r"[^\x00-\x7F]"), F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), read), read)).otherwise(read)
    return F.regexp_replace(F.lower(ascii_), r"\.+$", "")


def _head(url: Column) -> Column:
    """A URL without what browsers drop: blanks around it, line ends and tabs in it, its query and fragment; with slashes for backslashes."""
    whole = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")
    return F.translate(F.regexp_extract(whole, r"^[^?#]*", 0), "\\", "/")


def host_of(url: Column) -> Column:
    """The host that a browser would ask, "" where there is none."""
    authority = F.regexp_extract(_head(url), SCHEME + "([^/]*)", 1)
    return _plain_host(F.regexp_extract(F.regexp_extract(authority, "([^@]*)$", 1), r"^(\[[^\]]*\]|[^:]*)", 1))


def path_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(_head(url), SCHEME + "[^/]*(.*)", 1))


def pattern_of(entry: Column) -> Column:
    """An entry of a list in the spelling of hosts and paths."""
    text = F.trim(entry)
    return F.concat(_plain_host(F.regexp_extract(text, "^[^/]*", 0)), F.lower(F.regexp_extract(text, "/.*$", 0)))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, from, until) of (pattern, action, day): until is the day of the pattern's next entry, or null."""
    one = entries.select(pattern_of(F.col("pattern")).alias("pattern"), "action", "day").where("pattern <> '' and day is not null").groupBy("pattern", "day").agg(F.max("action").alias("action"))
    until = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    return one.select("pattern", "action", F.col("day").alias("from"), until.alias("until")).where("action <> 'remove'")


def depth(listed: DataFrame) -> int:
    """The most path parts that a pattern of the list names."""
    return listed.agg(F.max(F.size(F.split("pattern", "/")) - 2).alias("n")).first()["n"] or 0


def patterns(url: Column, parts_at_most: int) -> Column:
    """Possible patterns of a URL, each with its rank: longer hosts and paths are more specific."""
    def of(host: Column) -> Column:
        labels = F.split(host, r"\.")
        n = F.size(labels)
        domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.array_join(F.slice(labels, i, n), ".").alias("pattern"), (n - i).alias("rank")))
        parts = F.slice(F.array_remove(F.split(path_of(url), "/"), ""), 1, max(parts_at_most, 0))
        at = F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)))
        paths = F.transform(F.filter(at, lambda k: k <= F.size(parts)), lambda k: F.struct(F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")).alias("pattern"), (F.lit(1000) + k).alias("rank")))
        return F.when(host == "", F.array().cast("array<struct<pattern:string,rank:int>>")).otherwise(F.concat(domains, paths))

    return base.let(host_of(url), of)


def evaluate(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """(key, url, fetched, verdict, pattern, since) for every capture."""
    columns = [key, url, fetched]
    same = captures.select(*columns).groupBy(*columns).count()
    listed = base.bounded(base.stored(intervals(entries), "intervals"))
    asked = same.select("*", F.explode_outer(patterns(F.col(url), depth(listed))).alias("p")).select(*columns, "count", "p.pattern", "p.rank")
    active = (F.col(f"a.{fetched}") >= F.col("l.from")) & (F.col("l.until").isNull() | (F.col(f"a.{fetched}") < F.col("l.until")))
    joined = asked.alias("a").join(listed.alias("l"), (F.col("a.pattern") == F.col("l.pattern")) & active, "left")
    found = F.when(F.col("l.pattern").isNotNull(), F.struct(F.col("l.action").alias("verdict"), F.col("l.pattern").alias("pattern"), F.col("l.from").alias("since")))
    best = joined.groupBy(*[F.col(f"a.{c}").alias(c) for c in columns], F.col("a.count").alias("count")).agg(F.max_by(found, F.when(F.col("l.pattern").isNotNull(), F.col("a.rank"))).alias("best"))
    rows = best.select(*columns, F.coalesce("best.verdict", F.lit("unlisted")).alias("verdict"), F.col("best.pattern").alias("pattern"), F.col("best.since").alias("since"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("count"))).alias("copy"))
    return rows.drop("copy")


FIRST_DAY, DAYS = "2024-01-01", 360


def test_captures(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch times; a page's is a day of 2024 by its id."""
    return pages.select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id"), F.lit(DAYS)).cast("int")).alias("fetched"))


def test_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of the pages: what is listed and when follows from md5 of the pattern.

    Every host is denied on one day and taken off 90 days later, or allowed; the domains above are denied for the second half of the
    year; a host's first path part is allowed from a day of its own on.
    """
    host = F.lower(F.regexp_extract(F.col("url"), HOST, 1))
    hosts = pages.select(host.alias("host")).where("host <> ''").distinct()
    draw = lambda c, most: F.pmod(F.conv(F.substring(F.md5(c.cast("binary")), 1, 6), 16, 10).cast("bigint"), F.lit(most)).cast("int")
    day = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n)
    at = draw(F.col("host"), 270)
    own = hosts.select(F.col("host").alias("pattern"), F.when(draw(F.concat(F.lit("a"), F.col("host")), 3) == 0, "allow").otherwise("deny").alias("action"), day(at).alias("day"))
    gone = hosts.select(F.col("host").alias("pattern"), F.lit("remove").alias("action"), day(at + 90).alias("day"))
    above = hosts.select(F.substring_index("host", ".", -2).alias("pattern")).distinct().select("pattern", F.lit("deny").alias("action"), day(F.lit(180)).alias("day"))
    path = hosts.select(F.concat("host", F.lit("/en/")).alias("pattern")).select("pattern", F.lit("allow").alias("action"), day(draw(F.col("pattern"), 360)).alias("day"))
    return own.unionByName(gone).unionByName(above).unionByName(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = base.read(spark, sf_dir, "pages")
    return evaluate(test_captures(pages), test_entries(pages))


ORACLE = rf"""
WITH p AS (SELECT page_id, url, DATE '{FIRST_DAY}' + (page_id % {DAYS})::int AS fetched,
    lower(regexp_extract(url, '{HOST}', 1)) AS host, list_filter(string_split(lower(regexp_extract(url, '{PATH}', 1)), '/'), lambda x: x <> '') AS parts FROM pages),
h AS (SELECT DISTINCT host FROM p WHERE host <> ''),
e AS (
  SELECT host AS pattern, CASE WHEN ('0x' || substr(md5('a' || host), 1, 6))::bigint % 3 = 0 THEN 'allow' ELSE 'deny' END AS action, DATE '{FIRST_DAY}' + (('0x' || substr(md5(host), 1, 6))::bigint % 270)::int AS day FROM h
  UNION ALL SELECT host, 'remove', DATE '{FIRST_DAY}' + (('0x' || substr(md5(host), 1, 6))::bigint % 270)::int + 90 FROM h
  UNION ALL SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), -2, -1), '.'), 'deny', DATE '{FIRST_DAY}' + 180 FROM h
  UNION ALL SELECT host || '/en/', 'allow', DATE '{FIRST_DAY}' + (('0x' || substr(md5(host || '/en/'), 1, 6))::bigint % 360)::int FROM h),
v AS (SELECT pattern, max(action) AS action, day AS since, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS until FROM e GROUP BY pattern, day),
k AS (
  SELECT page_id, url, fetched, array_to_string(list_slice(string_split(host, '.'), i, 99), '.') AS pattern, len(string_split(host, '.')) - i AS rank
  FROM (SELECT *, unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS i FROM p WHERE host <> '')
  UNION ALL SELECT page_id, url, fetched, host || '/' || array_to_string(list_slice(parts, 1, i), '/') || '/', 1000 + i
  FROM (SELECT *, unnest(range(1, least(len(parts), {PATH_PARTS}) + 1)) AS i FROM p WHERE host <> '')),
b AS (SELECT page_id, url, fetched, arg_max(v.action, rank) AS verdict, arg_max(v.pattern, rank) AS pattern, arg_max(v.since, rank) AS since
  FROM k JOIN v ON k.pattern = v.pattern AND fetched >= v.since AND (v.until IS NULL OR fetched < v.until) AND v.action <> 'remove' GROUP BY page_id, url, fetched)
SELECT p.page_id, p.url, p.fetched::date AS fetched, coalesce(b.verdict, 'unlisted') AS verdict, b.pattern, b.since::date AS since FROM p LEFT JOIN b USING (page_id)
"""
