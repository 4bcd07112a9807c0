"""Queries over the events table, read as attempts by a declared mapping: signup reserves, view starts, click finishes, error fails, purchase releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.operators import ledger
from inkwell.sources.tables import table

ACTIONS = {"signup": "reserve", "view": "start", "click": "finish", "error": "finish", "purchase": "release"}
#: Wide enough for the events table to be refused by every limit now and then.
LIMITS = ledger.Limits(user_daily=2, global_daily=200, global_monthly=4000, max_in_flight=2, ticket_ttl_seconds=86_400)


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Times without a zone are UTC."""
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def ledger_admission(spark: SparkSession, d: str) -> DataFrame:
    judged = ledger.admitted(_events(spark, d).select("event_id", "user_id", "ts"), LIMITS)
    return judged.select("event_id", "refused")


def ledger_daily_totals(spark: SparkSession, d: str) -> DataFrame:
    judged = ledger.admitted(_events(spark, d).select("event_id", "user_id", "ts"), LIMITS)
    return judged.groupBy(F.to_date("ts").alias("day"), F.coalesce("refused", F.lit("ok")).alias("result")).agg(F.count("*").alias("n"))


def usage_by_day(spark: SparkSession, d: str) -> DataFrame:
    return ledger.usage_by_day(_events(spark, d))


def global_usage(spark: SparkSession, d: str) -> DataFrame:
    return ledger.month_to_date(ledger.usage_global(ledger.usage_by_day(_events(spark, d))))


def _tickets(spark: SparkSession, d: str) -> DataFrame:
    """Every event opens a ticket that stays open for half a day."""
    return _events(spark, d).select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("opened"), (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("closed"))


def inflight_overlap(spark: SparkSession, d: str) -> DataFrame:
    return ledger.in_flight(_tickets(spark, d)).select("id", "open_before")


def ticket_state_counts(spark: SparkSession, d: str) -> DataFrame:
    """Each account has one ticket, whose state is its last event's."""
    return ledger.ticket_states(_events(spark, d), "user_id", "event_type")


def refusal_codes(spark: SparkSession, d: str) -> DataFrame:
    """A code for each event, by its id: every refusal, another code, and none."""
    codes = F.array(*[F.lit(c) for c in (*ledger.REFUSALS, "42501")], F.lit(None))
    code = ledger.refusal(F.element_at(codes, (F.pmod("event_id", F.lit(8)) + 1).cast("int")))
    return table(spark, d, "events").select("event_id", code["code"].alias("code"), code["status"].alias("status"))


def replay_input(events: DataFrame) -> DataFrame:
    """(event_id, ts, action, account, ticket, outcome): a reservation's ticket is its own id, later moves concern the account's latest."""
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[F.col("event_type")]
    latest = F.last(F.when(F.col("action") == "reserve", F.col("event_id")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    outcome = F.when(F.col("event_type") == "click", "succeeded").when(F.col("event_type") == "error", "failed")
    return events.withColumn("action", action).select("event_id", "ts", "action", F.col("user_id").alias("account"), F.coalesce(latest, F.lit(-1)).alias("ticket"), outcome.alias("outcome"))


def ledger_stateful(spark: SparkSession, d: str) -> DataFrame:
    return ledger.replay(replay_input(_events(spark, d)), LIMITS)


QUERIES = {f.__name__: f for f in (ledger_admission, ledger_daily_totals, usage_by_day, global_usage, inflight_overlap, ticket_state_counts, refusal_codes, ledger_stateful)}

_ADMITTED = f"""
SELECT a.event_id, a.ts, CASE WHEN own > {LIMITS.user_daily} THEN '53401' WHEN al > {LIMITS.global_daily} THEN '53402' WHEN mo > {LIMITS.global_monthly} THEN '53403' END AS refused
FROM (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id, ts::date ORDER BY ts, event_id) AS own FROM events) a
LEFT JOIN (SELECT event_id, al, CASE WHEN al <= {LIMITS.global_daily} THEN row_number() OVER (PARTITION BY date_trunc('month', ts), al <= {LIMITS.global_daily} ORDER BY ts, event_id) END AS mo FROM (
  SELECT event_id, ts, row_number() OVER (PARTITION BY ts::date ORDER BY ts, event_id) AS al FROM (
    SELECT event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts::date ORDER BY ts, event_id) <= {LIMITS.user_daily}))) b USING (event_id)"""
ORACLES = {
    "ledger_admission": f"SELECT event_id, refused FROM ({_ADMITTED})",
    "ledger_daily_totals": f"SELECT ts::date AS day, coalesce(refused, 'ok') AS result, count(*) AS n FROM ({_ADMITTED}) GROUP BY ALL",
    "usage_by_day": "SELECT user_id, ts::date AS day, count(*) AS count FROM events GROUP BY ALL",
    "global_usage": "SELECT day, count, (sum(count) OVER (PARTITION BY date_trunc('month', day) ORDER BY day))::bigint AS month_to_date FROM (SELECT ts::date AS day, count(*) AS count FROM events GROUP BY 1)",
    "inflight_overlap": "SELECT a.event_id AS id, count(b.event_id) AS open_before FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND (b.ts, b.event_id) < (a.ts, a.event_id) AND b.ts + INTERVAL 12 HOUR > a.ts GROUP BY 1",
    "ticket_state_counts": "SELECT state, count(*) AS n FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1) GROUP BY 1",
    "refusal_codes": "SELECT event_id, (['too_many_requests', 'quota_exceeded', 'global_quota_exceeded', 'global_quota_exceeded', 'unauthorized', 'unauthorized', 'server_error', 'server_error'])[(event_id % 8 + 1)::int] AS code, ([429, 429, 429, 429, 401, 401, 500, 500])[(event_id % 8 + 1)::int] AS status FROM events",
}
