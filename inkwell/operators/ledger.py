"""The ledger of attempts: tickets, daily and monthly limits.

Two forms. Where every reservation starts at once and nothing is given back, limits are monotone and admission is a chain of ranks
(`admitted`), which Spark computes by window. With refunds, tickets in flight and expiry only the order of events decides:
`fold` applies them one at a time, and `replay` runs it over a table; the ceilings for all accounts make that one key by nature.
"""

from __future__ import annotations

from calendar import monthrange
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from heapq import heappop, heappush
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Limits(NamedTuple):
    """The shipped policy."""

    user_daily: int = 5
    global_daily: int = 15
    global_monthly: int = 300
    max_in_flight: int = 2
    ticket_ttl_seconds: int = 90


RETENTION, PURGE = timedelta(days=2), 200
OPEN, OUTCOMES = ("reserved", "started"), ("succeeded", "failed", "cancelled")
#: What a refusal's code means to a reader, and its status; any other code is a server error.
REFUSALS = {
    "53400": ("too_many_requests", 429),
    "53401": ("quota_exceeded", 429),
    "53402": ("global_quota_exceeded", 429),
    "53403": ("global_quota_exceeded", 429),
    "28000": ("unauthorized", 401),
    "23503": ("unauthorized", 401),
}


def refusal(code: Column) -> Column:
    """struct(code, status) for a refusal's code."""
    shown = F.struct(F.lit("server_error").alias("code"), F.lit(500).alias("status"))
    for known, (name, status) in REFUSALS.items():
        shown = F.when(code == known, F.struct(F.lit(name).alias("code"), F.lit(status).alias("status"))).otherwise(shown)
    return shown


def admitted(attempts: DataFrame, limits: Limits = Limits(), user: str = "user_id", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """attempts with `refused`: null, or the code of the first limit that the attempt's rank is beyond.

    The same attempts are admitted as by the fold. The code can differ: ranks count an account's refused attempts too.

    Ranks within (account, day) come first and keep at most user_daily rows of each, so that what the day's and the month's ranks
    sort is bounded by accounts times days, and the rows beyond are marked without being sorted again.
    """
    day, month = F.to_date(F.col(ts)), F.date_trunc("month", F.col(ts))
    at = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(ts, key))
    own = attempts.withColumn("_day", day).withColumn("_month", month).withColumn("_own", at(F.col(user), F.col("_day")))
    within = own.where(F.col("_own") <= limits.user_daily).withColumn("_all", at(F.col("_day")))
    daily = within.where(F.col("_all") <= limits.global_daily).withColumn("_sum", at(F.col("_month")))
    # a full month refuses everyone, so it is looked at last; a day's refusals never free it
    verdicts = daily.select(key, F.when(F.col("_sum") > limits.global_monthly, "53403").otherwise("ok").alias("_verdict"))
    joined = own.join(verdicts, key, "left")
    code = F.when(F.col("_own") > limits.user_daily, "53401").when(F.col("_verdict").isNull(), "53402").when(F.col("_verdict") != "ok", F.col("_verdict"))
    return joined.withColumn("refused", code).drop("_day", "_month", "_own", "_verdict")


def usage_by_day(accepted: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    return accepted.groupBy(F.col(user), F.to_date(F.col(ts)).alias("day")).agg(F.count("*").alias("count"))


def usage_global(usage: DataFrame) -> DataFrame:
    return usage.groupBy("day").agg(F.sum("count").cast("bigint").alias("count"))


def month_to_date(daily: DataFrame) -> DataFrame:
    """Each day's count with the running total of its month."""
    w = Window.partitionBy(F.date_trunc("month", F.col("day"))).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("month_to_date", F.sum("count").over(w).cast("bigint"))


def in_flight(tickets: DataFrame, user: str = "user_id", opened: str = "opened", closed: str = "closed", key: str = "id") -> DataFrame:
    """tickets with the number of the account's tickets open when each was opened, itself not counted.

    A sweep over openings and closings instead of a join of intervals: +1 and -1 in time order; a ticket that closes as another opens is closed.
    """
    moves = tickets.select(user, F.col(opened).alias("_at"), F.lit(1).alias("_kind"), F.lit(1).alias("_step"), key).unionByName(
        tickets.where(F.col(closed).isNotNull()).select(user, F.col(closed).alias("_at"), F.lit(0).alias("_kind"), F.lit(-1).alias("_step"), key)
    )
    ahead = Window.partitionBy(user).orderBy("_at", "_kind", key).rowsBetween(Window.unboundedPreceding, -1)
    swept = moves.withColumn("open_before", F.coalesce(F.sum("_step").over(ahead), F.lit(0)).cast("bigint"))
    return swept.where("_kind = 1").select(user, key, F.col("_at").alias(opened), "open_before")


@dataclass
class Ticket:
    account: object
    day: date
    created: datetime
    state: str = "reserved"
    searched: bool = False


@dataclass
class Book:
    """The state of the ledger: tickets and counters. Times are UTC.

    Open tickets are found by their account, and by age through a heap, so that an event costs what it changes and not what is held.
    """

    limits: Limits = Limits()
    tickets: dict[object, Ticket] = field(default_factory=dict)
    usage: dict[tuple[object, date], int] = field(default_factory=dict)
    total: dict[date, int] = field(default_factory=dict)
    open: dict[object, set] = field(default_factory=dict)
    to_expire: list[tuple[datetime, object]] = field(default_factory=list)
    to_purge: list[tuple[datetime, object]] = field(default_factory=list)

    def _give_back(self, ticket: Ticket) -> None:
        at = (ticket.account, ticket.day)
        self.usage[at] = max(self.usage.get(at, 0) - 1, 0)

    def _ceiling(self, today: date) -> str | None:
        if self.total.get(today, 0) >= self.limits.global_daily:
            return "53402"
        spent = sum(self.total.get(today.replace(day=k), 0) for k in range(1, 1 + monthrange(today.year, today.month)[1])) + sum(n for d, n in self.total.items() if d > today and (d.year, d.month) != (today.year, today.month))
        return "53403" if spent >= self.limits.global_monthly else None

    def _close(self, key: object, ticket: Ticket, state: str) -> None:
        ticket.state = state
        self.open.get(ticket.account, set()).discard(key)

    def reserve(self, account: object, ticket: object, now: datetime) -> str:
        """ "ok", or the code of the refusal, which leaves everything as it was."""
        if account is None:
            return "28000"
        today, limit = now.date(), now - timedelta(seconds=self.limits.ticket_ttl_seconds)
        own = [self.tickets[k] for k in self.open.get(account, ())]
        back = sum(t.created < limit and t.state == "reserved" and t.day == today for t in own)
        if sum(t.created >= limit for t in own) >= self.limits.max_in_flight:
            return "53400"
        if max(self.usage.get((account, today), 0) - back, 0) >= self.limits.user_daily:
            return "53401"
        if code := self._ceiling(today):
            return code
        while self.to_expire and self.to_expire[0][0] < limit:
            created, key = heappop(self.to_expire)
            stale = self.tickets.get(key)
            if stale is not None and stale.created == created and stale.state in OPEN:
                if stale.state == "reserved":
                    self._give_back(stale)
                self._close(key, stale, "released" if stale.state == "reserved" else "expired")
        self.usage[(account, today)] = self.usage.get((account, today), 0) + 1
        if ticket in self.tickets:
            self.open.get(self.tickets[ticket].account, set()).discard(ticket)
        self.tickets[ticket] = Ticket(account, today, now)
        self.open.setdefault(account, set()).add(ticket)
        heappush(self.to_expire, (now, ticket))
        heappush(self.to_purge, (now, ticket))
        purged = 0
        while purged < PURGE and self.to_purge and self.to_purge[0][0] < now - RETENTION:
            created, key = heappop(self.to_purge)
            old = self.tickets.get(key)
            if old is not None and old.created == created:
                self.open.get(old.account, set()).discard(key)
                del self.tickets[key]
                purged += 1
        return "ok"

    def start(self, account: object, ticket: object, now: datetime) -> str:
        own = self.tickets.get(ticket)
        if account is None:
            return "28000"
        if own is None or own.account != account or own.state != "reserved" or not own.created > now - timedelta(seconds=self.limits.ticket_ttl_seconds):
            return "false"
        if code := self._ceiling(now.date()):
            return code
        own.state = "started"
        self.total[now.date()] = self.total.get(now.date(), 0) + 1
        return "ok"

    def finish(self, account: object, ticket: object, outcome: str | None) -> str:
        own = self.tickets.get(ticket)
        if account is None:
            return "28000"
        if outcome not in OUTCOMES:
            return "22023"
        if own is None or own.account != account or own.state != "started":
            return "false"
        self._close(ticket, own, outcome)
        return "ok"

    def release(self, account: object, ticket: object) -> str:
        own = self.tickets.get(ticket)
        if account is None:
            return "28000"
        if own is None or own.account != account or own.state != "reserved":
            return "false"
        self._close(ticket, own, "released")
        self._give_back(own)
        return "ok"

    def search(self, account: object, ticket: object) -> str:
        """Once for each started ticket of the account."""
        own = self.tickets.get(ticket)
        if account is None:
            return "28000"
        if own is None or own.account != account or own.state != "started" or own.searched:
            return "42501"
        own.searched = True
        return "ok"

    def apply(self, action: str, account: object, ticket: object, now: datetime, outcome: str | None = None) -> str:
        match action:
            case "reserve":
                return self.reserve(account, ticket, now)
            case "start":
                return self.start(account, ticket, now)
            case "finish":
                return self.finish(account, ticket, outcome)
            case "release":
                return self.release(account, ticket)
            case "search":
                return self.search(account, ticket)
        return "unknown"


def fold(events: Iterable[tuple], limits: Limits = Limits()) -> Iterator[tuple[object, str]]:
    """(event id, result) for (id, action, account, ticket, time, outcome) in order."""
    book = Book(limits)
    for key, action, account, ticket, now, outcome in events:
        yield key, book.apply(action, account, ticket, now, outcome)


def replay(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(event_id, result) of (event_id, ts, action, account, ticket, outcome), in the order of (ts, event_id).

    One task by design: the ceilings of all accounts order all events, as one lock would. It reads a sorted stream, batch after
    batch, and holds the tickets of two days. For limits by account alone use `admitted`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = Book(limits)
        for rows in batches:
            out = [(r.event_id, book.apply(r.action, None if pd.isna(r.account) else r.account, r.ticket, r.ts.to_pydatetime(), r.outcome)) for r in rows.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["event_id", "result"])

    return events.repartition(1).sortWithinPartitions("ts", "event_id").mapInPandas(run, "event_id bigint, result string")


def ticket_states(moves: DataFrame, ticket: str = "ticket", state: str = "state", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """How many tickets are in each state, by the last move of each."""
    last = moves.groupBy(ticket).agg(F.max_by(state, F.struct(ts, key)).alias("state"))
    return last.groupBy("state").agg(F.count("*").alias("n"))
