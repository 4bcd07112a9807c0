"""The ledger: scenarios of the fold, and ranks against it."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from inkwell.operators.ledger import Book, Limits, admitted, fold

T0 = datetime(2024, 1, 10, 12)
ROOMY = Limits(1000, 100_000, 1_000_000, 100, 90)


def test_in_flight_and_expiry():
    book = Book(Limits(5, 15, 300, 2, 90))
    assert [book.reserve("u", i, T0) for i in range(3)] == ["ok", "ok", "53400"]
    assert book.start("u", 0, T0) == "ok" and book.usage[("u", T0.date())] == 2
    later = T0 + timedelta(seconds=91)
    assert book.start("u", 1, later) == "false"  # too old to start, not yet given back
    assert book.reserve("u", 4, later) == "ok"
    assert (book.tickets[0].state, book.tickets[1].state, book.usage[("u", T0.date())]) == ("expired", "released", 2)


def test_exactly_at_the_lifetime_neither_holds():
    book = Book(Limits(5, 15, 300, 1, 90))
    book.reserve("u", 0, T0)
    edge = T0 + timedelta(seconds=90)
    assert book.start("u", 0, edge) == "false" and book.reserve("u", 1, edge) == "53400"


def test_release_and_finish_once():
    book = Book(ROOMY)
    book.reserve("u", 0, T0)
    assert [book.release("u", 0), book.release("u", 0), book.start("u", 0, T0)] == ["ok", "false", "false"]
    book.reserve("u", 1, T0)
    book.start("u", 1, T0)
    assert [book.finish("v", 1, "failed"), book.finish("u", 1, "odd"), book.search("u", 1), book.search("u", 1)] == ["false", "22023", "ok", "42501"]
    assert [book.finish("u", 1, "failed"), book.finish("u", 1, "failed"), book.search("u", 1)] == ["ok", "false", "42501"]
    assert book.reserve(None, 2, T0) == "28000"


def test_month_boundary():
    book = Book(Limits(100, 100, 2, 100, 90))
    for i, day in enumerate((30, 31)):
        book.reserve("u", i, T0.replace(day=day))
        assert book.start("u", i, T0.replace(day=day)) == "ok"
    assert book.reserve("u", 9, T0.replace(day=31)) == "53403"
    assert book.reserve("u", 9, T0.replace(month=2, day=1)) == "ok"


def test_ranks_equal_the_fold(spark):
    """Without refunds, and with every reservation started at once, admission is a chain of ranks."""
    draw = random.Random(3)
    limits = Limits(3, 12, 40, 10_000, 10_000_000)
    attempts = sorted((T0 + timedelta(hours=draw.randrange(24 * 40)), i, draw.randrange(8)) for i in range(400))
    events = [e for ts, i, u in attempts for e in ((f"r{i}", "reserve", u, i, ts, None), (f"s{i}", "start", u, i, ts, None))]
    results = dict(fold(events, limits))
    rows = spark.createDataFrame([(i, ts, u) for ts, i, u in attempts], "event_id bigint, ts timestamp, user_id bigint")
    found = {r["event_id"]: r["refused"] or "ok" for r in admitted(rows, limits).select("event_id", F.col("refused")).collect()}
    assert {i for i, r in found.items() if r == "ok"} == {i for _, i, _ in attempts if results[f"r{i}"] == "ok"}


class _Plain:
    """Brute force: every rule looks at all tickets and counters, from the words of the policy."""

    def __init__(self, limits):
        self.limits, self.rows, self.used, self.all = limits, [], {}, {}

    def _old(self, t, now):
        return t["created"] < now - timedelta(seconds=self.limits.ticket_ttl_seconds)

    def _full(self, now):
        if self.all.get(now.date(), 0) >= self.limits.global_daily:
            return "53402"
        month = sum(n for d, n in self.all.items() if d >= now.date().replace(day=1))
        return "53403" if month >= self.limits.global_monthly else None

    def apply(self, action, account, key, now, outcome):
        if account is None:
            return "28000"
        own = next((t for t in self.rows if t["id"] == key), None)
        if action == "reserve":
            live = [t for t in self.rows if t["state"] in ("reserved", "started")]
            stale = [t for t in live if self._old(t, now)]
            freed = sum(t["account"] == account and t["state"] == "reserved" and t["day"] == now.date() for t in stale)
            if sum(t["account"] == account for t in live) - sum(t["account"] == account for t in stale) >= self.limits.max_in_flight:
                return "53400"
            if max(self.used.get((account, now.date()), 0) - freed, 0) >= self.limits.user_daily:
                return "53401"
            if full := self._full(now):
                return full
            for t in stale:
                if t["state"] == "reserved":
                    self.used[t["account"], t["day"]] = max(self.used[t["account"], t["day"]] - 1, 0)
                t["state"] = "released" if t["state"] == "reserved" else "expired"
            self.used[account, now.date()] = self.used.get((account, now.date()), 0) + 1
            self.rows = [t for t in self.rows if t["id"] != key] + [{"id": key, "account": account, "day": now.date(), "created": now, "state": "reserved"}]
            gone = [t["id"] for t in sorted((t for t in self.rows if t["created"] < now - timedelta(days=2)), key=lambda t: (t["created"], t["id"]))][:200]
            self.rows = [t for t in self.rows if t["id"] not in gone]
            return "ok"
        wanted = {"start": "reserved", "release": "reserved", "finish": "started"}[action]
        if action == "finish" and outcome not in ("succeeded", "failed", "cancelled"):
            return "22023"
        if own is None or own["account"] != account or own["state"] != wanted or (action == "start" and not own["created"] > now - timedelta(seconds=self.limits.ticket_ttl_seconds)):
            return "false"
        if action == "start":
            if full := self._full(now):
                return full
            self.all[now.date()] = self.all.get(now.date(), 0) + 1
        if action == "release":
            self.used[account, own["day"]] = max(self.used[account, own["day"]] - 1, 0)
        own["state"] = {"start": "started", "release": "released", "finish": outcome}[action]
        return "ok"


def _brute(events, limits):
    plain = _Plain(limits)
    return {key: plain.apply(action, account, ticket, now, outcome) for key, action, account, ticket, now, outcome in events}


def test_fold_is_brute_force():
    for seed in range(12):
        draw, now, events = random.Random(seed), T0.replace(day=25), []
        limits = Limits(draw.randrange(2, 5), draw.randrange(4, 20), draw.randrange(20, 90), draw.randrange(1, 3), draw.choice([90, 7200, 86_400]))
        for k in range(400):
            now += timedelta(seconds=draw.choice([1, 30, 90, 91, 4000, 30_000]))
            ticket = k if draw.random() < 0.5 else draw.randrange(max(0, k - 12), k + 1)
            action = "reserve" if ticket == k else draw.choice(["start", "start", "finish", "release", "reserve"])
            events.append((k, action, draw.choice([None, "u", "u", "v", "w"]), ticket, now, draw.choice(["succeeded", "failed", "odd"])))
        assert dict(fold(events, limits)) == _brute(events, limits)


def test_registered_replay_is_brute_force(spark, sf):
    """The whole query, against the plain rules over the same events in order."""
    from inkwell.plans import ledger as plans

    rows = sorted(plans.replay_input(plans._events(spark, sf)).collect(), key=lambda r: (r["ts"], r["event_id"]))
    want = _brute([(r["event_id"], r["action"], r["account"], r["ticket"], r["ts"], r["outcome"]) for r in rows], plans.LIMITS)
    assert {r["event_id"]: r["result"] for r in plans.ledger_stateful(spark, sf).collect()} == want and len(set(want.values())) >= 3
