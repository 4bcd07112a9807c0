"""Tickets as a stream with timers, and events put together again from pieces."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkwell.operators.ledger import RETENTION, Limits
from inkwell.streaming.chunks import EventLines

LIFE = "ticket bigint, state string, at timestamp"
LIFE_STATE = "state string, created_us bigint"
#: What a move does to a ticket in a state; any other move changes nothing.
MOVES = {("reserved", "start"): "started", ("reserved", "release"): "released", ("started", "succeeded"): "succeeded", ("started", "failed"): "failed", ("started", "cancelled"): "cancelled"}


def lifetimes(moves: DataFrame, limits: Limits = Limits(), late: str = "10 seconds") -> DataFrame:
    """Each change of a ticket's state, from moves (ticket, move, at): by a move, or by its lifetime's end through an event-time timer.

    A reserved ticket that is too old is released, a started one expires. A closed ticket's state is kept for two days and then
    dropped by a second timer, so that a move that comes late finds it closed, and memory follows two days of tickets.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, end = [], limits.ticket_ttl_seconds * 1_000_000
        now, created = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            if now in ("reserved", "started"):
                now = "released" if now == "reserved" else "expired"
                out.append((key[0], now, pd.Timestamp(created + end, unit="us")))
            elif state.getCurrentWatermarkMs() * 1000 >= created + RETENTION.total_seconds() * 1_000_000:
                state.remove()
                yield pd.DataFrame(out, columns=["ticket", "state", "at"])
                return
        else:
            for move, at in pd.concat(list(batches)).sort_values("at")[["move", "at"]].itertuples(index=False):
                micros = int(at.value // 1000)
                if now in ("reserved", "started") and micros > created + end:
                    now = "released" if now == "reserved" else "expired"
                    out.append((key[0], now, pd.Timestamp(created + end, unit="us")))
                new = "reserved" if now is None and move == "reserve" else MOVES.get((now, move))
                if new:
                    created = micros if new == "reserved" else created
                    now = new
                    out.append((key[0], now, at))
        if now is not None:
            state.update((now, created))
            due = created + end if now in ("reserved", "started") else created + int(RETENTION.total_seconds() * 1_000_000)
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["ticket", "state", "at"])

    return moves.withWatermark("at", late).groupBy("ticket").applyInPandasWithState(run, LIFE, LIFE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


EVENTS = "stream_id bigint, n bigint, type string, event string"


def events_of(chunks: DataFrame) -> DataFrame:
    """Events of streams (stream_id, seq, chunk) whose lines end anywhere in a piece; a line's beginning rests in the state until its end comes."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lines = EventLines()
        lines.rest, n = state.get if state.exists else ("", 0)
        found = [e for chunk in pd.concat(list(batches)).sort_values("seq")["chunk"] for e in lines.push(chunk)]
        state.update((lines.rest, n + len(found)))
        yield pd.DataFrame([(key[0], n + k, e["type"], json.dumps(e, ensure_ascii=False)) for k, e in enumerate(found)], columns=["stream_id", "n", "type", "event"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, EVENTS, "rest string, n bigint", "append", GroupStateTimeout.NoTimeout)
