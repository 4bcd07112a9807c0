"""Answers that arrive in pieces: objects are handed on as soon as their closing brace is there."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkwell.functions.edits.guard import Collector

FIELDS = ("original", "replacement", "reason")
EVENTS = ("start", "edit", "done", "error")


@dataclass
class Parser:
    """The place in an answer {"edits": [{...}, ...]}: brackets open, whether in a string, and the piece of the edit read so far.

    Its whole state is these fields, so it can rest between micro-batches; any way of cutting the answer gives the same edits.
    """

    depth: int = 0
    string: bool = False
    escaped: bool = False
    piece: str = ""

    def push(self, chunk: str) -> list[dict[str, str]]:
        found = []
        for c in chunk:
            if self.depth >= 3:
                self.piece += c
            if self.string:
                self.string, self.escaped = self.escaped or c != '"', not self.escaped and c == "\\"
            elif c == '"':
                self.string = True
            elif c in "{[":
                self.depth += 1
                self.piece = c if self.depth == 3 else self.piece
            elif c in "}]":
                if self.depth == 3 and (edit := whole_edit(self.piece)):
                    found.append(edit)
                self.depth -= 1
        return found


def whole_edit(piece: str) -> dict[str, str] | None:
    """The edit, or None where the piece is no object with its three texts."""
    try:
        value = json.loads(piece)
    except ValueError:
        return None
    complete = isinstance(value, dict) and all(isinstance(value.get(f), str) for f in FIELDS)
    return {f: value[f] for f in FIELDS} if complete else None


class EventLines:
    """Events, one JSON object a line, from pieces that end anywhere; lines that are no event are passed over."""

    def __init__(self) -> None:
        self.rest = ""

    def push(self, chunk: str) -> list[dict]:
        *lines, self.rest = (self.rest + chunk).split("\n")
        found = []
        for line in filter(str.strip, lines):
            try:
                event = json.loads(line)
            except ValueError:
                continue
            if isinstance(event, dict) and event.get("type") in EVENTS:
                found.append(event)
        return found


PARSED = "attempt_id bigint, n bigint, original string, replacement string, reason string"


def parsed(chunks: DataFrame) -> DataFrame:
    """Batch form: the edits of (attempt_id, seq, chunk), numbered in each attempt."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parser = Parser()
        edits = [e for c in rows.sort_values("seq")["chunk"] for e in parser.push(c)]
        return pd.DataFrame([(rows["attempt_id"].iloc[0], n, *(e[f] for f in FIELDS)) for n, e in enumerate(edits)], columns=["attempt_id", "n", *FIELDS])

    return chunks.groupBy("attempt_id").applyInPandas(run, PARSED)


STATE = "depth int, string boolean, escaped boolean, piece string, n bigint"


def parsed_stream(chunks: DataFrame) -> DataFrame:
    """Streaming form: the same edits, each in the micro-batch that brings its closing brace. Chunks of one batch are ordered by seq."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        depth, string, escaped, piece, n = state.get if state.exists else (0, False, False, "", 0)
        parser, out = Parser(depth, string, escaped, piece), []
        for chunk in pd.concat(list(batches)).sort_values("seq")["chunk"]:
            for edit in parser.push(chunk):
                out.append((key[0], n, *(edit[f] for f in FIELDS)))
                n += 1
        state.update((parser.depth, parser.string, parser.escaped, parser.piece, n))
        yield pd.DataFrame(out, columns=["attempt_id", "n", *FIELDS])

    return chunks.groupBy("attempt_id").applyInPandasWithState(run, PARSED, STATE, "append", GroupStateTimeout.NoTimeout)


COLLECTED = "attempt_id bigint, seq bigint, id string, reason string, start int, end int"
COLLECTOR_STATE = "taken array<struct<start:int,end:int>>, seen int, refused int"


def collected_stream(edits: DataFrame) -> DataFrame:
    """Edits (attempt_id, seq, text, original, replacement) judged as they arrive; state: the places taken and two counters."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken, seen, refused = state.get if state.exists else ([], 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        keep = Collector(rows["text"].iloc[0], [tuple(t) for t in taken], seen, refused)
        out = []
        for r in rows.itertuples(index=False):
            found = keep.add(r.original, r.replacement)
            out.append((key[0], r.seq, found.id, found.reason, found.start, found.end))
        state.update(([Row(start=t.start, end=t.end) for t in keep.taken], keep.seen, keep.refused))
        yield pd.DataFrame(out, columns=["attempt_id", "seq", "id", "reason", "start", "end"])

    return edits.groupBy("attempt_id").applyInPandasWithState(run, COLLECTED, COLLECTOR_STATE, "append", GroupStateTimeout.NoTimeout)


def cut(texts: DataFrame, size: int, key: str = "attempt_id", text: str = "text") -> DataFrame:
    """(key, seq, chunk): texts in pieces of a size."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size))
    return texts.select(key, F.posexplode(F.transform(at, lambda i: F.substring(F.col(text), i, F.lit(size)))).alias("seq", "chunk")).withColumn("seq", F.col("seq").cast("bigint"))


def outcome(finished: DataFrame) -> DataFrame:
    """How attempts ended, from (complete, refused, delivered, reader_left): the event that closes them, the state, and whether a history is saved."""
    left, some = F.col("reader_left"), F.col("delivered") > 0
    good, cut_short = F.col("complete") & ~F.col("refused"), ~F.col("complete") & ~F.col("refused") & some
    event = F.when(left, "none").when(good, "done").when(cut_short, "done partial").otherwise("error")
    state = F.when(left, "cancelled").when(good, "succeeded").otherwise("failed")
    return finished.withColumn("event", event).withColumn("state", state).withColumn("saved", F.when(left, some).otherwise(good | cut_short))


def delivered(edits: DataFrame, ts: str = "edit_ts", left: str = "left_ts") -> DataFrame:
    """Edits that were finished before the reader left; later ones are neither shown nor saved."""
    return edits.where(F.col(left).isNull() | (F.col(ts) <= F.col(left)))
