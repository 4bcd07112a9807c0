"""Mixing sources to target weights: Pfair scheduling (Baruah et al., 1996).

A source's documents are put into blocks of ROWS in the order of their ids' hashes. Block k of a source with weight w of W may begin
at floor(k W / w) and must be placed by ceil((k + 1) W / w); at every place of the mix the earliest deadline among the released
blocks is taken. So at any place a source has had less than one block more or less than its weight's share.

The weights are whole numbers of sum W, so the schedule repeats after W places: one period is made on the driver, and every block
finds its place by its number alone, whatever the size of the input. Sources are kept whole. When one has no blocks left, a new
phase begins with the weights of those that remain; the bound holds in each phase. Without given weights, a source's weight is its
number of documents to the power TEMPER. The SOURCES largest sources are scheduled each by itself; all smaller ones together are
one more, with the sum of their weights, in which the order of hashes mixes them: there each has its share on average.

Defined results: a null source is a source of its own; null and empty texts are rows like others; rows without an id are numbered
like others; rows that are equal take places of their own; an empty table gives an empty result; other columns are ignored by `mix`
and kept by `stage`. A source that the weights do not name, or give 0, comes after the mix, alone in its phase.

Rows are first counted by what identifies them, map-side, so that an id that a third of the rows have is one row; the rest are
numbered by buckets of the id's hash, so that no task holds a source. Only the counts of the largest sources and the phases' periods
come to the driver or are broadcast; neither grows with the rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm import base

#: Rows of a block; sources that are scheduled each by itself at most.
ROWS, SOURCES = 16, 500
#: The power of a source's size that is its weight where none is given.
TEMPER = 0.7
#: Copies of one row that a task numbers.
PIECE = 10_000
BUCKET_DIGITS = 3
POOL = "pool"


class Phase(NamedTuple):
    """Places slot, slot + 1, ... of the mix: `places` says where in each period a source's blocks stand, `done` how many of its blocks came before."""

    slot: int
    period: int
    done: dict[str, int]
    places: dict[str, list[int]]


def period(weights: Mapping[str, int]) -> dict[str, list[int]]:
    """The places of each source's blocks among the first sum(weights) places, by earliest deadline of what is released."""
    total = sum(weights.values())
    places: dict[str, list[int]] = {s: [] for s in weights}
    waiting, ready = [(0, s) for s in sorted(weights)], []
    for time in range(total):
        while waiting and waiting[0][0] <= time:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(places[s]) + 1) * total // weights[s]), s))
        _, s = heapq.heappop(ready)
        places[s].append(time)
        heapq.heappush(waiting, (len(places[s]) * total // weights[s], s))
    return places


def phases(blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[Phase]:
    """The mix of sources with so many blocks and whole-number weights."""
    done = {s: 0 for s, n in sorted(blocks.items()) if n > 0}
    rest = [s for s in done if weights.get(s, 0) <= 0]
    active, found, slot = [s for s in done if s not in rest], [], 0
    while active:
        places = period({s: weights[s] for s in active})
        total = sum(weights[s] for s in active)
        last = {s: divmod(blocks[s] - done[s] - 1, weights[s]) for s in active}
        length = min(c * total + places[s][i] for s, (c, i) in last.items()) + 1
        found.append(Phase(slot, total, {s: done[s] for s in active}, places))
        times, part = divmod(length, total)
        for s in active:
            done[s] += times * weights[s] + bisect_left(places[s], part)
        slot += length
        active = [s for s in active if done[s] < blocks[s]]
    for s in rest:
        found.append(Phase(slot, 1, {s: 0}, {s: [0]}))
        slot += blocks[s]
    return found


def schedule(blocks: Mapping[str, int], weights: Mapping[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block, phase) in the order of the mix."""
    found = phases(blocks, weights)
    for k, phase in enumerate(found):
        end = found[k + 1].slot if k + 1 < len(found) else sum(n for n in blocks.values() if n > 0)
        at = {i: (s, j) for s, own in phase.places.items() for j, i in enumerate(own)}
        for t in range(end - phase.slot):
            s, j = at[t % phase.period]
            yield s, phase.done[s] + t // phase.period * len(phase.places[s]) + j, k


def whole(weights: Mapping[str, float], total: int) -> dict[str, int]:
    """Weights as whole numbers of sum `total`, about; each that is above 0 is 1 at least."""
    sum_ = sum(w for w in weights.values() if w > 0) or 1
    return {s: max(1, round(w / sum_ * total)) if w > 0 else 0 for s, w in weights.items()}


def _named(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _keyed(docs: DataFrame, tie: Column, largest: list[str] | None) -> DataFrame:
    """docs with `_source` (never null; None for largest: every source by itself), `_hash` of the id, its bucket and `_tie`."""
    name = _named(F.col("source"))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    own = name if largest is None else F.when(name.isin(largest), name).otherwise(POOL)
    return docs.withColumn("_tie", tie).withColumn("_name", name).withColumn("_source", own).withColumn("_hash", digest).withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))


class Plan(NamedTuple):
    """`same`: (keys, doc_id, source, _n, _first): distinct rows, how many of each there are, and the first one's number in its source."""

    same: DataFrame
    largest: list[str] | None
    rows: int
    found: list[Phase]
    short: list[int]


KEYS = ["_source", "_name", "_hash", "_tie"]


def plan(docs: DataFrame, tie: Column, weights: Mapping[str | None, float] | None, rows: int, most: int) -> Plan:
    by_name = docs.groupBy(_named(F.col("source")).alias("name")).agg(F.count("*").alias("n"))
    by_name = base.stored(by_name, "mix-sources")
    given = None if weights is None else {_literal(s): w for s, w in weights.items()}
    weight = F.pow("n", F.lit(TEMPER)) if given is None else F.lit(0.0)
    top = by_name.orderBy(F.desc("n"), "name").limit(most).collect()
    sizes = {r["name"]: r["n"] for r in top}
    pooled = by_name.agg(F.count("*").alias("sources"), F.sum("n").alias("n"), F.sum(weight).alias("w")).first()
    target = {s: n**TEMPER if given is None else given.get(s, 0.0) for s, n in sizes.items()}
    largest = None
    if pooled["sources"] > len(sizes):
        largest = list(sizes)
        target[POOL] = pooled["w"] - sum(target.values()) if given is None else sum(w for s, w in given.items() if s not in sizes)
        sizes[POOL] = pooled["n"] - sum(sizes.values())
    base.deleted(by_name)
    same = _keyed(docs, tie, largest).groupBy(*KEYS, "_bucket", "doc_id", "source").agg(F.count("*").alias("_n"))
    same = base.stored(same, "mix-rows")
    counts = same.groupBy("_source", "_bucket").agg(F.sum("_n").alias("n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_source", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))  # at most SOURCES * 4096 rows
    ahead = Window.partitionBy("_source", "_bucket").orderBy("_hash", "_name", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    numbered = same.withColumn("_in", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).join(base.bounded(starts), ["_source", "_bucket"]).withColumn("_first", F.col("_before") + F.col("_in"))
    blocks = {s: -(-n // rows) for s, n in sizes.items()}
    total = max(4 * len(sizes), min(10_000, 200_000 // max(1, len(sizes))))
    found = phases(blocks, whole(target, total))
    # every phase but the last ends with the last block of a source, which may be shorter than the others
    ends = [{s for s in p.done if k + 1 == len(found) or s not in found[k + 1].done} for k, p in enumerate(found)]
    short, missing = [], 0
    for gone in ends:
        short.append(missing)
        missing += sum(blocks[s] * rows - sizes[s] for s in gone)
    return Plan(numbered.drop("_in", "_before", "_bucket"), largest, rows, found, short)


def _literal(source: str | None) -> str:
    return "null" if source is None else f"={source}"


def located(numbered: DataFrame, plan: Plan) -> DataFrame:
    """Rows with `_source` and `_number` get block_no, slot (the block's place), position (the row's place) and phase."""
    spark = numbered.sparkSession
    spans, table = [], []
    for k, phase in enumerate(plan.found):
        for s, done in phase.done.items():
            until = plan.found[k + 1].done.get(s) if k + 1 < len(plan.found) else None
            spans.append((s, k, done, until, phase.slot, phase.period, len(phase.places[s]), plan.short[k]))
            table += [(s, k, i, place) for i, place in enumerate(phase.places[s])]
    spans_ = spark.createDataFrame(spans, "_source string, phase int, _done bigint, _until bigint, _slot bigint, _period bigint, _w bigint, _short bigint")
    places = spark.createDataFrame(table, "_source string, phase int, _i bigint, _place bigint")
    block = numbered.withColumn("block_no", F.floor(F.col("_number") / plan.rows).cast("bigint"))
    own = (F.col("block_no") >= F.col("_done")) & (F.col("_until").isNull() | (F.col("block_no") < F.col("_until")))
    of = block.join(F.broadcast(spans_.withColumnRenamed("_source", "_of")), (F.col("_source") == F.col("_of")) & own)
    turn = F.col("block_no") - F.col("_done")
    of = of.withColumn("_i", turn % F.col("_w")).withColumn("_turn", F.floor(turn / F.col("_w")).cast("bigint")).join(base.bounded(places), ["_source", "phase", "_i"])
    of = of.withColumn("slot", F.col("_slot") + F.col("_turn") * F.col("_period") + F.col("_place"))
    return of.withColumn("position", F.col("slot") * plan.rows - F.col("_short") + F.col("_number") - F.col("block_no") * plan.rows)


def _copies(rows: DataFrame) -> DataFrame:
    """A row with `_number` for each copy; many copies are dealt out in pieces."""
    lone = rows.where("_n = 1").withColumn("_number", F.col("_first"))
    pieces = rows.where("_n > 1").withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(PIECE).cast("bigint"))))
    first = F.col("_first") + F.col("_from")
    many = pieces.repartition("_hash", "_from").withColumn("_number", F.explode(F.sequence(first, F.col("_first") + F.least(F.col("_from") + PIECE, F.col("_n")) - 1)))
    return lone.unionByName(many.drop("_from"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, rows: int = ROWS, sources: int = SOURCES) -> DataFrame:
    """(doc_id, source, block_no, slot, position, phase) for every row of docs."""
    planned = plan(docs.select("doc_id", "source"), F.lit(0), weights, rows, sources)
    return located(_copies(planned.same), planned).select("doc_id", "source", "block_no", "slot", "position", "phase")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(base.read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: all documents in the order of the mix, which is the order of the files and of the rows in them.

    Numbers are made from ids, sources and a hash of the whole row; the rows themselves are dealt out once, by their positions,
    where the numbers are few enough to be broadcast. Rows that are equal in all columns are interchangeable.
    """
    # the row travels as one column, so that its names cannot clash with those of the schedule
    tie = F.xxhash64(*[F.col(c).cast("string") if t.startswith("map") else F.col(c) for c, t in docs.dtypes])
    carried = docs.select("doc_id", "source", tie.alias("_of"), F.struct(*docs.columns).alias("_row"))
    planned = plan(carried.drop("_row"), F.col("_of"), None, ROWS, SOURCES)
    keyed = _keyed(carried, F.col("_of"), planned.largest).select(*KEYS, "_row")
    numbers = base.stored(planned.same.select(*KEYS, "_n", "_first", F.col("_first").alias("_number")), "mix-numbers")
    rows = keyed.join(base.bounded(numbers.where("_n = 1").select(*KEYS, "_number")), KEYS).select("_source", "_number", "_row")
    many = numbers.where("_n > 1").drop("_number")
    if many.limit(1).count():
        once = keyed.join(base.bounded(many), KEYS).groupBy(*KEYS, "_n", "_first").agg(F.first("_row").alias("_row"))
        rows = rows.unionByName(_copies(once).select("_source", "_number", "_row"))
    ordered = located(rows, planned)
    base.returned(spark)
    return ordered.repartitionByRange("position").sortWithinPartitions("position").select("_row.*")
