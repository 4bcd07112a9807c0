"""Edits as tables: guard, location, application and decisions.

An attempt's edits are judged in the order of arrival, because each one that is kept takes its place in the text. So an attempt is
one group of a grouped map; attempts are many and bounded (a model's answer), and spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.edits import figures, guard, locate, names, units

#: The retyped characters and what they are folded to, for the native rules.
_FROM, _TO = "".join(locate.RETYPED), "".join(locate.RETYPED.values())


def _structs(texts: tuple[str, ...], numbers: tuple[str, ...] = ()) -> T.ArrayType:
    """Spelled out, because a type in DDL needs a session when the module is imported."""
    return T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in texts] + [T.StructField(n, T.IntegerType()) for n in numbers]))


def squashed(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.translate(text, _FROM, _TO), r"(?U)\s+", " ")))


def cheap_reason(original: Column, replacement: Column) -> Column:
    """The rules that need no figures, in order, as one CASE; null where all of them pass."""
    return (
        F.when(squashed(original) == squashed(replacement), "unchanged")
        .when(F.length(original) > guard.MAX_SPAN, "span_too_long")
        .when(F.length(replacement) > F.greatest(F.lit(guard.LEAST_ROOM), F.length(original) * guard.MAX_GROWTH), "too_long")
        .when(replacement.rlike(r"(?i)</?[a-z][^>]*>|\]\(|^(?U:\s*)#{1,6}(?U:\s)"), "markup")
    )


@F.pandas_udf(T.StringType())
def _dear_reason(original: pd.Series, replacement: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else guard.why_drop(a, b) for a, b in zip(original, replacement, strict=True)], dtype=object)


def reasons(edits: DataFrame, original: str = "original", replacement: str = "replacement") -> DataFrame:
    """edits with `reason`. Rows that a native rule drops are settled in the JVM; only the others' text goes to Python."""
    cheap = edits.withColumn("_cheap", cheap_reason(F.col(original), F.col(replacement)))
    asked = F.when(F.col("_cheap").isNull(), F.col(original)), F.when(F.col("_cheap").isNull(), F.col(replacement))
    return cheap.withColumn("reason", F.coalesce("_cheap", _dear_reason(*asked))).drop("_cheap")


@F.pandas_udf(_structs(("value", "written"), ("start", "end")))
def figures_of(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [f._asdict() for f in figures.figures_in(t)] for t in text], dtype=object)


@F.pandas_udf(_structs(("value", "scale", "after_year", "units")))
def readings_of(text: pd.Series) -> pd.Series:
    """Figures with their size and units, the units joined by commas."""

    def read(t: str) -> list[dict]:
        found = [(f, units.read_figure(t, f)) for f in figures.figures_in(t)]
        return [{"value": f.value, "scale": r.scale, "after_year": r.after_year, "units": ",".join(r.units)} for f, r in found]

    return pd.Series([None if t is None else read(t) for t in text], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def names_of(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [n.name for n in names.names_in(t)] for t in text], dtype=object)


COLLECTED = "attempt_id bigint, seq bigint, id string, reason string, original string, replacement string, start int, end int"


def collected(edits: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """What becomes of each (attempt_id, seq, text, original, replacement), as a stream of the attempt would show it.

    Where `texts` (attempt_id, text) is given, each text goes to Python once, not with each of its edits. A task reads its attempts
    one after the other in the order of the shuffle: a text, then its edits; only one text is held at a time.
    """
    whole = edits.groupBy("attempt_id").agg(F.min("text").alias("text")) if texts is None else texts.select("attempt_id", "text")
    asked = whole.join(edits.select("attempt_id").distinct(), "attempt_id", "left_semi")
    heads = asked.select("attempt_id", F.lit(-1).cast("bigint").alias("seq"), F.col("text").alias("original"), F.lit(None).cast("string").alias("replacement"), F.lit(0).alias("_kind"))
    rows = heads.unionByName(edits.select("attempt_id", "seq", "original", "replacement", F.lit(1).alias("_kind")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep, own = None, None
        for batch in batches:
            out = []
            for attempt, seq, original, replacement, kind in batch[["attempt_id", "seq", "original", "replacement", "_kind"]].itertuples(index=False):
                if kind == 0:
                    keep, own = (None if original is None else guard.Collector(original)), attempt
                elif keep is not None and own == attempt:
                    out.append((attempt, seq, *keep.add(original, replacement)))
            yield pd.DataFrame(out, columns=["attempt_id", "seq", "id", "reason", "original", "replacement", "start", "end"])

    return rows.repartition("attempt_id").sortWithinPartitions("attempt_id", "_kind", "seq").mapInPandas(run, COLLECTED)


def guarded(edits: DataFrame) -> DataFrame:
    """(attempt_id, seq, reason) in the batch form: the cap counts what the rules keep, before location."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("seq")
        return ordered[["attempt_id", "seq"]].assign(reason=guard.guard_all(list(zip(ordered["original"], ordered["replacement"], strict=True))))

    return edits.groupBy("attempt_id").applyInPandas(run, "attempt_id bigint, seq bigint, reason string")


def histogram(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def applied(texts: DataFrame, kept: DataFrame, key: str = "attempt_id", text: str = "text") -> DataFrame:
    """texts with `result`: accepted edits (start, end, replacement, accepted) put in, all else as it was. Edits do not overlap."""
    spans = kept.where("accepted").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("_edits"))
    whole = F.col(text)
    state = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    add = lambda s, e: F.struct(F.concat(s["done"], F.substring(whole, s["at"] + 1, e["start"] - s["at"]), e["replacement"]).alias("done"), e["end"].alias("at"))
    joined = texts.join(spans, key, "left")
    result = F.aggregate("_edits", state, add, lambda s: F.concat(s["done"], F.substring(whole, s["at"] + 1, F.length(whole))))
    return joined.withColumn("result", F.coalesce(result, whole)).drop("_edits")


# Fixed value: seconds after which a stored result is not opened again.
MAX_AGE = 60


def reopenable(rows: DataFrame, text: str = "text", edits: str = "edits", age: str | None = None) -> Column:
    """Whether a stored result is young enough (`age` in seconds) and every edit (start, end, original) still names what stands in the text."""
    young = F.lit(True) if age is None else F.coalesce(F.col(age).between(0, MAX_AGE), F.lit(False))
    return young & F.forall(F.col(edits), lambda e: (e["start"] >= 0) & (e["end"] >= e["start"]) & (F.substring(F.col(text), e["start"] + 1, e["end"] - e["start"]) == e["original"]))


def next_pending(edits: DataFrame, key: str = "attempt_id") -> DataFrame:
    """For each edit the next one in reading order that still waits, round the end to the beginning; itself where none does."""
    own = edits.select(key, "id", "start", "state")
    waiting = F.when(F.col("state") == "pending", F.struct("start", "id"))
    later = Window.partitionBy(key).orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    found = own.withColumn("_later", F.min(waiting).over(later)).withColumn("_first", F.min(waiting).over(Window.partitionBy(key)))
    return found.select(key, "id", F.coalesce("_later.id", "_first.id", "id").alias("next_id"))


def decided(edits: DataFrame, state: str, key: str = "attempt_id") -> DataFrame:
    """All of an attempt's edits accepted or rejected, with how many are accepted."""
    return edits.withColumn("state", F.lit(state)).groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "accepted").alias("accepted"))


def stand_in(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(attempt_id, seq, original, replacement): a deterministic model. Every other sentence becomes its last six words, capitalised."""
    sentences = F.array_remove(F.split(F.col(text), r"(?<=[.!?])(?U:\s+)"), "")
    at = docs.select(F.col(key).alias("attempt_id"), F.posexplode(sentences).alias("pos", "original")).where("pos % 2 = 0")
    words = F.split("original", " ")
    tail = F.array_join(F.slice(words, F.greatest(F.size(words) - 5, F.lit(1)), F.lit(6)), " ")
    replacement = F.concat(F.upper(F.substring(tail, 1, 1)), F.expr("substring(" + "_tail" + ", 2)"))
    made = at.withColumn("_tail", tail).withColumn("replacement", replacement).where("original <> replacement")
    return made.select("attempt_id", (F.col("pos") / 2).cast("bigint").alias("seq"), "original", "replacement")


def facts_stated(texts: DataFrame, key: str, text: str = "text", facts: str = "facts") -> DataFrame:
    """(key, fact_no, stated) of texts with an array of facts: whether every figure of a fact stands in its text."""
    own = texts.select(key, F.transform(figures_of(F.col(text)), lambda f: f["value"]).alias("_own"), F.posexplode(facts).alias("fact_no", "_fact"))
    figures_ = F.transform(figures_of(F.col("_fact")), lambda f: f["value"])
    return own.select(key, "fact_no", (F.size(F.array_except(figures_, F.col("_own"))) == 0).alias("stated"))


def progress(drops: DataFrame, key: str = "attempt_id", order: str = "seq") -> DataFrame:
    """drops, a row an edit with its `reason` or none, with how many of the attempt were dropped and accepted so far, and their share."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = drops.withColumn("dropped", F.count_if(F.col("reason").isNotNull()).over(w)).withColumn("seen", F.count("*").over(w))
    return counted.withColumn("share", (F.col("seen") - F.col("dropped")) / F.greatest(F.col("seen"), F.lit(1)))


def moved(edits: DataFrame, steps: int, key: str = "attempt_id") -> DataFrame:
    """For each edit the one `steps` further on in reading order, round the end: what moving the focus reaches."""
    w = Window.partitionBy(key)
    placed = edits.select(key, "id", "start").withColumn("_at", F.row_number().over(w.orderBy("start", "id")) - 1).withColumn("_n", F.count("*").over(w))
    goal = placed.select(key, F.col("_at").alias("_goal"), F.col("id").alias("moved_id"))
    return placed.withColumn("_goal", F.pmod(F.col("_at") + F.lit(steps), F.col("_n"))).join(goal, [key, "_goal"]).select(key, "id", "moved_id")
