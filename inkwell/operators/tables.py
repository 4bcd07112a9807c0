"""What a table store does to tables, for Parquet: upserts, deletes, caps, constraints, access, histories."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.sizes import numbered, small

# Page length of a history, and rows one call purges.
PAGE, PURGE, BATCH = 50, 200, 100


def upserted(target: DataFrame, batch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """target with the batch's rows in place of those with the same key. Of a key that the batch has twice the last by `order` wins; doing it again changes nothing."""
    new = batch
    if order:
        columns = batch.columns
        best = batch.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_row"))
        new = best.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])
    kept = target.join(new.select(key), key, "left_anti")
    return kept.unionByName(new.select(*[c for c in new.columns if c in target.columns]), allowMissingColumns=True)


def batches(rows: DataFrame, order: list[str], size: int = BATCH) -> DataFrame:
    """rows with the number of the batch they are sent in."""
    return numbered(rows, order, "_place").withColumn("batch_no", F.floor(F.col("_place") / size).cast("bigint")).drop("_place")


def purged(rows: DataFrame, key: str, created: str, before: Column, most: int = PURGE) -> DataFrame:
    """rows without the oldest `most` of those created before a time."""
    old = rows.where(F.col(created) < before).orderBy(created, key).limit(most).select(key)
    return rows.join(F.broadcast(old), key, "left_anti")  # at most `most` keys


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def account_deleted(tables: Mapping[str, DataFrame], account: object, user: str = "user_id", keep: tuple[str, ...] = ("usage_global",)) -> dict[str, DataFrame]:
    """Every table without an account's rows, but for those that hold no rows of accounts."""
    return {name: df if name in keep else df.where(~F.col(user).eqNullSafe(F.lit(account))) for name, df in tables.items()}


def violations(rows: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Rows that break a constraint, with the names of those they break. As in SQL, a check that is null holds."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(check, F.lit(True)), F.lit(name)) for name, check in checks.items()]))
    return rows.withColumn("broken", broken).where(F.size("broken") > 0)


def owned(rows: DataFrame, account: object, user: str = "user_id") -> DataFrame:
    """What row-level access lets an account see."""
    return rows.where(F.col(user) == F.lit(account))


def newest(rows: DataFrame, user: str, created: str, key: str, page: int = PAGE) -> DataFrame:
    """Each account's newest rows, with its total."""
    own = Window.partitionBy(user)
    totals = rows.groupBy(user).agg(F.count("*").alias("total"))
    ranked = rows.withColumn("place", F.row_number().over(own.orderBy(F.desc(created), F.desc(key)))).where(F.col("place") <= page)  # a task keeps `page` rows of an account
    return ranked.join(totals, user)


def found_in(page: DataFrame, text: str, query: str) -> DataFrame:
    """A page's rows that contain the query, case aside; a blank query finds all. Applied after the page is cut."""
    wanted = query.strip().lower()
    return page.where(F.lower(F.col(text)).contains(wanted)) if wanted else page


def privileges(roles: DataFrame, objects: DataFrame, granted: DataFrame) -> DataFrame:
    """(role, object, privileges): each role's privileges on each object in one sorted line; roles and objects are catalogue-sized."""
    pairs = roles.crossJoin(small(objects))
    lines = granted.groupBy("role", "object").agg(F.array_join(F.sort_array(F.collect_set("privilege")), ",").alias("privileges"))
    return pairs.join(lines, ["role", "object"], "left").select("role", "object", F.coalesce("privileges", F.lit("")).alias("privileges"))


def differences(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, and which."""
    extra = found.exceptAll(expected).withColumn("side", F.lit("found"))
    return extra.unionByName(expected.exceptAll(found).withColumn("side", F.lit("expected")))


def appended(history: DataFrame, results: DataFrame, key: str = "id", hidden: tuple[str, ...] = ("voice_sample",)) -> DataFrame:
    """A history with finished results added once each, without the columns that are never kept."""
    new = results.drop(*hidden).join(history.select(key), key, "left_anti")
    return history.unionByName(new.select(*[c for c in new.columns if c in history.columns]), allowMissingColumns=True)


def reclassified(rows: DataFrame, open_states: tuple[str, ...], state: str, closed: str, before: Column, created: str = "created_at", column: str = "state") -> DataFrame:
    """rows in which every open one from before a time is closed: one pass that rewrites a column."""
    stale = F.col(column).isin(*open_states) & (F.col(created) < before)
    return rows.withColumn(closed, F.when(stale, before).otherwise(F.col(closed))).withColumn(column, F.when(stale, F.lit(state)).otherwise(F.col(column)))


def latest(rows: DataFrame, day: str, days: int = 31) -> DataFrame:
    """Rows of the newest `days` days that there are, newest first; days without rows do not count."""
    newest_days = rows.select(day).distinct().orderBy(F.desc(day)).limit(days)
    return rows.join(F.broadcast(newest_days), day, "left_semi").orderBy(F.desc(day))


def unnested(rows: DataFrame, key: str, column: str, schema: str) -> DataFrame:
    """(key, place, fields) of results stored as a JSON array in a column; rows whose column is no array have none."""
    stored = F.from_json(F.col(column), f"array<struct<{schema}>>")
    return rows.select(key, F.posexplode(stored).alias("place", "_r")).select(key, F.col("place").cast("bigint").alias("place"), "_r.*")


def nested(rows: DataFrame, key: str, order: list[str], fields: list[str], column: str = "results") -> DataFrame:
    """The way back: each key's rows as one JSON array, in order."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("_r"))))
    return rows.groupBy(key).agg(F.to_json(F.transform(ordered, lambda x: x["_r"])).alias(column))


def the_one(rows: DataFrame) -> dict:
    """The single row of a table of settings; an error where there are none or several."""
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise ValueError("a table of settings has to have one row")
    return found[0].asDict()
