"""When a table may be broadcast, and numbers in an order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a table is broadcast, and ranges into which a numbering is cut.
SMALL, PARTS = 200_000, 64


def small(table: DataFrame, most: int = SMALL) -> DataFrame:
    """table, marked for broadcast where a count, cut off beyond `most`, allows it; a larger one takes part in a shuffled join."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def numbered(rows: DataFrame, order: list[str], name: str, groups: list[str] | None = None) -> DataFrame:
    """rows with their place from 0 in a total order, in all or in each group, without sorting all rows or a group in one task.

    Rows are cut into PARTS ranges of the first column of the order, quantiles say where; what lies ahead of a range is a sum over
    a few counts, and only places within a range come from sorting it. Rows equal in the first column share a range.
    """
    own, first = list(groups or []), F.col(order[0])
    edges = F.broadcast(rows.agg(F.percentile_approx(first, [k / PARTS for k in range(1, PARTS)], 10 * PARTS).alias("_edges")))
    placed = rows.crossJoin(edges).withColumn("_part", F.coalesce(F.size(F.filter("_edges", lambda e: e < first)), F.lit(-1))).drop("_edges")
    by_part = Window.partitionBy(*own).orderBy("_part") if own else Window.orderBy("_part")
    counts = placed.groupBy(*own, "_part").agg(F.count("*").alias("_n"))
    starts = counts.select(*[F.col(g).alias(f"_of_{g}") for g in own], F.col("_part").alias("_of_part"), F.coalesce(F.sum("_n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # at most PARTS + 1 rows a group
    inner = placed.withColumn("_in", F.row_number().over(Window.partitionBy(*own, "_part").orderBy(*order)) - 1)
    same = F.col("_part") == F.col("_of_part")
    for g in own:
        same = same & inner[g].eqNullSafe(F.col(f"_of_{g}"))
    joined = inner.join(starts, same)
    return joined.select(*rows.columns, (F.col("_start") + F.col("_in")).cast("bigint").alias(name))
