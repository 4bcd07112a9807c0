"""Summaries of measurements: two kinds of median, paired comparison, reports, and detector curves."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rule by which the paired comparison is decided.
LEAST_PAIRS, LEAST_GAIN = 10, 0.5
#: Ranges into which a running sum is cut.
PARTS = 64


def median(value: Column) -> Column:
    """The true median of finite values: the mean of the middle two of an even number."""
    return F.percentile(F.when(value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) != float("inf")), value.cast("double")), F.lit(0.5))


def running(rows: DataFrame, groups: list[str], order: str, sums: Mapping[str, str]) -> DataFrame:
    """rows, one for each (groups, order), with the sum of each column over all smaller rows of the group under its new name.

    A group is cut into PARTS ranges of its order's rank among a sample of quantiles: sums of ranges are few and are summed by
    one window, and within a range by another, so that no task sorts a group.
    """
    edges = rows.agg(F.percentile_approx(order, [k / PARTS for k in range(1, PARTS)], 10 * PARTS).alias("edges"))
    placed = rows.crossJoin(F.broadcast(edges)).withColumn("_part", F.size(F.filter("edges", lambda e: e < F.col(order)))).drop("edges")
    parts = placed.groupBy(*groups, "_part").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if groups else Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*groups, "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{n}") for c, n in sums.items()])  # at most PARTS rows a group
    within = Window.partitionBy(*groups, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_in_{n}") for c, n in sums.items()])
    joined = own.join(starts, [*groups, "_part"])
    return joined.select(*rows.columns, *[(F.col(f"_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums.values()])


def nearest_ranks(rows: DataFrame, groups: list[str], value: str, ps: Mapping[str, float]) -> DataFrame:
    """groups and, under each name, sorted[min(n - 1, floor(p / 100 * n))] of the group's values: at 50 the upper middle.

    Values are counted map-side first, so that what is ranked is distinct values, and ranks are running counts in ranges.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    sizes = counted.groupBy(*groups).agg(F.sum("_n").alias("_all"))
    ranked = running(counted, groups, value, {"_n": "_below"}).join(sizes, groups)
    place = lambda p: F.least(F.col("_all") - 1, F.floor(F.lit(p) * F.col("_all") / 100))
    holds = lambda p: (F.col("_below") <= place(p)) & (place(p) < F.col("_below") + F.col("_n"))
    return ranked.groupBy(*groups).agg(*[F.max(F.when(holds(p), F.col(value))).alias(name) for name, p in ps.items()])


def medians(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups and the true median of their finite values as `median`: the mean of the middle two of an even number, by ranks of counted values."""
    finite = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) != float("inf"))).withColumn(value, F.col(value).cast("double"))
    counted = finite.groupBy(*groups, value).agg(F.count("*").alias("_n"))
    ranked = running(counted, groups, value, {"_n": "_below"}).join(counted.groupBy(*groups).agg(F.sum("_n").alias("_all")), groups)
    at = lambda k: F.max(F.when((F.col("_below") <= k) & (k < F.col("_below") + F.col("_n")), F.col(value)))
    return ranked.groupBy(*groups).agg(((at(F.floor((F.col("_all") - 1) / 2)) + at(F.floor(F.col("_all") / 2))) / 2).alias("median"))


def pivoted(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row for each of the known values; 0 where there is none."""
    return rows.groupBy(row).pivot(column, values).count().na.fill(0, subset=values)


def first_seen(rows: DataFrame, kind: str, text: str, where: str, order: str) -> DataFrame:
    """Each (kind, text) once, with where it was seen first and how often."""
    return rows.groupBy(kind, text).agg(F.min_by(where, order).alias("first_at"), F.count("*").alias("times"))


def paired(ratings: DataFrame, pair: str, condition: str, score: str, errors: str) -> DataFrame:
    """One row: pairs, errors on and off, the median gain, and the decision. condition is "on" or "off"."""
    wide = ratings.groupBy(pair).agg(*[F.max(F.when(F.col(condition) == c, F.col(v))).alias(f"{v}_{c}") for v in (score, errors) for c in ("on", "off")])
    both = wide.where(F.col(f"{score}_on").isNotNull() & F.col(f"{score}_off").isNotNull())
    summed = both.agg(F.count("*").alias("pairs"), F.sum(f"{errors}_on").cast("bigint").alias("errors_on"), F.sum(f"{errors}_off").cast("bigint").alias("errors_off"), median(F.col(f"{score}_on") - F.col(f"{score}_off")).alias("gain"))
    rule = F.when(F.col("pairs") < LEAST_PAIRS, "no answer").when((F.col("errors_on") <= F.col("errors_off")) & (F.col("gain") >= LEAST_GAIN), "keep").otherwise("leave off")
    return summed.withColumn("decision", rule)


def blinded(pairs: DataFrame, pair: str, first: str, second: str, seed: str = "0") -> DataFrame:
    """pairs with their two versions as `x` and `y` in an order that a hash of seed and pair decides, and `swapped`, which a rater does not see."""
    swapped = F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col(pair).cast("string")).cast("binary")), 1, 1) >= "8"
    marked = pairs.withColumn("swapped", swapped)
    return marked.withColumn("x", F.when(F.col("swapped"), F.col(second)).otherwise(F.col(first))).withColumn("y", F.when(F.col("swapped"), F.col(first)).otherwise(F.col(second)))


def unblinded(ratings: DataFrame, x: str = "score_x", y: str = "score_y") -> DataFrame:
    """ratings of `x` and `y`, with `swapped`, as the scores of the first and the second version."""
    return ratings.withColumn("score_first", F.when(F.col("swapped"), F.col(y)).otherwise(F.col(x))).withColumn("score_second", F.when(F.col("swapped"), F.col(x)).otherwise(F.col(y)))


def auroc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: the area under the ROC curve, ties counted half, from counts by distinct score and running sums in ranges."""
    by = rows.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(positive).cast("bigint")).alias("p"), F.count("*").alias("n")).withColumn("neg", F.col("n") - F.col("p"))
    ranked = running(by, [], score, {"neg": "neg_below"})
    return ranked.agg(((F.sum(F.col("p") * F.col("neg_below")) + F.sum(F.col("p") * F.col("neg")) / 2) / F.nullif(F.sum("p") * F.sum("neg"), F.lit(0))).alias("auroc"))


def threshold_at(rows: DataFrame, score: str, positive: str, most: float) -> DataFrame:
    """One row: the smallest score above which at most a share `most` of the negatives lies, the share of positives detected above it, and the false positive rate there."""
    by = rows.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(positive).cast("bigint")).alias("p"), F.count("*").alias("n")).withColumn("neg", F.col("n") - F.col("p"))
    totals = by.agg(F.sum("p").alias("all_p"), F.sum("neg").alias("all_neg"))
    ranked = running(by, [], score, {"neg": "neg_below", "p": "p_below"}).crossJoin(F.broadcast(totals))
    above_neg, above_p = F.col("all_neg") - F.col("neg_below") - F.col("neg"), F.col("all_p") - F.col("p_below") - F.col("p")
    fits = ranked.where(above_neg <= F.col("all_neg") * most)
    return fits.agg(F.min_by(F.struct(F.col(score).cast("double").alias("threshold"), (above_p / F.col("all_p")).alias("detected"), (above_neg / F.col("all_neg")).alias("false_rate")), F.col(score)).alias("r")).select("r.*")


def bootstrap_auroc(rows: DataFrame, score: str, positive: str, key: str, rounds: int = 200, seed: str = "0") -> DataFrame:
    """One row: the 2.5 % and 97.5 % points of the AUROC over resampled rows.

    Each row's weight in a round is drawn from its key by a hash (Poisson with mean 1), so a round is a weighted sum and nothing
    is resampled by moving rows.
    """
    draw = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string"), F.col("round").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    bounds = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]  # of Poisson(1)
    weight = sum((draw >= b).cast("bigint") for b in bounds)
    drawn = rows.select(F.col(key), F.col(score).alias("s"), F.col(positive).cast("bigint").alias("p"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("w", weight).where("w > 0")
    by = drawn.groupBy("round", "s").agg(F.sum(F.col("w") * F.col("p")).alias("pos"), F.sum(F.col("w") * (1 - F.col("p"))).alias("neg"))
    ranked = running(by, ["round"], "s", {"neg": "neg_below"})
    areas = ranked.groupBy("round").agg(((F.sum(F.col("pos") * F.col("neg_below")) + F.sum(F.col("pos") * F.col("neg")) / 2) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("a"))
    return areas.agg(F.percentile("a", F.lit(0.025)).alias("low"), F.percentile("a", F.lit(0.975)).alias("high"))  # of `rounds` rows
