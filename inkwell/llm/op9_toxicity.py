"""Toxicity: non-negative positive-unlabelled learning (Kiryo et al., 2017).

A linear model over word indicators is trained with numpy from confirmed toxic texts and unlabelled ones. The risk of calling an
unlabelled text toxic is corrected by the toxic texts in it, whose share is the class prior: R = pi R+(f) + max(0, Ru-(f) - pi R+-(f));
where the corrected part falls below 0 its gradient is reversed, so that the model does not learn the unlabelled toxic texts by heart.

The prior is the toxic share among labels outside the held-out fold. Both training samples are bounded (POSITIVE, UNLABELLED) and
are the rows with the smallest hash of their ids; of unlabelled rows no label is read. What is counted of the samples is counted on
executors; the driver takes the indicators that tell the samples apart, and at most MOST of them in all rows of a sample. Every document is scored over its whole text.

Defined results: a null or empty text gets the score of no indicators; equal texts get equal scores; repeated rows are scored each
by itself; a label that is null or not 0 or 1 is no label; ids that are null have no label; without a confirmed toxic text every
score is 0; an empty table gives an empty result. The style is mapInArrow with numpy, as for the quality classifier.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import base, labelled
from inkwell.llm.features import SIZE
from inkwell.llm.op8_quality import squash

FAMILIES = ("words", "beginnings")
#: Rows of each kind that the model is trained on at most.
POSITIVE, UNLABELLED = 6000, 18000
#: Telling indicators of all rows of a sample that the driver takes at most, four bytes each.
MOST = 8_000_000
#: Passes over the unlabelled sample, parts of a pass, step size, weight decay; indicators in fewer sampled texts, or less telling, have no weight.
PASSES, PARTS, RATE, DECAY, LEAST_TEXTS, LEAST_Z = 40, 12, 0.05, 2e-3, 4, 4.0
LEAST = 0.3


def _sums(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows end to end, where each begins, and the row of every entry."""
    sizes = np.array([len(r) for r in rows])
    return np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64), sizes, np.repeat(np.arange(len(rows)), sizes)


def margins(part: tuple[np.ndarray, np.ndarray, np.ndarray], w: np.ndarray, bias: float) -> np.ndarray:
    index, sizes, row = part
    return bias + np.bincount(row, w[index], minlength=len(sizes))


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """The indicators whose log odds differ between the samples by LEAST_Z standard errors or more; a long text has thousands of others."""
    p, u = (np.bincount(np.concatenate([*rows, np.empty(0, np.int32)]), minlength=SIZE) for rows in (positive, unlabelled))
    a, b, c, d = p + 0.5, len(positive) - p + 0.5, u + 0.5, len(unlabelled) - u + 0.5
    z = np.log(a * d / (b * c)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return (p + u >= LEAST_TEXTS) & (np.abs(z) >= LEAST_Z)


def risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk from the margins of toxic and of unlabelled texts; the second is the one that is held at 0 or more."""
    return prior * float(np.logaddexp(0, -fp).mean()), float(np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean())


def slopes(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives by the margins: of the whole risk, or, where its second part is below 0, of that part reversed."""
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    gp, gu = prior * sigmoid(fp) / len(fp), sigmoid(fu) / len(fu)
    return (-prior * sigmoid(-fp) / len(fp) - gp, gu) if risk(fp, fu, prior)[1] >= 0 else (gp, -gu)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias, by Adam on mini-batches of the non-negative risk with the logistic loss."""
    seen = telling(positive, unlabelled)
    positive, unlabelled = [[r[seen[r]] for r in rows] for rows in (positive, unlabelled)]
    used = np.flatnonzero(seen)
    place = np.zeros(SIZE, np.int64)
    place[used] = np.arange(len(used))
    w, bias, moments, step = np.zeros(len(used)), math.log(prior / (1 - prior)), np.zeros((2, len(used) + 1)), 0
    order = np.random.default_rng(11)
    for _ in range(PASSES):
        p_order, u_order = order.permutation(len(positive)), order.permutation(len(unlabelled))
        for k in range(PARTS):
            p, u = ([rows[i] for i in at[k::PARTS]] for rows, at in ((positive, p_order), (unlabelled, u_order)))
            if not p or not u:
                continue
            parts = [_sums([place[r] for r in rows]) for rows in (p, u)]
            fp, fu = (margins(part, w, bias) for part in parts)
            by_p, by_u = slopes(fp, fu, prior)
            slope = np.zeros(len(used) + 1)
            for (index, _, row), g in zip(parts, (by_p, by_u), strict=True):
                slope[:-1] += np.bincount(index, g[row], minlength=len(used))
                slope[-1] += g.sum()
            slope[:-1] += DECAY * w
            step += 1
            moments[0] = 0.9 * moments[0] + 0.1 * slope
            moments[1] = 0.999 * moments[1] + 0.001 * slope**2
            move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
            w -= move[:-1]
            bias -= move[-1]
    weights = np.zeros(SIZE)
    weights[used] = w
    return weights, float(bias)


def _telling_only(sample: DataFrame) -> DataFrame:
    """The sample with those indicators only that `telling` keeps; counted on executors, at most SIZE numbers come to the driver."""
    sizes = {r["grp"]: r["count"] for r in sample.groupBy("grp").count().collect()}
    one = lambda g: F.sum((F.col("grp") == g).cast("bigint"))
    counts = sample.select("grp", F.explode("found").alias("i")).groupBy("i").agg(one(1).alias("p"), one(0).alias("u")).where(F.col("p") + F.col("u") >= LEAST_TEXTS)
    a, c = F.col("p") + 0.5, F.col("u") + 0.5
    b, d = F.lit(sizes.get(1, 0) + 0.5) - F.col("p"), F.lit(sizes.get(0, 0) + 0.5) - F.col("u")
    z = F.log(a * d / (b * c)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    mask = np.zeros(SIZE, bool)
    mask[[r["i"] for r in counts.where(F.abs(z) >= LEAST_Z).select("i").collect()]] = True
    shared = sample.sparkSession.sparkContext.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.asarray(f.values, np.int32) for f in batch.column(2)]
            kept = [f[shared.value[f]] for f in found]
            ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, np.concatenate([*kept, np.empty(0, np.int32)]))], names=["doc_id", "grp", "found"])

    return base.stored(sample.mapInArrow(run, "doc_id bigint, grp int, found array<int>"), "telling")


def model(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, unlabelled: int = UNLABELLED, most: int = MOST) -> tuple[np.ndarray, float]:
    known = labelled.known_labels(labels, "toxic")
    counts = {r["grp"]: r["count"] for r in known.groupBy("grp").count().collect()}
    if not counts.get(1):
        return np.zeros(SIZE), -30.0
    prior = min(max(counts[1] / sum(counts.values()), 1e-3), 0.999)
    toxic = labelled.first_by_hash(known.where("grp = 1"), positive)
    ids = docs.where(~labelled.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id").distinct().withColumn("grp", F.lit(0))
    sample = labelled.sampled(docs, toxic.unionByName(labelled.first_by_hash(ids, unlabelled)), FAMILIES)
    fewer = _telling_only(sample)
    found = labelled.gathered(fewer, most)
    base.deleted(sample, fewer)
    sets = [[r for g, r in found if g == want] for want in (1, 0)]
    return train(*sets, prior) if all(sets) else (np.zeros(SIZE), -30.0)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    weights, bias = model(docs, labels)
    return labelled.scored(docs, FAMILIES, weights, bias, squash, LEAST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(base.read(spark, sf_dir, "documents"), base.read(spark, sf_dir, "labels"))
