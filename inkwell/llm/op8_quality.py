"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

Indicators of character and word-shape n-grams are scaled by their log-count ratio between good and bad documents; a linear model
with squared hinge loss is fitted to them by dual coordinate descent (Hsieh et al., 2008); a logistic curve through its margins on
the training rows, weighted by how often each class was sampled, makes scores of them.

The training sample is bounded: PER_CLASS labelled rows of each class, those with the smallest hash of their ids outside the
held-out fold, and of these as many as have MOST indicators together, so that very long texts cannot fill the driver. Counts of the classes are taken over all such labels. Every document is scored over its whole text.

Defined results: a null or empty text gets the score of no indicators; equal texts get equal scores; repeated rows are scored each
by itself; a label that is null or not 0 or 1 is no label; ids that are null have no label; without labels of both classes every
score is the share of good labels, or 1 where there are none; an empty table gives an empty result.
The style is mapInArrow with numpy: the indicators are byte work, and the model is one table of 2^18 numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import base, labelled
from inkwell.llm.features import SIZE

FAMILIES = ("characters", "shapes")
#: Labelled rows of each class that the model is fitted to at most.
PER_CLASS = 3000
#: Indicators of all sampled rows of a class that the driver takes at most, four bytes each.
MOST = 8_000_000
#: Added to counts; the price of errors; passes over the sample; the share of the fitted weights, the rest being their mean size.
ALPHA, COST, PASSES, BLEND = 1.0, 1.0, 12, 0.25
LEAST = 0.7


class Model(NamedTuple):
    """score = 1 / (1 + exp(-(slope * (sum of weights / sqrt(number of indicators)) + shift)))."""

    weights: np.ndarray
    shift: float


class Scaled(Sequence):
    """The values of each row's indicators, their ratios over the root of their number: made when asked for, since those of all rows take twice the rows' memory."""

    def __init__(self, rows: list[np.ndarray], ratio: np.ndarray) -> None:
        self.rows, self.ratio = rows, ratio

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ratio[self.rows[i]] / max(1.0, len(self.rows[i])) ** 0.5


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = {c: np.full(SIZE, ALPHA) for c in (-1, 1)}
    for r, c in zip(rows, y, strict=True):
        counts[int(c)][r] += 1  # a row has an indicator once
    return np.log((counts[1] / counts[1].sum()) / (counts[-1] / counts[-1].sum()))


def dual_descent(rows: list[np.ndarray], values: Sequence[np.ndarray], y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised squared-hinge model; the bias is an indicator that every row has."""
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    norms = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(7)
    for _ in range(PASSES):
        largest = 0.0
        for i in order.permutation(len(rows)):
            damp = 0.5 / cost[i]
            value = values[i]
            slope = y[i] * (w[rows[i]] @ value + bias) - 1.0 + damp * alpha[i]
            if (slope if alpha[i] > 0 else min(slope, 0.0)) == 0.0:
                continue
            new = max(alpha[i] - slope / (norms[i] + damp), 0.0)
            step = (new - alpha[i]) * y[i]
            largest = max(largest, abs(step))
            alpha[i] = new
            w[rows[i]] += step * value
            bias += step
        if largest < 1e-4:
            break
    return w, bias


def logistic(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift by Newton's method, with his smoothed targets."""
    good, bad = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        gap, curve = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(gap * margins).sum(), gap.sum()])
        h = np.array([[(curve * margins**2).sum() + 1e-6, (curve * margins).sum()], [(curve * margins).sum(), curve.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = max(a - da, 1e-3), b - db
        if abs(da) + abs(db) < 1e-6:
            break
    return a, b


def fit(rows: list[np.ndarray], y: np.ndarray, shares: dict[int, float]) -> Model:
    """A model of indicator sets with classes +1 and -1; shares: the classes' shares among all labels."""
    ratio = log_count_ratio(rows, y)
    values = Scaled(rows, ratio)
    weight = np.array([shares[int(c)] / (y == c).mean() for c in y])
    w, bias = dual_descent(rows, values, y, np.full(len(rows), COST))
    mean = np.abs(w).mean()  # what every ratio is trusted with, however its own weight came out
    w = (1 - BLEND) * mean + BLEND * w
    margins = np.array([w[r] @ v for r, v in zip(rows, values, strict=True)])
    slope, shift = logistic(margins + bias, y, weight)
    return Model(slope * w * ratio, slope * bias + shift)


def squash(x: float) -> float:
    return 1 / (1 + math.exp(-min(max(x, -30.0), 30.0)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most: int = MOST) -> tuple[Model, Callable[[float], float]]:
    """The model of the labels outside the held-out fold."""
    known = labelled.known_labels(labels, "quality")
    counts = {r["grp"]: r["count"] for r in known.groupBy("grp").count().collect()}
    total = sum(counts.values())
    found: list[tuple[int, np.ndarray]] = []
    if len(counts) == 2:
        sample = labelled.sampled(docs, labelled.first_by_hash(known.where("grp = 1"), per_class).unionByName(labelled.first_by_hash(known.where("grp = 0"), per_class)), FAMILIES)
        found = labelled.gathered(sample, most)
        base.deleted(sample)
    y = np.array([1 if g else -1 for g, _ in found])
    if len(set(y)) < 2:
        share = counts.get(1, 0) / total if total else 1.0
        return Model(np.zeros(SIZE), 0.0), lambda _: share
    return fit([r for _, r in found], y, {1: counts[1] / total, -1: counts[0] / total}), squash


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    model, shape = train(docs, labels)
    return labelled.scored(docs, FAMILIES, model.weights, model.shift, shape, LEAST, normal=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(base.read(spark, sf_dir, "documents"), base.read(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the documents that are predicted to be good, with their columns. The text is scored where it stands, without a join."""
    model, shape = train(docs, base.read(spark, sf_dir, "labels"))
    base.returned(spark)  # the sample, which none of the later stages needs
    return labelled.kept(docs, FAMILIES, model.weights, model.shift, shape, LEAST, normal=True)
