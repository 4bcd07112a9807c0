"""Functions over embedding vectors (arrays of numbers), as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(a: Column, b: Column) -> Column:
    """1 - cosine distance; null for a vector of length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity_to(a: Column, query: Sequence[float]) -> Column:
    """similarity to a fixed vector of the same length, whose norm is folded into the plan; sums are written out, so that they are compiled."""
    values = [F.get(a, F.lit(i)).cast("double") for i in range(len(query))]
    total = lambda terms: reduce(lambda s, x: s + x, terms, F.lit(0.0))
    dot_, square = total(v * float(x) for v, x in zip(values, query, strict=True)), total(v * v for v in values)
    return F.try_divide(dot_, F.sqrt(square) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5))


@F.arrow_udf(T.StringType())
def literal(v: pa.Array) -> pa.Array:
    """A vector as text with six decimals, as a vector database reads it; a number that is null is left out.

    Rounded as C's printf does: by the exact value, halves to even digits. The JVM's format rounds halves away from zero and fills
    large numbers up with zeros.
    """
    numbers = [None if row is None else tuple(x for x in row if x is not None) for row in v.to_pylist()]
    return pa.array([None if row is None else f"[{','.join(['%.6f'] * len(row))}]" % row for row in numbers], pa.string())


def from_literal(s: Column) -> Column:
    numbers = F.transform(F.split(F.regexp_replace(s, r"^\s*\[|\]\s*$", ""), ","), lambda x: x.cast("float"))
    return F.when(s.rlike(r"^\s*\[\s*\]\s*$"), F.array().cast("array<float>")).otherwise(numbers)


def quantized(v: Column) -> Column:
    """struct(codes array<tinyint>, scale): codes * scale is v up to half a step; a zero vector has scale 1. Halves go to the even code."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    codes = F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x.cast("double") / scale).cast("int"))).cast("tinyint"))
    return F.struct(codes.alias("codes"), scale.alias("scale"))


def restored(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda c: c.cast("double") * scale)


def unit(v: Column) -> Column:
    """v at length 1; null for a zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))
