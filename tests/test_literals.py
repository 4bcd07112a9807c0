"""Literal cases with known results, for rules that the test tables have no data for."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import edits

CASES = [
    ("same", "same", "unchanged"),
    ("It’s  fine", "it's fine", "unchanged"),
    ("x 1", "x 2", "numbers_changed"),
    ("rose 12%", "rose 15%", "numbers_changed"),
    ("rose 12%", "grew 12 percent", None),
    ("1 200,5 units", "1200.5 units", None),
    ("3 million", "3", "units_changed"),
    ("A 5 km walk", "A 5 mile walk", "units_changed"),
    ("$40 paid", "40 euros paid", "units_changed"),
    ("$40 paid", "40 dollars paid", None),
    ("between 3 and 5 million", "between 3 million and 5 million", None),
    ("500 €/mois", "500 euros par mois", None),
    ("Apple rose 12% and Google rose 40%", "Apple rose 40% and Google rose 12%", "figures_swapped"),
    ("Apple rose 12% and Google rose 40%", "Google rose 40% and Apple rose 12%", None),
    ("It is safe", "It is not safe", "negation_changed"),
    ("The drug is not approved in France. It is safe.", "The drug is approved. It is safe.", "negation_changed"),
    ("no more than 40", "at most 40", None),
    ("no more than 40", "more than 40", "negation_changed"),
    ("It's not just a phone, it's a camera.", "It's a camera.", None),
    ("not possible", "impossible", None),
    ("plain words", "<b>plain</b> words", "markup"),
    ("plain words", "[plain](x) words", "markup"),
    ("# plain", "## plain", "markup"),
    ("a" * 601, "b", "span_too_long"),
    ("short", "long " * 60, "too_long"),
]


def test_verdicts(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(CASES)], "id bigint, original string, replacement string")
    found = {r["id"]: r["reason"] for r in edits.reasons(rows).collect()}
    assert found == {i: reason for i, (_, _, reason) in enumerate(CASES)}
    cheap = {r["id"]: r["reason"] for r in rows.select("id", edits.cheap_reason(F.col("original"), F.col("replacement")).alias("reason")).collect()}
    assert cheap == {i: reason if reason in ("unchanged", "span_too_long", "too_long", "markup") else None for i, (_, _, reason) in enumerate(CASES)}
