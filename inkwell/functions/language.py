"""Which of two languages a text is in, by its short function words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import let

# Function words that only one of the languages uses all the time, and the thresholds.
ENGLISH = "the of and to in is that it was for with as his her he she they at be this have from or by not but are were which an their you we had has been would there what when who will more if no".split()
FRENCH = "le la les de des du et un une est que qui dans pour pas sur au aux avec ce cette ces il elle ils elles nous vous je tu se sa ses leur mais ou par ne y en était sont à".split()
ELIDED = r"^(?:[lLdDnNcCjJsSmMtT]|[qQ][uU])'\p{Ll}"
LEAST_WORDS, LEAST_HITS, MARGIN = 8, 3, 1.3


def guess(text: Column) -> Column:
    """ "en", "fr", or null where the text is too short or too close to call."""
    found = F.regexp_extract_all(F.replace(F.coalesce(text, F.lit("")), F.lit("’"), F.lit("'")), F.lit(r"[\p{L}']+"), F.lit(0))

    def judge(words: Column) -> Column:
        plain = F.transform(F.filter(words, lambda w: ~w.rlike(ELIDED)), lambda w: F.substring_index(F.lower(w), "'", 1))
        elided = F.size(F.filter(words, lambda w: w.rlike(ELIDED)))
        hits = F.struct(F.size(F.filter(plain, lambda w: w.isin(*ENGLISH))).alias("en"), (elided + F.size(F.filter(plain, lambda w: w.isin(*FRENCH)))).alias("fr"))
        verdict = lambda h: F.when(h["en"] + h["fr"] < LEAST_HITS, None).when(h["fr"] > h["en"] * MARGIN, F.lit("fr")).when(h["en"] > h["fr"] * MARGIN, F.lit("en"))
        return F.when(F.size(words) >= LEAST_WORDS, let(hits, verdict))

    return let(found, judge)
