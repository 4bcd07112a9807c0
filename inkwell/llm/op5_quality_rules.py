"""Quality rules: a threshold table compiled into one projection (native).

Every measure is a Column over one text; RULES says which measures, or ratios of two, must lie within which bounds; compile_rules
turns the table into one boolean. Measures are whole numbers and bounds are compared by cross-multiplication, so that no verdict
hangs on the rounding of a quotient.

Defined results: a null text counts as an empty one; a text without words has all measures 0 and fails the base rules; ties and
repeated rows are judged each by itself; an empty table gives an empty result; the stage passes all columns on.
Very long texts cost time in proportion to n log n of their words: repeats are found by sorting window hashes, not by comparing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import base

#: Words in a window; a window found twice marks all its words as repeated.
WINDOW = 8

#: Frequent words of the languages in the corpus, lower case.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as was by are this at from or an not "
    "der die und das ist nicht von mit den ein eine im zu für auf dem des sich als auch es "
    "le la les de des du et un une est dans que qui pour en par sur au pas ne se il "
    "el los las que y del un una por con no su para al lo como más se"
).split()


class Rule(NamedTuple):
    """least * per / 100 <= measure <= most * per / 100 with per a measure's name, or plain bounds where per is None."""

    name: str
    measure: str
    per: str | None
    least: int | None
    most: int | None


#: The base rules that every verdict starts from, fixed by the contract.
BASE = (
    Rule("too_few_words", "n_words", None, 20, None),
    Rule("repeated_windows", "n_repeat_words", "n_words", None, 30),
)
#: The method's own rules: length, symbol, stop-word and line ratios, in per cent of `per`.
RULES = (
    Rule("too_many_words", "n_words", None, None, 10_000_000),
    Rule("mean_word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("stop_word_count", "n_stop_words", None, 2, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 60),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
    Rule("words_with_letters", "n_letter_words", "n_words", 80, None),
    Rule("upper_case", "n_upper", "word_chars", None, 40),
)


def _covered(hashes: Column) -> Column:
    """Words in windows that occur twice or more: the lengths of the union of [i, i + WINDOW) over those windows' positions."""
    tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(rows: Column) -> Column:
        again = F.filter(rows, lambda r, k: (r["h"] == F.get(rows, k - 1)["h"]) | (r["h"] == F.get(rows, k + 1)["h"]))
        return F.sort_array(F.transform(again, lambda r: r["i"]))

    def total(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    return base.let(base.let(tagged, positions), total)


def _repeated(words: Column) -> Column:
    """Only texts in which some window recurs are sorted; the others are settled by counting distinct hashes."""

    def paired(hashes: Column, step: int) -> Column:
        return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))

    def windows(hashes: Column) -> Column:
        """Hashes of 2, 4 and then WINDOW = 8 words from each position; the last positions have no full window."""
        two = base.let(hashes, lambda h: paired(h, 1))
        four = base.let(two, lambda h: paired(h, 2))
        return F.slice(base.let(four, lambda h: paired(h, 4)), F.lit(1), F.size(hashes) - (WINDOW - 1))

    def count(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("bigint")).otherwise(_covered(found))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("bigint")).otherwise(base.let(base.let(hashed, windows), count))


def measures(text: Column) -> Column:
    """A struct of all measures of one text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(base.WORD))

    def over(words: Column) -> Column:
        joined = F.array_join(words, "")

        def by_line(rows: Column) -> list[Column]:
            return [
                F.size(rows).cast("bigint").alias("n_lines"),
                (F.size(rows) - F.size(F.array_distinct(rows))).cast("bigint").alias("n_dup_lines"),
                F.size(F.filter(rows, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[•‣*-]"))).cast("bigint").alias("n_bullet_lines"),
                F.size(F.filter(rows, lambda x: x.rlike(r"(…|\.\.\.)[\x20\x09-\x0D]*$"))).cast("bigint").alias("n_ellipsis_lines"),
            ]

        return base.let(
            lines,
            lambda rows: F.struct(
                F.size(words).cast("bigint").alias("n_words"),
                F.length(joined).cast("bigint").alias("word_chars"),
                F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
                _repeated(words).alias("n_repeat_words"),
                F.size(F.filter(words, lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))).cast("bigint").alias("n_stop_words"),
                F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).cast("bigint").alias("n_letter_words"),
                F.regexp_count(whole, F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
                *by_line(rows),
            ),
        )

    return base.let(base.words_of(text), over)


def compile_rules(rules: tuple[Rule, ...], measured: Column) -> Column:
    """True where every rule of the table holds."""
    holds = F.lit(True)
    for rule in rules:
        value, unit = measured[rule.measure], (F.lit(1).cast("bigint") if rule.per is None else measured[rule.per])
        scaled = value if rule.per is None else value * 100
        if rule.least is not None:
            holds = holds & (scaled >= unit * rule.least)
        if rule.most is not None:
            holds = holds & (scaled <= unit * rule.most)
    return holds


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the shown measures, base_failed and kept."""

    def of(m: Column) -> Column:
        failed = ~compile_rules(BASE, m)
        shown = [m[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return F.struct(*shown, failed.alias("base_failed"), (~failed & compile_rules(rules, m)).alias("kept"))

    return base.let(measures(text), of)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.read(spark, sf_dir, "documents").select("doc_id", verdict(F.col("text")).alias("v")).select("doc_id", "v.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the documents that are kept, with their columns."""
    return docs.where(verdict(F.col("text"))["kept"])


def sql(table: str) -> str:
    """DuckDB: the verdicts over `table`, with all its columns."""
    bounds = lambda rule: " AND ".join(
        f"{rule.measure}{'' if rule.per is None else ' * 100'} {op} {rule.per or 1} * {bound}" for op, bound in ((">=", rule.least), ("<=", rule.most)) if bound is not None
    )
    ws, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return rf"""
SELECT * EXCLUDE (rn, t, ws, ls, failed, n_lines, n_stop_words, n_bullet_lines, n_ellipsis_lines, n_letter_words, n_upper),
  failed AS base_failed, NOT failed AND {' AND '.join(bounds(r) for r in RULES)} AS kept FROM (
SELECT *, NOT ({' AND '.join(bounds(r) for r in BASE)}) AS failed FROM (
SELECT m.*, coalesce(r.n_repeat_words, 0)::bigint AS n_repeat_words FROM (
  SELECT *, len(ws)::bigint AS n_words, length(array_to_string(ws, ''))::bigint AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint AS n_symbols,
    len(ls)::bigint AS n_lines, (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines,
    len(list_filter(ws, lambda w: list_contains([{stops}], lower(w))))::bigint AS n_stop_words,
    len(list_filter(ls, lambda x: regexp_matches(x, '^{ws}*[•‣*-]')))::bigint AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(…|\.\.\.){ws}*$')))::bigint AS n_ellipsis_lines,
    len(list_filter(ws, lambda w: regexp_matches(w, '\p{{L}}')))::bigint AS n_letter_words, len(regexp_extract_all(t, '\p{{Lu}}'))::bigint AS n_upper
  FROM (SELECT *, regexp_extract_all(t, '{word}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls
        FROM (SELECT *, coalesce(text, '') AS t, doc_id AS rn FROM {table}))) m
LEFT JOIN (
  SELECT rn, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT rn, unnest(range(i, i + {WINDOW})) AS p FROM (
      SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS k FROM (
        SELECT rn, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS g FROM (
          SELECT rn, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 1))) AS i FROM (
            SELECT doc_id AS rn, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM {table}))))
    WHERE k > 1) GROUP BY rn) r USING (rn)))
"""


ORACLE = f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({sql('documents')})"
