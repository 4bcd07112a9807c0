"""Passages from documents: windows, quality, vocabulary, sampling, duplicates and caps.

Every rule that depends on order takes the order as columns; nothing depends on how rows lie in files or partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators.sizes import numbered, small

# Thresholds of the noise report.
MIN_COMMON, MAX_UNKNOWN, MAX_FRAGMENTS, MAX_JUNK = 0.35, 0.10, 0.22, 1.5
VOCABULARY_SIZE, VOCABULARY_COUNT = 40_000, 3
AUTHOR_CHARS, TITLE_CHARS = 120, 160


def passages(docs: DataFrame, text: str = "text", least: int = T.MIN_WORDS, most: int = T.MAX_WORDS, separator: str = r"\n(?U:\s*)\n") -> DataFrame:
    """docs with a row for each usable passage: passage_no from 0, passage and n_words instead of the text."""
    kept = [c for c in docs.columns if c != text]
    cut = docs.select(*kept, T.windows(F.col(text), least, most, separator).alias("_cut"))
    return cut.select(*kept, F.posexplode("_cut").alias("passage_no", "_p")).select(*kept, "passage_no", "_p.*")


def edge_trimmed(docs: DataFrame, key: str, text: str = "text", separator: str = "\n") -> DataFrame:
    """(key, block_no, block): paragraphs without the edges."""
    return docs.select(key, F.posexplode(T.trimmed_edges(T.paragraphs(F.col(text), separator))).alias("block_no", "block"))


def first_of(rows: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key. Copies are settled by one pass over rows of the key; min_by combines map-side, so a hot key is cheap."""
    place = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    columns = rows.columns
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), place).alias("_row"))
    return best.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


def deduplicated(rows: DataFrame, passage: str, order: list[str]) -> DataFrame:
    """First-seen passages by signature."""
    return first_of(rows.withColumn("_signature", T.signature(F.col(passage))), ["_signature"], order).drop("_signature")


def last_values_first_place(rows: DataFrame, text: str, order: str) -> DataFrame:
    """Exact duplicates: the values of the last copy at the place of the first, as a table keyed by content keeps them."""
    columns = [c for c in rows.columns if c != order]
    best = rows.groupBy(F.sha2(F.col(text), 256).alias("sha256")).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_row"), F.min(order).alias("first_place"))
    return best.select("sha256", "first_place", *[F.col(f"_row.`{c}`").alias(c) for c in columns])


def capped(rows: DataFrame, groups: list[str], order: list[str], cap: Column | int) -> DataFrame:
    """The first `cap` rows of each group. Spark keeps only cap rows of a group in each task before it shuffles them."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col("_rank") <= cap).drop("_rank")


def capped_by_site(rows: DataFrame, site: str, lang: str, order: list[str], cap: int, share: float = 0.12) -> DataFrame:
    """At most a share of the cap for each site, then the cap for each language."""
    return capped(capped(rows, [lang, site], order, int(cap * share)), [lang], order, cap)


def deduplicated_and_capped(rows: DataFrame, passage: str, groups: list[str], order: list[str], cap: int) -> DataFrame:
    """Duplicates go first, then each group is capped: a passage that its group's cap refuses still counts as seen."""
    return capped(deduplicated(rows, passage, order), groups, order, cap)


def swept(rows: DataFrame, passage: str, group: str, order: list[str], cap: int) -> DataFrame:
    """Duplicates and caps in one sweep in order: a passage that a full group refuses is not seen, so a copy in another group may stay.

    A group is full from the place of its cap-th kept passage on. With these places known, of each signature the first copy stays
    that comes before its group is full; and that gives the places. Starting from no group full, places only move ahead, to those of
    the sweep. A round is an aggregation of first copies; the places, one a group, are all that comes to the driver.
    """
    place = F.struct(*order)
    first = rows.groupBy(T.signature(F.col(passage)).alias("_signature"), F.col(group).alias("_group")).agg(F.min(place).alias("_at")).cache()  # read in every round
    shape, full = first.schema["_at"].dataType, None
    while True:
        before = F.lit(True)
        for name, at in (full or {}).items():
            before = F.when(F.col("_group").eqNullSafe(F.lit(name)), F.col("_at") <= F.struct(*[F.lit(v) for v in at]).cast(shape)).otherwise(before)
        kept = first.where(before).groupBy("_signature").agg(F.min(F.struct("_at", "_group")).alias("_x")).select("_x.*")
        last = kept.withColumn("_rank", F.row_number().over(Window.partitionBy("_group").orderBy("_at"))).where(F.col("_rank") <= cap)
        found = {r["_group"]: tuple(r["_at"]) for r in last.where(F.col("_rank") == cap).collect()}  # a row for each full group
        if found == (full or {}):
            break
        full = found
    return rows.withColumn("_at", place).withColumn("_group", F.col(group)).join(last.select("_group", "_at"), ["_group", "_at"], "left_semi").drop("_group", "_at")


def corpus_rows(passages: DataFrame, prefix: str, document: Column, author: str, title: str, date: str) -> DataFrame:
    """passages with an id by document and number, credits cut to what a corpus stores, and a whole year."""
    return passages.withColumn("id", F.concat_ws("-", F.lit(prefix), document.cast("string"), F.col("passage_no").cast("string"))).withColumn(author, F.substring(author, 1, AUTHOR_CHARS)).withColumn(title, F.substring(title, 1, TITLE_CHARS)).withColumn("year", F.floor(F.col(date)).cast("bigint"))


def credits(passages: DataFrame) -> DataFrame:
    """What of a passage is shown beside an answer."""
    return passages.select("author", "title")


def spread(rows: DataFrame, groups: list[str], order: list[str], per: int, seed: str = "0") -> DataFrame:
    """`per` rows spread over each group: one for each equal slice, chosen by a hash of seed, group and slice; all of a smaller group.

    Slices begin at bround(i * n / per), as the nearest even number.
    """
    edge = lambda i: F.bround(i.cast("double") * F.col("_n") / F.lit(per)).cast("int")
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("_n"))
    placed = numbered(rows, order, "_at", groups)
    same = F.lit(True)
    for g in groups:
        same = same & placed[g].eqNullSafe(sizes[g])
    counted = placed.join(sizes, same).select(placed["*"], "_n")
    near = F.floor(F.col("_at") * F.lit(per) / F.col("_n")).cast("int")
    part = F.when(F.col("_at") < edge(near), near - 1).when(F.col("_at") >= edge(near + 1), near + 1).otherwise(near)
    with_slice = counted.withColumn("_slice", part)
    key = F.concat_ws("-", F.lit(seed), *[F.col(g).cast("string") for g in groups], F.col("_slice").cast("string"))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")
    width = F.greatest(edge(F.col("_slice") + 1) - edge(F.col("_slice")), F.lit(1))
    return with_slice.where((F.col("_n") <= per) | (F.col("_at") == edge(F.col("_slice")) + F.pmod(draw, width.cast("bigint")))).drop("_n", "_at", "_slice")


def vocabulary(docs: DataFrame, text: str = "text", top: int = VOCABULARY_SIZE, least: int = VOCABULARY_COUNT) -> DataFrame:
    """(word, n): the commonest folded words, cut to `top` first and to counts and lengths after. Ties are settled by the word."""
    counted = docs.select(F.explode(T.words(F.col(text))).alias("w")).groupBy(T.fold(F.col("w")).alias("word")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "word").limit(top).where((F.col("n") >= least) & (F.length("word") > 1))


def noise_report(rows: DataFrame, vocab: DataFrame, key: list[str], text: str) -> DataFrame:
    """key and the six measures of OCR noise. vocab: (word), broadcast where a count finds it small.

    What needs no vocabulary is computed where the text lies and travels with its words; the words of a key are summed up in the
    task that reads it, so the one shuffle has a row for each key, and no text.
    """
    read = rows.select(*key, T.char_noise(F.col(text)).alias("chars"), T.words(F.col(text)).alias("_words"))
    folded = read.select(*key, "chars", F.explode_outer("_words").alias("_w")).select(*key, "chars", T.fold(F.col("_w")).alias("word"))
    known = folded.join(small(vocab.select("word", F.lit(True).alias("known"))), "word", "left")
    count = lambda c: F.count_if(c & F.col("word").isNotNull())
    unknown = F.col("known").isNull()
    sums = known.groupBy(*key).agg(F.first("chars").alias("chars"), F.count("word").alias("n"), count(~unknown).alias("common"), count(unknown & (F.length("word") >= 4)).alias("unknown"), count(unknown & (F.length("word") <= 2)).alias("fragment"))
    ratio = lambda c: F.col(c) / F.greatest(F.col("n"), F.lit(1))
    return sums.select(*key, ratio("common").alias("common_ratio"), ratio("unknown").alias("unknown_ratio"), ratio("fragment").alias("fragment_ratio"), "chars.*")


def is_clean() -> Column:
    """Over the columns of noise_report."""
    return (
        (F.col("common_ratio") >= MIN_COMMON)
        & (F.col("unknown_ratio") <= MAX_UNKNOWN)
        & (F.col("fragment_ratio") <= MAX_FRAGMENTS)
        & (F.col("junk_per_100") <= MAX_JUNK)
        & (F.col("bad_case_words") == 0)
        & (F.col("repeats") == 0)
    )


def reject_reason(text: Column, clean: Column) -> Column:
    """The first test that a passage fails, cheapest first; null where it passes all."""
    return (
        F.when(~T.is_prose(text), F.lit("not prose"))
        .when(~T.is_running_prose(text), F.lit("list or table"))
        .when(T.has_strange_accents(text), F.lit("misread letters"))
        .when(~clean, F.lit("ocr noise"))
    )


def dehyphenated(rows: DataFrame, vocab: DataFrame, key: list[str], text: str) -> DataFrame:
    """rows with words that a line end split glued together where the vocabulary knows the whole, else with the hyphen but no space.

    Each break is looked up by a broadcast join; a text is put together again from its parts.
    """
    mark = r"(\p{L}+)-(?U:\s+)([a-zà-ÿ]+)"
    parts = F.split(F.regexp_replace(F.col(text), mark, "$1\u0001-\u0002$2"), "\u0001-\u0002")
    cut = rows.select(*key, F.posexplode(parts).alias("i", "part"))
    following = F.lead("part").over(Window.partitionBy(*key).orderBy("i"))
    glued = cut.withColumn("next", following).withColumn("whole", T.fold(F.concat(F.regexp_extract("part", r"(\p{L}+)$", 1), F.regexp_extract("next", r"^([a-zà-ÿ]+)", 1))))
    found = glued.join(small(vocab.select(F.col("word").alias("whole"), F.lit(True).alias("known"))), "whole", "left")
    ended = found.withColumn("out", F.concat("part", F.when(F.col("next").isNull(), "").when(F.col("known"), "").otherwise("-")))
    joined = ended.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "out"))), lambda x: x["out"]), "").alias("_whole"))
    return rows.join(joined, key, "left").withColumn(text, F.coalesce("_whole", F.col(text))).drop("_whole")


def profile(rows: DataFrame, groups: list[str], year: str | None = None) -> DataFrame:
    """Counts by group, and the first and last year where there is one."""
    extra = [F.min(year).alias("first_year"), F.max(year).alias("last_year")] if year else []
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), *extra)


def curated(ids: DataFrame, catalog: DataFrame, key: str, valid: Column) -> DataFrame:
    """ids with their catalogue rows; an error where one is missing or not valid, found by a count before anything is returned."""
    usable = catalog.where(valid)
    missing = ids.select(key).join(usable.select(key), key, "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"not usable: {missing[0][key]}")
    return usable.join(small(ids), key)
