"""Readers of catalogues, books, articles, passages, vocabularies and artifacts. All go through Spark's readers."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import metadata as M
from inkwell.functions import text as T
from inkwell.operators.sizes import numbered

PASSAGE = "id string, gutenberg_id int, position int, author string, title string, lang string, kind string, n_words int, text string, source string, collection string, year int, sha256 string"


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, author, death, lang, public_domain) of a catalogue's texts. An id that comes twice keeps its last row in the file."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("_at", F.monotonically_increasing_id())
    texts = raw.where("Type = 'Text'")
    last = texts.groupBy(F.col("`Text#`").cast("int").alias("id")).agg(F.max_by(F.struct("Title", "Authors", "Language"), "_at").alias("r"))
    author = M.parse_author(F.col("r.Authors"))
    return last.select("id", M.short_title(F.col("r.Title")).alias("title"), author["name"].alias("author"), author["death"].alias("death"), F.col("r.Language").alias("lang"), M.public_domain(author["death"]).alias("public_domain"))


def books(spark: SparkSession, folder: str, ids: DataFrame | None = None) -> DataFrame:
    """(id, text) of <id>.txt files; with ids, an error for one that has no file."""
    read = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.txt$", 1).alias("name"), F.col("value").alias("text"))
    found = read.where("name <> ''").select(F.col("name").cast("int").alias("id"), "text")
    if ids is None:
        return found
    missing = ids.select("id").join(found.select("id"), "id", "left_anti").limit(1).collect()
    if missing:
        raise FileNotFoundError(f"no file for book {missing[0]['id']}")
    return found.join(ids.select("id"), "id")


def articles(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, url, text, year) of newline JSON, gzipped or not. `limit` counts rows read, in the order of file and row, before any filter."""
    rows = spark.read.schema("url string, text string, timestamp string").json(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    # a row's number in its file, from 0, whatever parts the file is read in: parts in their order, rows of a part in theirs
    placed = numbered(rows.withColumn("_at", F.monotonically_increasing_id()), ["_block", "_at"], "_row", ["_file"])
    kept = placed if limit is None else placed.where(F.col("_row") < limit).orderBy("_file", "_row").limit(limit)
    shard = F.regexp_extract("_file", r"(\d+)", 1)
    return kept.select(F.concat_ws("-", F.lit("c4"), shard, F.col("_row").cast("string")).alias("id"), "url", "text", F.expr("try_cast(substring(timestamp, 1, 4) as int)").alias("year"))


def evenly(names: Sequence[str], n: int) -> list[str]:
    """n of the names, sorted, at equal steps (halves to even); all of fewer."""
    ordered = sorted(names)
    return ordered if len(ordered) <= n else [ordered[round(i * len(ordered) / n)] for i in range(n)]


def crawl(spark: SparkSession, paths: Sequence[str], sites: DataFrame | None = None) -> DataFrame:
    """(id, url, text, year) of Parquet crawls up to the last usable year; files that cannot be read are passed over."""
    from inkwell.operators.web import on_sites

    reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    rows = reader.parquet(*paths).select("id", "url", "text", M.crawl_year(F.col("dump")).alias("year")).where(F.col("year") <= M.LATEST_CRAWL_YEAR)
    return rows if sites is None else on_sites(rows, sites)


def there(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of the paths that exist, with a warning for each of the others; an error where none does."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = [p for p in paths if jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(p))]
    for path in paths:
        if path not in found:
            warnings.warn(f"no file at {path}", stacklevel=2)
    if not found:
        raise FileNotFoundError("none of the files is there")
    return found


def passages(spark: SparkSession, *paths: str) -> DataFrame:
    """Passage files (JSON Lines) as one table; fields that a file lacks are null, but for the source, which has a default. Missing files are warned of."""
    rows = spark.read.schema(PASSAGE).json(there(spark, paths)).where("id is not null")
    return rows.withColumn("source", F.coalesce("source", F.lit("gutenberg")))


def texts_with_facts(spark: SparkSession, path: str) -> DataFrame:
    """(id, locale, text, facts) of a JSON document that holds an array of texts, each with an array of facts."""
    whole = spark.read.schema("note string, texts array<struct<id:string,locale:string,text:string,facts:array<string>>>").option("multiLine", True).json(path)
    return whole.select(F.explode("texts").alias("t")).select("t.*")


def embedder(spark: SparkSession, table: str, scales: str, dim: int, checksums: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """(token_id, codes, scale) of an embedder's two binary files: a signed byte for each dimension, and a little-endian float32 a row."""
    both = artifact(spark, table, checksums[0]).select(F.col("content").alias("codes")).crossJoin(artifact(spark, scales, checksums[1]).select(F.col("content").alias("scales")))

    def run(batches):
        for batch in batches:
            for codes, scale in zip(batch["codes"], batch["scales"], strict=True):
                rows, steps = np.frombuffer(codes, np.int8).reshape(-1, dim), np.frombuffer(scale, "<f4")
                if len(rows) != len(steps):
                    raise ValueError("as many scales as rows are wanted")
                for at in range(0, len(rows), 10_000):
                    yield pd.DataFrame({"token_id": range(at, min(at + 10_000, len(rows))), "codes": list(rows[at : at + 10_000]), "scale": steps[at : at + 10_000].astype(float)})

    return both.mapInPandas(run, "token_id bigint, codes array<tinyint>, scale double")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(T.tokens(F.col("value"))).alias("word")).distinct()


def artifact(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """(content) of a binary file; an error where its checksum is another."""
    rows = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("sha256"))
    if sha256 is not None:
        rows = rows.withColumn("content", F.when(F.col("sha256") == sha256, F.col("content")).otherwise(F.raise_error(F.lit("checksum differs")).cast("binary")))
    return rows


def log_reports(spark: SparkSession, path: str, schema: str, prefix: str = "Rewrite attempt ") -> DataFrame:
    """The JSON reports in a log's lines."""
    line = F.regexp_extract("value", prefix + r"(\{.*\})", 1)
    return spark.read.text(path).select(line.alias("json")).where("json <> ''").select(F.from_json("json", schema).alias("r")).select("r.*")


def synthetic(spark: SparkSession, n: int, dim: int, seed: int = 1) -> DataFrame:
    """(id, lang, embedding): seeded random unit vectors, languages in turn."""
    from inkwell.functions.vectors import unit

    drawn = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.xxhash64(F.col("id"), i, F.lit(seed)) / F.lit(float(1 << 63)))
    return spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"), unit(drawn).alias("embedding"))


def body_accepted(body: str, most: int = 40_000):
    """Whether a request body fits, counted in bytes."""
    return F.octet_length(F.col(body)) <= most
