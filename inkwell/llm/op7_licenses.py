"""License scans (native): MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A text is the sequence of its words (runs of letters and digits, lower case); a shingle is five words in a row, as a 64-bit hash.
A template of m words is looked for in windows of m + m / 8 words that begin every m / 8 + 1 words, so that a verbatim copy lies
whole in some window. Window and template collide in a band when their min-hashes under its hash function are equal. A window that
holds LEAST per cent of a template's shingles has a Jaccard similarity of 0.6 or more with it, so BANDS bands of one row each miss
it with a probability of 0.4 ** 16, less than one in two million.

A window's min-hash can only equal a template's where the window holds the very shingle that has it. So windows are taken only
around the shingles of the band table, and a text that holds none of these is settled by one look-up. The band table and the
templates have a fixed size, which is why they are broadcast.

Defined results: a row for each document and license found, with the best window (of equal ones the first); null and empty texts,
and texts of fewer than five words, have none; repeated rows are merged in that; a row without an id is reported without one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import base

WORDS, BANDS, LEAST = 5, 16, 80

# Notices by which publicly known licenses are granted.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
}


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(text: Column) -> Column:
    """The hash of each five words in a row, in order."""

    def of(hashes: Column) -> Column:
        paired = F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1)))
        five = lambda two: F.transform(two, lambda h, i: F.xxhash64(h, F.get(two, i + 2), F.get(hashes, i + 4)))
        return F.slice(base.let(paired, five), F.lit(1), F.greatest(F.size(hashes) - (WORDS - 1), F.lit(0)))

    return base.let(F.transform(_words(text), lambda w: F.xxhash64(w)), of)


def _least(values: Column, band: Column) -> Column:
    return F.array_min(F.transform(values, lambda x: F.xxhash64(x, band)))


def templates(spark: SparkSession, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    """(license, wanted, size, step, bands): shingles, windows, and the shingle that has each band's min-hash."""
    rows = spark.createDataFrame([(k, v) for k, v in texts.items()], "license string, text string").select("license", shingles(F.col("text")).alias("wanted"))
    extra = F.floor((F.size("wanted") + WORDS - 1) / 8).cast("int")
    held = lambda k: F.array_min(F.transform("wanted", lambda x: F.struct(F.xxhash64(x, F.lit(k)).alias("h"), x.alias("x"))))
    bands = F.array(*[F.struct(F.lit(k).alias("band"), held(k)["h"].alias("h"), held(k)["x"].alias("x")) for k in range(BANDS)])
    return rows.select("license", "wanted", (F.size("wanted") + extra).alias("size"), (extra + 1).alias("step"), bands.alias("bands"))


def scan(docs: DataFrame, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, license, containment, first_word): per cent of the license's shingles in the best window, and where that begins."""
    spark = docs.sparkSession
    table = templates(spark, texts)
    bands = table.select("license", "wanted", "size", "step", F.explode("bands").alias("b")).select("license", "wanted", "size", "step", "b.*")
    ends = bands.agg(F.collect_set("x").alias("known"), F.max("size").alias("reach")).first()  # at most len(texts) * BANDS numbers
    known, reach = ends["known"], ends["reach"]
    hit = lambda x: x.isin(*known)
    found = docs.select("doc_id", shingles(F.col("text")).alias("all")).where(F.exists("all", hit))
    # around a hit goes what its windows can hold, and not the text
    at = F.filter(F.transform("all", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: hit(p["x"]))
    begin = lambda i: F.greatest(F.lit(0), i - reach + 1)
    near = F.transform(at, lambda p: F.struct(p["x"].alias("x"), p["i"].alias("i"), begin(p["i"]).alias("begin"), F.slice(F.col("all"), begin(p["i"]) + 1, F.lit(2 * reach)).alias("part")))
    hits = found.select("doc_id", F.explode(near).alias("p")).select("doc_id", "p.*").join(F.broadcast(bands), "x")
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - F.col("size") + 1) / F.col("step")).cast("int") * F.col("step"))
    last = F.floor(F.col("i") / F.col("step")).cast("int") * F.col("step")
    windows = hits.where(first <= last).select("doc_id", "license", "wanted", "band", "h", "size", "begin", "part", F.explode(F.sequence(first, last, F.col("step"))).alias("start"))
    held = windows.select("doc_id", "license", "wanted", "band", "h", "start", F.slice("part", F.col("start") - F.col("begin") + 1, F.col("size")).alias("window"))
    candidates = held.where(_least(F.col("window"), F.col("band")) == F.col("h"))
    share = F.floor(F.size(F.array_intersect("window", "wanted")) * 100 / F.size(F.array_distinct("wanted"))).cast("bigint")
    exact = candidates.select("doc_id", "license", "start", share.alias("containment")).where(F.col("containment") >= LEAST)
    best = F.max_by(F.struct("containment", "start"), F.struct("containment", -F.col("start")))
    return exact.groupBy("doc_id", "license").agg(best.alias("best")).select("doc_id", "license", F.col("best.containment").alias("containment"), F.col("best.start").cast("bigint").alias("first_word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(base.read(spark, sf_dir, "documents"))


def _sql() -> str:
    """DuckDB: every window of every text against every template, without bands."""
    values = ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())
    split = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    grams = "list_transform(range(1, greatest(len({0}) - 3, 1)), lambda i: array_to_string(list_slice({0}, i, i + 4), ' '))"
    return f"""
WITH t AS (SELECT license, {grams.format('w')} AS wanted, len(w) AS m FROM (SELECT license, {split.format('body')} AS w FROM (VALUES {values}) v(license, body))),
d AS (SELECT doc_id, {grams.format('w')} AS grams FROM (SELECT doc_id, {split.format('text')} AS w FROM documents)),
c AS (SELECT doc_id, grams, license, wanted, m // 8 AS extra FROM d, t WHERE list_has_any(grams, wanted)),
w AS (SELECT doc_id, license, start, (len(list_intersect(list_slice(grams, start + 1, start + len(wanted) + extra), wanted)) * 100) // len(list_distinct(wanted)) AS containment
  FROM (SELECT *, unnest(range(0, len(grams), extra + 1)) AS start FROM c))
SELECT doc_id, license, containment::bigint AS containment, start::bigint AS first_word FROM w
WHERE containment >= {LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, start) = 1
"""


ORACLE = _sql()
