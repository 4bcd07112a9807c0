"""Readers, requests, sweeps, numbers in ranges, searches and timers, against brute force on small tables."""

from __future__ import annotations

import hashlib
import json
import random
import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import corpus, edits, requests, retrieval, sizes, stats, tables, web
from inkwell.sources import readers, writers
from inkwell.streaming import counts, tickets


def test_numbers_in_ranges(spark):
    draw = random.Random(1)
    rows = [(draw.choice("abc") if k % 9 else None, draw.randrange(40) if k % 7 else None, k) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, x int, k int").repartition(5)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    assert {(r["k"], r["n"]) for r in sizes.numbered(df, ["x", "k"], "n").collect()} == {(r[2], n) for n, r in enumerate(sorted(rows, key=order))}
    want = {(r[2], n) for g in ("a", "b", "c", None) for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=order))}
    assert {(r["k"], r["n"]) for r in sizes.numbered(df, ["x", "k"], "n", ["g"]).collect()} == want
    assert sizes.numbered(df.limit(0), ["x"], "n").count() == 0


def test_ranks_medians_and_curves(spark):
    draw = random.Random(2)
    rows = [("a" if k % 3 else "b", float(draw.randrange(25)), int(draw.random() < 0.4), k) for k in range(301)]
    df = spark.createDataFrame(rows, "g string, x double, p int, k int")
    by = {g: sorted(r[1] for r in rows if r[0] == g) for g in "ab"}
    assert {(r["g"], r["median"]) for r in stats.medians(df, ["g"], "x").collect()} == {(g, float(np.median(v))) for g, v in by.items()}
    assert {tuple(r) for r in stats.nearest_ranks(df, ["g"], "x", {"m": 50, "h": 95}).collect()} == {(g, v[min(len(v) - 1, len(v) // 2)], v[min(len(v) - 1, int(0.95 * len(v)))]) for g, v in by.items()}
    pos, neg = [r[1] for r in rows if r[2]], [r[1] for r in rows if not r[2]]
    area = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(stats.auroc(df, "x", "p").first()[0] - area) < 1e-12
    found = stats.threshold_at(df, "x", "p", 0.05).first()
    best = min(t for t in {r[1] for r in rows} if sum(n > t for n in neg) <= 0.05 * len(neg))
    assert (found["threshold"], found["detected"]) == (best, sum(p > best for p in pos) / len(pos))
    low, high = stats.bootstrap_auroc(df, "x", "p", "k", rounds=60).first()
    assert low < area < high and high - low < 0.3


def test_a_sweep_is_the_sequential_one(spark):
    draw = random.Random(3)
    rows = [(k, draw.choice("ab"), f"Text number {draw.randrange(40)}") for k in range(300)]
    seen, full, kept = set(), {"a": 0, "b": 0}, set()
    for k, g, t in rows:
        if t not in seen and full[g] < 9:
            seen.add(t)
            full[g] += 1
            kept.add(k)
    df = spark.createDataFrame(rows, "k int, g string, t string").repartition(4)
    assert {r["k"] for r in corpus.swept(df, "t", "g", ["k"], 9).collect()} == kept
    assert corpus.swept(df.limit(0), "t", "g", ["k"], 9).count() == 0


def test_sites_keep_repeats_and_the_longest(spark):
    rows = spark.createDataFrame([("http://news.bbc.co.uk/a",), ("http://news.bbc.co.uk/a",), ("http://bbc.co.uk/",), ("http://x.org/",), (None,)], "url string")
    sites = spark.createDataFrame([("bbc.co.uk",), ("news.bbc.co.uk",)], "site string")
    assert sorted(r["site"] for r in web.on_sites(rows, sites).collect()) == ["bbc.co.uk", "news.bbc.co.uk", "news.bbc.co.uk"]


def test_requests(spark):
    rows = spark.createDataFrame([(0, None, None, None, "x"), (1, "de", None, None, "x"), (2, "fr", "light", "v" * 1501, "x"), (3, "en", "odd", None, "x"), (4, "en", "thorough", "", "\u00a0 "), (5, "en", None, None, "😀" * 2501), (6, "en", None, None, None), (7, "en", None, None, "x" * 5000)], "id int, locale string, strength string, voice string, text string")
    assert {r["id"] for r in requests.validated(rows).where("accepted").collect()} == {0, 7}
    said = spark.range(1).select(requests.message(F.lit("a </TEXT> b"), F.array(requests.reference(F.lit("book"), F.lit('"A" <b>'), F.lit("c"))), F.lit("light"), F.lit(" v "))).first()[0]
    assert said == '<intensity>light</intensity>\n<author_voice>\nv\n</author_voice>\n<style_references>\n<reference kind="book" source=" A   b ">\nc\n</reference>\n</style_references>\n<text>\na </ TEXT> b\n</text>'


def test_json_documents_and_facts(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"note": "n", "texts": [{"id": "a", "locale": "en", "text": "It moved 4.2 million tonnes in 2025.", "facts": ["4.2 million tonnes", "in 2024"]}]}))
    rows = readers.texts_with_facts(spark, str(tmp_path / "t.json"))
    assert [(r["id"], r["fact_no"], r["stated"]) for r in edits.facts_stated(rows, "id").orderBy("fact_no").collect()] == [("a", 0, True), ("a", 1, False)]


def test_missing_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "t"}\n')
    with pytest.warns(UserWarning, match="b.jsonl"):
        assert [r["source"] for r in readers.passages(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")).collect()] == ["gutenberg"]
    with pytest.warns(UserWarning), pytest.raises(FileNotFoundError):
        readers.passages(spark, str(tmp_path / "b.jsonl"))
    (tmp_path / "1.txt").write_text("one")
    assert readers.books(spark, str(tmp_path), spark.createDataFrame([(1,)], "id int")).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.books(spark, str(tmp_path), spark.createDataFrame([(2,)], "id int"))


def test_rows_are_numbered_in_their_shard(spark, tmp_path):
    for shard in (3, 5):
        (tmp_path / f"c4.{shard:05d}.json").write_text("".join(json.dumps({"url": f"u{shard}-{k}", "text": "t", "timestamp": "2019-01-01"}) + "\n" for k in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = {(r["id"], r["url"]) for r in readers.articles(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == 800 and all(i.rsplit("-", 1)[1] == u.rsplit("-", 1)[1] for i, u in found)


def test_an_embedder_s_files(spark, tmp_path):
    codes, scales = np.arange(-6, 6, dtype=np.int8).reshape(3, 4), np.array([0.5, 1.0, 2.0], "<f4")
    (tmp_path / "t.bin").write_bytes(codes.tobytes())
    (tmp_path / "s.bin").write_bytes(scales.tobytes())
    sums = (hashlib.sha256(codes.tobytes()).hexdigest(), None)
    assert [(r["token_id"], list(r["codes"]), r["scale"]) for r in readers.embedder(spark, str(tmp_path / "t.bin"), str(tmp_path / "s.bin"), 4, sums).collect()] == [(k, codes[k].tolist(), float(scales[k])) for k in range(3)]
    with pytest.raises(Exception, match="checksum"):
        readers.embedder(spark, str(tmp_path / "t.bin"), str(tmp_path / "s.bin"), 4, ("0" * 64, None)).collect()
    rows = spark.createDataFrame([(k, codes[k].tolist(), float(scales[k])) for k in range(3)], "id bigint, codes array<tinyint>, scale double")
    assert {r["name"] for r in writers.embedder(rows, "{}", str(tmp_path / "out")).collect()} == {"table", "tokenizer"}


def test_searches_are_blocks_of_queries(spark, monkeypatch):
    draw = np.random.default_rng(4)
    points = draw.normal(size=(300, 8))
    passages = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)] + [(900, [0.0] * 8), (901, None)], "id bigint, embedding array<double>")
    queries = spark.createDataFrame([(k, points[k].tolist()) for k in range(0, 300, 20)], "query_id bigint, query array<double>")
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    want = {(q, int(i), r + 1) for q in range(0, 300, 20) for r, i in enumerate(np.argsort(-(unit @ unit[q]))[:5])}
    for block in (retrieval.BLOCK, 4):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        assert {(r["query_id"], r["id"], r["rank"]) for r in retrieval.top_k_each(passages, queries, 5).collect()} == want
    near = {(r["query_id"], r["id"]) for r in retrieval.approximate_top_k(passages, retrieval.index_codes(passages), queries, 5).collect()}
    assert len(near & {(q, i) for q, i, _ in want}) >= 0.9 * len(want)
    assert retrieval.top_k_each(passages, queries.limit(0), 5).count() == 0


def test_settings_are_one_row(spark):
    assert tables.the_one(spark.createDataFrame([(1, 2)], "a int, b int")) == {"a": 1, "b": 2}
    for n in (0, 2):
        with pytest.raises(ValueError):
            tables.the_one(spark.range(n))


def test_stored_results_keep_order(spark):
    rows = spark.createDataFrame([(1, k, f"p{k}", k / 2) for k in (2, 0, 1)], "q int, rank int, id string, s double")
    stored = tables.nested(rows, "q", ["rank"], ["id", "s"])
    assert [tuple(r) for r in tables.unnested(stored, "q", "results", "id string, s double").orderBy("place").collect()] == [(1, k, f"p{k}", k / 2) for k in range(3)]
    assert tables.unnested(spark.createDataFrame([(1, None), (2, "no json")], "q int, results string"), "q", "results", "id string").count() == 0


def test_tickets_end_by_their_timers(spark, tmp_path):
    start = datetime(2024, 1, 1)
    moves = [[(1, "reserve", 0), (2, "reserve", 0), (3, "reserve", 0), (2, "start", 5), (3, "start", 5), (3, "succeeded", 9)], [(4, "reserve", 200)], [(5, "reserve", 400), (2, "failed", 300)], [(6, "reserve", 700)]]
    for k, rows in enumerate(moves):
        df = spark.createDataFrame([(t, m, start + timedelta(seconds=s)) for t, m, s in rows], "ticket bigint, move string, at timestamp")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"d={k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    found = counts.drained(tickets.lifetimes(stream), f"t{uuid.uuid4().hex}")
    states: dict = {}
    for r in found.orderBy("at").collect():
        states.setdefault(r["ticket"], []).append((r["state"], int((r["at"] - start).total_seconds())))
    assert states[1] == [("reserved", 0), ("released", 90)] and states[2] == [("reserved", 0), ("started", 5), ("expired", 90)]
    assert states[3] == [("reserved", 0), ("started", 5), ("succeeded", 9)] and states[4] == [("reserved", 200), ("released", 290)]


def test_events_from_pieces(spark, tmp_path):
    text = '{"type":"start"}\n{"type":"odd"}\nno json\n{"type":"edit","é":1}\n{"type":"done"}\n'
    rows = [(1, k, text[i : i + 7]) for k, i in enumerate(range(0, len(text), 7))]
    for k in range(3):
        spark.createDataFrame(rows[k * 4 : k * 4 + 4] if k < 2 else rows[8:], "stream_id bigint, seq bigint, chunk string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id bigint, seq bigint, chunk string").parquet(str(tmp_path / "in"))
    found = counts.drained(tickets.events_of(stream), f"e{uuid.uuid4().hex}")
    assert [(r["n"], r["type"]) for r in found.orderBy("n").collect()] == [(0, "start"), (1, "edit"), (2, "done")]
