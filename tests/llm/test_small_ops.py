"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, brute force."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from datetime import date

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import rows_of
from inkwell.llm import base, features, op1_url_filters, op2_media, op3_bpe, op4_jaccard, op5_quality_rules, op6_sharding, op7_licenses, op10_mixing, queries

#: Texts that every operator has to take: null, empty, blank, short, long without a space, repeated, odd white space, marks.
ODD = [None, "", " \n\t", "one", "The same text of a few words.", "The same text of a few words.", "x" * 70_000, "a b\x0bc\x0cd\re", "é" * 10 + " ß 中文 😀", "<|endoftext|> 's 12 <|endoftext|>", "line\nline\nline\n\nother", "w " * 300]
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, cls bigint, tokens string, slot int, position int, _row int"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 3}" if k % 4 else None, 0 if t is None else len(t), 1, 2, "x", 3, 4, 5) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, [*ODD, ODD[4]], [*range(len(ODD)), 4])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(name, spark, sf, oracle):
    df = queries.QUERIES[name](spark, sf)
    columns, rows = oracle(queries.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of(list(columns), rows)


def test_empty_tables(spark):
    empty = table(spark, [])
    for found in (op2_media.media_columns(op2_media.to_media(empty)), op3_bpe.encode_decode(empty, op3_bpe.default_path()), op4_jaccard.join(empty), op5_quality_rules.stage(spark, empty, ""), op6_sharding.assign(empty, [1, 1], [1, 1, 1]), op7_licenses.scan(empty), op10_mixing.mix(empty), op10_mixing.stage(spark, empty, ""), op4_jaccard.stage(spark, empty, "")):
        assert found.count() == 0


# 1 URL filters
def _entries(spark, rows):
    return spark.createDataFrame([(p, a, date(2024, 1, d)) for p, a, d in rows], "pattern string, action string, day date")


def test_as_of(spark):
    captures = [(1, "http://a.b.com/x/y?q", 5), (2, "http://a.b.com/x/y", 10), (3, "http://a.b.com/x/y", 20), (4, "https://u@B.com:80/", 6), (5, None, 5), (6, "no url", 5), (7, "http://evilb.com/", 6), (2, "http://a.b.com/x/y", 10)]
    rows = spark.createDataFrame([(k, u, date(2024, 1, d), 0) for k, u, d in captures] + [(8, "http://b.com/", None, 0)], "page_id bigint, url string, fetched date, verdict int")
    listed = _entries(spark, [("b.com", "deny", 3), ("A.b.com", "allow", 5), ("a.b.com", "remove", 8), ("a.b.com/x/", "allow", 20), ("b.com", "deny", 3)])
    found = sorted((r["page_id"], r["verdict"], r["pattern"]) for r in op1_url_filters.evaluate(rows, listed).collect())
    assert found == [(1, "allow", "a.b.com"), (2, "deny", "b.com"), (2, "deny", "b.com"), (3, "allow", "a.b.com/x/"), (4, "deny", "b.com"), (5, "unlisted", None), (6, "unlisted", None), (7, "unlisted", None), (8, "unlisted", None)]
    assert {r["verdict"] for r in op1_url_filters.evaluate(rows, listed.limit(0)).collect()} == {"unlisted"}


def test_spellings_of_a_host(spark):
    """A browser would ask evil.com for each of these, so the list holds for each."""
    urls = ["http://evil.com./x", "//evil.com/x", " http://evil.com/x", "http://evil.com\\@good.org/x", "http:\\\\evil.com", "HTTP://EVIL%2ecom/", "https:evil.com", "http:////evil.com/", "http://good.org@evil.com:81/", "ht\ntp://ev\til.com", "http://\uff45vil.com/"]
    kept = ["http://evil.com.good.org/", "http://good.org/evil.com", "http://good.org/?u=http://evil.com", "http://notevil.com/", "evil.com/x", "http://", "", None, "http://good.org/" + "x/" * 5000]
    rows = spark.createDataFrame([(k, u, date(2024, 1, 5)) for k, u in enumerate([*urls, *kept])], "page_id bigint, url string, fetched date")
    listed = _entries(spark, [(" Evil.com. ", "deny", 3), ("m\u00fcnchen.de", "deny", 3), (None, "deny", 3), ("", "deny", 3)])
    found = {r["page_id"]: r["verdict"] for r in op1_url_filters.evaluate(rows, listed).collect()}
    assert found == {k: "deny" if k < len(urls) else "unlisted" for k in range(len(urls) + len(kept))}
    assert op1_url_filters.evaluate(rows.limit(0), listed).count() == 0
    names = spark.createDataFrame([(1, "http://xn--mnchen-3ya.de/", date(2024, 1, 5)), (2, "http://M\u00dcNCHEN.de/", date(2024, 1, 5))], "page_id bigint, url string, fetched date")
    assert {r["verdict"] for r in op1_url_filters.evaluate(names, listed).collect()} == {"deny"}


# 2 media
@given(st.binary(max_size=9000))
@settings(max_examples=40, deadline=None)
def test_container_round_trip(payload):
    payload = payload.ljust(max(64, -(-len(payload) // 64) * 64), b"\0")
    stored = op2_media.write_container(payload)
    media = op2_media.describe(stored)
    assert op2_media.payload_of(stored, media) == payload and media.samples == media.duration == len(payload)


def test_key_frames_and_own_sizes():
    """A video track with sizes of its own, two chunks and three key frames."""
    box, full, u32 = op2_media._box, op2_media._full, lambda *n: struct.pack(f">{len(n)}I", *n)
    sizes = [10, 20, 30, 40, 50]
    data = box(b"mdat", bytes(range(150)))
    entry = box(b"avc1", bytes(78))
    tables = box(b"stbl", full(b"stsd", u32(1), entry), full(b"stts", u32(1, 5, 3)), full(b"stss", u32(3, 1, 2, 4)), full(b"stsc", u32(2, 1, 3, 1, 2, 2, 1)), full(b"stsz", u32(0, 5, *sizes)), full(b"co64", struct.pack(">IQQ", 2, 8, 68)))
    movie = box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", u32(0, 0, 90, 15), bytes(4)), box(b"minf", tables))))
    media = op2_media.describe(data + movie)
    assert (media.codec, media.timescale, media.duration, media.keyframes) == ("avc1", 90, 15, 3)
    assert media.ranges == [(8, 38), (68, 108)]


def _track(kind, entry, sizes, offsets, stss=None, wide=False, runs=None):
    box, full, u32 = op2_media._box, op2_media._full, lambda *n: struct.pack(f">{len(n)}I", *n)
    keys = [full(b"stss", u32(len(stss), *stss))] if stss else []
    places = full(b"co64", struct.pack(f">I{len(offsets)}Q", len(offsets), *offsets)) if wide else full(b"stco", u32(len(offsets), *offsets))
    runs = runs or [(1, len(sizes) // len(offsets), 1)]
    tables = box(b"stbl", full(b"stsd", u32(1), box(entry, bytes(78))), full(b"stts", u32(1, len(sizes), 1)), *keys, full(b"stsc", u32(len(runs)), *(u32(*r) for r in runs)), full(b"stsz", u32(0, len(sizes), *sizes)), places)
    return box(b"trak", box(b"mdia", full(b"mdhd", u32(0, 0, 90, 0), bytes(4)), full(b"hdlr", bytes(4), kind), box(b"minf", tables)))


def test_audio_and_video_each_by_their_own_tables(spark):
    data = op2_media._box(b"mdat", bytes(range(150)))
    audio, video = _track(b"soun", b"mp4a", [10] * 5, [8]), _track(b"vide", b"avc1", [20, 30, 50], [58], stss=[1, 3], wide=True)
    both = op2_media.tracks(data + op2_media._box(b"moov", audio, video))
    assert [(m.codec, m.samples, m.keyframes, m.ranges) for m in both] == [("mp4a", 5, 5, [(8, 58)]), ("avc1", 3, 2, [(58, 78), (108, 158)])]


def test_hostile_tables_are_errors(spark):
    data, moov = op2_media._box(b"mdat", bytes(200)), lambda *t: op2_media._box(b"moov", *t)
    files = [
        data + moov(_track(b"vide", b"avc1", [10], [8], runs=[(1, 1, 1), (0xFFFFFFFF, 1, 1)])),
        data + moov(_track(b"vide", b"avc1", [10, 10], [8, 18], runs=[(2, 1, 1), (1, 1, 1)])),
        data + moov(_track(b"vide", b"avc1", [10, 10], [8], stss=[2, 1])),
        data + moov(_track(b"vide", b"avc1", [0xFFFFFFFF], [8])),
        data + moov(op2_media._box(b"trak", bytes(3))),
        b"\0\0\0\x08moof" + data,
    ]
    rows = spark.createDataFrame([(k, 0, bytearray(f)) for k, f in enumerate(files)], "id bigint, n_bytes bigint, media binary")
    assert all(r["error"] and r["feature"] is None for r in op2_media.media_columns(rows).collect())


def test_key_frames_of_many_samples_take_linear_time():
    import time

    began = time.perf_counter()
    media = op2_media.describe(op2_media._box(b"mdat", bytes(200_000)) + op2_media._box(b"moov", _track(b"vide", b"avc1", [1] * 200_000, [8], stss=list(range(1, 200_001, 2)))))
    assert media.keyframes == 100_000 and time.perf_counter() - began < 5


def test_media_columns(spark, odd):
    found = {r["id"]: r for r in op2_media.media_columns(op2_media.to_media(odd)).collect()}
    for k, t in enumerate(ODD):
        payload = (t or "").encode()
        padded = payload.ljust(max(64, -(-len(payload) // 64) * 64), b"\0")
        r = found[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert found[4]["media_sha256"] == found[5]["media_sha256"] and found[4]["feature"] == found[5]["feature"]
    broken = spark.createDataFrame([(1, 0, bytearray(b"abc")), (2, 0, bytearray(op2_media.write_container(bytes(64))[:-9])), (3, 0, None)], "id bigint, n_bytes bigint, media binary")
    assert all(r["error"] and r["feature"] is None for r in op2_media.media_columns(broken).collect())


# 3 encoding
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op3_bpe.default_path())


def _expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoding_is_the_library_s(spark, odd, library):
    for long in (op3_bpe.LONG, 20):
        for r in op3_bpe.encode_decode(odd, op3_bpe.default_path(), long=long).collect():
            assert tuple(r)[1:] == _expected(library, ODD[r["doc_id"]])


def test_long_texts(spark, library):
    draw = random.Random(2)
    texts = ["".join(draw.choice("thaeinorsd") for _ in range(60_000)), "the and of " * 9000, "=" * 50_001 + " " * 40_000 + "é" * 30_000, "".join(draw.choice(["word ", "<|endoftext|>", "中", "\n\n", "1234"]) for _ in range(20_000))]
    rows = op3_bpe.encode_decode(table(spark, texts), op3_bpe.default_path()).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == {k: _expected(library, t) for k, t in enumerate(texts)}


@given(st.text(alphabet="ab \n'slt<|endoftext|>é中1!", max_size=200), st.sampled_from([1, 3, 8, 33]))
@settings(max_examples=150, deadline=None)
def test_tree_is_exact(text, leaf):
    library = test_tree_is_exact.__dict__.setdefault("library", __import__("tokenizers").Tokenizer.from_file(op3_bpe.default_path()))
    assert op3_bpe.codec(op3_bpe.default_path()).text(text, leaf) == library.encode(text, add_special_tokens=False).ids


def test_documents_go_up_the_tree(spark, library):
    """The method is what the registered query runs: texts above a leaf are joined, mostly inside pre-tokens, and whole tables agree with the library."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    model = op3_bpe.Codec(op3_bpe.default_path())
    assert [model.text(t or "") for t in texts] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert model.joins > 5000 and model.inner_joins > 1000


def test_bpe_query_is_the_library_s(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: tuple(r)[1:] for r in op3_bpe.query(spark, sf).collect()} == {k: _expected(library, t) for k, t in texts.items()}


def test_a_cut_special_token_and_long_runs_in_parts(spark, library, monkeypatch):
    monkeypatch.setattr(op3_bpe, "PART", 7)
    texts = ["ab<|endoftext|>" * 20, " " * 90, "'ll" * 30, "\n\n x" * 20, "中文 é" * 20, "a" * 200, None, ""]
    rows = op3_bpe.encode_decode(table(spark, texts, [0, 1, 2, 3, 4, 5, None, 7]), op3_bpe.default_path(), long=10).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == {(None if k == 6 else k): _expected(library, t) for k, t in enumerate(texts)}


# 4 near duplicates
def _sets(texts):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    return [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]


def _components(texts):
    sets = _sets(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sets, [find(k) for k in range(len(texts))]


def test_odd_texts(spark, odd):
    sets, roots = _components(ODD)
    for r in op4_jaccard.join(odd).collect():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), roots[r["doc_id"]])


def test_links_near_the_threshold(spark):
    """Texts that share from two thirds to all of their shingles, chains of near copies, a passage that all share, and many copies."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(40)]
    texts = []
    for _ in range(12):
        now = [word() for _ in range(draw.randrange(6, 120))]
        for _ in range(6):
            texts.append(" ".join(now))
            now = list(now)
            for _ in range(draw.randrange(1, 4)):
                now[draw.randrange(len(now))] = word()
    texts += [" ".join([*shared, *(word() for _ in range(draw.randrange(0, 14)))]) for _ in range(30)]
    texts += [texts[0]] * 10 + [texts[3].upper()] * 3 + ["a b c", "A b  c", "a b d"]
    sets, roots = _components(texts)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op4_jaccard.join(table(spark, texts).repartition(5)).collect()}
    assert found == {k: (len(sets[k]), roots[k]) for k in range(len(texts))}


def test_links_that_no_min_hash_finds(spark, monkeypatch):
    """With one min-hash only, the matrix has to find what the groups missed."""
    monkeypatch.setattr(op4_jaccard, "KEYS", 1)
    test_links_near_the_threshold(spark)


def test_words_that_collide_under_polynomial_hashes(spark):
    """Thue-Morse words of 1,024 letters have equal polynomial hashes modulo 2^64 for any base."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    assert [r["component_id"] for r in sorted(op4_jaccard.join(table(spark, [one, other, one])).collect())] == [0, 1, 0]


def test_a_hot_group_of_near_copies_is_not_paired(spark, monkeypatch):
    """600 near copies of one text: comparisons grow with the copies, not with their pairs."""
    draw = random.Random(9)
    text = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    copies = []
    for _ in range(600):
        now = list(text)
        for _ in range(draw.randrange(1, 6)):
            now[draw.randrange(120)] = f"v{draw.randrange(10**6)}"
        copies.append(" ".join(now))
    compared, plain = [], op4_jaccard._compared
    monkeypatch.setattr(op4_jaccard, "_compared", lambda pairs, sets: (compared.append(pairs.count()), plain(pairs, sets))[1])
    texts = [" ".join(text), *copies]
    sets, roots = _components(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op4_jaccard.join(table(spark, texts)).collect()} == {k: (len(sets[k]), roots[k]) for k in range(len(texts))}
    assert sum(compared) < 10 * len(texts)


def test_tables_are_deleted(spark):
    """What a join leaves in the shared folder is what its result reads."""
    from pathlib import Path

    folder = Path(base.shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("inkwell-*"))
    assert op4_jaccard.join(table(spark, ["a b c d e f g h", "a b c d e f g h i", "x y", None])).count() == 4
    assert len(set(folder.glob("inkwell-*")) - before) <= 2


def test_rows_without_ids_and_with_equal_ids(spark):
    """Links go through rows without ids; ids that stand for several texts decide nothing."""
    words = [f"w{k}" for k in range(60)]
    chain = [" ".join(words[:50]), " ".join(words[3:53]), " ".join(words[6:56])]
    rows = table(spark, [*chain, "other text of five words", "other text of five words", "lone words of another text", ""], [1, None, 2, None, None, 5, None])
    found = sorted((r["component_id"] is None, r["component_id"] or 0, r["n_shingles"]) for r in op4_jaccard.join(rows).collect())
    assert found == [(False, 1, 46), (False, 1, 46), (False, 1, 46), (False, 5, 1), (True, 0, 0), (True, 0, 1), (True, 0, 1)]
    kept = [(r["doc_id"], r["text"]) for r in op4_jaccard.stage(spark, rows, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, chain[0]), (None, "other text of five words"), (5, "lone words of another text"), (None, "")], key=str)
    twice = table(spark, ["a b c d e f g", "a b c d e f g", "clean words that no one else has", "a b c d e f g"], [7, 7, 8, 8])
    kept = sorted((r["doc_id"], r["text"]) for r in op4_jaccard.stage(spark, twice, "").collect())
    assert kept == [(7, "a b c d e f g"), (8, "clean words that no one else has")]


def test_one_of_each_group_stays(spark):
    docs = table(spark, ["a b c d e f", "a b c d e f", "other words in this one", None, None], [3, 2, 5, 6, None])
    kept = op4_jaccard.stage(spark, docs, "")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 2), (False, 5), (False, 6), (True, 0)] and kept.columns == docs.columns


# 5 quality rules
def _measures(text):
    ws, words = r"[\x20\x09-\x0D]", re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(rf"[^{ws[1:]}", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(grams)
    covered = {p for i, g in enumerate(grams) if times[g] > 1 for p in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), len("".join(words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_measures(spark, odd):
    texts = [*ODD, "a b c d e f g h i " * 5 + " ".join(map(str, range(200))), " ".join(map(str, range(30))) + "\n" + " ".join(map(str, range(12)))]
    rows = table(spark, texts)
    found = rows.select("doc_id", op5_quality_rules.verdict(rows["text"]).alias("v")).select("doc_id", "v.*").collect()
    for r in found:
        assert tuple(r)[1:7] == _measures(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    assert op5_quality_rules.stage(spark, odd, "").columns == odd.columns


# 6 shards
def test_shards(spark, odd):
    rows = op6_sharding.assign(odd.unionByName(table(spark, ["n", "n"], [None, None])), [1.0] * 8, [1.0] * 9).collect()
    assert len(rows) == len(ODD) + 3
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        if r["doc_id"] is not None:
            t = ODD[r["doc_id"]] or ""
            assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_many_equal_rows_and_weights(spark):
    many = spark.range(25_000).selectExpr("if(id < 24000, 7, id) doc_id", "'t' text")
    slots = defaultdict(list)
    for r in op6_sharding.assign(many, [1.0, 3.0, 0.0], [1.0, 3.0, 0.0, 1.0]).collect():
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == {0, 1} and all(sorted(s) == list(range(len(s))) for s in slots.values())
    single = [r["shard"] for r in op6_sharding.assign(spark.range(4000).selectExpr("id doc_id", "'t' text"), [1.0, 3.0], [1.0, 3.0]).collect()]
    assert 0.2 < single.count(0) / 4000 < 0.3


# 7 licenses
def test_licenses(spark, odd):
    assert op7_licenses.scan(odd).count() == 0
    grant = op7_licenses.TEMPLATES["mit-grant"]
    altered = grant.replace("obtaining", "getting").upper()
    texts = [f"Some words first. {grant} And more.", "x " * 500 + altered, "Released under the\nMIT license", "Released under the BSD license", None, "Licensed under CC BY-NC 4.0. Released under the MIT License."]
    found = {(r["doc_id"], r["license"]): r["containment"] for r in op7_licenses.scan(table(spark, texts, [0, 1, 2, 3, None, 5])).collect()}
    assert found[0, "mit-grant"] == 100 and 80 <= found[1, "mit-grant"] < 100 and found[2, "mit"] == 100
    assert {k[1] for k in found if k[0] == 5} == {"mit", "cc-by-nc-4.0"} and not any(k[0] == 3 for k in found)


def test_a_text_that_repeats_a_license(spark):
    line = op7_licenses.TEMPLATES["mit"]
    texts = [" ".join([f"w{k} {line}" for k in range(3000)]), f"{line} {line}"]
    found = {(r["doc_id"], r["license"]): (r["containment"], r["first_word"]) for r in op7_licenses.scan(table(spark, texts)).collect()}
    assert set(found) == {(0, "mit"), (1, "mit")} and found[1, "mit"] == (100, 0) and found[0, "mit"][0] == 100


# 10 mixing
@given(st.lists(st.integers(1, 60), min_size=1, max_size=6), st.data())
@settings(max_examples=80, deadline=None)
def test_less_than_a_block_off(blocks, data):
    names = [f"s{k}" for k in range(len(blocks))]
    weights = {n: data.draw(st.integers(1, 50)) for n in names}
    order = list(op10_mixing.schedule(dict(zip(names, blocks, strict=True)), weights))
    assert Counter(s for s, _, _ in order) == Counter(dict(zip(names, blocks, strict=True)))
    for phase in {p for _, _, p in order}:
        part = [s for s, _, p in order if p == phase]
        done = Counter(s for s, _, p in order if p < phase)
        active = [n for n, b in zip(names, blocks, strict=True) if done[n] < b]
        total, got = sum(weights[n] for n in active), Counter()
        for t, s in enumerate(part, 1):
            got[s] += 1
            assert all(abs(got[n] - t * weights[n] / total) < 1 for n in active)


def _mixed(rows, block, weights=None):
    """Brute force: blocks of the sources in the order of their ids' hashes, one after the other by the schedule."""
    by = defaultdict(list)
    for k, source in rows:
        by["null" if source is None else f"={source}"].append(k)
    for own in by.values():
        own.sort(key=lambda k: hashlib.md5(str("null" if k is None else k).encode()).hexdigest())
    blocks = {s: -(-len(own) // block) for s, own in by.items()}
    target = {s: len(own) ** op10_mixing.TEMPER if weights is None else weights.get(s, 0) for s, own in by.items()}
    found, position = [], 0
    for slot, (s, k, phase) in enumerate(op10_mixing.schedule(blocks, op10_mixing.whole(target, max(4 * len(by), min(10_000, 200_000 // max(1, len(by))))))):
        for doc in by[s][k * block : (k + 1) * block]:
            found.append((doc, None if s == "null" else s[1:], k, slot, position, phase))
            position += 1
    return sorted(found, key=str)


def test_mix_is_brute_force(spark, odd, sf):
    rows = [(r["doc_id"], r["source"]) for r in odd.collect()]
    for block, given in ((5, None), (2, {"s1": 3.0, None: 1.0})):
        want = _mixed(rows, block, given and {"=s1": 3.0, "null": 1.0})
        assert sorted((tuple(r) for r in op10_mixing.mix(odd, given, block).collect()), key=str) == want
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = _mixed([(r["doc_id"], r["source"]) for r in docs.select("doc_id", "source").collect()], op10_mixing.ROWS)
    assert sorted((tuple(r) for r in op10_mixing.query(spark, sf).collect()), key=str) == want


def test_mix_of_a_hot_id_and_many_sources(spark, monkeypatch):
    hot = spark.range(30_000).selectExpr("if(id < 20000, null, if(id < 25000, 7, id)) doc_id", "'t' text", "if(id % 3 = 0, 'a', concat('s', id % 700)) source")
    rows = op10_mixing.mix(hot, sources=50).collect()
    assert sorted(r["position"] for r in rows) == list(range(30_000)) and len({r["source"] for r in rows}) == 701
    first = [r["source"] for r in sorted(rows, key=lambda r: r["position"])[:3000]]
    assert 0 < first.count("a") < 3000 and len(set(first)) > 100


def test_mixed_rows_are_whole_and_in_order(spark, odd, sf):
    kept = op10_mixing.stage(spark, odd, "")
    assert kept.columns == odd.columns and sorted(kept.collect(), key=str) == sorted(odd.collect(), key=str)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    position = {r["doc_id"]: r["position"] for r in op10_mixing.mix(docs).collect()}
    got = [r["doc_id"] for r in op10_mixing.stage(spark, docs, sf).collect()]
    assert got == sorted(position, key=position.get)


# shared parts
def test_indicators_do_not_depend_on_blocks(monkeypatch):
    text = "The quick brown fox, the lazy dog: 12 ### idiot\n" * 50
    whole = features.indicators(text, ("words", "shapes"))
    monkeypatch.setattr(features, "BLOCK", 4800)
    assert set(features.indicators(text, ("words",))) == set(features.indicators(text * 30, ("words",))) and set(features.indicators(text, ("words",))) <= set(whole)
    assert len(features.indicators(None, ("words", "characters"))) == len(features.indicators("", ("shapes",))) == 0


def test_stored_tables_can_be_released(spark):
    df = base.stored(spark.range(3).toDF("x"), "t")
    assert df.count() == 3
    base.released(spark, df)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_freed_memory_goes_back_to_the_system(spark):
    pages = lambda: int(open("/proc/self/statm").read().split()[1])  # noqa: E731, SIM115
    blocks = [np.ones(1000) for _ in range(25_000)]
    kept = blocks[::500]
    del blocks
    before = pages()
    base.released(spark)
    assert (before - pages()) * 4096 > 100e6 and len(kept) == 50
    assert "rim native heap" in base._trim(spark)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    for master, kept in (("spark://a:7077", None), ("local-cluster[2,1,1024]", None), ("yarn", "hdfs://a/b/")):
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default, kept=kept: kept), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
        if kept:
            assert base.shared_dir(session) == "hdfs://a/b"
        else:
            with pytest.raises(ValueError):
                base.shared_dir(session)


def test_texts_go_to_python_in_batches_of_bounded_bytes(spark):
    size = 50_000
    docs = spark.range(400).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), size).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    found = [r["n"] for r in base.mapped(docs, sizes, "n bigint").collect()]
    assert sum(found) >= 400 * size and max(found) <= base.BATCH_BYTES + 2 * size
