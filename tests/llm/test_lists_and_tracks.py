"""Entries of any depth, and tracks each by itself."""

from __future__ import annotations

import struct

from inkwell.llm import op1_url_filters, op2_media


def test_entries_of_any_depth_and_of_a_last_label(spark):
    urls = {1: "https://a.org/x/y/z/w?q", 2: "https://a.org/x/y/z", 3: "https://a.org/x/y", 4: "https://b.test/", 5: "https://c.d.org/x/y/z/w", 6: "https://b.net"}
    rows = spark.createDataFrame(list(urls.items()), "page_id bigint, url string").selectExpr("*", "DATE'2024-05-01' AS fetched")
    listed = spark.createDataFrame([("a.org/x/y/z/w/", "deny"), ("a.org/x/y/z/", "allow"), ("a.org", "deny"), ("test", "deny"), ("org", "allow")], "pattern string, action string").selectExpr("*", "DATE'2024-01-01' AS day")
    found = {r["page_id"]: (r["verdict"], r["pattern"]) for r in op1_url_filters.evaluate(rows, listed).collect()}
    assert found == {1: ("deny", "a.org/x/y/z/w/"), 2: ("allow", "a.org/x/y/z/"), 3: ("deny", "a.org"), 4: ("deny", "test"), 5: ("allow", "org"), 6: ("unlisted", None)}


def _trak(codec, step, sizes, offsets, sync, wide):
    box, full, u32 = op2_media._box, op2_media._full, lambda *n: struct.pack(f">{len(n)}I", *n)
    places = full(b"co64", u32(len(offsets)), struct.pack(f">{len(offsets)}Q", *offsets)) if wide else full(b"stco", u32(len(offsets), *offsets))
    tables = [full(b"stsd", u32(1), box(codec, bytes(8))), full(b"stts", u32(1, len(sizes), step)), full(b"stsc", u32(1, 1, len(sizes) // len(offsets), 1)), full(b"stsz", u32(0, len(sizes), *sizes)), places]
    tables += [full(b"stss", u32(len(sync), *sync))] if sync else []
    return box(b"trak", box(b"mdia", full(b"mdhd", u32(0, 0, 90, 0, 0)), box(b"minf", box(b"stbl", *tables))))


def test_tracks_are_described_each_by_itself(spark):
    data = op2_media._box(b"mdat", bytes(100))
    sound, film = _trak(b"mp4a", 2, [5, 5], [8], None, True), _trak(b"avc1", 3, [10, 20, 10, 20], [18, 48], [1, 4], False)
    both, turned = (data + op2_media._box(b"moov", *t) for t in ((sound, film), (film, sound)))
    a, b = "mp4a/90/4/2/2/8-18", "avc1/90/12/4/2/18-28,58-78"
    pieces = op2_media._box(b"moov", _trak(b"avc1", 1, [], [8], None, False)) + op2_media._box(b"moof", op2_media._box(b"traf", b"")) + data
    stored = spark.createDataFrame([(1, 0, bytearray(both)), (2, 0, bytearray(turned)), (3, 0, bytearray(pieces))], "id bigint, n_bytes bigint, media binary")
    found = {r["id"]: r for r in op2_media.media_columns(stored).collect()}
    assert [found[i]["feature"] for i in (1, 2)] == [f"{a};{b}", f"{b};{a}"] and [found[i]["codec"] for i in (1, 2)] == ["mp4a", "avc1"]
    assert "fragmented" in found[3]["error"] and found[3]["feature"] is None
