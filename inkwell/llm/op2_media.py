"""Media columns: ISO media containers (ISO/IEC 14496-12) written, walked and described.

`to_media` stores a payload losslessly as 8-bit mono PCM in an MP4 container; `media_columns` describes any such container by
walking its nested boxes and decoding its sample tables (stsd, stts, stsc, stsz, stco or co64, stss): codec, time scale, duration,
sample count and the byte ranges of key frames. Payloads are read back by those tables and are never decoded.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts give equal containers and columns; bytes that are
no container, whose tables are cut short or point outside the file, or whose samples are in fragments (moof), give a null
description and an `error`; tracks are described each by its own tables; repeated rows are described each by itself; an empty table gives an empty result. Texts are handled one at a time, in output batches of bounded
bytes, so memory follows the longest text, not the batch. The style is mapInArrow: hashing and box walking are byte work that
Catalyst has no expressions for.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import base

#: A payload's length is a positive multiple of this.
UNIT = 64
#: Samples a second of the PCM track, and bytes in one chunk of it.
RATE, CHUNK = 8000, 4096
#: Bytes of output that are gathered before a batch is handed to Spark.
BATCH_BYTES = 4 << 20
#: Boxes that hold boxes; the numbers are the bytes before the first child.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"udta": 0}


class Media(NamedTuple):
    """What a container says of one track; `ranges` are [start, end) bytes of key frames, adjoining ones joined."""

    codec: str
    timescale: int
    duration: int
    samples: int
    keyframes: int
    ranges: list[tuple[int, int]]
    chunks: list[tuple[int, int]]


def padded(text: str | None) -> tuple[bytes, int]:
    """The payload of a text and its length before padding."""
    raw = (text or "").encode("utf-8")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0"), len(raw)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_container(payload: bytes) -> bytes:
    """The payload as the 8-bit samples of one PCM track, media data first, so that chunk offsets do not depend on the tables' size."""
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")
    data = _box(b"mdat", payload)
    start, count = len(head) + len(data) - len(payload), len(payload)
    offsets = range(start, start + count, CHUNK)
    rest = count % CHUNK
    runs = [(1, CHUNK, 1)] * (count >= CHUNK) + [(len(offsets), rest, 1)] * bool(rest)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    wide = offsets[-1] > 0xFFFFFFFF
    tables = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, count, 1)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *run) for run in runs)),
        _full(b"stsz", struct.pack(">II", 1, count)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), struct.pack(f">{len(offsets)}{'Q' if wide else 'I'}", *offsets)),
    )
    info = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), tables)
    media = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, count, 0x55C4, 0), version=1), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), info)
    track = _box(b"trak", _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, count), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=3), media)
    movie = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, count), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
    return head + data + _box(b"moov", movie, track)


def boxes(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, body start, body end) of the boxes in data[start:end]; ValueError where a size does not fit."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box header is cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box header is cut short")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if start + size > end or start + size < body:
            raise ValueError(f"box {kind!r} does not fit")
        yield kind, body, start + size
        start += size


def _walk(data: memoryview, start: int, end: int, path: tuple[bytes, ...], found: dict[tuple[bytes, ...], list[tuple[int, int]]]) -> None:
    for kind, body, stop in boxes(data, start, end):
        found.setdefault((*path, kind), []).append((body, stop))
        if kind in CONTAINERS and len(path) < 8:
            _walk(data, body + CONTAINERS[kind], stop, (*path, kind), found)


def _numbers(data: memoryview, span: tuple[int, int], width: int, code: str, skip: int = 4) -> list[tuple[int, ...]]:
    """The rows of a counted table whose count stands `skip` bytes into the box."""
    (n,) = struct.unpack_from(">I", data, span[0] + skip)
    at, size = span[0] + skip + 4, struct.calcsize(f">{code * width}")
    if at + n * size > span[1]:
        raise ValueError("a sample table is cut short")
    flat = struct.unpack_from(f">{n * width}{code}", data, at)
    return [flat[i : i + width] for i in range(0, len(flat), width)]


def tracks(data: bytes) -> list[Media]:
    """Describes every track of a container, in the order of the file; ValueError or struct.error where it is malformed or in fragments."""
    view, found = memoryview(data), {}
    _walk(view, 0, len(view), (), found)
    if (b"moof",) in found:
        raise ValueError("a fragmented file: its samples are not in the movie's tables")
    spans = found.get((b"moov", b"trak"), [])
    if not spans:
        raise ValueError("no track with sample tables")
    return [_track(view, *span) for span in spans]


def describe(data: bytes) -> Media:
    """The first track of a container."""
    return tracks(data)[0]


def _track(view: memoryview, start: int, end: int) -> Media:
    """One track, by its own boxes."""
    found: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
    _walk(view, start, end, (b"moov", b"trak"), found)
    media = (b"moov", b"trak", b"mdia")
    table = (*media, b"minf", b"stbl")
    one = lambda *path: found[path][0] if path in found else None
    head, entry, sizes = one(*media, b"mdhd"), one(*table, b"stsd"), one(*table, b"stsz")
    if head is None or entry is None or sizes is None:
        raise ValueError("no track with sample tables")
    wide = view[head[0]] == 1
    if head[1] - head[0] < (32 if wide else 20) or entry[1] - entry[0] < 16 or sizes[1] - sizes[0] < 12:
        raise ValueError("a table is cut short")
    scale, length = struct.unpack_from(">IQ" if wide else ">II", view, head[0] + (20 if wide else 12))
    codec = bytes(view[entry[0] + 12 : entry[0] + 16]).decode("latin-1")
    each, count = struct.unpack_from(">II", view, sizes[0] + 4)
    offsets = [x[0] for x in (_numbers(view, one(*table, b"co64"), 1, "Q") if one(*table, b"co64") else _numbers(view, one(*table, b"stco") or (len(view), 0), 1, "I"))]
    runs = _numbers(view, one(*table, b"stsc") or (len(view), 0), 3, "I")
    ends = None if each else [0, *accumulate(x[0] for x in _numbers(view, sizes, 1, "I", 8))]
    span = lambda a, b: (b - a) * each if ends is None else ends[b] - ends[a]  # noqa: E731  bytes of samples a to b - 1
    firsts = [run[0] for run in runs]
    if firsts[:1] != [1] * bool(offsets) or any(b <= a for a, b in zip(firsts, firsts[1:], strict=False)) or any(f > len(offsets) for f in firsts):
        raise ValueError("runs of chunks that are out of order, or beyond the chunks")
    per_chunk = [run[1] for k, run in enumerate(runs) for _ in range(run[0], runs[k + 1][0] if k + 1 < len(runs) else len(offsets) + 1)]
    if len(per_chunk) != len(offsets) or sum(per_chunk) != count:
        raise ValueError("the sample tables disagree")
    chunks, starts, at = [], [0], 0
    for offset, n in zip(offsets, per_chunk, strict=True):
        size = span(at, at + n)
        if offset + size > len(view):
            raise ValueError("a chunk lies outside the file")
        chunks.append((offset, offset + size))
        at += n
        starts.append(at)
    sync = one(*table, b"stss")
    if sync is None:  # every sample is a key frame
        spans, keys = chunks, count
    else:
        spans, keys, chunk, last = [], 0, 0, -1
        for (number,) in _numbers(view, sync, 1, "I"):
            sample = number - 1
            if keys and sample <= last:
                raise ValueError("key frames out of order")
            last = sample
            while chunk + 1 < len(starts) and starts[chunk + 1] <= sample:
                chunk += 1
            if not 0 <= sample < count:
                raise ValueError("a key frame that is no sample")
            first = chunks[chunk][0] + span(starts[chunk], sample)
            spans.append((first, first + span(sample, sample + 1)))
            keys += 1
    ranges: list[tuple[int, int]] = []
    for span in spans:
        if ranges and ranges[-1][1] == span[0]:
            ranges[-1] = (ranges[-1][0], span[1])
        else:
            ranges.append(span)
    ticks = sum(n * step for n, step in _numbers(view, one(*table, b"stts") or (len(view), 0), 2, "I"))
    if length not in (0, ticks):
        raise ValueError("the header's duration is not the samples'")
    return Media(codec, scale, ticks, count, keys, ranges, chunks)


def payload_of(data: bytes, media: Media) -> bytes:
    """The stored samples, in order, as the tables place them."""
    return b"".join(data[start:end] for start, end in media.chunks)


def feature(media: Media) -> str:
    spans = ",".join(f"{a}-{b}" for a, b in media.ranges)
    return f"{media.codec}/{media.timescale}/{media.duration}/{media.samples}/{media.keyframes}/{spans}"


def _flushed(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """rows in batches of about BATCH_BYTES of column `weight`."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[weight] or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


STORED = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
DESCRIBED = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("codec", pa.string()), ("duration_ticks", pa.int64()), ("timescale", pa.int64()), ("keyframes", pa.int64()), ("error", pa.string())])


def to_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's payload in a container."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                payload, n = padded(t.as_py())
                yield k, n, write_container(payload)

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text)).mapInArrow(lambda it: _flushed(rows(it), STORED, 2), "id bigint, n_bytes bigint, media binary")


def media_columns(stored: DataFrame) -> DataFrame:
    """The columns of DESCRIBED for (id, n_bytes, media), from the stored bytes alone; n_bytes is passed on.

    `feature` has every track, in the order of the file; the payload, codec, duration, time scale and key frames are the first track's.
    """

    def row(k: int, n: int, data: bytes | None) -> tuple:
        try:
            if data is None:
                raise ValueError("no bytes")
            described = tracks(data)
        except (ValueError, struct.error) as error:
            return (k, n, None, None, None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), None, None, None, None, None, str(error)[:200])
        media, features = described[0], ";".join(map(feature, described))
        payload = payload_of(data, media)
        return (k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), features, media.codec, media.duration, media.timescale, media.keyframes, None)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                yield row(k, n, data.as_py())

    schema = "id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, duration_ticks bigint, timescale bigint, keyframes bigint, error string"
    return stored.select("id", "n_bytes", "media").mapInArrow(lambda it: _flushed(rows(it), DESCRIBED, 6), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers are written by one step and described by the next, which sees their bytes only."""
    return media_columns(to_media(base.read(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
