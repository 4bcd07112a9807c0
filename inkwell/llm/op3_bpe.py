"""Byte-pair encoding and decoding by tree concatenation.

A text, between special tokens, is halved by length, wherever that cuts it, until no part has more than LEAF characters. The parts
are encoded each by itself; then, up the tree, neighbouring parts are joined: what lies around the join is encoded again, in a
window that grows until its ends agree with both sides, and the tokens outside the window stay as they are.

Why that is exact. The tokenizer first splits a text into pre-tokens by a pattern that is matched from left to right and looks at
most three characters ahead, so a part's pre-tokens but for its last two are those of any longer text that begins with the part.
The window begins at the third last pre-token of the left part and grows, match by match over the whole text, until a match ends
where one of the right part's own ends too: from there on the matches are the same. A pre-token that lies in one match on both
sides, as in long unsplit text, is not encoded again: a sequence of byte-pair tokens is the encoding of its bytes if and only if
every two neighbours are (Berglund and van der Merwe, 2023), so a window of tokens around the join grows until its first token
agrees with the left side's and its last with the right side's. Pairs outside are pairs of the parts, pairs inside are pairs of the
window's encoding, and agreement at both ends makes the seams pairs of a part too.

Defined results: a null or empty text has no tokens and decodes to the empty text; the special token's string in a text is that
token; repeated rows get results each for itself; an empty table gives an empty result; other columns of the input are ignored.
The style is mapInArrow and applyInPandas, since the library's encoder is not a Spark expression. The table is read once. A text of
up to LONG characters goes up its tree in the task that reads it; the parts of a longer one, of PART characters, are spread over
all tasks, each as a tree of its own, and meet again as token ids, of which one task holds one text's.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import base

#: Characters of a part that is encoded at once; of a text above which parts are rows of their own, and of such a part.
LEAF, LONG, PART = 512, 32_768, 16_384
#: Tokens on each side of a join inside a pre-token that the first window takes; characters before a part's end where the search for its last pre-tokens begins.
WINDOW, REACH = 4, 32
#: Texts whose results are handed to Spark at once.
BATCH = 512

RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
RESULT_DDL = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Part(NamedTuple):
    """text[start:end] as tokens, and where its last pre-tokens begin: three, or fewer where the first of them is sure to stay one."""

    start: int
    end: int
    ids: list[int]
    last: list[int]


class Codec:
    """The encoder and decoder of a tokenizer file of the byte-level BPE kind; every process loads it once."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # GPT-2's printable stand-ins for bytes: printable Latin-1 characters are themselves, the others follow from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        # a token's rank must follow the order in which merges make it
        order = {left.encode() + b" " + right.encode(): i for i, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])}
        made = [vocab[bytes(byte[c] for c in key.decode().replace(" ", ""))] for key in order]
        if any(b <= a for a, b in zip(made, made[1:], strict=False)):
            raise ValueError("this tokenizer's ids are not in the order of its merges")
        import public_tokenizers

        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.model = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.whole = tiktoken.Encoding("byte-bpe-pieces", pat_str="(?s:.+)", mergeable_ranks=vocab, special_tokens={})
        self.bytes = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.texts = [str(i) for i in range(max(self.bytes) + 1)]
        #: Joins made, and those among them that were inside a pre-token.
        self.joins = self.inner_joins = 0

    def piece(self, piece: str) -> list[int]:
        """One pre-token, or part of one, without pre-tokenization."""
        return self.whole.encode_ordinary(piece)

    def decoded(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])

    def runs(self, text: str) -> list[str]:
        """The text between special tokens and these, in order."""
        return [r for r in regex.split(f"({'|'.join(map(regex.escape, self.special))})", text) if r] if any(s in text for s in self.special) else [text] * bool(text)

    def leaf(self, text: str, start: int, end: int) -> Part:
        return Part(start, end, self.model.encode_ordinary(text[start:end]), self.last(text, start, end))

    def last(self, text: str, start: int, end: int) -> list[int]:
        """Where the last pre-tokens begin, looked for from a space after a character that is no white space: a pre-token always begins there."""
        at = end - REACH
        while at > start and ((at := text.rfind(" ", start + 1, at)) > start) and text[at - 1].isspace():
            pass
        return [m.start() for m in self.pattern.finditer(text, max(at, start), end)][-3:]

    def behind(self, ids: list[int], size: int) -> int:
        """How many of the last tokens have `size` bytes together."""
        n = 0
        while size > 0:
            n += 1
            size -= len(self.bytes[ids[-n]])
        return n

    def ahead(self, ids: list[int], size: int) -> int:
        """How many of the first tokens have `size` bytes together."""
        n = 0
        while size > 0:
            size -= len(self.bytes[ids[n]])
            n += 1
        return n

    def within(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of a pre-token from those of its two parts."""
        self.inner_joins += 1
        cut = lambda token: self.bytes[token][0] & 0xC0 == 0x80  # noqa: E731  a token that begins inside a character
        width = WINDOW
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            while i > 0 and cut(left[i]):
                i -= 1
            while j < len(right) and cut(right[j]):
                j += 1
            window = self.piece(self.decoded([*left[i:], *right[:j]]).decode())
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return [*left[:i], *window, *right[j:]]
            width *= 2

    def joined(self, text: str, left: Part, right: Part) -> Part:
        """text[left.start:right.end] from two neighbouring parts."""
        self.joins += 1
        middle, size = left.end, lambda a, b: len(text[a:b].encode())
        own = self.pattern.finditer(text, middle, right.end)
        begin, agreed, first, pieces = left.last[0], middle, 0, []
        for found in self.pattern.finditer(text, begin, right.end):
            s, e = found.span()
            pieces.append((s, e))
            while agreed < e and e >= middle:
                agreed = next(own).end()
                first = first or agreed
            if e == agreed:
                break
        window: list[int] = []
        for s, e in pieces:
            if s < middle < e and s == left.last[-1] and e == first:
                window += self.within(left.ids[-self.behind(left.ids, size(s, middle)) :], right.ids[: self.ahead(right.ids, size(middle, e))])
            else:
                window += self.piece(text[s:e])
        before, after = len(left.ids) - self.behind(left.ids, size(begin, middle)), self.ahead(right.ids, size(middle, agreed))
        starts = [*(s for s, _ in pieces), *(s for s in right.last if s >= agreed)]
        return Part(left.start, right.end, [*left.ids[:before], *window, *right.ids[after:]], starts[-3:])

    def up(self, text: str, parts: list[Part]) -> list[int]:
        """Neighbouring parts joined in pairs, level by level."""
        while len(parts) > 1:
            parts = [self.joined(text, *parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0].ids if parts else []

    def tree(self, run: str, leaf: int = LEAF) -> list[int]:
        """The encoding of a text without special tokens."""
        return self.up(run, [self.leaf(run, a, b) for a, b in halves(len(run), leaf)])

    def text(self, text: str, leaf: int = LEAF) -> list[int]:
        """The whole method on one text, in one process."""
        return [i for run in self.runs(text) for i in ([self.special[run]] if run in self.special else self.tree(run, leaf))]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def halves(n: int, leaf: int) -> list[tuple[int, int]]:
    """n characters halved until no part has more than leaf; a power of two of parts, so that pairs of the list are the tree."""
    parts = 1
    while n > parts * leaf:
        parts *= 2
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def digest(model: Codec, doc_id: int | None, ids: list[int]) -> tuple:
    names = model.texts
    return doc_id, len(ids), hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(model.decoded(ids)).hexdigest()


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, ..., text) of rows whose last column is the text, one text at a time."""
    for batch in batches:
        keys = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
        for i, t in enumerate(batch.column(batch.num_columns - 1)):
            yield *(k[i] for k in keys), t.as_py()


STEP = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("tree", pa.int64()), ("part", pa.string()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
STEP_DDL = "row bigint, doc_id bigint, n bigint, tree bigint, part string, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
PARTS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("tree", pa.int64()), ("ids", pa.binary())])
PARTS_DDL = "row bigint, doc_id bigint, n bigint, tree bigint, ids binary"


def _read(path: str, long: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The result of a text of up to `long` characters; the parts of a longer one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)

        def rows() -> Iterator[tuple]:
            for row, k, t in _texts(batches):
                if len(t) <= long:
                    yield row, k, None, None, None, *digest(model, k, model.text(t))[1:]
                    continue
                n = 0
                for tree, run in enumerate(model.runs(t)):
                    for a, b in [(0, len(run))] if run in model.special else halves(len(run), min(PART, long)):
                        yield row, k, n, tree, run[a:b], None, None, None
                        n += 1

        return _batched(rows(), STEP, BATCH)

    return run


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        return _batched(((*keys, np.asarray(model.text(part), np.int32).tobytes()) for *keys, part in _texts(batches)), PARTS, 64)

    return run


def _assemble(path: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(parts: pd.DataFrame) -> pd.DataFrame:
        model, ids = codec(path), []
        for _, own in parts.sort_values("n").groupby("tree", sort=True):
            found = [np.frombuffer(p, np.int32).tolist() for p in own["ids"]]
            texts = [model.decoded(f).decode() for f in found]
            if texts[0] in model.special:
                ids += found[0]
                continue
            text, nodes, at = "".join(texts), [], 0
            for f, t in zip(found, texts, strict=True):
                nodes.append(Part(at, at + len(t), f, model.last(text, at, at + len(t))))
                at += len(t)
            ids += model.up(text, nodes)
        k = parts["doc_id"].iloc[0]
        return pd.DataFrame([digest(model, None if pd.isna(k) else int(k), ids)], columns=RESULT.names)

    return run


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", long: int = LONG) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of docs, with the tokenizer file at path.

    The first step is a table in the shared folder: the results of most texts, and the parts of long ones under a number of the row
    that holds from there on, whichever executor is lost later.
    """
    whole = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    step = base.stored(base.mapped(whole, _read(path, long), STEP_DDL), "bpe")
    done = step.where("part is null").select(*RESULT.names)
    rows = step.where("part is not null").select("row", "doc_id", "n", "tree", "part").repartition("row", "n")
    parts = base.mapped(rows, _encode(path), PARTS_DDL)
    return done.unionByName(parts.groupBy("row").applyInPandas(_assemble(path), RESULT_DDL))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(base.read(spark, sf_dir, "documents"), default_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the documents as token counts and digests."""
    return encode_decode(docs, default_path())
