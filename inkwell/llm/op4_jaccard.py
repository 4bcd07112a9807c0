"""N-gram Jaccard join by a token-group matrix (after LES3, Li et al., 2021): exact, without all pairs.

A document is the set of its distinct 5-word shingles, as 64-bit hashes; two are linked when 100 * |A and B| >= 80 * |A or B|.

1. Equal sets are one class. A class's prefix is its (n - ceil(0.8 n) + n / 10) smallest hashes; of two linked classes the first
   n / 10 common hashes are in both prefixes. So a class of whose prefix fewer hashes occur in other classes has no link and is
   settled. That is found without a join: a hash's smallest and largest class are combined map-side, a hash with one class is
   counted for it, and a passage that a third of the documents share is one row. Of the others, whole sets are covered the same way.
2. What is left is partitioned into groups of similar documents. Of the classes that agree in a min-hash the centre is the one
   whose tokens occur in most classes: of many near copies of one text that is the text itself, or what is nearest to it. Every
   class is compared exactly with the centres of its KEYS min-hashes, and what is linked is one group (connected components, over
   tables in the shared folder). A large group of near copies is thus one group, whatever its size, for one comparison a member.
3. The matrix holds each group's token union as (token, group) rows, with the sizes of the members that have the token and the
   largest rest of a set from it on. Tokens of one group only lead nowhere and are counted out. A query, a class, asks only with its
   rarest n - 0.8 n + 1 tokens, and only for groups that hold one of them in a member's own prefix, of a size and with a rest that
   a link allows. Such a group's overlap with the query is bounded by the query's tokens in the group's whole union; a group with
   fewer than 0.8 n of them stays closed. In the groups that open, the members with a common prefix token are compared exactly.

Every link between different texts is thus in step 2 or step 3, or between documents that a chain of links joins anyway.

Defined results: null and empty texts and texts without words have no shingles and are linked with nothing; fewer than five words
are one shingle; repeated rows are copies; rows without a doc_id are linked like others, and a component without any doc_id has a
null component_id; an empty table gives an empty result; other columns are ignored. Shingles are numpy work on bytes (mapInArrow);
all joins and counts are DataFrame work. Equality of hashes stands for equality of shingles and, with the count, of sets: 64 bits
each, from BLAKE2b of the words, so that no rule for making collisions is known.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from inkwell.llm import base

WORDS, PER_CENT = 5, 80
#: Min-hashes of a class, and how many of them a class and its centre must agree in to be compared.
KEYS, AGREE = 8, 3
#: Bytes of a text that are split at once.
BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x09-\x0d ]")
#: Tokens that are handed to Spark at once.
BATCH_TOKENS = 200_000

#: Words whose hashes a worker keeps at hand, and the longest of them.
KEPT_WORDS, KEPT_BYTES = 300_000, 64
_MIXES = tuple(np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIXES[0]
    h = (h ^ (h >> np.uint64(29))) * _MIXES[1]
    return h ^ (h >> np.uint64(32))


class _Hashes(dict):
    """Hashes of words by word; most words of a text have been seen before."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = value
        return value


_hashes = _Hashes()


def _words(data: bytes) -> np.ndarray:
    """A hash for each word, in order, in blocks that end at white space. Bytes have A-Z lowered and are split at 9 to 13 and 32 only."""
    found, start = [np.empty(0, np.uint64)], 0
    while start < len(data):
        end = min(len(data), start + BLOCK)
        if end < len(data) and (space := _SPACE.search(data, end)):
            end = space.start()
        elif end < len(data):
            end = len(data)
        words = data[start:end].lower().split()
        found.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
        start = end
    return np.concatenate(found)


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    words = _words((text or "").encode())
    if not len(words):
        return np.empty(0, np.int64)
    width = min(WORDS, len(words))
    h = np.full(len(words) - width + 1, np.uint64(width))
    for k in range(width):
        h = _mix(h * _MIXES[0] + words[k : len(words) - width + 1 + k])
    return np.unique(h.view(np.int64))


def overlap(n: Column) -> Column:
    """Common shingles that a set of n needs with any other it is linked with."""
    return F.floor((n * PER_CENT + 99) / 100).cast("bigint")


def overlap_of_smaller(n: Column) -> Column:
    """Common shingles that a set of n needs with one that is not smaller: 2 * 0.8 / 1.8 of its own."""
    return F.floor((n * 2 * PER_CENT + 99 + PER_CENT) / (100 + PER_CENT)).cast("bigint")


def prefix(n: Column) -> Column:
    """Smallest hashes of a set of n that are its prefix."""
    return n - overlap(n) + F.greatest(F.lit(1), F.floor(n / 10))


def common_in_prefix(n: Column) -> Column:
    """Hashes of its prefix that a set of n has in common with the prefix of any other it is linked with, which may be a fifth smaller."""
    return F.greatest(F.lit(1), F.floor(overlap(n) / 10))


def _slack(n: int) -> int:
    return max(1, n // 10)


def _class(tokens: np.ndarray) -> int | None:
    """A hash of a whole set; none for an empty one."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True) if len(tokens) else None


def _rows(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, n, cls and the prefix, or the whole set, of every text."""
    keys: list = []
    sets: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        kept = [s if whole else s[: len(s) - -(-len(s) * PER_CENT // 100) + _slack(len(s))] if len(s) else s for s in sets]
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in kept]))).astype(np.int32)
        classes = [_class(s) for s in sets]
        arrays = [pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()), pa.ListArray.from_arrays(offsets, np.concatenate([*kept, np.empty(0, np.int64)]))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "cls", "tokens"])

    held = 0
    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys.append(k)
            sets.append(shingles(t.as_py()))
            held += len(sets[-1])
            if held >= BATCH_TOKENS:
                yield flush()
                keys, sets, held = [], [], 0
    if keys:
        yield flush()


def sets_of(docs: DataFrame, whole: bool) -> DataFrame:
    return base.mapped(docs.select(F.col("doc_id").cast("bigint"), "text"), lambda it: _rows(it, whole), "doc_id bigint, n bigint, cls bigint, tokens array<bigint>")


def _alone(rows: DataFrame, owner: str) -> DataFrame:
    """(owner, alone): how many tokens no other owner has; owners without such tokens are missing. rows: (owner, tokens)."""
    by_token = rows.select(owner, F.explode("tokens").alias("token")).groupBy("token").agg(F.min(owner).alias(owner), F.max(owner).alias("last"))
    return by_token.where(F.col(owner) == F.col("last")).groupBy(owner).agg(F.count("*").alias("alone"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): its smallest reachable node.

    Each round takes the smallest label of a node's neighbours, then the label of that label; tables of the rounds are written to
    the shared folder, and only whether a label has changed comes to the driver.
    """
    spark = edges.sparkSession
    if not edges.limit(1).count():
        return spark.createDataFrame([], "node bigint, component bigint")
    both = base.stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = base.stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        known = base.bounded(labels)
        near = both.join(known, both["b"] == known["node"]).groupBy("a").agg(F.min("component").alias("near"))
        step = near.join(known, near["a"] == known["node"]).select("node", F.least("component", "near").alias("hop"), F.col("component").alias("was"))
        jump = base.bounded(labels).select(F.col("node").alias("hop"), F.col("component").alias("far"))
        nearer = base.stored(step.join(jump, "hop", "left").select("node", F.least("hop", F.coalesce("far", "hop")).alias("component"), "was"), "labels")
        base.deleted(labels)
        labels = nearer.select("node", "component")
        if not nearer.where("component <> was").limit(1).count():
            base.released(spark, both)
            return labels


def _linked(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common * 100 >= (n_a + n_b - common) * PER_CENT


def _sized(n_a: Column, n_b: Column) -> Column:
    """Whether sets of these sizes can be linked at all."""
    return (n_a * 100 >= n_b * PER_CENT) & (n_b * 100 >= n_a * PER_CENT)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) that are linked, as a table. Sets of a meet their pairs where they lie while the pairs are few, and are shuffled once, by b."""
    asked = base.stored(pairs, "pairs")
    few = base.bounded(asked)
    a = sets.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("of_a")).join(few, "a")
    wanted = base.bounded(few.select("b").distinct())
    b = sets.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("of_b")).join(wanted, "b", "left_semi")
    found = base.stored(a.join(b, "b").where(_sized(F.col("n_a"), F.col("n_b")) & _linked(F.col("of_a"), F.col("of_b"), F.col("n_a"), F.col("n_b"))).select("a", "b"), "links")
    base.deleted(asked)
    return found


def _covered(sets: DataFrame) -> DataFrame:
    """(cls, n, tokens, centre): the sets of which other sets hold enough tokens for a link; centre: how often the mean token occurs, as a logarithm."""
    rows = sets.select("cls", "n", F.explode("tokens").alias("token"))
    times = rows.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    of = rows.join(times, "token").groupBy("cls", "n").agg(F.count("*").alias("shared"), F.sum(F.log2("times")).alias("weight"))
    enough = base.stored(of.where(F.col("shared") >= overlap(F.col("n"))).select("cls", (F.col("weight") / F.col("n")).alias("centre")), "enough")
    left = base.stored(sets.join(base.bounded(enough), "cls"), "covered")
    base.released(sets.sparkSession, enough)
    return left


def _star_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) of classes to the most central class with the same min-hash, compared exactly."""
    least = lambda k: F.array_min(F.transform("tokens", lambda t: F.xxhash64(t, F.lit(k))))
    signed = sets.select("cls", "n", "centre", F.array(*[least(k) for k in range(KEYS)]).alias("sign"))
    keyed = base.stored(signed.select("cls", "n", "centre", "sign", F.posexplode("sign").alias("k", "key")), "keys")
    of = F.struct(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("sign").alias("sign_b"))
    first = keyed.groupBy("k", "key").agg(F.max_by(of, F.struct("centre", "cls")).alias("of"), F.count("*").alias("held")).where("held > 1").select("k", "key", "of.*")
    first = base.stored(first, "centres")  # so that a min-hash that many classes share is split, or its centre broadcast
    agree = F.size(F.filter(F.zip_with("sign", "sign_b", lambda x, y: x == y), lambda x: x))
    near = (F.col("cls") != F.col("b")) & _sized(F.col("n"), F.col("n_b")) & (agree >= min(AGREE, KEYS))
    links = _compared(keyed.join(base.bounded(first), ["k", "key"]).where(near).select(F.col("cls").alias("a"), "b").distinct(), sets)
    base.deleted(keyed, first)
    return links


def _fits(n: Column, rest: Column, least: Column, most: Column, most_rest: Column) -> Column:
    """Whether a query of size n can be linked, by a common token that leaves it `rest` tokens, with a set that is not larger.

    The first common token of a linked pair leaves both sets enough tokens, from it on, for the overlap that their sizes ask for.
    Of the sets in question the smallest and the largest size and the largest rest are known.
    """
    need = F.floor(((n + F.greatest(least, overlap(n))) * PER_CENT + 99 + PER_CENT) / (100 + PER_CENT))
    return (least <= n) & (most * 100 >= n * PER_CENT) & (rest >= need) & (most_rest >= need)


def _group_links(sets: DataFrame, groups: DataFrame) -> DataFrame | None:
    """Links between documents of different groups by the token-group matrix, as a table; None where no group opens."""
    spark, n, rest = sets.sparkSession, F.col("n"), F.col("rest")
    of = groups.select(F.col("node").alias("cls"), F.col("component").alias("grp"))
    known = base.stored(sets.select("cls", "n", F.explode("tokens").alias("token")).join(base.bounded(of), "cls", "left").withColumn("grp", F.coalesce("grp", "cls")), "known")
    union = base.stored(known.groupBy("token", "grp").agg(F.count("*").alias("members")), "union")
    width = union.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1")
    # one order for all sets: tokens of fewer groups first; those of one group, which lead nowhere, are counted but not kept
    w = Window.partitionBy("cls")
    held = known.join(width, "token").withColumn("shared", F.count("*").over(w)).where(F.col("shared") >= overlap(n))
    held = base.stored(held.withColumn("rest", F.col("shared") - F.row_number().over(w.orderBy("groups", "token")) + 1).select("cls", "n", "grp", "token", "shared", "rest"), "held")
    base.released(spark, known)
    # of a linked pair the smaller has 8 / 9 of its tokens in common, the larger 0.8; their first common token is in both these prefixes
    larger = held.where(rest >= overlap(n))
    smaller = held.where((F.col("shared") >= overlap_of_smaller(n)) & (rest >= overlap_of_smaller(n)))
    matrix = smaller.groupBy(F.col("grp").alias("other"), "token").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("rest").alias("most_rest"))
    met = larger.join(matrix, "token").where((F.col("grp") != F.col("other")) & _fits(n, rest, F.col("least_n"), F.col("most_n"), F.col("most_rest")))
    asking = base.stored(met.select("cls", "n", "other").distinct(), "asking")
    # the bound of a query and a group: the query's tokens in the group's whole union
    few = base.bounded(asking)
    wanted = union.select("token", F.col("grp").alias("other")).join(base.bounded(few.select("other").distinct()), "other", "left_semi")
    bound = held.select("cls", "token").join(few, "cls").join(wanted, ["token", "other"]).groupBy("cls", "n", "other").agg(F.count("*").alias("common"))
    open_ = base.stored(bound.where(F.col("common") >= overlap(n)).select("cls", "other"), "open")
    base.released(spark, union, asking)
    links = None
    if open_.limit(1).count():
        members = smaller.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("grp").alias("other"), "token", F.col("rest").alias("rest_b"))
        met = larger.join(base.bounded(open_), "cls").join(members, ["token", "other"]).where(_fits(n, rest, F.col("n_b"), F.col("n_b"), F.col("rest_b")))
        links = _compared(met.select(F.col("cls").alias("a"), "b").distinct(), sets)
    base.released(spark, held, open_)
    return links


def _open_sets(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """(cls, n, tokens): whole sets of the classes open_ (doc_id, cls), of the texts read again; one row a class."""
    ids = base.bounded(open_.select(F.col("doc_id").alias("id")).distinct())
    again = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    again = again.join(ids, again["doc_id"].eqNullSafe(ids["id"]), "left_semi")
    sets = base.stored(sets_of(again, whole=True).join(base.bounded(open_.select("cls")), "cls", "left_semi").select("cls", "n", "tokens"), "sets")
    if sets.count() == open_.count():
        return sets
    once = base.stored(sets.groupBy("cls").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")), "sets")  # rows that are repeated, or without an id
    base.deleted(sets)
    return once


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, n, cls) of every row of docs, and (node, component) of the classes that are linked with others."""
    spark = docs.sparkSession
    sketches = base.stored(sets_of(docs, whole=False), "sketches")
    rows = base.stored(sketches.select("doc_id", "n", "cls"), "rows")
    alone = base.stored(_alone(sketches.where("n > 0").select("cls", "tokens"), "cls"), "alone")
    base.released(spark, sketches)
    classes = rows.where("n > 0").groupBy("cls", "n").agg(F.min("doc_id").alias("doc_id"))
    shared = prefix(F.col("n")) - F.coalesce("alone", F.lit(0))
    open_ = base.stored(classes.join(alone, "cls", "left").where(shared >= common_in_prefix(F.col("n"))).select("doc_id", "cls"), "open-classes")
    base.released(spark, alone)
    if not open_.limit(1).count():
        base.deleted(open_)
        return rows, spark.createDataFrame([], "node bigint, component bigint")
    sets = _open_sets(docs, open_)
    base.deleted(open_)
    left = _covered(sets)
    base.released(spark, sets)
    links = _star_links(left)
    groups = components(links)
    more = _group_links(left, groups)
    if more is not None:
        old, groups = groups, components(links.unionByName(more))
        base.deleted(old, more)
    base.released(spark, left, links)
    return rows, groups


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    rows, groups = classified(docs)
    classes = rows.where("n > 0").groupBy("cls", "n").agg(F.min("doc_id").alias("rep"))
    joined = classes.join(base.bounded(groups), classes["cls"] == groups["node"]).select("cls", "n", "rep", "component")
    smallest = joined.groupBy("component").agg(F.min("rep").alias("least"))
    merged = joined.join(smallest, "component").select("cls", "n", "least")
    named = classes.join(merged, ["cls", "n"], "left").select("cls", "n", F.coalesce("least", "rep").alias("least"))
    return rows.join(named, ["cls", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(base.read(spark, sf_dir, "documents"))


def _tagged(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs, its columns renamed to names, with `_n` and `_cls` of each row's text."""
    at, renamed = docs.columns.index("text"), docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(at)]
            tags = [pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *tags], names=[*names, "_n", "_cls"])

    return base.mapped(renamed, run, StructType([*renamed.schema.fields, StructField("_n", LongType()), StructField("_cls", LongType())]))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each component the document with the smallest id stays, whole; of rows with equal ids and words one stays.

    Rows without words all stay. A component without any id keeps one of its rows. An id that stands for several texts, or none,
    decides nothing by itself: such rows are told apart by their sets of shingles.
    """
    rows, groups = classified(docs)
    member = rows.where("n > 0").join(base.bounded(groups), rows["cls"] == groups["node"], "left").select("doc_id", "n", "cls", F.coalesce("component", "cls").alias("component"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "cls")).alias("best")
    first = base.stored(member.groupBy("component").agg(best, F.count("*").alias("held")).where("held > 1").select("component", F.col("best.doc_id").alias("first_id"), F.col("best.cls").alias("first_cls")), "first")
    twice = base.stored(rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "twice")
    gone = base.stored(member.join(base.bounded(first), "component").where("doc_id <> first_id").select("doc_id").distinct(), "gone")
    ids, unclear = base.bounded(gone), base.bounded(twice)
    own = docs["doc_id"].cast("bigint")
    if not twice.limit(1).count():
        base.released(spark, rows, groups, first)
        return docs.join(ids, own == ids["doc_id"], "left_anti").select(docs["*"])
    names = [f"_{k}" for k in range(len(docs.columns))]
    key = F.col(names[docs.columns.index("doc_id")]).cast("bigint")
    clear = docs.join(unclear, own.eqNullSafe(unclear["doc_id"]), "left_anti").select(docs["*"])
    clear = clear.join(ids, clear["doc_id"].cast("bigint") == ids["doc_id"], "left_anti").select(clear["*"])
    both = _tagged(docs.join(unclear, own.eqNullSafe(unclear["doc_id"]), "left_semi").select(docs["*"]), names)
    of = groups.select(F.col("node").alias("_cls"), F.col("component").alias("_component"))
    both = both.join(base.bounded(of), "_cls", "left").withColumn("_component", F.coalesce("_component", "_cls"))
    both = both.join(base.bounded(first), F.col("_component") == F.col("component"), "left").where(F.col("component").isNull() | (key.eqNullSafe(F.col("first_id")) & (F.col("_cls") == F.col("first_cls"))))
    whole = F.struct(*names).alias("row")
    wordless = both.where("_n = 0").select(*names)
    once = both.where("_n > 0").groupBy("_component").agg(F.first(whole).alias("row")).select("row.*")
    return clear.unionByName(wordless.unionByName(once).toDF(*docs.columns))
