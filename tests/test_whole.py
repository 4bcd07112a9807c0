"""Queries take in whole tables: against brute force on small tables with long texts and any ids."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from inkwell.functions.edits import figures, guard
from inkwell.operators import edits
from inkwell.plans import edits as edit_plans
from inkwell.plans import corpus, lines, retrieval

_LONG = " ".join(f"It was said again that word{chr(97 + i % 7)} stays where it is and nothing else moves." for i in range(120))
_TEXTS = [(1, "One short line is here to stay now. Two."), (2, _LONG), (5, "The same words come twice over here. x. The same words come twice over here. y."), (7, _LONG[:1999]), (8, "rose 12% in the year. and. no."), (9, "")]


@pytest.fixture(scope="module")
def texts_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame([(i, t, len(t)) for i, t in _TEXTS], "doc_id bigint, text string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    return path


def test_edits_of_all_documents(spark, texts_dir):
    docs = spark.read.parquet(f"{texts_dir}/documents.parquet")
    proposed, whole = edits.stand_in(docs), docs.selectExpr("doc_id AS attempt_id", "text")
    made: dict[int, list] = {}
    for r in sorted(proposed.collect(), key=lambda r: (r["attempt_id"], r["seq"])):
        made.setdefault(r["attempt_id"], []).append(r)
    places, reasons, results = set(), Counter(), set()
    for i, text in _TEXTS:
        keep, at, result = guard.Collector(text), [], text
        for r in made.get(i, []):
            o = keep.add(r["original"], r["replacement"])
            places.add((i, r["seq"], o.id, o.reason, o.start, o.end))
            at += [o] * (o.id is not None)
        for o in sorted(at, key=lambda o: -o.start):
            result = result[: o.start] + o.replacement + result[o.end :]
        results |= {(i, hashlib.md5(result.encode()).hexdigest(), len(result))} if i in made else set()
        reasons.update(filter(None, guard.guard_all([(r["original"], r["replacement"]) for r in made.get(i, [])])))
    assert set(made) == {1, 2, 5, 7, 8} and reasons["too_many"] == 20
    found = edits.collected(proposed, whole)
    assert {tuple(r) for r in found.select("attempt_id", "seq", "id", "reason", "start", "end").collect()} == places
    assert {r["reason"]: r["n"] for r in edits.histogram(edits.guarded(proposed)).collect()} == dict(reasons)
    done = edits.applied(whole.join(proposed, "attempt_id", "left_semi"), found.where("id is not null").selectExpr("*", "true AS accepted"))
    assert {tuple(r) for r in done.selectExpr("attempt_id", "md5(cast(result AS binary))", "length(result)").collect()} == results


@given(st.text(alphabet="0123456789.,-/:% ab€$−–)'’\u00a0pct²", max_size=60))
def test_numbers_are_found_from_their_digits(text):
    assert [m.span() for m in figures._numbers(text)] == [m.span() for m in figures._NUMBER.finditer(text)]


def test_texts_of_any_length_have_an_embedding(spark, texts_dir):
    found = {r["doc_id"]: r["norm"] for r in retrieval.text_embedding(spark, texts_dir).collect()}
    assert found == {i: 1.0 if t else None for i, t in _TEXTS}


def test_turns_of_all_conversations(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 else "model", "x" * (t * c % 3)) for c in (0, 49, 50, 700) for t in range(6)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    following = set()
    for c, t, _, _ in rows:
        waiting = [u for k, u, _, x in rows if k == c and len(x) % 2 == 0]
        following.add((c, f"edit-{t}", f"edit-{min([u for u in waiting if u > t] or waiting or [t])}"))
    assert {tuple(r) for r in edit_plans.review_next(spark, str(tmp_path)).collect()} == following
    line = '{"type":"%s","payload":"%s"}'
    assert {tuple(r) for r in lines.event_lines(spark, str(tmp_path)).collect()} == {(c, t, line % ("edit" if t else "start", role)) for c, t, role, _ in rows}


def test_whole_vectors_words_and_query_sets(spark, tmp_path):
    spark.createDataFrame([(i, [float(i + 1), *[k / 8 for k in range(63)]], 0) for i in range(61)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "Déjà déjà vu, naïveté")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    assert {r["query_id"] for r in retrieval.topk_each_query(spark, d).collect()} == {0, 20, 40, 60}
    assert {(r["id"], r["literal"], r["n"]) for r in retrieval.vector_literals(spark, d).collect()} == {(i, "[" + ",".join(f"{x:.6f}" for x in [i + 1, *[k / 8 for k in range(63)]]) + "]", 64) for i in range(61)}
    assert {tuple(r) for r in corpus.folded_words(spark, d).collect()} == {("deja", 2), ("vu", 1), ("naivete", 1)}


def test_vector_literals_round_as_sql_does(spark, tmp_path, oracle):
    tie = 1 / 128  # 0.0078125: halves go to the even digit
    rows = [(1, [tie, 3 * tie, -9 * tie, 1.5, -1e-9, -0.0]), (2, [1e30, -3.4e38, 16777216.0, 1e-45]), (3, [float("nan"), float("inf"), float("-inf")]), (4, []), (5, None)]
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/rows")
    next(tmp_path.glob("rows/*.parquet")).rename(tmp_path / "embeddings.parquet")
    found = {r["id"]: (r["literal"], r["n"]) for r in retrieval.vector_literals(spark, str(tmp_path)).collect()}
    assert found[1] == ("[0.007812,0.023438,-0.070312,1.500000,-0.000000,-0.000000]", 6)
    assert found == {i: (text, n) for i, text, n in oracle(retrieval.ORACLES["vector_literals"], str(tmp_path))[1]}
