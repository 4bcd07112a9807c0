"""The two classifiers and the pipeline: held-out accuracy, odd inputs, and a brute-force run of the stages."""

from __future__ import annotations

import hashlib
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from inkwell.llm import labelled, op3_bpe, op4_jaccard, op5_quality_rules, op8_quality, op9_toxicity
from test_small_ops import DDL, ODD, _components, table

SF = "/root/testdata/sf0.01"


def _auc(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    good = labels.sum()
    return (rank[labels == 1].sum() - good * (good + 1) / 2) / (good * (len(labels) - good))


@pytest.mark.parametrize(("query", "label", "folder", "least"), [(op8_quality.query, "quality", SF, 0.97), (op9_toxicity.query, "toxic", SF, 0.7), (op9_toxicity.query, "toxic", "/root/testdata/sf0.1", 0.95)])
def test_held_out(spark, query, label, folder, least):
    rows = query(spark, folder).collect()
    known = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert _auc(np.array([r["score"] for r in held]), np.array([known[r["doc_id"]] for r in held])) > least


@pytest.mark.parametrize("model", [op8_quality, op9_toxicity])
def test_odd_inputs(spark, model):
    docs = table(spark, [*ODD, ODD[4]], [*range(len(ODD) - 1), None, 4])
    for labels in ([], [(0, 1, 1)], [(0, 1, 0), (1, 0, 1), (4, None, None), (None, 1, 1), (99, 5, 5), (6, 0, 1), (7, 1, 0)]):
        frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
        rows = model.score(docs, frame).collect()
        assert len(rows) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert model.score(docs.limit(0), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def test_dual_descent_finds_the_primal_optimum():
    """Brute force: Newton steps on w w / 2 + b b / 2 + sum of cost * max(0, 1 - y (w x + b)) ** 2."""
    draw = np.random.default_rng(3)
    x = (draw.random((40, 6)) < 0.5) * draw.normal(size=6)
    y, cost = np.where(draw.random(40) < 0.5, 1, -1), draw.uniform(0.3, 2, 40)
    rows = [np.flatnonzero(r).astype(np.int32) for r in x]
    full = np.hstack([x, np.ones((40, 1))])
    w = np.zeros(7)
    for _ in range(100):
        gap = np.maximum(0, 1 - y * (full @ w))
        hard = (gap > 0) * cost
        w -= np.linalg.solve(np.eye(7) + 2 * (full * hard[:, None]).T @ full, w - 2 * full.T @ (cost * gap * y))
    op8_passes, op8_quality.PASSES = op8_quality.PASSES, 3000
    try:
        found, bias = op8_quality.dual_descent(rows, [r[i] for r, i in zip(x, rows, strict=True)], y, cost)
    finally:
        op8_quality.PASSES = op8_passes
    assert np.allclose(found[:6], w[:6], atol=1e-3) and abs(bias - w[6]) < 1e-3


@pytest.mark.parametrize("shift", [0.0, -6.0])
def test_slopes_are_those_of_finite_differences(shift):
    draw = np.random.default_rng(4)
    fp, fu, step = draw.normal(size=5) + (8 if shift else 0), draw.normal(size=9) + shift, 1e-6
    low = op9_toxicity.risk(fp, fu, 0.4)[1] < 0
    assert low == bool(shift)
    whole = lambda p, u: -op9_toxicity.risk(p, u, 0.4)[1] if low else sum(op9_toxicity.risk(p, u, 0.4))
    for part, got in zip((0, 1), op9_toxicity.slopes(fp, fu, 0.4), strict=True):
        for k in range(len(got)):
            near = [fp.copy(), fu.copy()]
            near[part][k] += step
            assert abs((whole(*near) - whole(fp, fu)) / step - got[k]) < 1e-4


def test_what_the_driver_takes_is_bounded(spark):
    docs = table(spark, ["some words in a text " * 3, "more words", "yet other ones here", "x y z"], [1, 2, 3, 3])
    chosen = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id bigint, grp int")
    sample = labelled.sampled(docs, chosen, ("words",))
    whole = labelled.gathered(sample, 100)
    assert [g for g, _ in whole] == [1, 1, 0] and [len(f) for _, f in whole] == [5, 2, 3]
    assert sum(len(f) for _, f in labelled.gathered(sample, 4)) <= 8


def test_a_fit_takes_less_memory_than_its_rows():
    draw = np.random.default_rng(6)
    rows = [np.unique(draw.integers(0, op8_quality.SIZE, 5000)).astype(np.int32) for _ in range(1000)]
    tracemalloc.start()
    try:
        op8_quality.fit(rows, np.array([1, -1] * 500), {1: 0.7, -1: 0.3})
        assert tracemalloc.get_traced_memory()[1] < sum(r.nbytes for r in rows)
    finally:
        tracemalloc.stop()


def test_linear_model_separates():
    rows = [np.array([0, 2], np.int32), np.array([0, 3], np.int32), np.array([1, 2], np.int32), np.array([1, 3], np.int32)] * 5
    model = op8_quality.fit(rows, np.array([1, 1, -1, -1] * 5), {1: 0.5, -1: 0.5})
    assert model.weights[0] > abs(model.weights[2]) and model.weights[1] < -abs(model.weights[3])


def test_toxic_words_are_found_among_unlabelled_ones():
    draw = np.random.default_rng(1)
    plain = lambda: draw.choice(np.arange(100, 400), 30, replace=False)
    toxic = [np.sort(np.append(plain(), draw.integers(0, 3))).astype(np.int32) for _ in range(200)]
    mixed = [np.sort(np.append(plain(), draw.integers(0, 3)) if k % 10 == 0 else plain()).astype(np.int32) for k in range(2000)]
    weights, bias = op9_toxicity.train(toxic, mixed, 0.1)
    score = lambda r: bias + weights[r].sum()
    assert np.mean([score(r) for r in mixed[::10]]) > np.mean([score(r) for r in mixed[1::10]]) + 2


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op3_bpe.default_path())


def test_stages(spark):
    """The pipeline's rows: scores and rules by the registered queries, near copies by all pairs, every token by the library; nothing else is lost."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in op8_quality.query(spark, SF).collect() if r["predicted"] == 1}
    kept = sorted(r["doc_id"] for r in op5_quality_rules.query(spark, SF).collect() if r["kept"] and r["doc_id"] in good)
    _, roots = _components([texts[k] for k in kept])
    left = {k for i, k in enumerate(kept) if roots[i] == i}
    assert set(got) == left and len(left) < len(kept)
    library = _library()
    for k in left:
        ids = library.encode(texts[k], add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[k] == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


def test_stages_take_odd_rows(spark):
    """Nulls, empty and blank texts, repeated rows, rows without ids and clashing columns pass each stage by its own rules."""
    docs = table(spark, [*ODD, ODD[4], ODD[4]], [*range(len(ODD) - 1), None, 4, 4])
    rows = sorted(map(str, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        found = sorted(map(str, out.collect()))
        assert out.columns == docs.columns and not Counter(found) - Counter(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name == "mixing":
            assert found == rows
        if name == "quality_classifier":  # equal texts share their fate
            assert sum("The same text" in r for r in found) in (0, 4)
        if name == "jaccard_join":
            assert sum("The same text" in r for r in found) == 1
    encoded = op3_bpe.stage(spark, docs, SF).collect()
    assert len(encoded) == len(rows) and {r["n_tokens"] for r in encoded if r["doc_id"] in (0, 1)} == {0}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_names_and_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "jaccard_join", "mixing", "bpe"]
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13, 1, 1, "x", 1, 1, 1)], DDL)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_brute_force_helper():
    assert _components(["a b c", "a  B c", "d"])[1] == [0, 0, 2]
