import math

import numpy as np
import pytest

from llm_helpers import no_docs, no_labels, odd_docs  # noqa: F401

from ensemblescope.llm import queries
from ensemblescope.llm import importance_resampling as ir

B = 64


def encoded(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def test_features_are_words_pairs_and_fours():
    chosen, owner = ir.features(*encoded(["a bb a", "", "a a", "xyz"]), B)
    family = chosen // B
    of = lambda text, f: chosen[(owner == text) & (family == f)].tolist()
    assert len(of(0, 0)) == 3 and of(0, 0)[0] == of(0, 0)[2] == of(2, 0)[0] == of(2, 0)[1]
    assert len(of(0, 1)) == 2 and of(2, 1) == [B] and of(3, 1) == []
    assert len(of(0, 2)) == 3 and of(2, 2) == [] and not (owner == 1).any()


def test_texts_do_not_mix(spark):
    one, _ = ir.features(*encoded(["alpha beta"]), B)
    both, owner = ir.features(*encoded(["alpha beta", "gamma"]), B)
    assert sorted(one.tolist()) == sorted(both[owner == 0].tolist())


def test_ratio_equals_brute_force(spark):
    rows = [(0, "a b c d", True), (1, "a b a b", False), (2, None, True), (3, "zz top zz", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, aim boolean")
    ratio = ir.fit_ratio(ir.count_features(docs, docs.aim, buckets=B), B)
    raw, aim = np.ones(3 * B), np.ones(3 * B)
    for _, text, good in rows:
        chosen, _ = ir.features(*encoded([text or ""]), B)
        raw += np.bincount(chosen, minlength=3 * B)
        aim += np.bincount(chosen, minlength=3 * B) * bool(good)
    want = [math.log(aim[k] / aim[k // B * B : k // B * B + B].sum()) - math.log(raw[k] / raw[k // B * B : k // B * B + B].sum()) for k in range(3 * B)]
    assert np.allclose(ratio.weights, want)
    chosen, _ = ir.features(*encoded(["a b c d"]), B)
    got = {r.doc_id: r.log_ratio for r in ir.score_documents(docs, ratio).collect()}
    assert math.isclose(got[0], ratio.weights[chosen].sum() * ir.STRETCH / (len(chosen) + ir.NEUTRAL)) and got[2] == 0


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000, 2000])
def test_kth_largest(spark, k):
    values = [float(v) for v in np.round(np.random.default_rng(1).normal(size=990), 3)] + [1e9] * 5 + [-1e9] * 5
    table = spark.createDataFrame([(v,) for v in values], "x double")
    got = ir.kth_largest(table, "x", k, width=16)
    assert got == (math.inf if k < 1 else -math.inf if k >= len(values) else sorted(values)[-k])


def test_best_cut():
    assert ir.best_cut(np.array([1.0, 2, 8, 9]), np.array([False, False, True, True])) == 5
    assert ir.best_cut(np.array([1.0]), np.array([True])) == -math.inf


def test_odd_documents(odd_docs, no_docs, no_labels, spark):
    scored, least = ir.resample(odd_docs, no_labels)
    got = scored.collect()
    assert least == -math.inf and len(got) == 9 and {r.log_ratio for r in got} == {0.0}
    labels = spark.createDataFrame([(1, 1), (5, 0), (77, 1), (None, 1), (7, None)], "doc_id bigint, quality int")
    scored, least = ir.resample(odd_docs, labels)
    kept = {r.doc_id for r in scored.collect() if r.sample_key >= least}
    assert 1 in kept and 6 in kept and 5 not in kept
    scored, least = ir.resample(odd_docs, labels, k=2)
    assert sum(r.sample_key >= least for r in scored.collect()) >= 2
    assert ir.resample(no_docs, no_labels)[0].count() == 0


def test_query_keeps_good_and_rejects_bad(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in queries.read(spark, sf_dir, "labels").collect()}
    got = queries.op8_importance_resampling(spark, sf_dir).collect()
    assert len(got) == queries.read(spark, sf_dir, "documents").count()
    right = [(r.kept == bool(labels[r.doc_id])) for r in got if r.doc_id in labels]
    assert sum(right) >= 0.93 * len(right)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op8_importance_resampling(spark, sf_dir).collect()))
