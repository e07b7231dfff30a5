import zlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
from llm_helpers import no_docs, no_labels, odd_docs, plain  # noqa: F401
from pyspark.sql import functions as F

from ensemblescope.llm import queries, toxic_cnn as cnn
from ensemblescope.llm.common import utf8_view


def parts(texts):
    return cnn.features(*utf8_view(pa.array(texts)))


def test_words_and_beginnings():
    found, first = parts(["Stupid, stupidly!", "", "réeux", "stupid"])
    assert first.tolist() == [0, 2, 2, 3, 4]
    assert (found[0] == found[3]).all()
    shared = len([b for b in cnn.BEGINNINGS if b <= 6])
    assert (found[0][1 : shared + 1] == found[1][1 : shared + 1]).all() and found[0][0] != found[1][0]
    assert (found[0][shared + 1 :] == -1).all()


def brute_score(rows, model):
    """Every filter at every window, word by word."""
    padded = np.concatenate([rows, np.zeros((2 + (len(rows) == 0), rows.shape[1]), rows.dtype)])
    words = [sum(model.vectors[s].astype(float) for s in r) for r in padded]
    best, column = [], 0
    for k, width in enumerate(cnn.WIDTHS):
        for f in range(cnn.FILTERS):
            weights = [model.filters[:, column + j] for j in range(width)]
            column += width
            answers = [sum(float(words[i + j] @ weights[j]) for j in range(width)) for i in range(len(words) - 2)]
            best.append(max(0.0, max(answers) + float(model.bias[k * cnn.FILTERS + f])))
    return 1 / (1 + np.exp(-(np.array(best) @ model.output + model.offset)))


def some_model(seed=3, n=40):
    model = cnn.fresh(np.arange(n), 0.3, seed)
    return replace(model, vectors=model.vectors * 10)


def test_score_equals_brute_force(monkeypatch):
    model, draw = some_model(), np.random.default_rng(1)
    monkeypatch.setattr(cnn, "BLOCK", 7)
    for n in (0, 1, 2, 6, 7, 8, 30):
        rows = draw.integers(0, 41, (n, 8)).astype(np.int32)
        assert abs(cnn.score_text(rows, model) - brute_score(rows, model)) < 1e-5


def test_gradient_equals_differences():
    model, draw = some_model(), np.random.default_rng(2)
    texts = [draw.integers(0, 41, (n, 8)).astype(np.int32) for n in (0, 3, 9, 12)]
    toxic = np.array([0, 1, 0, 1], np.float32)
    _, used, vectors, filters, bias, output, offset = cnn.loss_gradient(texts, toxic, model)

    def loss(m):
        p = np.clip([brute_score(t, m) for t in texts], 1e-12, 1 - 1e-12)
        return -np.mean(toxic * np.log(p) + (1 - toxic) * np.log(1 - p))

    def slope(field, at, step=1e-3):
        values = []
        for sign in (1, -1):
            changed = getattr(model, field).astype(np.float64)
            changed[at] += sign * step
            values.append(loss(replace(model, **{field: changed})))
        return (values[0] - values[1]) / (2 * step)

    for at in ((0, 0), (3, 20), (9, 60), (15, 95)):
        assert abs(slope("filters", at) - filters[at]) < 2e-3
    for at in (0, 17, 47):
        assert abs(slope("bias", at) - bias[at]) < 2e-3 and abs(slope("output", at) - output[at]) < 2e-3
    for k in (1, len(used) - 1):
        assert abs(slope("vectors", (used[k], 4)) - vectors[k, 4]) < 2e-3
    assert abs((loss(replace(model, offset=model.offset + 1e-3)) - loss(replace(model, offset=model.offset - 1e-3))) / 2e-3 - offset) < 2e-3


def test_shards_are_averaged(spark):
    bad, good = "you utter moron {} go away", "you kind friend {} come here"
    texts = [((bad if k % 2 else good).format(f"w{k % 7}"), k % 2, float(k)) for k in range(120)]
    sample = spark.createDataFrame(texts, "text string, toxic int, key double").repartition(3)
    model = cnn.fit(sample, shard=40)
    again = cnn.fit(sample.repartition(5), shard=40)
    assert np.array_equal(model.vectors, again.vectors) and model.offset == again.offset
    docs = spark.createDataFrame([(1, "what a moron"), (2, "hello friend"), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in cnn.score_documents(docs, model).collect()}
    assert got[1] > 0.7 > 0.5 > got[2]


def test_common_features_come_first(spark):
    texts = [("aa bb", 0, 1.0), ("aa bb", 0, 2.0), ("aa cc", 0, 3.0), ("aa", 0, 4.0)]
    sample = spark.createDataFrame(texts, "text string, toxic int, key double")
    (aa, bb), _ = (parts(["aa bb"])[0][:, 0], 0)
    assert cnn.embedded_buckets(sample, least=2).tolist() == sorted([aa, bb])
    assert cnn.embedded_buckets(sample, least=2, most=1).tolist() == [aa]
    assert cnn.embedded_buckets(sample, least=9).tolist() == []


def test_odd_documents(odd_docs, no_docs, no_labels, spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (5, 0, 0), (2, 0, None), (None, 0, 1), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    sample = cnn.labelled_sample(odd_docs, labels, F.lit(True))
    assert sorted((r.text[:5], r.toxic) for r in sample.collect()) == [("alpha", 1), ("alpha", 1), ("long ", 0), ("é ß Σ", 0)]
    assert cnn.labelled_sample(odd_docs, labels, F.lit(True), most=0).count() == 0
    model = cnn.fit(sample)
    clash = odd_docs.withColumn("_text", F.lit(7)).withColumn("toxic", F.lit("mine"))
    found = cnn.score_documents(clash, model)
    assert set(found.columns) == set(clash.columns) and found.count() == 9
    scores = {r.doc_id: r.score for r in found.collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[2] == scores[3] == scores[4]
    untrained = cnn.fit(cnn.labelled_sample(no_docs, no_labels, F.lit(True)))
    assert {r.score for r in cnn.score_documents(odd_docs, untrained).collect()} == {0.5}
    assert cnn.score_documents(no_docs, model).count() == 0


def test_limits_by_language(spark):
    rows = [("en", 0.9 if k % 2 else 0.1, k % 2) for k in range(400)]
    rows += [("de", 0.8 if k % 2 else 0.6, k % 2) for k in range(400)]
    rows += [("xx", 0.5, 1), (None, 0.95, 1), (None, 0.2, 0), ("en", 0.99, None)]
    table = spark.createDataFrame(rows, "lang string, score double, toxic int").repartition(4)
    got = {r.lang: r.threshold for r in cnn.calibrate(table).collect()}
    assert set(got) == {"en", "de", "xx", None}
    assert 0.1 < got["en"] and 0.6 < got["de"] <= 0.8
    # One document says little: the precision of all languages at its score is what counts.
    assert got["xx"] == 1.0 and got[None] == 0.95
    assert cnn.calibrate(table.limit(0)).count() == 0


def test_query_on_held_out_documents(spark, sf_dir):
    got = queries.op13_toxic_cnn(spark, sf_dir)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    found = {r.doc_id: r for r in got.collect()}
    docs = [r.doc_id for r in queries.read(spark, sf_dir, "documents").select("doc_id").collect()]
    assert sorted(found) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for i, r in found.items())
    labels = {r.doc_id: r.toxic for r in queries.read(spark, sf_dir, "labels").collect()}
    known = [i for i in labels if i in found and not found[i].held_out]
    assert sum(found[i].predicted == labels[i] for i in known) >= 0.9 * len(known)
    assert plain(queries.op13_toxic_cnn(spark, sf_dir)) == plain(got)
