import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from ensemblescope.llm import queries
from ensemblescope.session import materialise
from llm_helpers import no_docs, odd_docs  # noqa: F401


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    docs = queries.read(spark, sf_dir, "documents")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], sf_dir), "stage"))
    return out


def test_stages_return_the_columns_of_documents(staged):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mix", "tokens"]
    assert all(s.columns == staged[0].columns and s.dtypes == staged[0].dtypes for s in staged[1:-1])


def test_each_decision_takes_effect(spark, sf_dir, staged):
    start, good, single, clean, mixed, tokens = staged
    kept = {r.doc_id for r in queries.op8_importance_resampling(spark, sf_dir).collect() if r.kept}
    assert {r.doc_id for r in good.collect()} == kept
    found = {r.doc_id: r.class_id for r in queries.prob_minhash.near_duplicates(good).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(found.values()))
    before, after = ({r.doc_id: r for r in t.collect()} for t in (single, clean))
    assert before.keys() == after.keys()
    spans = {r.doc_id: r.spans for r in queries.secret_dfa.find_secrets(single).collect()}
    for i, r in after.items():
        assert (r.text == before[i].text) == (not spans[i]) and r.n_chars == len(r.text)
    plan = {r.doc_id: r.copies for r in queries.mixing.mix_documents(clean, queries.read(spark, sf_dir, "labels")).collect()}
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert times == {i: c for i, c in plan.items() if c}
    assert tokens.count() == mixed.count()
    assert tokens.where(F.size("token_ids") != F.col("n_tokens")).count() == 0


def test_run_gives_the_last_stage(spark, sf_dir, staged):
    columns = ["doc_id", "n_tokens", "ids_sha256"]
    key = lambda t: sorted(tuple(r) for r in t.select(*columns).collect())
    assert key(pipeline.run(spark, sf_dir)) == key(staged[-1])


def test_odd_documents_pass(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        table = docs
        for _, stage in pipeline.STAGES[:-1]:
            table = materialise(stage(spark, table, sf_dir), "stage")
            assert table.columns == docs.columns
        assert pipeline.STAGES[-1][1](spark, table, sf_dir).count() == table.count()
    assert pipeline.near_duplicates(spark, odd_docs, sf_dir).count() == 6


def test_secrets_are_masked_and_lengths_follow(spark, sf_dir):
    rows = [(1, "é token=abcdef0123 end", "en", "a", 22), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.secrets(spark, docs, sf_dir).collect()}
    assert got == {1: ("é [assign] end", 14), 2: (None, None)}
