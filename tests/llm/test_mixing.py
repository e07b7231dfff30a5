import duckdb
import pytest

from llm_helpers import no_docs, no_labels, odd_docs, plain  # noqa: F401

from ensemblescope.llm import queries
from ensemblescope.llm.mixing import MIX_SQL, budgets, mix, mix_documents
from ensemblescope.session import materialise


def brute_budgets(sizes, weights=(1, 2, 3), most=3.0):
    """Share by weight, stop at the limits, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free} if free else {}
        above = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not above:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 2, "c": 100, "d": 0, None: 40}, {"x": 7}, {"b": 1, "a": 1000, "c": 3, "d": 5}])
def test_budgets_equal_sharing_again_and_again(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in budgets(table).collect()}
    want = brute_budgets(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_hot_source_is_cut_in_the_right_place(spark):
    rows = [(k, "hot" if k % 3 else "small", 1 + k % 17, 1.0 + k % 2) for k in range(3000)]
    items = materialise(spark.createDataFrame(rows, "row_key bigint, source string, size bigint, quality double"))
    got = {r.row_key: r for r in mix(items, weights=(1, 9), slices=8).collect()}
    assert got == {r.row_key: r for r in mix(items, weights=(1, 9), slices=4096).collect()}
    for source in ("hot", "small"):
        own = sorted((r for r in got.values() if r.source == source), key=lambda r: r.sample_key)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 17
        extra = [r.copies - r.epochs for r in own]
        assert extra == sorted(extra, reverse=True) and all(r.copies <= 3 for r in own)


def test_better_documents_come_first(spark):
    rows = [(k, "s", 1, 2.0 if k % 2 else 0.5) for k in range(4000)] + [(-1, "t", 1200, 1.0)]
    items = materialise(spark.createDataFrame(rows, "row_key bigint, source string, size bigint, quality double"))
    chosen = [r for r in mix(items, weights=(1, 2)).collect() if r.source == "s"]
    taken = [r for r in chosen if r.copies > r.epochs]
    good = sum(r.quality == 2.0 for r in taken)
    assert 0 < len(taken) < len(chosen) and good > 1.2 * (len(taken) - good)


def test_odd_documents(spark, odd_docs, no_docs, no_labels):
    got = mix_documents(odd_docs, no_labels).collect()
    assert len(got) == 9 and all(r.taken <= 3 * r.size for r in got)
    assert {r.size for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert mix_documents(no_docs, no_labels).count() == 0
    empty = odd_docs.where("doc_id in (2, 3)")
    assert {r.taken for r in mix_documents(empty, no_labels).collect()} == {0}


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    want = con.sql(f"select {', '.join(columns)} from ({MIX_SQL})").fetchall()
    assert plain(queries.op5_weighted_mix(spark, sf_dir), *columns) == sorted(want, key=repr)
