import inspect

import pytest
from check_oracle import connect, difference

import __spark_entry__ as entry

# The quick ones; check_oracle.py runs all of them on a larger table.
QUICK = [
    "coverage_table", "completeness_filter", "roundtrip_wide", "corr_pairs", "valid_counts_all_sets",
    "standardise", "box_stats", "box_trajectory", "pca_scores", "per_combination_files", "mixed_case_headers", "box_rank", "peel_candidates", "class_metrics", "cluster_quartiles", "csv_round_trip",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, sf_dir, con, name):
    rows = entry.queries()[name](spark, sf_dir).toPandas()
    assert difference(rows, con.execute(entry.oracle_sql()[name]).df()) is None


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(len(inspect.signature(q).parameters) == 2 for q in entry.queries().values())


def test_entry(spark):
    assert entry.entry(spark).columns == ["variable", "coverage"]


def test_bench_names_exist():
    import bench

    assert set(bench.HEADLINE) <= set(entry.queries())


def test_combination_report_runs_the_default_work():
    options, default = entry.report_options(), entry.study.StudyOptions()
    assert options.num_combinations == default.num_combinations == 10 and options.num_samples == default.num_samples == 1000
    assert options.boosted_trees == options.forest == {}
