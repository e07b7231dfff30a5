import numpy as np
import pytest
from conftest import rows

import ensemblescope as es

SCHEMA = "model string, scenario string, variable string, year int, value double"


@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(1)
    table = {
        (f"s{s}", f"v{v}", y): float(rng.normal())
        for s in range(20) for v in range(6) for y in (2030, 2040, 2050)
        if rng.random() < 0.6 and (v, y) != (5, 2050)
    }
    df = spark.createDataFrame([("m", s, v, y, x) for (s, v, y), x in table.items()], SCHEMA).repartition(5)
    return df, table


def brute_coverage(table, variable, years):
    scenarios = {s for s, _, _ in table}
    return sum(all((s, variable, y) in table for y in years) for s in scenarios)


@pytest.mark.parametrize("years", [[2030], [2030, 2050], [2030, 2040, 2050]])
def test_coverage_table(sparse, years):
    df, table = sparse
    expected = sorted((f"v{v}", brute_coverage(table, f"v{v}", years)) for v in range(6))
    out = es.coverage_by_variable(df, years)
    assert rows(out) == expected
    counts = [r.coverage for r in out.collect()]
    assert counts == sorted(counts)


def test_coverage_of_one_variable(sparse):
    df, table = sparse
    assert rows(es.coverage_of(df, "v2", [2030, 2050])) == [("v2", brute_coverage(table, "v2", [2030, 2050]))]
    assert rows(es.coverage_of(df, "v5", [2030, 2050])) == [("v5", 0)]
    assert rows(es.coverage_of(df, "nope", [2030])) == [("nope", 0)]


def test_coverage_over_more_years_than_a_word_has_bits(spark):
    years = list(range(1900, 2030))
    data = [("m", "full", "A", y, 1.0) for y in years] + [("m", "part", "A", y, 1.0) for y in years[:-1]]
    assert rows(es.coverage_by_variable(spark.createDataFrame(data, SCHEMA), years)) == [("A", 1)]


def complete(table, variables, years, need):
    scenarios = {s for s, _, _ in table}
    return sorted(s for s in scenarios if sum((s, v, y) in table for v in variables for y in years) >= need)


def test_completeness_filter_uses_the_columns_that_exist(sparse):
    df, table = sparse
    variables, years = ["v0", "v1", "v5"], [2030, 2050]
    out = es.complete_scenarios(df, variables, years, 0.5)
    # v5 has no 2050 column: five columns, int(2.5) = 2 cells are needed.
    assert out.columns[2:] == ["v0 (2030)", "v0 (2050)", "v1 (2030)", "v1 (2050)", "v5 (2030)"]
    assert [r[0] for r in rows(out, "scenario")] == complete(table, variables, years, 2)
    assert rows(es.count_complete(df, variables, years, 0.5)) == [(0,)]
    full = complete(table, ["v0", "v1"], years, 3)
    assert rows(es.count_complete(df, ["v0", "v1"], years, 0.8)) == [(len(full),)]


def test_no_column_is_an_error_and_no_scenario_an_empty_table(spark, sparse):
    df, _ = sparse
    with pytest.raises(ValueError):
        es.complete_scenarios(df, ["nope"], [2030])
    one = spark.createDataFrame([("m", "a", "A", 2030, 1.0), ("m", "b", "B", 2030, 1.0)], SCHEMA)
    assert es.complete_scenarios(one, ["A", "B"], [2030], 1.0).count() == 0
