import math

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import ensemblescope as es
from ensemblescope.functions.names import flat_name, parse_flat_name, parsed_variable, parsed_year

LONG = "model string, scenario string, region string, variable string, year int, value double, category string, input_order int"
SEVEN = [
    ("M1", "S1", "World", "A|x", 2030, None, "C1", 1),
    ("M1", "S1", "World", "A|x", 2030, 5.0, "C1", 2),
    ("M1", "S1", "World", "B", 2030, 1.0, "C1", 3),
    ("M2", "S1", "World", "A|x", 2030, 2.0, "C3", 4),
    ("M2", "S1", "World", "B", 2030, None, "C3", 5),
    ("M3", "S1", "World", "A|x", 2030, 9.0, None, 6),
    ("M4", "S1", "World", "A|x", 2030, None, "C5", 7),
]


def test_pivot_of_the_unit_fixture(spark):
    cells = es.first_cells(es.tidy(spark.createDataFrame(SEVEN, LONG)))
    wide = es.pivot_cells(cells, es.present_columns(cells))
    assert wide.columns[4:] == ["A|x (2030)", "B (2030)"]
    assert rows(wide) == [("M1", "S1", "World", "1.5", 5.0, 1.0), ("M2", "S1", "World", "2", 2.0, None)]
    assert rows(es.shape_report(cells)) == [(2, 2)]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([("M", "S", "A", 2030, math.nan), ("M", "S", "A", 2030, 3.0)], "model string, scenario string, variable string, year int, value double")
    assert rows(es.first_cells(es.tidy(df), rule="smallest"), "value") == [(3.0,)]


def test_result_does_not_depend_on_partitions(spark):
    data = [("M", f"S{i % 3}", "A", 2030, float(i), i) for i in range(60)]
    df = spark.createDataFrame(data, "model string, scenario string, variable string, year int, value double, input_order int")
    results = {tuple(rows(es.first_cells(es.tidy(df.repartition(n))))) for n in (1, 4, 17)}
    assert len(results) == 1


def test_unpivot_keeps_missing_values(spark):
    df = spark.createDataFrame([("M", "S", "A", "1.5", None)], "Model string, Scenario string, Variable string, `2030` string, `2050` double")
    assert rows(es.tidy(df)) == [("M", "S", "A", 2030, 1.5), ("M", "S", "A", 2050, None)]


NAMES = [
    ("Secondary Energy|Electricity (2030)", "Secondary Energy|Electricity", 2030),
    ("Renewables (incl. Biomass) (2030)", "Renewables (incl. Biomass)", 2030),
    ("Price (USD)", "Price (USD)", None),
    ("plain", "plain", None),
    ("A ( 2030 )", "A", 2030),
]


def test_name_codec(spark):
    df = spark.createDataFrame(NAMES, "name string, v string, y int")
    parsed = df.select("name", parsed_variable(F.col("name")), parsed_year(F.col("name")))
    assert rows(parsed) == sorted(NAMES, key=repr)
    assert [parse_flat_name(n) for n, _, _ in NAMES] == [(v, y) for _, v, y in NAMES]
    assert parse_flat_name("('A|b', '2030')") == ("A|b", 2030)
    assert rows(df.where("y is not null").select(flat_name(F.lit("A"), F.col("y")))) == [("A (2030)",)] * 3


def test_wide_layout_keeps_its_keys(spark):
    df = spark.createDataFrame([("M", "S", "C1", 1.0, 2.0, 7.0)], "Model string, Scenario string, Category string, `A (2030)` double, `A (2050)` double, `Price (USD)` double")
    long = es.tidy(df)
    assert rows(long, "temp_bucket", "variable", "year", "value") == [
        ("1.5", "A", 2030, 1.0), ("1.5", "A", 2050, 2.0), ("1.5", "Price (USD)", None, 7.0)
    ]
    assert es.first_cells(long, rule="smallest").count() == 2
    with pytest.raises(ValueError, match="input_order"):
        es.first_cells(long)


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([("A", 2030, 1.0)], "variable string, year int, value double")
    with pytest.raises(ValueError, match="model"):
        es.tidy(df)


def test_feature_columns(spark):
    df = spark.createDataFrame([], "model string, scenario string, region string, Category string, temp_bucket string, cluster int, `A (2030)` double")
    assert es.feature_columns(df) == ["A (2030)"]


CELLS = st.dictionaries(
    st.tuples(st.sampled_from(["s1", "s2", "s3"]), st.sampled_from(["A|x", "B (y)", "C"]), st.sampled_from([2030, 2050])),
    st.floats(-1e6, 1e6),
    min_size=1,
)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(CELLS)
def test_pivot_and_unpivot_are_inverse(spark, cells):
    data = [("m", s, v, y, x) for (s, v, y), x in cells.items()]
    long = spark.createDataFrame(data, "model string, scenario string, variable string, year int, value double")
    wide = es.pivot_cells(long, es.present_columns(long))
    assert rows(es.first_cells(es.tidy(wide), rule="smallest")) == rows(long)
