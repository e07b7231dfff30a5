import pytest
from conftest import rows
from pyspark.sql import functions as F

import ensemblescope as es

CATEGORIES = ["C1", " C2", "C3", "C8", " C9 ", "failed-vetting", None]


@pytest.mark.parametrize(
    "unmapped, expected",
    [
        ("trimmed", ["1.5", "1.5", "2", "above 2", "C9", "failed-vetting", None]),
        ("raw", ["1.5", "1.5", "2", "above 2", " C9 ", "failed-vetting", None]),
        ("null", ["1.5", None, "2", "above 2", None, "failed-vetting", None]),
    ],
)
def test_buckets(spark, unmapped, expected):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CATEGORIES)], "i int, c string")
    out = df.select("i", es.temp_bucket(F.col("c"), unmapped).alias("b")).orderBy("i").collect()
    assert [r.b for r in out] == expected


def test_unknown_rule_is_an_error():
    with pytest.raises(ValueError):
        es.temp_bucket(F.col("c"), "other")


def test_target(spark):
    df = spark.createDataFrame([("1.5", "C7"), ("2", "C1"), (None, "C2")], "temp_bucket string, category string")
    assert [r[0] for r in df.select(es.binary_target(df)).collect()] == [1, 0, 0]
    by_category = df.select("category")
    assert [r[0] for r in df.select(es.binary_target(by_category)).collect()] == [0, 1, 1]
    with pytest.raises(ValueError):
        es.binary_target(spark.range(1))


def test_display_labels_and_colours(spark):
    df = spark.createDataFrame([("1.5",), ("above 2",), ("no-climate-assessment",), ("x",)], "b string")
    assert [r[0] for r in df.select(es.display_label(F.col("b"))).collect()] == [
        "1.5°C", "Above 2.0°C", "No Climate Assessment", "X"
    ]
    assert [r[0] for r in df.select(es.bucket_colour(F.col("b"))).collect()][3] is None


def test_last_sector_wins_and_default(spark):
    mapping = spark.createDataFrame([("A", "x", 1), ("A", "y", 2)], "variable string, sector string, ordinal int")
    df = spark.createDataFrame([("A",), ("B",)], "variable string")
    assert rows(es.assign_sector(df, mapping)) == [("A", "y"), ("B", "Other")]
    sets = spark.createDataFrame([(7, ["B", "A"])], "sample_id long, variables array<string>")
    assert rows(es.combination_sectors(sets, mapping), "position", "variable", "sector") == [(0, "B", "Unknown"), (1, "A", "y")]


def test_sector_variables(spark):
    mapping = spark.createDataFrame(
        [("B", "s2", 1), ("A", "s1", 2), ("Z", "s3", 3), ("C", "s2", 4), ("B", "s1", 5)], "variable string, sector string, ordinal int"
    )
    cells = spark.createDataFrame([("A",), ("B",), ("C",)], "variable string")
    assert list(es.sector_variables(mapping, cells).items()) == [("s2", ["B", "C"]), ("s1", ["A", "B"])]
    assert rows(es.absent_sector_variables(mapping, cells), "variable") == [("Z",)]
    with pytest.raises(ValueError):
        es.sector_variables(mapping, cells.where("false"))


def test_two_labels_multiply_rows(spark):
    df = spark.createDataFrame([("m", "s", 1)], "model string, scenario string, x int")
    labels = spark.createDataFrame([("m", "s", "C1"), ("m", "s", "C3"), ("m", "s", "C1")], "model string, scenario string, category string")
    assert rows(es.attach_category_map(df, labels), "temp_bucket") == [("1.5",), ("2",)]


def test_value_counts_skip_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "c string")
    assert [tuple(r) for r in es.value_counts(df, "c").collect()] == [("b", 2), ("a", 1)]
