import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

import ensemblescope as es
from ensemblescope.operators import features


def test_scaling(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(5, 3, size=(40, 3))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 2] = 0.1
    data = [(f"s{i}", *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(data, "scenario string, `A|x (2030)` double, `B.c (2030)` double, C double").repartition(5)
    scaled, scaling = es.scale_and_impute(df)
    filled = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    expected = (filled - filled.mean(axis=0)) / np.where(filled.std(axis=0) < 1e-12, 1, filled.std(axis=0))
    out = np.array([r[1:] for r in sorted(scaled.collect(), key=lambda r: int(r.scenario[1:]))])
    assert np.allclose(out, expected, atol=1e-12)
    assert scaled.columns == df.columns
    assert scaling.to_raw("B.c (2030)", out[0, 1]) == pytest.approx(filled[0, 1])
    imputed = features.impute_mean(df, scaling)
    assert imputed.where("`A|x (2030)` is null").count() == 0


def test_a_feature_without_values_is_dropped(spark):
    df = spark.createDataFrame([("s", 1.0, None)], "scenario string, a double, b double")
    with pytest.warns(UserWarning, match="'b'"):
        scaled, _ = es.scale_and_impute(df)
    assert scaled.columns == ["scenario", "a"]


def test_ranges(spark):
    df = spark.createDataFrame([(1.0, 5), (3.0, 4)], "a double, b int")
    assert rows(es.feature_ranges(df)) == [("a", 1.0, 3.0), ("b", 4.0, 5.0)]


def test_split_is_stable_and_near_its_share(spark):
    df = spark.range(5000).withColumn("t", es.is_training_row(F.col("id")))
    first = {r.id for r in df.where("t").collect()}
    again = {r.id for r in df.repartition(9).where("t").collect()}
    assert first == again and 0.67 < len(first) / 5000 < 0.73
