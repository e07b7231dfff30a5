"""Feature matrix: imputation, scaling, ranges and the train/test split."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reshape import feature_columns, quoted


@dataclass(frozen=True)
class Scaling:
    """Mean and population standard deviation per feature, after imputation."""

    mean: dict[str, float]
    sd: dict[str, float]

    def to_raw(self, feature: str, scaled: float) -> float:
        return scaled * self.sd[feature] + self.mean[feature]


def column_statistics(df: DataFrame, columns: list[str]) -> dict:
    """Count, mean and population variance of all columns in one pass."""
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        x = quoted(c)
        aggregates += [
            F.count(x).alias(f"n{i}"),
            F.avg(x).alias(f"mean{i}"),
            F.var_pop(x).alias(f"var{i}"),
        ]
    row = df.agg(*aggregates).first()
    return {
        "rows": row["rows"],
        **{
            c: {k: row[f"{k}{i}"] for k in ("n", "mean", "var")}
            for i, c in enumerate(columns)
        },
    }


def fit_scaling(df: DataFrame, columns: list[str] | None = None) -> Scaling:
    """Means for imputation and scales for standardisation from one aggregate.

    Imputing the mean leaves the mean alone and shrinks the variance by the
    share of present values, so the second pass over imputed data is not needed.
    A column without any value is left out, with a warning.
    """
    columns = feature_columns(df) if columns is None else columns
    stats = column_statistics(df, columns)
    return scaling_of(stats["rows"], {c: stats[c] for c in columns})


def scaling_of(rows: int, stats: dict[str, dict]) -> Scaling:
    """Scaling from the count, mean and variance (``n``, ``mean``, ``var``) of each feature's present values."""
    mean, sd = {}, {}
    for c, s in stats.items():
        if not s["n"]:
            warnings.warn(f"feature {c!r} has no value and is dropped", stacklevel=2)
            continue
        variance = s["var"] * s["n"] / rows
        rounding = rows * np.finfo(float).eps
        constant = variance <= rounding * variance + (rounding * s["mean"]) ** 2
        mean[c] = s["mean"]
        sd[c] = 1.0 if constant else float(np.sqrt(variance))
    return Scaling(mean, sd)


def impute_mean(df: DataFrame, scaling: Scaling) -> DataFrame:
    return df.withColumns({c: F.coalesce(quoted(c), F.lit(m)) for c, m in scaling.mean.items()})


def standardise(df: DataFrame, scaling: Scaling, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus every scaled feature; a constant feature becomes 0."""
    keep = [c for c in df.columns if c not in scaling.mean] if keep is None else keep
    scaled = [
        ((F.coalesce(quoted(c), F.lit(m)) - F.lit(m)) / F.lit(scaling.sd[c])).alias(c)
        for c, m in scaling.mean.items()
    ]
    return df.select(*[quoted(k) for k in keep], *scaled)


def scale_and_impute(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, Scaling]:
    """Mean-impute, then standardise, all feature columns."""
    scaling = fit_scaling(df, columns)
    drop = set(feature_columns(df) if columns is None else columns)
    keep = [c for c in df.columns if c not in drop]
    return standardise(df, scaling, keep), scaling


def feature_ranges(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(variable, low, high): smallest and largest value per feature."""
    columns = feature_columns(df) if columns is None else columns
    extremes = []
    for c in columns:
        extremes += [F.min(quoted(c)), F.max(quoted(c))]
    low_high = [
        F.struct(
            F.lit(c).alias("variable"),
            extremes[2 * i].cast("double").alias("low"),
            extremes[2 * i + 1].cast("double").alias("high"),
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(F.array(*low_high).alias("ranges")).select(F.inline("ranges"))


def hash_bucket(*key: Column, buckets: int = 1000, seed: int = 42) -> Column:
    """Stable bucket of a row key, independent of partitioning."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets


def is_training_row(*key: Column, test_size: float = 0.3, seed: int = 42) -> Column:
    return hash_bucket(*key, seed=seed) < round(1000 * (1 - test_size))


def assemble(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns plus the vector column ``features``."""
    aliases = [f"f{i}" for i in range(len(columns))]
    plain = df.select(*[quoted(k) for k in keep], *[quoted(c).alias(a) for c, a in zip(columns, aliases)])
    return VectorAssembler(inputCols=aliases, outputCol="features").transform(plain).drop(*aliases)
