"""Outcome labels: category -> bucket -> binary target -> display text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import (
    BLANKS,
    BUCKET_COLOURS,
    BUCKET_LABELS,
    CATEGORY_BUCKETS,
    TARGET_BUCKET,
    TARGET_CATEGORIES,
)


def lookup(mapping: dict, key: Column) -> Column:
    """Value of ``key`` in a small constant mapping, null when absent."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])[key]


def temp_bucket(category: Column, unmapped: str = "trimmed") -> Column:
    """Temperature bucket of a category.

    ``unmapped`` says what a category outside the map becomes: ``'trimmed'``
    or ``'raw'`` keep it (without or with the blanks around it), ``'null'``
    drops it and also accepts no blanks around known categories.
    """
    trimmed = F.btrim(category, F.lit(BLANKS))
    if unmapped == "null":
        return lookup(CATEGORY_BUCKETS, category)
    if unmapped == "raw":
        return F.coalesce(lookup(CATEGORY_BUCKETS, trimmed), category)
    if unmapped == "trimmed":
        return F.coalesce(lookup(CATEGORY_BUCKETS, trimmed), trimmed)
    raise ValueError(f"unmapped must be 'trimmed', 'raw' or 'null', not {unmapped!r}")


def binary_target(df: DataFrame) -> Column:
    """1 for the target bucket (or, without buckets, its categories), else 0.

    A null label counts as 0. Raises when ``df`` has neither column.
    """
    if "temp_bucket" in df.columns:
        hit = F.col("temp_bucket") == TARGET_BUCKET
    elif "category" in df.columns:
        hit = F.col("category").isin(*TARGET_CATEGORIES)
    else:
        raise ValueError("no temp_bucket or category column to build a target from")
    return F.coalesce(hit, F.lit(False)).cast("int")


def display_label(bucket: Column) -> Column:
    """Text shown for a bucket: fixed labels, else blanks for dashes, title case."""
    return F.coalesce(
        lookup(BUCKET_LABELS, bucket),
        F.initcap(F.replace(bucket, F.lit("-"), F.lit(" "))),
    )


def bucket_colour(bucket: Column) -> Column:
    return lookup(BUCKET_COLOURS, bucket)


def cluster_label(cluster: Column, mapping: dict, default: str = "Unknown") -> Column:
    """Label of a cluster id, ``default`` for ids outside the mapping."""
    if not mapping:
        return F.lit(default)
    return F.coalesce(lookup(mapping, cluster), F.lit(default))
