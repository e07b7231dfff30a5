"""Header normalisation, format detection and column checks (driver side)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..functions.fixed_values import CATEGORY_MAP_HEADERS, HEADER_NAMES

LONG, SEMI_WIDE, WIDE = "long", "semi_wide", "wide"


def normalise_headers(df: DataFrame) -> DataFrame:
    """Lower-case the known header names; every other column keeps its name."""
    return df.withColumnsRenamed(
        {c: c.lower() for c in df.columns if c.lower() in HEADER_NAMES and c != c.lower()}
    )


def alias_category_headers(df: DataFrame) -> DataFrame:
    """Singular/plural, any-case headers of a category map -> canonical names."""
    return df.withColumnsRenamed(
        {c: CATEGORY_MAP_HEADERS[c.lower()] for c in df.columns if c.lower() in CATEGORY_MAP_HEADERS}
    )


def require_columns(df: DataFrame, required, what: str = "table") -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}, found {df.columns}")
    return df


def year_columns(columns) -> list[str]:
    return [c for c in columns if re.fullmatch(r"[0-9]{4}", c)]


def bracket_columns(columns) -> list[str]:
    return [c for c in columns if "(" in c and ")" in c]


def detect_format(df: DataFrame) -> str:
    """``long``, ``semi_wide`` (a column per year) or ``wide`` (name and year)."""
    columns = set(df.columns)
    if {"variable", "year", "value"} <= columns:
        return LONG
    if "variable" in columns and year_columns(df.columns):
        return SEMI_WIDE
    if bracket_columns(df.columns):
        return WIDE
    raise ValueError(
        "unknown layout: expected variable/year/value columns, a variable column with "
        f"four-digit year columns, or 'name (year)' columns; found {df.columns}"
    )


def scenario_keys(columns) -> list[str]:
    """Columns that identify one scenario row.

    model and scenario, plus region and temp_bucket when present; category only
    counts when there is no temp_bucket.
    """
    keys = ["model", "scenario"]
    if "region" in columns:
        keys.append("region")
    if "temp_bucket" in columns:
        keys.append("temp_bucket")
    elif "category" in columns:
        keys.append("category")
    return keys
