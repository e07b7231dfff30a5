"""Codec between (variable, year) and the flat column name ``variable (year)``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import BLANKS

# A flat name, and a two-level name written as text.
FLAT_NAME = r"(?s)^(.*)\(\s*([+-]?\d+)\s*\)*$"
TUPLE_NAME = r"(?s)^\('(.*)', '?(\d+)'?\)$"


def flat_name(variable: Column, year: Column) -> Column:
    return F.concat(variable, F.lit(" ("), year.cast("string"), F.lit(")"))


def parsed_variable(name: Column) -> Column:
    """Variable part of a flat name; the whole name when it carries no year."""
    variable = F.btrim(F.regexp_extract(name, FLAT_NAME, 1), F.lit(BLANKS))
    return F.when(_has_year(name), variable).otherwise(name)


def parsed_year(name: Column) -> Column:
    """Year part of a flat name as int, null when there is none."""
    return F.when(_has_year(name), F.regexp_extract(name, FLAT_NAME, 2).try_cast("int"))


def _has_year(name: Column) -> Column:
    return name.contains(")") & name.rlike(FLAT_NAME)


def parse_flat_name(name: str) -> tuple[str, int | None]:
    """The same rule for a column header, which lives on the driver."""
    match = re.match(TUPLE_NAME, name) or (")" in name and re.match(FLAT_NAME, name))
    if not match:
        return name, None
    return match[1].strip(), int(match[2])
