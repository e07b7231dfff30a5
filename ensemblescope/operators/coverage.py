"""How complete the scenarios are: coverage tables and completeness filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reshape import filled_rows, keys_of, pivot_cells, present_columns, quoted, restrict, small_table

WORD_BITS = 62


def year_words(years: list[int]) -> list[Column]:
    """One bigint aggregate per 62 years, a bit for each year seen."""
    words = []
    for start in range(0, len(years), WORD_BITS):
        bits = [
            F.when(F.col("year") == y, F.lit(1 << i).cast("bigint"))
            for i, y in enumerate(years[start : start + WORD_BITS])
        ]
        words.append(F.bit_or(F.coalesce(*bits, F.lit(0).cast("bigint"))))
    return words


def coverage_by_variable(cells: DataFrame, years: list[int], keys: list[str] | None = None) -> DataFrame:
    """(variable, coverage): scenarios with a value in all the years.

    Every variable seen in any of the years is listed, least covered first. A
    variable that lacks one of the years altogether has coverage 0. The years of
    a scenario are collected as bits, so both aggregations combine before their
    shuffle and take input with or without duplicate cells.
    """
    keys = keys or keys_of(cells)
    years = sorted(set(years))
    words = [w.alias(f"w{i}") for i, w in enumerate(year_words(years))]
    seen = filled_rows(restrict(cells, years=years), keys).groupBy(*keys, "variable").agg(*words)
    full = reduce(
        lambda a, b: a & b,
        [
            F.col(f"w{i}") == (1 << len(years[s : s + WORD_BITS])) - 1
            for i, s in enumerate(range(0, len(years), WORD_BITS))
        ],
    )
    return (
        seen.groupBy("variable")
        .agg(F.count_if(full).alias("coverage"))
        .orderBy("coverage", "variable")
    )


def coverage_of(cells: DataFrame, variable: str, years: list[int], keys: list[str] | None = None) -> DataFrame:
    """One row (variable, coverage); 0 for a variable that is not there."""
    table = coverage_by_variable(cells.where(F.col("variable") == variable), years, keys)
    return table.agg(
        F.lit(variable).alias("variable"),
        F.coalesce(F.max("coverage"), F.lit(0)).cast("bigint").alias("coverage"),
    )


def needed_cells(n_columns: int, threshold: float) -> int:
    """Cells a scenario must fill; the product is truncated, not rounded up."""
    return int(n_columns * threshold)


def filled(columns: list[str]) -> Column:
    """Number of non-null cells of a row."""
    return reduce(lambda a, b: a + b, [quoted(c).isNotNull().cast("int") for c in columns])


def all_scenarios(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row (n_scenarios): scenarios with any value at all."""
    return filled_rows(cells, keys).agg(F.count_distinct(*keys).alias("n_scenarios"))


def presence_patterns(
    cells: DataFrame, columns: list[tuple[str, int]], keys: list[str] | None = None
) -> DataFrame:
    """Distinct presence patterns over ``columns`` and how many scenarios show them.

    A pattern is a row of bigint words with 62 columns each. Scenarios with no
    value in any of the columns are not in the result. Both aggregations combine
    before their shuffle; duplicates do not matter.
    """
    keys = keys or keys_of(cells)
    index = small_table(
        cells.sparkSession,
        [(v, y, i // WORD_BITS, 1 << (i % WORD_BITS)) for i, (v, y) in enumerate(columns)],
        "variable string, year int, word int, bit bigint",
    )
    n_words = -(-len(columns) // WORD_BITS)
    words = [
        F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}")
        for w in range(n_words)
    ]
    years = sorted({y for _, y in columns})
    return (
        filled_rows(restrict(cells, [v for v, _ in columns], years), keys)
        .join(index, ["variable", "year"])
        .groupBy(*keys)
        .agg(*words)
        .groupBy(*[f"w{w}" for w in range(n_words)])
        .agg(F.count(F.lit(1)).alias("n"))
    )


def complete_scenarios(
    cells: DataFrame,
    variables: list[str],
    years: list[int],
    threshold: float = 0.8,
    keys: list[str] | None = None,
) -> DataFrame:
    """Wide table of the scenarios that fill enough of the existing columns."""
    found = set(present_columns(cells, variables, years, keys))
    columns = [(v, y) for v in variables for y in years if (v, y) in found]
    if not columns:
        raise ValueError("none of the requested variable and year pairs is in the data")
    wide = pivot_cells(cells, columns, keys)
    names = [f"{v} ({y})" for v, y in columns]
    need = needed_cells(len(names), threshold)
    if need <= 0:
        # Nothing is required, so scenarios without any of the columns stay too.
        keys = keys or keys_of(cells)
        return filled_rows(cells, keys).select(*keys).distinct().join(wide, keys, "left")
    return wide.where(filled(names) >= need)


def count_complete(
    cells: DataFrame,
    variables: list[str],
    years: list[int],
    threshold: float = 0.8,
    keys: list[str] | None = None,
) -> DataFrame:
    """One row (n_scenarios): complete scenarios, 0 if any column is missing.

    Works on presence bits: no wide table is built and duplicates do not matter.
    """
    keys = keys or keys_of(cells)
    variables, years = list(dict.fromkeys(variables)), list(dict.fromkeys(years))
    columns = [(v, y) for v in variables for y in years]
    need = needed_cells(len(columns), threshold)
    if len(present_columns(cells, variables, years, keys)) < len(columns):
        return cells.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n_scenarios"))
    if need <= 0:
        return all_scenarios(cells, keys)
    patterns = presence_patterns(cells, columns, keys)
    bits = reduce(lambda a, b: a + b, [F.bit_count(w) for w in patterns.columns if w != "n"])
    return patterns.where(bits >= need).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_scenarios"))
