"""Between the three table layouts and the canonical long table.

A *long* table has key columns, ``variable``, ``year`` and ``value``. *Cells*
are the long table after duplicates are resolved: at most one non-null value
for each (keys, variable, year). Operators that only ask whether a cell is
filled also take a long table, which saves resolving the duplicates.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.labels import temp_bucket
from ..functions.names import parse_flat_name
from ..sources.readers import INPUT_ORDER
from ..sources.schema import (
    LONG,
    SEMI_WIDE,
    WIDE,
    detect_format,
    normalise_headers,
    require_columns,
    scenario_keys,
    year_columns,
)

NOT_FEATURES = ("model", "scenario", "region", "category", "temp_bucket", "cluster")
_ID_COLUMNS = ("model", "scenario", "region", "unit", "category", "temp_bucket", INPUT_ORDER)


def quoted(name: str) -> Column:
    """Column by its exact name (flat names hold dots, bars and brackets)."""
    return F.col(f"`{name}`")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Driver-side rows as a DataFrame.

    Built from an Arrow table, so that a small one becomes a local relation
    whose true size is known when joins are planned; nothing is forced, and a
    large one is joined like any other table.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow))


# -- to the long layout ---------------------------------------------------------


def unpivot_years(df: DataFrame) -> DataFrame:
    """One row per four-digit year column; missing values are kept."""
    years = year_columns(df.columns)
    ids = [quoted(c) for c in df.columns if c not in years]
    doubles = [quoted(y).cast("double").alias(y) for y in years]
    long = df.select(*ids, *doubles).unpivot(ids, [quoted(y) for y in years], "year", "value")
    return long.withColumn("year", F.col("year").cast("int"))


def unpivot_names(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per ``name (year)`` column; other non-key columns get a null year.

    Header names are parsed once on the driver, not once per row.
    """
    keys = [c for c in df.columns if c in _ID_COLUMNS] if keys is None else keys
    cells = []
    for name in df.columns:
        if name in keys:
            continue
        variable, year = parse_flat_name(name)
        cells.append(
            F.struct(
                F.lit(variable).alias("variable"),
                F.lit(year).cast("int").alias("year"),
                quoted(name).cast("double").alias("value"),
            )
        )
    return df.select(*[quoted(k) for k in keys], F.inline(F.array(*cells)))


def tidy(df: DataFrame, unmapped: str = "trimmed") -> DataFrame:
    """Any of the three layouts -> the canonical long table.

    The result has the key columns (see ``scenario_keys``; a category is
    replaced by its bucket), variable, year, value, and ``input_order`` if the
    reader added it.
    """
    df = normalise_headers(df)
    layout = detect_format(df)
    long = {LONG: lambda d: d, SEMI_WIDE: unpivot_years, WIDE: unpivot_names}[layout](df)
    require_columns(long, ["model", "scenario", "variable", "year", "value"])
    if "temp_bucket" not in long.columns and "category" in long.columns:
        long = long.withColumn("temp_bucket", temp_bucket(F.col("category"), unmapped))
    order = [INPUT_ORDER] if INPUT_ORDER in long.columns else []
    return long.select(
        *scenario_keys(long.columns),
        "variable",
        F.col("year").cast("int").alias("year"),
        F.nanvl(F.col("value").cast("double"), F.lit(None)).alias("value"),
        *order,
    )


def keys_of(long: DataFrame) -> list[str]:
    return scenario_keys(long.columns)


# -- duplicates and the wide layout ---------------------------------------------


def first_cells(
    long: DataFrame, keys: list[str] | None = None, order_by: list | None = None, rule: str = "first"
) -> DataFrame:
    """One value of every (keys, variable, year): by ``rule`` the first or the smallest non-null one.

    Rows with a null key, variable, year or value do not count. ``order_by``
    says what "first" means and must leave no ties between different values; it
    defaults to ``input_order``. Without an order, "first" raises ValueError. The
    aggregation combines before the shuffle, so a scenario with a third of all
    rows is no hot spot. A single numeric order column is fastest: it keeps the
    hash aggregate, several need a sort.
    """
    keys = keys or keys_of(long)
    if order_by is None and INPUT_ORDER in long.columns:
        order_by = [INPUT_ORDER]
    group = [*keys, "variable", "year"]
    if rule not in ("first", "smallest"):
        raise ValueError(f"unknown rule {rule!r}")
    if rule == "smallest":
        pick = F.min("value")
    elif not order_by:
        raise ValueError("no input_order column: give order_by, or take the smallest value by rule")
    else:
        pick = F.min_by("value", F.struct(*order_by) if len(order_by) > 1 else order_by[0])
    return filled_rows(long, keys).groupBy(*group).agg(pick.alias("value"))


def filled_rows(long: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that count as a filled cell: value, keys, variable and year not null."""
    present = F.col("value").isNotNull()
    for c in [*keys, "variable", "year"]:
        present = present & F.col(c).isNotNull()
    return long.where(present)


def pivot_cells(cells: DataFrame, columns: list[tuple[str, int]], keys: list[str] | None = None) -> DataFrame:
    """Keys plus one ``variable (year)`` column for each listed pair.

    The columns are given, not discovered, which saves a pass over the data and
    keeps the table as wide as the analysis needs. Scenarios with no value in
    any listed column do not appear.
    """
    keys = keys or keys_of(cells)
    wanted = small_table(
        cells.sparkSession,
        [(v, y, f"{v} ({y})") for v, y in columns],
        "variable string, year int, flat string",
    )
    names = [f"{v} ({y})" for v, y in columns]
    return (
        restrict(cells, [v for v, _ in columns], sorted({y for _, y in columns}))
        .join(wanted, ["variable", "year"])
        .groupBy(*keys)
        .pivot("flat", names)
        .agg(F.first("value", ignorenulls=True))
    )


def restrict(cells: DataFrame, variables=None, years=None) -> DataFrame:
    """Rows of the given variables and years; both reach the scan."""
    if years is not None:
        cells = cells.where(F.col("year").isin(*years))
    if variables is not None:
        cells = cells.where(F.col("variable").isin(*dict.fromkeys(variables)))
    return cells


def present_columns(cells: DataFrame, variables=None, years=None, keys: list[str] | None = None) -> list[tuple[str, int]]:
    """The (variable, year) pairs that hold a value, sorted; takes long tables too.

    One row per column of the wide table comes to the driver, never data rows.
    """
    found = filled_rows(restrict(cells, variables, years), keys_of(cells) if keys is None else keys)
    return sorted((r.variable, r.year) for r in found.select("variable", "year").distinct().collect())


def shape_report(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Number of scenarios and of (variable, year) columns of the wide table."""
    keys = keys or keys_of(cells)
    return filled_rows(cells, keys).agg(
        F.count_distinct(*keys).alias("n_scenarios"),
        F.count_distinct("variable", "year").alias("n_columns"),
    )


def feature_columns(df: DataFrame) -> list[str]:
    """Every column that is neither a key, a label nor a cluster id."""
    return [c for c in df.columns if c.lower() not in NOT_FEATURES]
