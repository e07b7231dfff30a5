"""Wide tables of any number of columns, as groups of bounded width.

A folder holds ``values``, one row per scenario and column group with the group's
values in one array, and ``manifest``, which names the column at every place of
every group. Both are written in one pass; neither plan nor schema grows with the
number of columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reshape import keys_of, small_table

SUFFIX = ".groups"
#: Columns of one group.
WIDTH = 1000
_MANIFEST = "column string, variable string, year int, part int, at int, width int"


def write_column_groups(cells: DataFrame, columns: list[tuple[str, int]], path: str, width: int = WIDTH, mode: str = "error") -> str:
    """Cells as column groups below ``path``; only the listed (variable, year) pairs are written."""
    spark, keys = cells.sparkSession, keys_of(cells)
    places = [(f"{v} ({y})", v, y, i // width, i % width, min(width, len(columns) - i // width * width)) for i, (v, y) in enumerate(columns)]
    manifest = small_table(spark, places, _MANIFEST)
    entries = F.map_from_entries(F.collect_list(F.struct("at", "value")))
    placed = cells.where("value is not null").join(manifest.drop("column"), ["variable", "year"])
    grouped = placed.groupBy("part", "width", *keys).agg(entries.alias("cells"))
    values = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.try_element_at("cells", i))
    grouped.select("part", *keys, values.alias("values")).write.mode(mode).partitionBy("part").parquet(f"{path}/values")
    manifest.write.mode(mode).parquet(f"{path}/manifest")
    return path


def column_names(spark: SparkSession, path: str) -> list[str]:
    """All columns of the wide table, in order."""
    return [r.column for r in spark.read.parquet(f"{path}/manifest").orderBy("part", "at").select("column").collect()]


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Keys and the given columns of the wide table; only their groups are read, and joined by key.

    A scenario without any of the columns does not appear.
    """
    known = {r.column: (r.part, r["at"]) for r in spark.read.parquet(f"{path}/manifest").where(F.col("column").isin(columns)).collect()}
    missing = [c for c in columns if c not in known]
    if missing:
        raise ValueError(f"{path}: no columns {missing}")
    parts = sorted({known[c][0] for c in columns})
    values = spark.read.parquet(f"{path}/values")
    keys = keys_of(values)
    # One aggregate by key instead of a join for each group; null keys are groups of their own.
    picked = [F.max(F.when(F.col("part") == known[c][0], F.get("values", F.lit(known[c][1])))).alias(c) for c in columns]
    found = values.where(F.col("part").isin(parts)).groupBy(*keys).agg(*picked)
    return found.dropna("all", subset=[f"`{c}`" for c in columns])


def read_long(spark: SparkSession, path: str) -> DataFrame:
    """All filled cells of the wide table: (keys, variable, year, value), without building it."""
    values = spark.read.parquet(f"{path}/values")
    keys = keys_of(values)
    manifest = spark.read.parquet(f"{path}/manifest").select("part", "at", "variable", "year")
    cells = values.select("part", *keys, F.posexplode("values").alias("at", "value")).where("value is not null")
    return cells.join(manifest, ["part", "at"]).select(*keys, "variable", "year", "value")
