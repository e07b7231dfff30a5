"""Readers: scenario tables, sector maps, category maps."""

from __future__ import annotations

import os
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import CSV_MISSING
from .schema import (
    WIDE,
    alias_category_headers,
    bracket_columns,
    detect_format,
    normalise_headers,
    require_columns,
    year_columns,
)

INPUT_ORDER = "input_order"
_TEXT_COLUMNS = {"model", "scenario", "region", "variable", "unit", "category", "temp_bucket"}


def read_table(spark: SparkSession, path: str, input_order: bool = False, malformed: str = "error") -> DataFrame:
    """Parquet by suffix, anything else as CSV with a header.

    ``input_order=True`` adds the column ``input_order``, one number that sorts
    rows as they lie in the files, files by path; it serves as ``order_by`` where
    the first of several values must win. Text in a CSV's number column raises
    when its row is read; with ``malformed="null"`` it becomes null.
    """
    if os.path.splitext(path.rstrip("/"))[1].lower() == ".parquet":
        df = spark.read.parquet(path)
        return _numbered(df, F.col("_metadata.row_index")) if input_order else df
    raw = _read_csv_texts(spark, path)
    if input_order:
        # Rows of a split count up in file order, splits begin at their byte.
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("decimal(38,0)")
        within = F.col("_metadata.file_block_start").cast("decimal(20,0)") * F.lit(1 << 33).cast("decimal(11,0)") + row
        raw = _numbered(raw, within)
    return _typed(raw, malformed)


def _numbered(df: DataFrame, within: Column) -> DataFrame:
    """``df`` with ``input_order``: the number of the row's file, with the place within it in the lower digits."""
    # A local path may be written with one slash or three, and with or without escapes.
    files = [re.sub("^file:/+", "file:/", f) for f in sorted(df.inputFiles())]
    known = {name: i for i, f in enumerate(files) for name in (f, unquote(f))}
    table = df.sparkSession.createDataFrame(list(known.items()), "_file string, _number bigint")
    path = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")
    placed = df.select("*", path.alias("_path"), within.alias("_within"))
    # Broadcast is the driver's own list of files.
    placed = placed.join(F.broadcast(table), F.col("_path") == F.col("_file"), "left")
    unknown = F.raise_error(F.concat(F.lit("unknown file "), "_path")).cast("bigint")
    placed = placed.withColumn("_number", F.coalesce("_number", unknown))
    if isinstance(placed.schema["_within"].dataType, T.DecimalType):
        number = (F.col("_number").cast("decimal(10,0)") * F.lit(str(1 << 80)).cast("decimal(25,0)")).cast("decimal(38,0)") + F.col("_within")
        order = number.cast("decimal(38,0)")
    else:
        order = F.shiftleft(F.col("_number"), 40) + F.col("_within")
    return placed.withColumn(INPUT_ORDER, order).drop("_path", "_within", "_file", "_number")


def _read_csv_texts(spark: SparkSession, path: str) -> DataFrame:
    # Only the header is looked at; the data is never scanned for inference.
    reader = spark.read.option("header", True).option("escape", '"')
    header = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return reader.schema(schema).csv(path)


def _typed(raw: DataFrame, malformed: str) -> DataFrame:
    """Numbers out of the texts of the columns that hold numbers; a year may be written as 2030.0."""
    if malformed not in ("error", "null"):
        raise ValueError(f"unknown treatment {malformed!r}")
    header = [c for c in raw.columns if c != INPUT_ORDER]
    missing = list(CSV_MISSING)
    columns = {}
    for c in header:
        text = F.col(f"`{c}`")
        text = F.when(~text.isin(missing), text)
        kind = _csv_type(c, header)
        if not isinstance(kind, T.StringType):
            value = F.trim(text).try_cast("double")
            if isinstance(kind, T.IntegerType):
                value = F.when(value == F.floor(value), value).try_cast("int")
            if malformed == "error":
                wrong = text.isNotNull() & value.isNull()
                said = F.concat(F.lit(f"not a number in column {c}: "), text)
                value = F.when(wrong, F.raise_error(said).cast(kind)).otherwise(value)
            text = value
        columns[c] = text
    return raw.withColumns(columns)


def _csv_type(name: str, header: list[str]) -> T.DataType:
    lowered = [c.lower() for c in header]
    if name.lower() in _TEXT_COLUMNS:
        return T.StringType()
    if name.lower() == "year":
        return T.IntegerType()
    if name.lower() == "value" or name in year_columns(header) or name in bracket_columns(header):
        return T.DoubleType()
    is_wide = bool(bracket_columns(header)) and "variable" not in lowered
    return T.DoubleType() if is_wide else T.StringType()


def read_scenarios(spark: SparkSession, path: str, input_order: bool = False, malformed: str = "error") -> DataFrame:
    """A scenario table with normalised headers and NaN turned into null."""
    df = normalise_headers(read_table(spark, path, input_order, malformed))
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None)) for c in floats})


def read_sector_map(spark: SparkSession, path: str) -> DataFrame:
    """Columns ``variable, sector, ordinal``; the ordinal is the order in the file."""
    df = require_columns(read_table(spark, path, True), ["Variable", "Sector"], "sector map")
    return df.select(
        F.col("Variable").alias("variable"),
        F.col("Sector").alias("sector"),
        F.col(INPUT_ORDER).alias("ordinal"),
    )


def read_category_map(spark: SparkSession, path: str) -> DataFrame:
    """Columns ``model, scenario, category`` from any accepted header spelling."""
    needed = ["model", "scenario", "category"]
    df = alias_category_headers(read_table(spark, path))
    return require_columns(df, needed, "category map").select(*needed)


def is_wide(df: DataFrame) -> bool:
    return detect_format(df) == WIDE
