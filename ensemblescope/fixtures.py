"""Scenario-shaped views of the star-schema test tables.

Models are nations, scenarios suppliers, variables part brands, years the ship
years; the value of a cell is the price of its first line item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.reshape import first_cells, tidy

YEARS = (1996, 1998)
KEYS = ["model", "scenario", "region", "temp_bucket"]
RULE_FEATURES = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice", "l_extendedprice"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _category() -> Column:
    last = F.col("s_suppkey") % 10
    return (
        F.when(last == 9, "failed-vetting")
        .when(last == 0, "no-climate-assessment")
        .otherwise(F.concat(F.lit("C"), last.cast("string")))
    )


def _scenario_columns() -> list[Column]:
    return [
        F.col("n_name").alias("model"),
        F.col("s_name").alias("scenario"),
        F.col("r_name").alias("region"),
        _category().alias("category"),
    ]


def _order() -> Column:
    """Items by ship date, order, line and part, as one number: it keeps aggregates by hash."""
    day = F.unix_date(F.to_date("l_shipdate")).cast("bigint")
    line = (day * F.lit(1 << 36) + F.col("l_orderkey")) * 8 + F.col("l_linenumber")
    return line * 256 + F.pmod("l_partkey", F.lit(256))


def _with_places(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Nation and region of rows that have a supplier."""
    return df.join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, scenario, region, category, s_suppkey): one row per scenario."""
    return _with_places(spark, sf_dir, read(spark, sf_dir, "supplier")).select(*_scenario_columns(), "s_suppkey")


def scenario_long(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """Long table with duplicates; in the sparse form only returned items have a value.

    The fact table meets one dimension after the other, so each join is planned
    by that dimension's own size.
    """
    items = read(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")) if sparse else F.col("l_extendedprice")
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("variable"))
    supplied = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(
        read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    return _with_places(spark, sf_dir, supplied).select(
        *_scenario_columns(),
        "variable",
        F.year("l_shipdate").alias("year"),
        value.alias("value"),
        _order().alias("input_order"),
    )


def long(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """The canonical long table, duplicates included."""
    return tidy(scenario_long(spark, sf_dir, sparse))


def cells(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """The canonical long table without duplicates."""
    return first_cells(long(spark, sf_dir, sparse))


def brands(spark: SparkSession, sf_dir: str) -> list[str]:
    """All brands of the part table, a reference list, by their number."""
    found = [r.p_brand for r in read(spark, sf_dir, "part").select("p_brand").distinct().collect()]
    return sorted(found, key=lambda b: (len(b), b))


def sector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variable, sector, ordinal) of the brands in the part table, five a sector."""
    number = F.substring_index("variable", "#", -1).cast("int")
    brands = read(spark, sf_dir, "part").select(F.col("p_brand").alias("variable")).distinct()
    return brands.select(
        "variable",
        F.concat(F.lit("S"), F.floor((number - 1) / 5).cast("string")).alias("sector"),
        number.alias("ordinal"),
    )


def semi_wide(cells: DataFrame) -> DataFrame:
    """One row per scenario and variable, a column per year of the data."""
    years = [str(r.year) for r in cells.select("year").distinct().orderBy("year").collect()]
    return cells.groupBy("model", "scenario", "region", "variable").pivot("year", years).agg(F.first("value"))


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six features per line item and a planted rule as label."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    label = ((F.col("l_quantity") > 35) & (F.col("l_discount") < 0.05)).cast("int")
    joined = read(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(*[F.col(f).cast("double").alias(f) for f in RULE_FEATURES], label.alias("label"))


def embedding_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, one double column per dimension (e0, e1, ...), cluster."""
    table = read(spark, sf_dir, "embeddings")
    width = table.select(F.max(F.size("embedding"))).first()[0]
    dims = [F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(width)]
    return table.select("vec_id", *dims, F.col("label").alias("cluster"))


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with their length, language and source."""
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").drop("text"), "doc_id")
