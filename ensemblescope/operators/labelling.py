"""Joins that attach categories, buckets and sectors; class counts."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import temp_bucket
from ..session import materialise


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; nulls are not counted."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )


#: Bytes of distinct labels, with their keys, that every task may hold for a map-side join.
MAP_SIDE_BYTES = 64 << 20


def attach_label(df: DataFrame, labelled: DataFrame, column: str) -> DataFrame:
    """Left join of a label by (model, scenario).

    The label side is made distinct and written once; a scenario with two labels
    still yields two rows. Its size is then known: up to ``MAP_SIDE_BYTES`` it goes
    to every task, so ``df`` is not shuffled. Beyond that both sides are shuffled,
    and scenarios that hold more rows than a task's share are dealt over as many salts as there are shuffle partitions.
    """
    keys = ["model", "scenario"]
    labels = materialise(labelled.select(*keys, column).distinct(), "labels")
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in (*keys, column)), F.lit(24))
    size = labels.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    rows = df.drop(column)
    if size <= MAP_SIDE_BYTES:
        return rows.join(F.broadcast(labels), keys, "left")
    hot, salts = _hot_scenarios(rows, keys)
    is_hot = F.xxhash64(*keys).isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(F.lit(0))
    copies = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    salted, labels = rows.withColumn(_SALT, salt.cast("int")), labels.withColumn(_SALT, copies)
    return salted.join(labels, [*keys, _SALT], "left").drop(_SALT)


_SALT = "__label_salt"


def _hot_scenarios(rows: DataFrame, keys: list[str]) -> tuple[list[int], int]:
    """Hashes of the scenarios with more rows than a shuffle partition's share, and the number of partitions.

    There are fewer of them than partitions. Counts combine before their shuffle.
    """
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.groupBy(F.xxhash64(*keys).alias("scenario")).agg(F.count(F.lit(1)).alias("n"))
    counted = materialise(counted, "scenario-counts")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return [r.scenario for r in counted.where(F.col("n") * salts > total).collect()], salts


def attach_category_map(df: DataFrame, category_map: DataFrame, unmapped: str = "trimmed") -> DataFrame:
    """Category of an external map joined by (model, scenario), plus its bucket."""
    joined = attach_label(df, category_map, "category")
    return joined.withColumn("temp_bucket", temp_bucket(F.col("category"), unmapped))


def unique_sector_map(sector_map: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One sector per variable: the last line of the map wins."""
    return sector_map.groupBy("variable").agg(F.max_by("sector", ordinal).alias("sector"))


def assign_sector(df: DataFrame, sector_map: DataFrame, default: str = "Other") -> DataFrame:
    """Sector of each row's variable, ``default`` when the map lacks it."""
    joined = df.join(unique_sector_map(sector_map), "variable", "left")
    return joined.withColumn("sector", F.coalesce("sector", F.lit(default)))


def present_sector_variables(sector_map: DataFrame, cells: DataFrame) -> DataFrame:
    """Lines of the sector map whose variable occurs in the data."""
    return sector_map.join(cells.select("variable").distinct(), "variable", "left_semi")


def absent_sector_variables(sector_map: DataFrame, cells: DataFrame) -> DataFrame:
    """Lines of the sector map whose variable does not occur in the data."""
    return sector_map.join(cells.select("variable").distinct(), "variable", "left_anti")


def sector_variables(sector_map: DataFrame, cells: DataFrame) -> dict[str, list[str]]:
    """Sector -> its variables that occur in the data, both in map order.

    The map is user-made reference data, one line per variable; it comes to the
    driver because the selection is parametrised by it. Sectors left without a
    variable are dropped with a warning; an empty result is an error.
    """
    sectors: dict[str, list[str]] = {}
    mapped = {r.sector for r in sector_map.select("sector").distinct().collect()}
    for row in present_sector_variables(sector_map, cells).orderBy("ordinal").collect():
        names = sectors.setdefault(row.sector, [])
        if row.variable not in names:
            names.append(row.variable)
    if not sectors:
        raise ValueError("no variable of the sector map occurs in the data")
    if absent := sorted(mapped - sectors.keys(), key=str):
        warnings.warn(f"sectors without a variable in the data: {absent}", stacklevel=2)
    return sectors


def combination_sectors(sets: DataFrame, sector_map: DataFrame, default: str = "Unknown") -> DataFrame:
    """(sample_id, position, variable, sector) of every member of every set."""
    members = sets.select("sample_id", F.posexplode("variables").alias("position", "variable"))
    return assign_sector(members, sector_map, default)
