"""Mixing sources to target weights by Efraimidis-Spirakis keys, in DataFrame operations only.

Each source gets a budget of words. As many whole passes over the source as the
budget holds come first; the rest is filled by weighted sampling without
replacement: documents in order of exponential keys, divided by their quality
weight, until their prefix sum reaches the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import WORD, join_small, whole_text

#: Slices of the key range in each source; only one slice of a source is sorted.
SLICES = 1 << 12
_UNIT = 2.0**-52


def word_count(text: str = "text") -> Column:
    return F.size(F.regexp_extract_all(whole_text(text), F.lit(WORD), F.lit(0))).cast("bigint")


def uniform(*columns: str) -> Column:
    """A number in (0, 1) that depends on the values of the columns only."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) * _UNIT


def budgets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Target of each source: all words shared by weight, none above ``most`` times its source's words.

    ``sizes`` has one row (source, source_size) for each source. Sources take the
    weights in turn, by code point, a null source last. What is above a limit is
    shared among the others until none is above: that is one water level, which a
    single pass in order of limit to weight finds. The windows hold one row for
    each source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    shares = sizes.select("source", "source_size", weight.alias("share_weight"))
    shares = shares.withColumn("_limit", F.col("source_size").cast("double") * F.lit(float(most)))
    by_limit = Window.orderBy(F.col("_limit") / F.col("share_weight"), F.col("source").isNull(), "source")
    earlier, all_rows = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(all_rows) - F.coalesce(F.sum("_limit").over(earlier), F.lit(0.0))
    heads = F.sum("share_weight").over(all_rows) - F.coalesce(F.sum("share_weight").over(earlier), F.lit(0.0))
    shares = shares.withColumn("_level", left / heads).withColumn("_at", F.row_number().over(by_limit))
    fits = F.col("_level") * F.col("share_weight") <= F.col("_limit")
    first = F.min(F.when(fits, F.struct("_at", "_level"))).over(all_rows)
    target = F.least(F.col("_limit"), F.coalesce(first["_level"], F.lit(0.0)) * F.col("share_weight"))
    return shares.select("source", "source_size", "share_weight", target.alias("target"))


def mix(items: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, slices: int = SLICES) -> DataFrame:
    """Every item with source_size, target, epochs, copies and taken.

    ``items`` has row_key, source, size (bigint) and quality (positive double) and
    is read several times, so pass a written table. ``copies`` is how often the mix
    holds the item, ``taken`` copies times size. An item is chosen for the
    fractional pass if the middle of its stretch of the prefix sum lies within the
    rest, so a source misses its target by half an item at most, unless the limit
    binds. Equal keys go by row_key, then size; a null or non-positive quality
    counts as the smallest weight. An empty table gives no rows; without any words
    all targets are 0. Keys depend on row_key only: reruns agree.
    """
    quality = F.greatest(F.coalesce(F.col("quality"), F.lit(0.0)), F.lit(1e-6))
    items = items.withColumn("sample_key", -F.log(uniform("row_key")) / quality)
    items = items.withColumn("_slice", F.floor((F.lit(1.0) - F.exp(-F.col("sample_key"))) * slices).cast("int"))
    filled = items.groupBy("source", "_slice").agg(F.sum("size").alias("_words"))
    targets = budgets(filled.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(F.lit(0))
    targets = targets.withColumn("epochs", epochs.cast("bigint"))
    targets = targets.withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # The slice in which a source's rest ends, and the words before it.
    along = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    reached = filled.withColumn("_after", F.sum("_words").over(along)).withColumn("_before", F.col("_after") - F.col("_words"))
    reached = reached.withColumnRenamed("source", "_source")
    ended = targets.join(reached, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_after") >= F.col("_rest")), "left")
    edge = F.min(F.struct("_slice", "_before"))
    plan = ended.groupBy("source", "source_size", "target", "epochs", "_rest").agg(edge.alias("_edge"))
    plan = plan.select("source", "source_size", "target", "epochs", "_rest", F.col("_edge._slice").alias("_edge_slice"), F.col("_edge._before").alias("_before"))
    plan = materialise(plan, "mix-plan")
    rows = join_small(items, plan, ["source"], ["row_key", "size"])
    inside = F.coalesce(F.col("_slice") < F.col("_edge_slice"), F.lit(True))
    at_edge = F.coalesce(F.col("_slice") == F.col("_edge_slice"), F.lit(False))
    plain = rows.where(~at_edge).withColumn("_chosen", inside)
    order = Window.partitionBy("source").orderBy("sample_key", "row_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("_before") + F.sum("size").over(order) - F.col("size") / 2
    sorted_rows = rows.where(at_edge).withColumn("_chosen", middle <= F.col("_rest"))
    mixed = plain.unionByName(sorted_rows)
    copies = F.least(F.col("epochs") + F.when(F.col("_chosen") & (F.col("_rest") > 0), 1).otherwise(0), F.lit(int(most)))
    mixed = mixed.withColumn("copies", copies.cast("bigint")).withColumn("taken", F.col("copies") * F.col("size"))
    return mixed.drop("_slice", "_edge_slice", "_before", "_rest", "_chosen")


def label_quality(labels: DataFrame) -> DataFrame:
    """Quality weight of each labelled document: 2 for good, 0.5 for bad; the best of several labels counts."""
    best = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return best.select(F.col("doc_id").alias("_labelled"), F.when(F.col("quality") > 0, 2.0).otherwise(0.5).alias("quality"))


def mix_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Plan of the mix over ``documents``: doc_id, source, size, quality and what ``mix`` adds.

    A document without label weighs 1; a null text has size 0.
    """
    sized = docs.select("doc_id", "source", word_count().alias("size"))
    rated = sized.join(label_quality(labels), F.col("doc_id") == F.col("_labelled"), "left").drop("_labelled")
    items = rated.withColumn("quality", F.coalesce("quality", F.lit(1.0))).withColumn("row_key", F.col("doc_id"))
    return mix(materialise(items, "mix-items")).drop("row_key")


#: The same rows in SQL.
MIX_SQL = r"""
WITH sized AS (
  SELECT d.doc_id, d.source, CAST(len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         coalesce(l.quality, 1.0) AS quality,
         (CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) * power(2::DOUBLE, -52) AS u
  FROM documents d LEFT JOIN (
    SELECT doc_id, CASE WHEN max(quality) > 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS quality
    FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) l ON d.doc_id = l.doc_id),
keyed AS (SELECT *, -ln(u) / quality AS sample_key FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM sized GROUP BY source),
limits AS (SELECT *, source_size::DOUBLE * 3 AS cap FROM sources),
levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS pos,
         (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS water
  FROM limits),
targets AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT arg_min(water, pos) FROM levels WHERE water * w <= cap), 0) * w) AS target FROM levels),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT k.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.sample_key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size / 2.0::DOUBLE AS middle
  FROM keyed k JOIN plans p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(least(epochs + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END, 3) * size AS BIGINT) AS taken
FROM placed
"""
