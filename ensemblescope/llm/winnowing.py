"""Document fingerprints by winnowing: of the k-gram hashes of each window the smallest, the rightmost of equals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, mix64, powers, whole_text

GRAM = 16
WINDOW = 40
_PLACE_BITS = 20
_PLACES = 1 << _PLACE_BITS
#: k-grams handled at once; the minimum of a window compares places modulo ``_PLACES``.
_BLOCK = 1 << 18


class Winnower:
    """Chosen k-grams of a text as (hash, place), in order of place.

    Any run of ``gram + window - 1`` code points that two texts share gives them
    a common hash; runs below ``gram`` give none. A text shorter than ``gram``
    has its whole self as its one gram, an empty text has no fingerprint.
    """

    def __init__(self, gram: int = GRAM, window: int = WINDOW):
        if gram < 1 or not 1 <= window < _BLOCK:
            raise ValueError("gram and window must be positive")
        self.gram, self.window = gram, window
        self.up, self.down = powers(_BLOCK + gram + window)

    def grams(self, points: np.ndarray) -> np.ndarray:
        """44-bit hashes of all k-grams of a block of code points."""
        n, k = len(points), self.gram
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.down[:n], out=sums[1:])
        return mix64((sums[k:] - sums[:-k]) * self.up[: n - k + 1]) >> np.uint64(_PLACE_BITS)

    def choose(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(points):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(points) < self.gram:
            padded = np.concatenate([points.astype(np.uint64) + np.uint64(1 << 32), np.zeros(self.gram - len(points), np.uint64)])
            return self.grams(padded)[:1], np.zeros(1, np.int64)
        last, window = len(points) - self.gram + 1, self.window
        hashes, places = [], []
        begin = 0
        while True:
            # Blocks overlap by a window less one, so each window lies in one block.
            end = min(last, begin + _BLOCK)
            h = self.grams(points[begin : end + self.gram - 1])
            place = np.arange(begin, end, dtype=np.int64)
            turned = (_PLACES - 1 - (place - begin)).astype(np.uint64)
            key = h << np.uint64(_PLACE_BITS) | turned
            low, wide = key, 1
            span = min(window, len(key))
            while wide * 2 <= span:
                low = np.minimum(low[:-wide], low[wide:])
                wide *= 2
            if wide < span:
                low = np.minimum(low[: len(key) - span + 1], low[span - wide :])
            keep = np.ones(len(low), bool)
            keep[1:] = low[1:] != low[:-1]
            low = low[keep]
            hashes.append(low >> np.uint64(_PLACE_BITS))
            places.append(begin + _PLACES - 1 - (low & np.uint64(_PLACES - 1)).astype(np.int64))
            if end == last:
                break
            begin = end - window + 1
        h, p = np.concatenate(hashes), np.concatenate(places)
        keep = np.ones(len(p), bool)
        keep[1:] = p[1:] != p[:-1]
        return h[keep], p[keep]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among all of two fingerprints; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def printed(hashes: np.ndarray, places: np.ndarray) -> str:
    return " ".join([f"{h:011x}:{p}" for h, p in zip(hashes.tolist(), places.tolist(), strict=True)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by the first code points of ``following``, as many or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(docs: DataFrame, id_col: str) -> DataFrame:
    """Rows with ``_range``: numbers of id ranges of about equal size, the highest ids first.

    The cuts come from a quantile sketch over all ids and are as many as there are
    shuffle partitions.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.percentile_approx(id_col, [k / n for k in range(1, n)] or [0.5], 100 * n)).head()[0] or []
    cuts = np.array(sorted(set(cuts)), np.float64)

    @F.pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, ids.astype("float64").fillna(-np.inf), side="left")).astype("int32")

    return docs.withColumn("_range", number(id_col))


def fingerprint_neighbours(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form and of how alike it is to that and to the next text.

    The next document is the one with the next smaller id; the last one's next is
    the first. Equal ids follow each other by text; a null id comes last. A null
    text counts as empty. Columns: id, n_chars, edited, fingerprint,
    edited_fingerprint, near_edited, near_next. An empty table gives no rows; a
    single document is its own next.

    One shuffle deals the texts into ranges of ids; within a range they are
    sorted. Only the first text of each range goes to its neighbour.
    """
    spark = docs.sparkSession
    bound_batches(spark, rows=256)
    table = _ranges(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text).alias("text")), "doc_id")
    # One row for each range: the text its predecessor's last document needs.
    tops = table.groupBy("_range").agg(F.max("doc_id").alias("_top")).withColumnRenamed("_range", "_in")
    # Broadcast are two numbers for each range.
    top_rows = table.join(F.broadcast(tops), (F.col("_range") == F.col("_in")) & F.col("doc_id").eqNullSafe(F.col("_top")))
    heads = top_rows.groupBy("_range").agg(F.min("text").alias("head"))
    over = Window.orderBy("_range")  # as many rows as ranges
    everything = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = heads.select("_range", F.coalesce(F.lead("head").over(over), F.first("head").over(everything)).alias("_follows"))
    dealt = table.unionByName(follows.select(F.lit(None).cast("bigint").alias("doc_id"), F.col("_follows").alias("text"), "_range").withColumn("_end", F.lit(True)), allowMissingColumns=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartitionByRange(n, "_range").sortWithinPartitions(
        "_range", F.coalesce("_end", F.lit(False)), F.col("doc_id").desc_nulls_last(), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnower = Winnower(gram, window)
        before: tuple | None = None
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("_end").to_pylist(), strict=True)
            for doc_id, own, end in rows:
                hashes, places = winnower.choose(code_points(own))
                if before is not None:
                    was, text_was, hashes_was, places_was = before
                    changed = edited(text_was, own)
                    hashes_changed, places_changed = winnower.choose(code_points(changed))
                    values = (
                        was, len(text_was), changed, printed(hashes_was, places_was), printed(hashes_changed, places_changed),
                        likeness(hashes_was, hashes_changed), likeness(hashes_was, hashes),
                    )
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                before = None if end else (doc_id, own, hashes, places)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=list(names))

    return dealt.select("doc_id", "text", "_end").mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
