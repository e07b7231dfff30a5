"""Helpers shared by the operators: Arrow batches, word hashes, quantised counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a character class and as bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Lower the session's Arrow batches to what a Python worker can hold beside its results.

    Only ever lowers; a single text is never split.
    """
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", rows),
        ("spark.sql.execution.arrow.maxBytesPerBatch", size),
    ):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with every column but the ``needed`` ones under a name of this call alone, and what gives the names back.

    Names that an operator uses inside can't meet those of its input in between.
    What gives names back leaves out a column called like a result, in any case of letters.
    """
    wanted, tag = {c.lower() for c in needed}, uuid4().hex[:12]
    names = {f"aside_{tag}_{k}": c for k, c in enumerate(docs.columns) if c.lower() not in wanted}
    hidden = dict(zip(names.values(), names, strict=True))
    aside = docs.toDF(*[hidden.get(c, c) for c in docs.columns])

    def give_back(found: DataFrame) -> DataFrame:
        made = {c.lower() for c in found.columns if c not in names}
        return found.select(*[F.col(c).alias(names.get(c, c)) for c in found.columns if c not in names or names[c].lower() not in made])

    return aside, give_back


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch; empty batches are skipped."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and where each text begins (one more entry than texts)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of ``units[start:end]``.

    ``up`` and ``down`` come from ``powers`` and reach over all units.
    """
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * down[: len(units)], out=sums[1:])
    length = (ends - starts).astype(np.uint64)
    return mix64((sums[ends] - sums[starts]) * up[starts] ^ (length * np.uint64(0xD6E8FEB86659FD93)))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of all texts, and the words before each text."""
    blank = np.zeros(256, bool)
    blank[list(SPACES)] = True
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~blank[data]
    # A text's first byte begins a word even if the text before ended in one.
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    return starts, ends, np.searchsorted(starts, offsets)


def grid(value: Column) -> Column:
    """Bin of a non-negative integer: exact below 64, then 32 bins for each power of two.

    Counts by bin are a quantile sketch with relative error 1/32 that merges by
    addition, in any order, with one result.
    """
    bits = F.length(F.bin(value.cast("bigint")))
    shift = F.greatest(bits - F.lit(6), F.lit(0))
    return (shift * 32 + F.floor(value / F.pow(F.lit(2.0), shift))).cast("int")


def grid_floor(column: Column) -> Column:
    """The smallest value of a bin of ``grid``."""
    shift = F.greatest(F.floor(column / 32) - F.lit(1), F.lit(0))
    return ((column - shift * 32) * F.pow(F.lit(2.0), shift)).cast("bigint")


def join_small(rows: DataFrame, small: DataFrame, on: list[str], salt_by: list[str], salts: int = 16, how: str = "left") -> DataFrame:
    """Attach the one row of ``small`` that has the same, perhaps null, values of ``on``.

    Rows of one key are dealt over ``salts`` tasks, so a key with a third of all
    rows is no hot spot and nothing has to be broadcast.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    copies = copies.withColumnsRenamed({c: f"_small_{c}" for c in on})
    same = F.col("_salt") == F.col("_salt_of")
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"_small_{c}"))
    return salted.join(copies, same, how).drop("_salt", "_salt_of", *[f"_small_{c}" for c in on])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def kth_largest(table: DataFrame, column: str, k: int, width: int = 1024) -> float:
    """The k-th largest value of a column, by counting in ever finer ranges; no row is sorted.

    Minus infinity if there are at most k rows, infinity for k below 1. Each pass
    brings at most ``width`` counts to the driver.
    """
    low, high, n = table.agg(F.min(column), F.max(column), F.count(column)).head()
    if n <= k:
        return -np.inf
    if k < 1:
        return np.inf
    wanted = k
    while low < high:
        step = (high - low) / width
        if low + step == low:
            break
        place = F.least(F.floor((F.col(column) - low) / step), F.lit(width - 1))
        inside = table.where((F.col(column) >= low) & (F.col(column) <= high)).groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("b"))
        for row in sorted(inside.collect(), key=lambda r: -r.p):
            if wanted <= row.n:
                low, high = row.a, row.b
                break
            wanted -= row.n
    return float(low)
