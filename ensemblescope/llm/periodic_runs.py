"""Periodic runs in texts, found through string synchronising sets.

After Kempa and Kociumaka, "String synchronizing sets" (STOC 2019). At scale t
(a power of two) hashes of stretches of t words select positions in a locally
consistent way: whether a position is selected depends on the 2t words from it
alone. Inside a run whose period is from t to 2t some position is selected, and
so is the one a period later, before the same 2t words. Pairs of neighbouring
selected positions with the same such words thus propose the period. Stretches
of a much smaller period have no selected positions; they are found by
themselves, from the next place where half a stretch occurs again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, free_name, map_batches, mix64, whole_text

#: A run holds its period so often, and so many words, at least. The method needs four periods.
PERIODS, WORDS = 4, 6
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_WORD = re.compile(WORD)
_NONE = np.uint64(2**64 - 1)


def _double(names: np.ndarray, t: int) -> np.ndarray:
    """Names of the stretches of 2t words from the names of those of t; -1 if a stretch occurs only once."""
    n = len(names) - t
    if n <= 0:
        return np.full(max(n, 0), -1, np.int64)
    left, right = names[:n], names[t : t + n]
    out = np.full(n, -1, np.int64)
    known = np.flatnonzero((left >= 0) & (right >= 0))
    _, inverse, times = np.unique(left[known] * (len(names) + t) + right[known], return_inverse=True, return_counts=True)
    repeated = times[inverse] > 1
    out[known[repeated]] = inverse[repeated]
    return out


def _next_same(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring positions of ``at`` with the same name: (position, distance to the next)."""
    at = at[names[at] >= 0]
    order = np.lexsort((at, names[at]))
    place = at[order]
    same = names[place[1:]] == names[place[:-1]]
    return place[:-1][same], (place[1:] - place[:-1])[same]


def _periodic(half: np.ndarray, t: int, n: int) -> np.ndarray:
    """Smallest period, if it is at most t/3, of each stretch of t words (0: none); ``half`` names stretches of t/2."""
    period = np.zeros(max(n - t + 1, 0), np.int64)
    if t < 4 or not len(period):
        return period
    at, step = _next_same(half, np.arange(len(half)))
    near = (step <= t // 3) & (at < len(period))
    at, step = at[near], step[near]
    # The first half repeats after ``step``; so must the half that ends the stretch.
    holds = half[at + t // 2 - step] == half[at + t // 2]
    holds &= half[at + t // 2] >= 0
    period[at[holds]] = step[holds]
    return period


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbouring values."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def synchronising_set(names: np.ndarray, half: np.ndarray, t: int) -> np.ndarray:
    """Selected positions: those whose stretch, or the one t words later, has the least hash of the t + 1 between them."""
    n = len(names) + t - 1
    if n < 2 * t:
        return np.zeros(0, np.int64)
    # A stretch that occurs once has no name; its place is one, for it is nowhere else.
    own = np.where(names >= 0, names, n + np.arange(len(names))).astype(np.uint64)
    ids = mix64(own + np.uint64(t * 0x9E3779B97F4A7C15 % 2**64))
    ids[_periodic(half, t, n) > 0] = _NONE
    least = _window_least(ids, t + 1)
    count = len(least)
    return np.flatnonzero(((ids[:count] == least) | (ids[t : t + count] == least)) & (least < _NONE))


def find_runs(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs with four periods and six words at least, by start, then period.

    Names of stretches are exact, so no result hangs on hashes; these only choose
    positions. Scales end where no stretch of 2t words occurs twice.
    """
    n = len(words)
    known: dict[str, int] = {}
    x = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    found: dict[tuple[int, int], int] = {}
    names, half, t = np.where(np.bincount(x, minlength=1)[x] > 1, x, -1) if n else x, np.zeros(0, np.int64), 1
    while 2 * t <= n and (names >= 0).any():
        context = _double(names, t)
        at, step = _next_same(context, synchronising_set(names, half, t))
        near = step <= 2 * t
        small = _periodic(half, t, n)
        dense = np.flatnonzero(small)
        _extend(x, np.concatenate([at[near], dense]), np.concatenate([step[near], small[dense]]), found)
        names, half, t = context, names, 2 * t
    runs = [(start, end - start, period) for (start, end), period in found.items()]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _extend(x: np.ndarray, at: np.ndarray, period: np.ndarray, found: dict[tuple[int, int], int]) -> None:
    """Note the maximal stretches in which the words ``period`` apart from position ``at`` on stay the same."""
    for p in np.unique(period):
        p = int(p)
        differs = np.flatnonzero(x[:-p] != x[p:])
        k = np.unique(np.searchsorted(differs, at[period == p]))
        start = np.append(-1, differs)[k] + 1
        end = np.append(differs, len(x) - p)[k] + p
        for s, e in zip(start.tolist(), end.tolist(), strict=True):
            if e - s >= max(WORDS, PERIODS * p):
                found[s, e] = min(p, found.get((s, e), p))


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return words if keep.all() else [w for w, k in zip(words, keep, strict=True) if k]


def collapse_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", n_words: str = "n_words") -> DataFrame:
    """Every row with its text's runs, its words without their repetitions, joined by blanks, and its number of words.

    Words are what white space separates. Every row is handled by itself, so
    ties, repeated rows and hot keys don't matter; a null or empty text has no
    words, no runs and an empty collapsed text. Columns called like a result are
    replaced, all others pass through, whatever they are called.
    """
    made = {runs: RUNS, collapsed: "string", n_words: "bigint"}
    inner = free_name(docs, "_text")
    table = docs.select("*", whole_text(text).alias(inner)).drop(*made)
    fields = [f for f in table.schema.fields if f.name != inner]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"`{n}` {kind}" for n, kind in made.items())])
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        listed, texts, counts = [], [], []
        for one in batch.column(inner):
            words = _WORD.findall(one.as_py())
            here = find_runs(words)
            listed.append([{"start": s, "length": n, "period": p} for s, n, p in here])
            texts.append(" ".join(collapse(words, here)))
            counts.append(len(words))
        results = [pa.array(listed, run_type), pa.array(texts, pa.string()), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *results], names=[*(f.name for f in fields), *made])

    return map_batches(table, scan, schema)


def most_repeated(runs: str = "runs") -> Column:
    """The run with the most periods by exact ratio; ties: smallest start, then period. Null without runs."""

    def better(a: Column, b: Column) -> Column:
        # Runs come by start and period, so the first of equal ones stays.
        return F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)

    return F.aggregate(F.col(runs), F.get(F.col(runs), F.lit(0)), better)


def listed(runs: str = "runs") -> Column:
    """All runs as lines ``start,length,period``."""

    def line(r: Column) -> Column:
        return F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))

    return F.array_join(F.transform(F.col(runs), line), "")
