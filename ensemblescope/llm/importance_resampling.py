"""Quality by importance resampling: how much likelier target text makes a document than raw text does.

Two generative models, bags of hashed n-grams, stand for target and raw text. The
logarithm of their ratio, plus Gumbel noise, ranks all documents; the best k are a
sample without replacement by importance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import bound_batches, kth_largest, map_batches, mix64, powers, set_aside, span_hashes, utf8_view, whole_text, word_spans
from .mixing import uniform

#: Buckets of each of the three families of n-grams: words, pairs of words, four bytes.
BUCKETS = 1 << 14
#: Most labelled documents of each kind that the target model and the size of the sample are fitted on.
LABELLED = 20_000
#: The log ratio is that of so many n-grams: the mean of a text's, with so many neutral ones added, times this.
STRETCH, NEUTRAL = 400, 50
_PAIR, _SAME = np.uint64(0xA0761D6478BD642F), np.uint64(0)


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every n-gram: words, pairs of words (a word twice in a row is one of its own), four bytes."""
    starts, ends, first = word_spans(data, offsets)
    mod = np.uint64(buckets)
    words = span_hashes(data, starts, ends, *powers(len(data) + 1))
    owner = np.searchsorted(offsets, starts, side="right") - 1
    pairs = np.where(words[1:] == words[:-1], _SAME, mix64(words[:-1] * _PAIR + words[1:]))
    same_text = owner[1:] == owner[:-1]
    wide = data.astype(np.uint64)
    fours = wide[:-3] | wide[1:-2] << np.uint64(8) | wide[2:-1] << np.uint64(16) | wide[3:] << np.uint64(24) if len(data) > 3 else np.zeros(0, np.uint64)
    fours = (fours * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    holder = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = holder[3:] == holder[:-3] if len(data) > 3 else np.zeros(0, bool)
    chosen = np.concatenate([words % mod, pairs[same_text] % mod + mod, fours[inside] % mod + mod + mod]).astype(np.int64)
    return chosen, np.concatenate([owner, owner[1:][same_text], holder[3:][inside]])


@dataclass(frozen=True)
class Ratio:
    """Log ratio of target to raw for every bucket, and the share of documents to keep."""

    weights: np.ndarray
    buckets: int = BUCKETS


def _blocks(data: np.ndarray, offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes; a longer text is a run of its own."""
    begin = 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1)
        yield begin, end
        begin = end


def count_features(docs: DataFrame, target: Column, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """n-gram counts over all texts: bucket, raw, target. ``target`` marks the rows of the target."""
    bound_batches(docs.sparkSession)
    table = docs.select(whole_text(text).alias("text"), F.coalesce(target, F.lit(False)).alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, aim = np.zeros(3 * buckets, np.int64), np.zeros(3 * buckets, np.int64)
        for batch in batches:
            data, offsets = utf8_view(batch.column("text"))
            marked = np.array(batch.column("target").to_pylist(), bool)
            for a, b in _blocks(data, offsets):
                chosen, owner = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)
                raw += np.bincount(chosen, minlength=3 * buckets)
                aim += np.bincount(chosen[marked[a:b][owner]], minlength=3 * buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, raw[seen], aim[seen])], names=["bucket", "raw", "target"])

    counted = table.mapInArrow(count, "bucket bigint, raw bigint, target bigint")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit_ratio(counts: DataFrame, buckets: int = BUCKETS) -> Ratio:
    """The two models from the counts, three numbers a bucket; one is added to every count. Without a target all weights are 0."""
    raw, aim = np.ones(3 * buckets), np.ones(3 * buckets)
    for row in counts.collect():  # at most three times ``buckets`` rows
        raw[row.bucket] += row.raw
        aim[row.bucket] += row.target
    if aim.sum() == 3 * buckets:
        return Ratio(np.zeros(3 * buckets), buckets)
    weights = np.zeros(3 * buckets)
    for k in range(3):
        part = slice(k * buckets, (k + 1) * buckets)
        weights[part] = np.log(aim[part] / aim[part].sum()) - np.log(raw[part] / raw[part].sum())
    return Ratio(weights, buckets)


def score_documents(docs: DataFrame, ratio: Ratio, text: str = "text", name: str = "log_ratio") -> DataFrame:
    """Every row with the log ratio of its whole text; 0 for a null or empty text. A column of that name is replaced.

    It is taken for a stretch of ``STRETCH`` n-grams, so that a long text isn't
    judged by a small difference between the models, many times over.
    """
    held = docs.sparkSession.sparkContext.broadcast(ratio.weights)
    buckets = ratio.buckets
    aside, give_back = set_aside(docs, text)
    kept = aside.select("*", whole_text(text).alias("_whole_text")).drop(name)
    fields = [f for f in kept.schema.fields if f.name != "_whole_text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` double"])

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8_view(batch.column("_whole_text"))
        sums = []
        for a, b in _blocks(data, offsets):
            chosen, owner = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)
            total = np.bincount(owner, weights=held.value[chosen], minlength=b - a)
            sums.append(total * STRETCH / (np.bincount(owner, minlength=b - a) + NEUTRAL))
        columns = [*(batch.column(f.name) for f in fields), pa.array(np.concatenate(sums))]
        return pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in fields), name])

    return give_back(map_batches(kept, score, schema))


def labelled_sample(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """Up to ``most`` labelled ids of each quality, chosen by their hashes: _id, good. The worst of several labels counts."""
    once = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    drawn = materialise(once.select(F.col("doc_id").alias("_id"), "good", uniform("doc_id").alias("draw")), "labels")
    parts = []
    for kind in (F.col("good"), ~F.col("good")):
        own = drawn.where(kind)
        parts.append(own.where(F.col("draw") >= F.lit(kth_largest(own, "draw", most))))
    return parts[0].unionByName(parts[1]).select("_id", "good")


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The score from which on documents count as good so that both kinds are told apart best; minus infinity without both kinds."""
    if not len(scores) or good.all() or not good.any():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    wrong = np.cumsum(g) / g.sum() + 1 - np.cumsum(~g) / (~g).sum()  # if the cut comes after each place
    at = int(np.argmin(wrong))
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else np.inf


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", most: int = LABELLED) -> tuple[Ratio, DataFrame]:
    """The two models, raw from all documents and target from the labelled good ones; and the labelled sample."""
    sample = materialise(labelled_sample(labels, most), "labelled")
    # Broadcast are at most twice ``most`` ids.
    marked = docs.select("doc_id", text).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"), "left")
    return fit_ratio(count_features(marked, F.col("good"), text)), sample


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", k: int | None = None, most: int = LABELLED) -> tuple[DataFrame, float]:
    """Every row of ``docs`` with log_ratio and sample_key, and the key from which on rows belong to the sample.

    ``sample_key`` is the log ratio plus Gumbel noise that depends on doc_id only.
    The sample has the ``k`` rows with the largest keys, and those that tie with
    the last. Without ``k``, it has as many as there are documents whose log ratio
    reaches the value that best tells the labelled good from the labelled bad; if
    either kind is missing, all. A null or empty text has log ratio 0. Labels of
    unknown documents count for nothing. Texts are scored once: the rows are
    written with their scores, and the key is found from what is written. Columns
    called like a result are replaced, all others pass through.
    """
    ratio, sample = fit(docs, labels, text, most)
    noise = -F.log(-F.log(uniform("doc_id")))
    aside, give_back = set_aside(docs, "doc_id", text)
    scored = score_documents(aside, ratio, text).withColumn("sample_key", F.col("log_ratio") + noise)
    scored = materialise(scored, "scores")
    narrow = scored.select("doc_id", "log_ratio", "sample_key")
    if k is None:
        seen = narrow.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.min("log_ratio").alias("s"), F.first("good").alias("g")).collect()
        cut = best_cut(np.array([r.s for r in seen], float), np.array([r.g for r in seen], bool))
        k = narrow.where(F.col("log_ratio") >= F.lit(cut)).count()
    return give_back(scored), kth_largest(narrow, "sample_key", k)
