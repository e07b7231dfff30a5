"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of the hashed embeddings of itself and of its beginnings.
Filters over one, two and three words slide over the whole text; the strongest
answer of each filter (max pooling) goes into a logistic output. Training runs
in the tasks: each shard of the labelled sample goes on from the common
parameters, and after a round the shards' parameters are averaged. Decision
limits for the score are then calibrated by language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import bound_batches, free_name, kth_largest, map_batches, powers, span_hashes, utf8_view, whole_text

#: Most labelled documents the classifier is fitted on; the rest of its input covers all rows.
LABELLED = 10_000
#: Documents of one training shard; rounds, and passes of a shard over its documents in a round.
SHARD, ROUNDS, PASSES = 2_500, 3, 4
#: Bytes of the word beginnings that are embedded beside the word.
BEGINNINGS = (3, 4, 5, 6, 7, 8, 9)
#: Features are hashed into so many buckets; one is embedded if so many training documents have it; most embedded ones.
BUCKETS, LEAST_DOCS, MOST_FEATURES = 1 << 21, 3, 1 << 17
DIMENSIONS, FILTERS, WIDTHS = 16, 16, (1, 2, 3)
#: Rows of words that are convolved at once: the bound of a long text's memory.
BLOCK = 1 << 14
BATCH, RATE, PULL = 16, 0.05, 1e-4

_LETTER = np.ones(256, bool)
_LETTER[:128] = [chr(i).isalnum() for i in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Column of the product of a word and all filters: which filter it belongs to and which word of its window it reads.
_OWNER = np.concatenate([np.repeat(np.arange(FILTERS) + k * FILTERS, w) for k, w in enumerate(WIDTHS)])
_PLACE = np.concatenate([np.tile(np.arange(w), FILTERS) for w in WIDTHS])
_POOLED = FILTERS * len(WIDTHS)
_PAD = max(WIDTHS) - 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word's features (rows of words, -1 where a word has no such beginning), and the words before each text.

    Words are runs of ASCII letters, digits and bytes of other scripts; A-Z count as a-z.
    """
    data = _LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _LETTER[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    up, down = powers(n + 1)
    mod = np.uint64(BUCKETS)
    found = np.full((len(starts), 1 + len(BEGINNINGS)), -1, np.int32)
    found[:, 0] = span_hashes(data, starts, ends, up, down) % mod
    for k, length in enumerate(BEGINNINGS, 1):
        long = ends - starts >= length
        hashed = span_hashes(data, starts[long], starts[long] + length, up, down)
        found[long, k] = (hashed ^ np.uint64(0x5851F42D4C957F2D)) % mod
    return found, np.searchsorted(starts, offsets)


@dataclass(frozen=True)
class Classifier:
    """Embedded buckets (ascending) with their vectors, filters, and the logistic output."""

    buckets: np.ndarray
    vectors: np.ndarray  # row 0 is nothing, row i + 1 belongs to buckets[i]
    filters: np.ndarray  # dimensions x columns
    bias: np.ndarray
    output: np.ndarray
    offset: float

    def slots(self) -> np.ndarray:
        """Row of ``vectors`` of each bucket; one more entry, for no feature."""
        table = np.zeros(BUCKETS + 1, np.int32)
        table[self.buckets] = np.arange(1, len(self.buckets) + 1)
        return table


def fresh(buckets: np.ndarray, share: float, seed: int = 0) -> Classifier:
    """Untrained parameters; ``share`` is the share of toxic documents."""
    draw = np.random.default_rng(seed)
    vectors = draw.normal(0, 0.05, (len(buckets) + 1, DIMENSIONS)).astype(np.float32)
    vectors[0] = 0
    filters = draw.normal(0, 0.3, (DIMENSIONS, len(_OWNER))).astype(np.float32)
    output = draw.normal(0, 0.3, _POOLED).astype(np.float32)
    share = min(max(share, 0.001), 0.999)
    return Classifier(buckets, vectors, filters, np.full(_POOLED, 0.02, np.float32), output, float(np.log(share / (1 - share))))


def _answers(words: np.ndarray, model: Classifier) -> np.ndarray:
    """Answer of each filter at each window; ``words`` has the padding behind the last window."""
    product = words @ model.filters
    n = len(words) - _PAD
    out = np.empty((n, _POOLED), np.float32)
    at = 0
    for k, width in enumerate(WIDTHS):
        block = product[:, at : at + width * FILTERS].reshape(len(words), FILTERS, width)
        part = block[:n, :, 0]
        for j in range(1, width):
            part = part + block[j : j + n, :, j]
        out[:, k * FILTERS : (k + 1) * FILTERS] = part
        at += width * FILTERS
    out += model.bias
    return out


def _word_vectors(rows: np.ndarray, model: Classifier) -> np.ndarray:
    total = model.vectors[rows[:, 0]].copy()
    for k in range(1, rows.shape[1]):
        total += model.vectors[rows[:, k]]
    return total


def _padded(rows: np.ndarray) -> np.ndarray:
    """A text's words with nothing behind them; a text without words is one empty window."""
    behind = _PAD + (len(rows) == 0)
    return np.concatenate([rows, np.zeros((behind, rows.shape[1]), rows.dtype)])


def pool(rows: np.ndarray, model: Classifier) -> tuple[np.ndarray, np.ndarray]:
    """Strongest answer of each filter over a whole text, and its window; long texts go block by block."""
    rows = _padded(rows)
    best, where = np.full(_POOLED, -np.inf, np.float32), np.zeros(_POOLED, np.int64)
    for begin in range(0, len(rows) - _PAD, BLOCK):
        answers = _answers(_word_vectors(rows[begin : begin + BLOCK + _PAD], model), model)
        at = answers.argmax(axis=0)
        value = answers[at, np.arange(_POOLED)]
        better = value > best
        best[better], where[better] = value[better], at[better] + begin
    return best, where


def score_text(rows: np.ndarray, model: Classifier) -> float:
    best, _ = pool(rows, model)
    return float(1 / (1 + np.exp(-(np.maximum(best, 0) @ model.output + model.offset))))


def loss_gradient(texts: list[np.ndarray], toxic: np.ndarray, model: Classifier):
    """Mean log loss of some texts and its gradient: (loss, rows of ``vectors``, their gradient, of filters, bias, output, offset)."""
    found = [pool(rows, model) for rows in texts]
    best = np.array([b for b, _ in found])
    hidden = np.maximum(best, 0)
    logit = hidden @ model.output + model.offset
    p = 1 / (1 + np.exp(-logit))
    loss = float(np.mean(np.logaddexp(0, logit) - toxic * logit))
    slope = (p - toxic).astype(np.float32) / np.float32(len(texts))
    back = slope[:, None] * model.output * (best > 0)
    g = back[:, _OWNER]
    rows, inputs = [], np.empty((len(texts), len(_OWNER), DIMENSIONS), np.float32)
    for i, (text, (_, where)) in enumerate(zip(texts, found, strict=True)):
        chosen = _padded(text)[where[_OWNER] + _PLACE]
        rows.append(chosen)
        inputs[i] = _word_vectors(chosen, model)
    filters = np.einsum("tc,tcd->dc", g, inputs)
    into = (g[:, :, None] * model.filters.T).reshape(-1, DIMENSIONS)
    slots = np.concatenate(rows)
    used, inverse = np.unique(slots, return_inverse=True)
    vectors = np.zeros((len(used), DIMENSIONS), np.float32)
    inverse = inverse.reshape(slots.shape)
    for k in range(slots.shape[1]):
        np.add.at(vectors, inverse[:, k], into)
    return loss, used, vectors, filters, back.sum(axis=0), slope @ hidden, float(slope.sum())


def train(texts: list[np.ndarray], toxic: np.ndarray, model: Classifier, passes: int = PASSES, seed: int = 0) -> tuple[Classifier, np.ndarray]:
    """The parameters after some passes (Adagrad, small batches), and which rows of ``vectors`` were used."""
    vectors, filters, bias, output, offset = model.vectors.copy(), model.filters.copy(), model.bias.copy(), model.output.copy(), np.array([model.offset], np.float32)
    now = replace(model, vectors=vectors, filters=filters, bias=bias, output=output)
    seen_vectors = np.full(vectors.shape, 1e-6, np.float32)
    seen = [np.full(x.shape, 1e-6, np.float32) for x in (filters, bias, output, offset)]
    touched = np.zeros(len(vectors), bool)
    draw = np.random.default_rng(seed)
    for _ in range(passes):
        order = draw.permutation(len(texts))
        for begin in range(0, len(order), BATCH):
            chosen = order[begin : begin + BATCH]
            _, used, g_vectors, *others = loss_gradient([texts[i] for i in chosen], toxic[chosen], now)
            real = used > 0
            used, g_vectors = used[real], g_vectors[real] + PULL * vectors[used[real]]
            touched[used] = True
            seen_vectors[used] += g_vectors**2
            vectors[used] -= RATE * g_vectors / np.sqrt(seen_vectors[used])
            for x, g, s in zip((filters, bias, output, offset), others, seen, strict=True):
                g = g + PULL * x
                s += g**2
                x -= RATE * g / np.sqrt(s)
            now = replace(now, offset=float(offset[0]))
    return now, touched


# -- fitting in Spark --------------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", text: str = "text", most: int = LABELLED) -> DataFrame:
    """(text, toxic, key): at most about ``most`` of the labelled rows that are ``allowed``, chosen by a hash of id and text.

    Rows without id or label are none; if a document has several labels, the
    highest holds. Equal ids with equal texts share their key and go together.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("toxic"))
    rows = docs.where(allowed).select("doc_id", whole_text(text).alias("text")).join(marks, "doc_id")
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 52)).cast("double")
    rows = materialise(rows.select("text", "toxic", key.alias("key")), "labelled")
    return rows.where(F.col("key") >= F.lit(float(kth_largest(rows, "key", most))))


def embedded_buckets(sample: DataFrame, least: int = LEAST_DOCS, most: int = MOST_FEATURES) -> np.ndarray:
    """Buckets that enough documents of the sample have, ascending; at most ``most``, the more common ones."""
    bound_batches(sample.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            found, first = features(*utf8_view(batch.column("text")))
            for a, b in zip(first[:-1], first[1:], strict=True):
                here = np.unique(found[a:b])
                total[here[here >= 0]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["bucket", "docs"])

    counted = sample.select("text").mapInArrow(count, "bucket bigint, docs bigint").groupBy("bucket").agg(F.sum("docs").alias("docs"))
    counted = materialise(counted.where(F.col("docs") >= least), "buckets")
    # As many rows as there are different counts, at most the size of the sample.
    levels = sorted(((r.docs, r["count"]) for r in counted.groupBy("docs").count().collect()), reverse=True)
    reached = np.cumsum([n for _, n in levels])
    bound = next((d for (d, _), n in zip(reversed(levels), reversed(reached)) if n <= most), None)
    if bound is None:
        return np.zeros(0, np.int64)
    return np.sort(counted.where(F.col("docs") >= bound).select("bucket").toArrow()["bucket"].to_numpy())


def _sums(before: Classifier, after: Classifier, touched: np.ndarray) -> tuple[np.ndarray, ...]:
    used = np.flatnonzero(touched)
    rest = np.concatenate([(x - y).ravel() for x, y in ((after.filters, before.filters), (after.bias, before.bias), (after.output, before.output))])
    return used, (after.vectors[used] - before.vectors[used]), np.append(rest, after.offset - before.offset)


def fit(sample: DataFrame, shard: int = SHARD, rounds: int = ROUNDS, passes: int = PASSES, seed: int = 0) -> Classifier:
    """The classifier of a labelled sample (text, toxic, key). Without rows it says 0.5 to every text.

    Documents are dealt over shards of about ``shard`` rows by their key. What a
    shard learned comes back as sums: a vector is averaged over the shards that
    used it, everything else over all shards. The driver holds parameters only.
    """
    spark = sample.sparkSession
    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).head()
    model = fresh(embedded_buckets(sample) if n else np.zeros(0, np.int64), toxic / n if n else 0.5, seed)
    if not n:
        return replace(model, output=np.zeros_like(model.output))
    shards = -(-n // shard)
    dealt = materialise(sample.withColumn("shard", (F.col("key") % shards).cast("int")).repartition(shards, "shard"), "shards")
    for number in range(rounds):
        held = spark.sparkContext.broadcast(tuple(getattr(model, f) for f in model.__dataclass_fields__))

        def learn(batches: Iterator[pa.RecordBatch], held=held, number=number) -> Iterator[pa.RecordBatch]:
            before = Classifier(*held.value)
            slots = before.slots()
            texts: dict[int, list] = {}
            for batch in batches:
                found, first = features(*utf8_view(batch.column("text")))
                rows = slots[found]
                for i, (part, y, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "toxic", "key")), strict=True)):
                    texts.setdefault(part, []).append((key, y, rows[first[i] : first[i + 1]]))
            for part in sorted(texts):
                # In one order, whatever order the rows came in.
                mine = sorted(texts[part], key=lambda t: (t[0], t[1]))
                after, touched = train([t[2] for t in mine], np.array([t[1] for t in mine], np.float32), before, passes, seed + 1000 * number + part)
                used, moved, rest = _sums(before, after, touched)
                at = np.append(used, -1)
                values = pa.array([*moved.astype(np.float64).tolist(), rest.tolist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), part, np.int64)), values], names=["at", "shard", "moved"])

        bound_batches(spark)
        moved = dealt.select("text", "toxic", "key", "shard").repartition(shards, "shard").mapInArrow(learn, "at bigint, shard bigint, moved array<double>")
        # The order of the shards is fixed, so that sums of doubles agree between runs.
        merged = moved.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("shard", "moved"))).alias("parts")).select(
            "at", F.size("parts").alias("n"), F.aggregate("parts", F.transform(F.col("parts")[0]["moved"], lambda x: F.lit(0.0)), lambda a, p: F.zip_with(a, p["moved"], lambda x, y: x + y)).alias("total")
        )
        model = _moved(model, merged.toArrow())
        held.destroy()
    return model


def _moved(model: Classifier, table: pa.Table) -> Classifier:
    at, n = table["at"].to_numpy(), table["n"].to_numpy()
    totals = table["total"].to_pylist()
    vectors = model.vectors.copy()
    rest = None
    for place, shards, total in zip(at, n, totals, strict=True):
        if place < 0:
            rest = np.array(total) / shards
        else:
            vectors[place] += np.array(total, np.float32) / np.float32(shards)
    sizes = np.cumsum([model.filters.size, model.bias.size, model.output.size])
    filters, bias, output, offset = np.split(rest.astype(np.float32), sizes)
    return replace(
        model, vectors=vectors, filters=model.filters + filters.reshape(model.filters.shape), bias=model.bias + bias, output=model.output + output, offset=model.offset + float(offset[0])
    )


def score_documents(docs: DataFrame, model: Classifier, text: str = "text", name: str = "score") -> DataFrame:
    """Every row with the score of its whole text, 0 to 1; a null text counts as empty.

    Repeated rows are scored each for itself. A column called ``name`` is
    replaced; all other columns pass through, whatever they are called.
    """
    held = docs.sparkSession.sparkContext.broadcast({"model": tuple(getattr(model, f) for f in model.__dataclass_fields__)})
    kept = docs.drop(name)
    inner = free_name(docs, "_text")
    table = kept.select("*", whole_text(text).alias(inner)) if text in kept.columns else docs.select(*kept.columns, whole_text(text).alias(inner))
    fields = [f for f in table.schema.fields if f.name != inner]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` double"])

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = held.value
        if "ready" not in known:
            ready = Classifier(*known["model"])
            known["ready"] = ready, ready.slots()
        ready, slots = known["ready"]
        found, first = features(*utf8_view(batch.column(inner)))
        rows = slots[found]
        scores = [score_text(rows[a:b], ready) for a, b in zip(first[:-1], first[1:], strict=True)]
        columns = [batch.column(f.name) for f in fields]
        return pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*(f.name for f in fields), name])

    return map_batches(table, score, schema)


# -- limits by language ------------------------------------------------------------------

#: Bins of the score, wanted precision, and the weight (in documents) of all languages in a language's precision.
BINS, PRECISION, SHRINK = 1000, 0.9, 20
#: For languages without labelled rows.
PLAIN_LIMIT = 0.7


def calibrate(scored: DataFrame, toxic: str = "toxic", lang: str = "lang", score: str = "score", precision: float = PRECISION) -> DataFrame:
    """(lang, threshold): the lowest score from which on the labelled rows of a language reach the precision.

    A language's precision is blended with that of all languages as if these had
    ``SHRINK`` documents, so rare languages follow the rest. A null language is
    one of its own. Counts by language and bin are what moves: ``BINS`` rows a
    language at most. A language that never reaches the precision gets 1.
    """
    bins = F.least(F.floor(F.col(score) * BINS), F.lit(BINS - 1)).cast("int")
    counted = scored.where(F.col(toxic).isNotNull()).groupBy(F.col(lang).alias("lang"), bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(toxic) > 0).cast("int")).alias("hits"))
    counted = materialise(counted, "calibration")
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    # One row for each bin, whatever the number of documents.
    overall = counted.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    overall = overall.select("bin", (F.sum("hits").over(above) / F.sum("n").over(above)).alias("all_precision"))
    mine = Window.partitionBy("lang").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    blended = (F.sum("hits").over(mine) + SHRINK * F.col("all_precision")) / (F.sum("n").over(mine) + SHRINK)
    reached = counted.join(overall, "bin").select("lang", "bin", blended.alias("precision"))
    least = F.min(F.when(F.col("precision") >= precision, F.col("bin") / F.lit(float(BINS))))
    return reached.groupBy("lang").agg(F.coalesce(least, F.lit(1.0)).alias("threshold"))
