"""Near-duplicates by ProbMinHash signatures of word shingles, banding and verification.

Each shingle of a document sends out a Poisson process whose rate is its weight;
each arrival hits one of the signature's components, and each component keeps the
shingle that hit it first. Two components agree with the probability Jaccard
likeness of the two documents. Arrivals later than the time by which all
components are hit are never made. Texts are signed with one weight for all their
distinct shingles: then that is the plain Jaccard likeness, which links ask for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import join_small, map_batches, mix64, powers, set_aside, span_hashes, utf8_view, whole_text, word_spans

SHINGLE = 5
SIMILARITY = 0.8
#: At likeness 0.8, 48 bands of 8 miss one pair in 6,800.
BANDS, ROWS = 48, 8
#: Further bands, of as many rows, of the signature whose shingles weigh 1 + ln(times).
WEIGHTED_BANDS = 12
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD1B54A32D192ED03)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts as (text, hash, times), by text, then hash.

    A text with fewer words than ``size`` has all its words as its one shingle; one
    without words has none.
    """
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends, *powers(len(data) + 1))
    counts = np.diff(first)
    # Words are padded at each text's end, so every text with words has a shingle.
    windows = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), windows)
    begin = np.repeat(first[:-1], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    until = first[1:][owner]
    grams = np.zeros(len(begin), np.uint64)
    for k in range(size):
        grams = mix64(grams * _GOLD + np.where(begin + k < until, padded[begin + k], np.uint64(0)))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    return owner[at], grams[at], np.diff(np.append(at, len(grams)))


def signatures(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures of ``n`` documents, m components each; a document without elements has zeros."""
    total = np.bincount(owner, weights=weights, minlength=n)
    first = np.full(n * m, np.inf)
    held = np.zeros(n * m, np.uint64)
    limit = np.zeros(n)
    # By this time all components are hit in 19 cases of 20; else the time goes on.
    limit[total > 0] = m * (np.log(m) + 3.0) / total[total > 0]
    now, step = np.zeros(len(owner)), np.zeros(len(owner), np.uint64)
    open_docs = total > 0
    while open_docs.any():
        active = np.flatnonzero(open_docs[owner] & (now <= limit[owner]))
        while len(active):
            # Several arrivals at once if few elements are left.
            ahead = int(np.clip((1 << 15) // len(active), 1, 64))
            number = step[active][:, None] + np.arange(1, ahead + 1, dtype=np.uint64)
            random = mix64(elements[active][:, None] + number * _GOLD)
            gap = -np.log(((random >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / weights[active][:, None]
            time = now[active][:, None] + np.cumsum(gap, axis=1)
            hit = (owner[active] * m)[:, None] + (mix64(random ^ _GOLD) % np.uint64(m)).astype(np.int64)
            made = time <= limit[owner[active]][:, None]
            t, place = time[made], hit[made]
            np.minimum.at(first, place, t)
            wins = t == first[place]
            held[place[wins]] = np.broadcast_to(elements[active][:, None], made.shape)[made][wins]
            now[active], step[active] = time[:, -1], number[:, -1]
            active = active[made[:, -1]]
        unfilled = np.isinf(first).reshape(n, m).any(axis=1) & (total > 0)
        # Elements whose last arrival came after the old limit have it made again: it may now count.
        if not unfilled.any():
            break
        first.reshape(n, m)[unfilled] = np.inf
        again = unfilled[owner]
        now[again], step[again] = 0.0, 0
        limit[unfilled] *= 2
        open_docs = unfilled
    return held.reshape(n, m)


def band_keys(held: np.ndarray, rows: int, first: int = 0) -> np.ndarray:
    """One key for each ``rows`` components; the bands are numbered from ``first``, so equal ones differ by place."""
    n, bands = len(held), held.shape[1] // rows
    keys = np.zeros((n, bands), np.uint64)
    for k in range(rows):
        keys = mix64(keys * _GOLD + held.reshape(n, bands, rows)[:, :, k])
    return mix64(keys + np.arange(first, first + bands, dtype=np.uint64) * _GOLD).view(np.int64)


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, weighted: int = WEIGHTED_BANDS) -> DataFrame:
    """doc_id, digest, bands and short components of every row of (doc_id, text).

    The first ``bands`` bands, and all components, weigh the distinct shingles of a
    text the same, however often it has them: they agree with the likeness that is
    verified. ``weighted`` more bands weigh a shingle 1 + ln(times). ``bands`` is null
    for a text without words.
    """
    m, every = bands * rows, bands + weighted

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8_view(batch.column("text"))
        owner, grams, times = shingles(data, offsets)
        n = batch.num_rows
        held = signatures(owner, grams, np.ones(len(grams)), n, m)
        # Other random numbers than those of the first signature.
        heavy = signatures(owner, mix64(grams ^ _OTHER), 1 + np.log(times), n, weighted * rows)
        keys = np.hstack([band_keys(held, rows), band_keys(heavy, rows, bands)])
        short = mix64(held).astype(np.uint16).view(np.int16)
        where = pa.array(np.arange(n + 1) * every, pa.int32())
        parts = pa.array(np.arange(n + 1) * m, pa.int32())
        mask = pa.array(np.bincount(owner, minlength=n) == 0)
        columns = [
            batch.column("doc_id"), batch.column("digest"),
            pa.ListArray.from_arrays(where, pa.array(keys.reshape(-1)), mask=mask),
            pa.ListArray.from_arrays(parts, pa.array(short.reshape(-1)), mask=mask),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "bands", "parts"])

    table = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    table = table.where("doc_id is not null").withColumn("digest", F.unhex(F.sha2("text", 256)))
    return map_batches(table, run, "doc_id bigint, digest binary, bands array<bigint>, parts array<smallint>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """key and the distinct shingle hashes of every row of (key, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, grams, _ = shingles(*utf8_view(batch.column("text")))
        ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(grams.view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("key"), sets], names=["key", "shingles"])

    return map_batches(docs.select("key", whole_text().alias("text")), run, "key bigint, shingles array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those pairs (a, b) whose Jaccard likeness of distinct shingles reaches ``similarity``."""
    left = sets.select(F.col("key").alias("_a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("key").alias("_b"), F.col("shingles").alias("_sb"))
    both = pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
    common = F.size(F.array_intersect("_sa", "_sb"))
    union = F.size("_sa") + F.size("_sb") - common
    return both.select("a", "b", (common / union).alias("likeness")).where(F.col("likeness") >= F.lit(similarity))


def classes(links: DataFrame) -> DataFrame:
    """Smallest key connected to every key that has a link: id, label.

    Labels go along links and then along labels, until none changes; that takes
    about the logarithm of the longest path.
    """
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    both = materialise(both.distinct(), "links")
    labels = materialise(both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("_y")).select("id", F.least("id", "_y").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("y") == F.col("id")).groupBy("x").agg(F.min("label").alias("_near"))
        moved = labels.join(near, F.col("id") == F.col("x")).select("id", F.col("label").alias("_old"), F.least("label", "_near").alias("_new"))
        roots = labels.select(F.col("id").alias("_root"), F.col("label").alias("_top"))
        jumped = moved.join(roots, F.col("_new") == F.col("_root"), "left")
        jumped = materialise(jumped.select("id", "_old", F.least("_new", F.coalesce("_top", "_new")).alias("label")), "labels")
        labels = jumped.select("id", "label")
        if not jumped.where("_old != label").limit(1).count():
            return labels


def _labelled(table: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``table`` with the label of a column's keys; a key without links is its own."""
    known = labels.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    joined = table.join(known, F.col(column) == F.col("_id"), "left")
    return joined.withColumn(f"{column}_label", F.coalesce("_label", column)).drop("_id", "_label")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: int = WEIGHTED_BANDS) -> DataFrame:
    """One row for each id and text: doc_id, digest, text_id, class_id, class_digest.

    ``text_id`` is the smallest id with exactly this text. ``class_id`` and
    ``class_digest`` are the smallest id, and its text's digest, that verified links,
    of Jaccard likeness 0.8 or more over distinct 5-word shingles, connect it to. A
    null text counts as empty; texts without words are alike only if equal. Rows
    without id are left out; repeated rows give one. An id may occur with several
    texts: each is a document of its own.

    Copies count once. In each bucket of a band all texts are first compared with
    the texts of the bucket's smallest and largest id, beginning with one such pair for each text. Then
    only texts of one bucket that still are in different classes are compared
    with each other, unless their signatures rule it out; so a large group of
    near copies isn't expanded into pairs, and no pair is skipped for its number.
    """
    docs = docs.select("doc_id", "text")
    signed = materialise(sign(docs, bands, rows, weighted), "signed")
    # A text goes by a number of its own, because ids may repeat; it is fixed once written.
    texts = signed.groupBy("digest").agg(F.min("doc_id").alias("text_id"), F.first("bands").alias("bands"))
    texts = materialise(texts.withColumn("key", F.monotonically_increasing_id()), "texts")
    keyed = texts.where("bands is not null").select("key", "text_id", F.explode("bands").alias("band"))
    by_id = F.struct("text_id", "key")
    heads = keyed.groupBy("band").agg(F.min(by_id).alias("low"), F.max(by_id).alias("high"))
    heads = heads.select(F.col("band").alias("_band"), F.col("low.key").alias("low"), F.col("high.key").alias("high")).where("low != high")
    shared = materialise(keyed.join(heads, F.col("band") == F.col("_band")).select("band", "low", "high", "key"), "shared")
    stars = shared.select(F.explode(F.array("low", "high")).alias("head"), "key").where("head != key")
    stars = stars.groupBy(F.least("head", "key").alias("a"), F.greatest("head", "key").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    stars = materialise(stars, "stars")
    involved = stars.select(F.explode(F.array("a", "b")).alias("_key")).distinct()
    wanted = texts.join(involved, F.col("key") == F.col("_key")).select("key", "text_id", F.col("digest").alias("_digest"))
    whole = docs.join(wanted, F.col("doc_id").cast("bigint") == F.col("text_id"))
    whole = whole.where(F.unhex(F.sha2(whole_text(), 256)) == F.col("_digest"))
    sets = materialise(shingle_sets(whole).dropDuplicates(["key"]), "sets")
    # One star each, with the head that shares most bands.
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    links = materialise(verified(best.select("a", "b"), sets, similarity), "links")
    labels = classes(links)
    tried = best.select(F.col("a").alias("_ta"), F.col("b").alias("_tb"))
    rest = stars.join(tried, (F.col("a") == F.col("_ta")) & (F.col("b") == F.col("_tb")), "left_anti")
    rest = _labelled(_labelled(rest, labels, "a"), labels, "b").where("a_label != b_label")
    links = links.unionByName(materialise(verified(rest.select("a", "b"), sets, similarity), "links"))
    labels = classes(links)
    # What remains: texts of one bucket in different classes, neither of them its head.
    split = _labelled(shared, labels, "key").withColumnRenamed("key_label", "label")
    mixed = split.groupBy("band").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low != _high").select(F.col("band").alias("_band"))
    open_rows = split.join(mixed, F.col("band") == F.col("_band")).where("key != low and key != high").select("band", "key", "label")
    open_rows = materialise(open_rows, "open")
    # The components of the few open texts; equal rows have equal ones.
    asked = texts.join(open_rows.select(F.col("key").alias("_open")).distinct(), F.col("key") == F.col("_open"))
    asked = asked.select(F.col("key").alias("_key"), "text_id", F.col("digest").alias("_digest"))
    parts = signed.join(asked, (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("text_id")))
    parts = parts.select("_key", "parts", "bands").dropDuplicates(["_key"])
    open_rows = materialise(open_rows.join(parts, F.col("key") == F.col("_key")).drop("_key"), "open")
    other = open_rows.withColumnsRenamed({c: f"_{c}" for c in open_rows.columns})
    m = bands * rows
    agreeing = _agreeing("parts", "_parts")
    # Nearly five standard deviations below what a likeness of 0.8 makes agree, so less than the bands miss.
    least = int(m * similarity - 4.9 * (m * similarity * (1 - similarity)) ** 0.5)
    first_shared = F.array_position(F.zip_with("bands", "_bands", lambda x, y: x == y), True)
    own_place = F.array_position("bands", F.col("band"))
    pairs = open_rows.join(
        other,
        (F.col("band") == F.col("_band")) & (F.col("label") != F.col("_label")) & (F.col("key") < F.col("_key")) & (first_shared == own_place) & (agreeing >= least),
    ).select(F.col("key").alias("a"), F.col("_key").alias("b"))
    links = links.unionByName(materialise(verified(pairs.distinct(), sets, similarity), "links"))
    labels = classes(links)
    named = materialise(_labelled(texts.select("digest", "text_id", "key"), labels, "key").withColumnRenamed("key_label", "label"), "named")
    # Classes of more than one text go by their smallest id; a large class is dealt over tasks.
    linked = labels.select(F.col("label").alias("_linked")).distinct()
    least_of = F.min(F.struct("text_id", "digest"))
    heads = named.join(linked, F.col("label") == F.col("_linked")).groupBy("label").agg(least_of.alias("head"))
    named = join_small(named, heads, ["label"], salt_by=["key"]).select(
        F.col("digest").alias("_digest"),
        "text_id",
        F.coalesce("head.text_id", "text_id").alias("class_id"),
        F.coalesce("head.digest", "digest").alias("class_digest"),
    )
    members = signed.select("doc_id", "digest").distinct()
    return members.join(named, F.col("digest") == F.col("_digest")).select("doc_id", "digest", "text_id", "class_id", "class_digest")


def _agreeing(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: of each class, the one with the smallest id.

    If that id has several texts of the class, the one of smallest digest stays. Rows without id all stay. Of rows that repeat both id and text one stays, any
    of them.
    """
    found = materialise(near_duplicates(docs, similarity), "found")
    out = found.where("doc_id != class_id or digest != class_digest").select(F.col("doc_id").alias("_out_id"), F.col("digest").alias("_out_digest"))
    aside, give_back = set_aside(docs, "doc_id", "text")
    marked = aside.withColumn("_key", F.col("doc_id").cast("bigint")).withColumn("_digest", F.unhex(F.sha2(whole_text(), 256)))
    stays = marked.join(out, (F.col("_key") == F.col("_out_id")) & (F.col("_digest") == F.col("_out_digest")), "left_anti")
    if docs.where("doc_id is not null").count() > found.count():
        named = stays.where("_key is not null").dropDuplicates(["_key", "_digest"])
        stays = named.unionByName(stays.where("_key is null"))
    return give_back(stays.drop("_key", "_digest"))
