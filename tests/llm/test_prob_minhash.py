import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm_helpers import no_docs, odd_docs  # noqa: F401

from ensemblescope.llm import queries
from ensemblescope.llm.prob_minhash import classes, keep_one, near_duplicates, shingles, sign, signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles_of(text):
    words = WORD.findall(text or "")
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or Counter([tuple(words)] if words else [])


def brute_classes(texts, similarity=0.8):
    """Class of each id by comparing all pairs of different texts."""
    first = {}
    for i, t in sorted(texts.items()):
        first.setdefault(t or "", i)
    sets = {i: set(shingles_of(t)) for t, i in first.items()}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and common / (len(sets[a]) + len(sets[b]) - common) >= similarity:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: top(first[t or ""]) for i, t in texts.items()}


def encoded(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def test_shingles_equal_brute_force():
    random.seed(8)
    texts = ["", " ", "a", "a b c d", "a b c d e", "a b c d e a b c d e", "é b c"] + [" ".join(random.choice("abc") for _ in range(random.randint(0, 30))) for _ in range(40)]
    owner, grams, times = shingles(*encoded(texts))
    for k, text in enumerate(texts):
        assert sorted(times[owner == k].tolist()) == sorted(shingles_of(text).values())
    # The same shingle has the same hash in every text.
    assert set(grams[owner == 4].tolist()) <= set(grams[owner == 5].tolist())


def test_components_agree_with_the_probability_jaccard_likeness():
    random = np.random.default_rng(9)
    m, elements = 4096, random.integers(0, 1 << 62, 60).astype(np.uint64)
    x, y = random.exponential(size=60) * (random.random(60) < 0.8), random.exponential(size=60) * (random.random(60) < 0.8)
    want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(60) if x[i] > 0 and y[i] > 0)
    owner = np.concatenate([np.zeros((x > 0).sum(), int), np.ones((y > 0).sum(), int)])
    held = signatures(owner, np.concatenate([elements[x > 0], elements[y > 0]]), np.concatenate([x[x > 0], y[y > 0]]), 3, m)
    assert abs((held[0] == held[1]).mean() - want) < 4 * (want * (1 - want) / m) ** 0.5
    assert (held[2] == 0).all()


def test_a_signature_does_not_depend_on_its_batch():
    elements = np.arange(1, 400, dtype=np.uint64) * np.uint64(7919)
    weights = np.linspace(0.5, 3, len(elements))
    alone = signatures(np.zeros(len(elements), int), elements, weights, 1, 64)[0]
    for n in (1, 3, 50):
        owner = np.concatenate([np.zeros(n, int), np.ones(len(elements), int)])
        held = signatures(owner, np.concatenate([elements[:n], elements]), np.concatenate([weights[:n], weights]), 2, 64)
        assert (held[1] == alone).all()
    # One element hits all components.
    assert (signatures(np.zeros(1, int), elements[:1], weights[:1], 1, 64) == elements[0]).all()


def test_classes_of_paths_and_rings(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, 103), (103, 101), (101, 100)] + [(500, 300), (300, 500)]
    got = dict(map(tuple, classes(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {k: 0 for k in range(21)} | {100: 100, 101: 100, 103: 100, 300: 300, 500: 300}
    assert classes(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def edited_copies(n, changes, length=150, seed=10):
    random.seed(seed)
    words = [f"w{random.randint(0, 999)}" for _ in range(length)]
    out = []
    for _ in range(n):
        own = list(words)
        for _ in range(random.randint(0, changes)):
            own[random.randrange(length)] = f"x{random.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


def test_large_groups_equal_brute_force(spark):
    texts = edited_copies(120, 9) + edited_copies(30, 2, length=40, seed=11) + ["alone " * 4, "alone " * 5, "a b", "a\tb", " a  b ", "a c"]
    texts += [texts[3]] * 20 + [None, "", " "]
    ids = {1000 - 3 * k: t for k, t in enumerate(texts)}
    docs = spark.createDataFrame(list(ids.items()), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    want = brute_classes(ids)
    assert len(set(want.values())) > 12 and max(Counter(want.values()).values()) > 40
    assert got == want


@pytest.mark.parametrize("times", [6, 20])
def test_repeated_lines_do_not_hide_near_copies(spark, times):
    random.seed(12)
    ids = {}
    for k in range(60):
        words = [f"w{random.randint(0, 10**6)}" for _ in range(44)]
        ids[2 * k], ids[2 * k + 1] = " ".join(words), " ".join(words + words[-10:] * times)
    docs = spark.createDataFrame(list(ids.items()), "doc_id bigint, text string").repartition(4)
    parts = {r.doc_id: np.array(r.parts) for r in sign(docs).collect()}
    # 40 of 44 shingles are common, and that is the share that agrees.
    shares = [(parts[2 * k] == parts[2 * k + 1]).mean() for k in range(60)]
    assert min(shares) > 0.8 and abs(np.mean(shares) - 40 / 44) < 0.01
    assert {r.doc_id: r.class_id for r in near_duplicates(docs).collect()} == brute_classes(ids)


def test_weighted_bands_follow_repeats(spark):
    random.seed(13)
    words = [f"w{random.randint(0, 10**6)}" for _ in range(60)]
    # The second has the shingles of the first, some of them 50 times; the third repeats the same line as often.
    texts = [words, words + words * 50, words + words * 50 + ["end"]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    bands = {r.doc_id: np.array(r.bands) for r in sign(docs, bands=48, rows=4, weighted=64).collect()}
    assert len(bands[0]) == 112 and len(set(bands[0].tolist())) == 112

    def shared(a, b, kind):
        return (bands[a] == bands[b])[kind].mean()

    plain, weighted = slice(0, 48), slice(48, None)
    # Four wrapping shingles are new among 60, and weigh about as much as the others in the second.
    assert shared(0, 1, plain) > 0.5 and shared(1, 2, weighted) > 0.8
    half = [f"v{random.randint(0, 10**6)}" for _ in range(30)]
    texts = [half + words[:30], half + words[:30] * 400]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    bands = {r.doc_id: np.array(r.bands) for r in sign(docs, bands=48, rows=4, weighted=64).collect()}
    assert shared(0, 1, weighted) < shared(0, 1, plain) - 0.2


def test_recall_on_planted_repeats(spark):
    """Near copies that repeat lines, in one text or in both, against brute force: no link is lost."""
    random.seed(14)
    ids = {}
    for k in range(150):
        words = [f"w{random.randint(0, 10**6)}" for _ in range(random.randint(40, 120))]
        near = list(words)
        for _ in range(random.randint(0, 2)):
            near[random.randrange(len(near))] = f"x{k}"
        line = random.choice([words[-12:], words[:20]])
        ids[2 * k] = " ".join(words + line * random.choice([0, 0, 3, 15]))
        ids[2 * k + 1] = " ".join(near + line * random.choice([0, 5, 40]))
    docs = spark.createDataFrame(list(ids.items()), "doc_id bigint, text string").repartition(4)
    want = brute_classes(ids)
    assert 60 < sum(want[2 * k + 1] == 2 * k for k in range(150)) < 150
    assert {r.doc_id: r.class_id for r in near_duplicates(docs).collect()} == want


def test_an_id_with_several_texts(spark):
    one, two, three = edited_copies(2, 2, seed=15), edited_copies(2, 2, seed=16), edited_copies(2, 2, seed=17)
    rows = [(5, one[0]), (5, two[0]), (9, one[1]), (10, two[1]), (7, three[0]), (7, three[1]), (7, three[1]), (11, three[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in found) == [(5, 5), (5, 5), (7, 7), (7, 7), (9, 5), (10, 5), (11, 7)]
    assert len({r.class_digest for r in found if r.class_id == 5}) == 2 and len({r.class_digest for r in found if r.class_id == 7}) == 1
    kept = sorted((r.doc_id, r.text) for r in keep_one(docs).collect())
    assert [k[0] for k in kept] == [5, 5, 7] and {k[1] for k in kept[:2]} == {one[0], two[0]} and kept[2][1] in three


def test_odd_documents(odd_docs, no_docs):
    found = near_duplicates(odd_docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in found) == [(1, 1), (2, 2), (3, 2), (4, 4), (5, 5), (6, 1), (7, 7)]
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 4, 5, 7, None]
    assert near_duplicates(no_docs).count() == 0 and keep_one(no_docs).count() == 0


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in queries.read(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: r.class_id for r in queries.op10_prob_minhash(spark, sf_dir).collect()}
    assert got == brute_classes(texts)
