import hashlib
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import no_docs, odd_docs, plain as rows  # noqa: F401
from pyspark.sql import functions as F

from ensemblescope.llm import periodic_runs, queries
from ensemblescope.llm.periodic_runs import collapse, collapse_runs, find_runs, synchronising_set

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """All maximal runs, period by period, the smallest period of a stretch first."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 9)), max_size=8))
def test_equals_brute_force(parts):
    words = list("".join(block * times for block, times in parts))
    runs = find_runs(words)
    assert runs == brute(words)
    assert collapse(words, runs) == brute_collapse(words, runs)


def test_fibonacci_and_thue_morse_words():
    a, b = "a", "ab"
    for _ in range(12):
        a, b = b, b + a
    assert find_runs(list(b)) == brute(list(b)) == []
    assert find_runs(list(b[:60] * 5)) == brute(list(b[:60] * 5)) != []
    morse = [str(bin(i).count("1") % 2) for i in range(2048)]
    assert find_runs(morse) == []
    assert find_runs(morse[:37] * 6) == brute(morse[:37] * 6)


def test_nested_runs_and_long_texts():
    inner = ["x"] * 9 + ["y"]
    assert find_runs(inner * 5) == brute(inner * 5)
    assert find_runs(["w"] * 200_000) == [(0, 200_000, 1)]
    assert find_runs([str(i % 1000) for i in range(100_000)]) == [(0, 100_000, 1000)]
    assert find_runs([]) == [] and find_runs(["a"] * 5) == [] and find_runs(["a"] * 6) == [(0, 6, 1)]


def test_selected_positions_are_consistent_and_dense():
    words = list("abcab" * 3 + "aabbbcabcaabcbacbacbbaacbcacb" * 3 + "cccccccccccccccc" + "abcbacbb" * 4)
    n, t = len(words), 4
    def named(size):
        seen = {}
        return periodic_runs.np.array([seen.setdefault(tuple(words[i : i + size]), len(seen)) for i in range(n - size + 1)])
    chosen = set(synchronising_set(named(t), named(t // 2), t).tolist())
    for i in range(n - 2 * t + 1):
        for j in range(i):
            if words[i : i + 2 * t] == words[j : j + 2 * t]:
                assert (i in chosen) == (j in chosen)
    for i in range(n - 3 * t + 2):
        stretch = words[i : i + 3 * t - 1]
        flat = any(stretch[p:] == stretch[:-p] for p in range(1, t // 3 + 1))
        assert (not chosen & set(range(i, i + t))) == flat


def test_odd_documents(odd_docs, no_docs):
    clash = odd_docs.withColumn("_text", F.lit("mine")).withColumn("runs", F.lit(1))
    found = collapse_runs(clash)
    assert set(found.columns) == {*clash.columns, "collapsed", "n_words"} and found.count() == 9
    got = {r.doc_id: r for r in found.collect()}
    assert all(r._text == "mine" for r in got.values())
    assert got[2].runs == got[3].runs == got[4].runs == [] and got[2].collapsed == got[4].collapsed == "" and got[2].n_words == 0
    assert got[1].runs[0].asDict() == {"start": 0, "length": 80, "period": 10} and got[1].collapsed == "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    assert got[5].collapsed == "long" and got[7].collapsed == "é ß Σ 日本 😀"
    assert collapse_runs(no_docs).count() == 0


def test_most_repeated_breaks_ties(spark):
    made = spark.createDataFrame([([(0, 8, 2), (3, 16, 4), (9, 9, 2), (20, 18, 4)],), ([],), ([(5, 8, 1), (5, 16, 2)],)], f"runs {periodic_runs.RUNS}")
    best = [r.best for r in made.select(periodic_runs.most_repeated().alias("best")).collect()]
    assert [b and tuple(b) for b in best] == [(9, 9, 2), None, (5, 8, 1)]


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listing = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listing, " ".join(brute_collapse(words, runs)))]
    return (doc_id, len(runs), *figures, *digests)


def test_query(spark, sf_dir, tmp_path):
    short = queries.read(spark, sf_dir, "documents").where(F.length("text") < 6000)
    extra = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", "en", "a", 0)], short.schema)
    # Ids whose checksum asks for a repetition, with and without words.
    short.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(queries.op11_periodic_runs(spark, str(tmp_path)))
    want = sorted((expected(r.doc_id, r.text) for r in short.unionByName(extra).collect()), key=repr)
    assert got == want and sum(r[1] for r in got) > 20
