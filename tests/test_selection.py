import hashlib

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

import ensemblescope as es
from ensemblescope.operators.correlation import correlation_matrix
from ensemblescope.operators.coverage import presence_patterns
from ensemblescope.operators.selection import conflict_bits

SCHEMA = "model string, scenario string, variable string, year int, value double"
SECTORS = {"x": [f"x{i}" for i in range(6)], "y": [f"y{i}" for i in range(4)], "z": ["z0", "z1", "x0"]}
NAMES = sorted({v for g in SECTORS.values() for v in g})
YEARS = [2030, 2050]


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(3)
    common = rng.normal(size=80)
    data = []
    for i, v in enumerate(NAMES):
        loading = 0.9 if i % 3 == 0 else 0.2
        for y in YEARS:
            x = loading * common + rng.normal(size=80)
            keep = rng.random(80) < 0.75
            data += [("m", f"s{s}", v, y, float(x[s])) for s in np.flatnonzero(keep)]
    return spark.createDataFrame(data, SCHEMA).repartition(6)


@pytest.fixture(scope="module")
def matrix(cells):
    return correlation_matrix(cells, 2030, NAMES).persist()


def order(seed, sample, names):
    return sorted(names, key=lambda v: hashlib.md5(f"{seed}|{sample}|{v}".encode()).hexdigest())


def test_start_sets(spark):
    out = es.sample_start_sets(spark, SECTORS, 20, 2, seed=7).orderBy("sample_id").collect()
    assert len(out) == 20
    for r in out:
        drawn = {s: order(7, r.sample_id, names) for s, names in SECTORS.items()}
        assert r.variables == [v for d in drawn.values() for v in d[:2]]
        assert {p.sector: p.variables for p in r.pools} == {s: d[2:] for s, d in drawn.items()}
    assert len({tuple(r.variables) for r in out}) > 10


def test_a_small_sector_voids_all_samples(spark):
    with pytest.warns(UserWarning, match="w"):
        assert es.sample_start_sets(spark, {**SECTORS, "w": ["w0"]}, 20, 2).count() == 0


def strengths(matrix):
    """|r| of every ordered pair; 1 where undefined or absent."""
    r = {(a, b): 1.0 for a in NAMES for b in NAMES}
    for m in matrix.where("var_a < var_b and abs_r is not null").collect():
        r[m.var_a, m.var_b] = r[m.var_b, m.var_a] = m.abs_r
    return r


@pytest.fixture(scope="module")
def gappy(matrix):
    """The matrix with one undefined and one absent pair."""
    undefined = F.when((F.col("var_a") == "x1") & (F.col("var_b") == "y1"), F.lit(None)).otherwise(F.col("abs_r"))
    return matrix.where("not (var_a = 'x2' and var_b = 'z1')").withColumn("abs_r", undefined).persist()


@pytest.mark.parametrize("threshold", [0.25, 0.4, 0.9, 1.0])
def test_expansion(spark, gappy, threshold):
    r = strengths(gappy)
    starts = es.sample_start_sets(spark, SECTORS, 60, 1).persist()
    out = {s.sample_id: s for s in es.expand_sets(starts, SECTORS, gappy, 3, threshold).collect()}
    assert len(out) == 60
    for s in starts.collect():
        chosen = out[s.sample_id].variables
        pairs = [r[a, b] for i, a in enumerate(chosen) for b in chosen[:i]]
        assert out[s.sample_id].max_corr == pytest.approx(max(pairs, default=0.0))
        assert chosen[: len(s.variables)] == s.variables
        grown = chosen[len(s.variables) :]
        if max((r[a, b] for i, a in enumerate(s.variables) for b in s.variables[:i]), default=0.0) > threshold:
            assert not grown
            continue
        # What was accepted fits everything before it; what was not was full or in conflict at its turn.
        assert max(pairs, default=0.0) <= threshold
        have = list(s.variables)
        for pool in s.pools:
            for v in pool.variables:
                full = sum(u in SECTORS[pool.sector] for u in have) >= 3
                fits = all(u != v and r[u, v] <= threshold or u == v and threshold >= 1 for u in have)
                if grown and grown[0] == v and not full and fits:
                    have.append(grown.pop(0))
                else:
                    assert full or not fits
        assert not grown


def test_conflicts_are_packed(spark, gappy):
    r = strengths(gappy)
    for threshold in (0.3, 1.0):
        bits = np.unpackbits(conflict_bits(NAMES, gappy, threshold), axis=1)[:, : len(NAMES)]
        assert bits.tolist() == [[int((1.0 if a == b else r[a, b]) > threshold) for b in NAMES] for a in NAMES]


def test_a_variable_of_two_sectors_fails_the_set_when_drawn_twice(spark, matrix):
    starts = spark.createDataFrame(
        [(0, ["x0", "x0"], [("x", ["x1"])])], "sample_id long, variables array<string>, pools array<struct<sector string, variables array<string>>>"
    )
    out = es.expand_sets(starts, SECTORS, matrix, 3, 0.9).first()
    assert out.variables == ["x0", "x0"] and out.max_corr == 1.0


def brute_support(cells, variables, threshold):
    have = {}
    for r in cells.collect():
        have.setdefault(r.scenario, set()).add((r.variable, r.year))
    wanted = [(v, y) for v in variables for y in YEARS]
    if not all(any(c in h for h in have.values()) for c in wanted):
        return 0
    return sum(sum(c in h for c in wanted) >= int(len(wanted) * threshold) for h in have.values())


@pytest.mark.parametrize("block_bytes", [1 << 20, 50])
def test_support(spark, cells, block_bytes):
    rng = np.random.default_rng(5)
    sets = [(i, [str(v) for v in rng.choice(NAMES, size=1 + i % 6, replace=False)]) for i in range(10)]
    sets.append((10, ["x1", "nope"]))
    sets.append((11, ["x1"]))
    frame = spark.createDataFrame(sets, "sample_id long, variables array<string>")
    out = dict(rows(es.supporting_scenarios(cells, frame, YEARS, 0.8, block_bytes=block_bytes)))
    assert out == {i: brute_support(cells, v, 0.8) for i, v in sets}


def test_a_set_that_requires_nothing_counts_all_scenarios(spark, cells):
    sets = spark.createDataFrame([(0, ["x1"]), (1, ["x1", "x2"])], "sample_id long, variables array<string>")
    out = dict(rows(es.supporting_scenarios(cells, sets, [2030], 0.8)))
    assert out[0] == 80 and out[1] < 80
    assert es.complete_scenarios(cells, ["x1"], [2030], 0.8).count() == 80
    assert rows(es.count_complete(cells, ["x1"], [2030], 0.8)) == [(80,)]


def test_support_of_no_sets(spark, cells):
    empty = spark.createDataFrame([], "sample_id long, variables array<string>")
    assert es.supporting_scenarios(cells, empty, YEARS).count() == 0


def test_patterns_need_several_words(spark):
    data = [("m", f"s{s}", f"v{v}", 2030, 1.0) for s in range(9) for v in range(150) if v % (s // 3 + 2) == 0]
    columns = [(f"v{v}", 2030) for v in range(150)]
    out = presence_patterns(spark.createDataFrame(data, SCHEMA), columns).collect()
    assert sorted(r.n for r in out) == [3, 3, 3] and "w2" in out[0].__fields__
    sets = spark.createDataFrame([(1, [f"v{v}" for v in range(0, 150, 2)])], "sample_id long, variables array<string>")
    assert rows(es.supporting_scenarios(spark.createDataFrame(data, SCHEMA), sets, [2030], 0.9)) == [(1, 3)]


def test_selection_end_to_end(cells):
    ranked = es.select_variable_combinations(cells, SECTORS, YEARS, 1, 3, 0.7, 0.5, 50).collect()
    assert ranked
    keys = [(-r.n_scenarios, r.sample_id) for r in ranked]
    assert keys == sorted(keys)
    for r in ranked:
        assert r.max_corr <= 0.5 and r.n_scenarios == brute_support(cells, r.variables, 0.7)
    empty = es.select_variable_combinations(cells, {"w": ["x0"]}, YEARS, 2, 3, num_samples=5)
    assert empty.count() == 0


def test_ranking_and_numbering(spark):
    sets = spark.createDataFrame(
        [(3, ["a", "b"], 5, 0.1), (1, ["b", "a"], 5, 0.1), (2, ["c"], 9, 0.2), (4, ["d"], 0, 0.0)],
        "sample_id long, variables array<string>, n_scenarios long, max_corr double",
    )
    top = es.number_combinations(es.rank_sets(sets, 10)).orderBy("combination").collect()
    assert [(r.combination, r.sample_id) for r in top] == [(1, 2), (2, 1), (3, 3)]
    assert [r.sample_id for r in es.rank_sets(sets, distinct=True).collect()] == [2, 1]
