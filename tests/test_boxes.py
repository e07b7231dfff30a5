import numpy as np
import pytest
from conftest import rows

import ensemblescope as es
from ensemblescope import fixtures as fx
from ensemblescope.operators.boxes import fit_binning
from ensemblescope.session import materialise


def frame(spark, x, y):
    names = [f"f{i}" for i in range(x.shape[1])]
    data = [(*map(float, row), int(t)) for row, t in zip(x, y)]
    return spark.createDataFrame(data, ", ".join(f"{n} double" for n in names) + ", label int").repartition(4), names


def brute_box(x, y, alpha=0.05, mass_min=0.05):
    """The same search on plain arrays, row sets instead of histograms."""
    inside = np.ones(len(y), dtype=bool)
    lows, highs = x.min(axis=0), x.max(axis=0)
    trajectory = [(int(inside.sum()), int(y[inside].sum()))]

    def chunk(values, order_desc, rows_needed, keep_one):
        levels = np.unique(values)
        levels = levels[::-1] if order_desc else levels
        total = 0
        limit = len(levels) - (1 if keep_one else 0)
        for k in range(limit):
            total += (values == levels[k]).sum()
            if total >= rows_needed:
                break
        return levels[: k + 1]

    while y[inside].mean() < 1:
        best = None
        for j in range(x.shape[1]):
            v = x[inside, j]
            if len(np.unique(v)) < 2:
                continue
            for desc in (False, True):
                gone = chunk(v, desc, alpha * len(v), True)
                rest = inside & ~np.isin(x[:, j], gone)
                if rest.sum() < mass_min * len(y):
                    continue
                key = (y[rest].mean(), rest.sum())
                if best is None or key > best[0]:
                    best = (key, rest, j, desc)
        if best is None or best[0][0] <= y[inside].mean():
            break
        _, inside, j, desc = best
        (highs if desc else lows)[j] = x[inside, j].max() if desc else x[inside, j].min()
        trajectory.append((int(inside.sum()), int(y[inside].sum())))
    while len(trajectory) > 1:
        ok = (x >= lows) & (x <= highs)
        inside = ok.all(axis=1)
        best = None
        for j in range(x.shape[1]):
            others = np.delete(ok, j, axis=1).all(axis=1)
            for desc, outside in ((False, others & (x[:, j] < lows[j])), (True, others & (x[:, j] > highs[j]))):
                if not outside.any():
                    continue
                added = chunk(x[outside, j], not desc, alpha * inside.sum(), False)
                grown = inside | (outside & np.isin(x[:, j], added))
                key = (y[grown].mean(), grown.sum())
                if best is None or key > best[0]:
                    best = (key, grown, j, desc, added)
        mean = y[inside].mean()
        if best is None or best[0][0] < mean or best[0][0] == mean < 1:
            break
        _, grown, j, desc, added = best
        if desc:
            highs[j] = added.max()
        else:
            lows[j] = added.min()
        trajectory.append((int(grown.sum()), int(y[grown].sum())))
    return lows, highs, trajectory


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_search_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=300), rng.integers(0, 12, 300), rng.random(300).round(2)])
    y = ((x[:, 0] > 0.2) & (x[:, 1] < 7)) | (rng.random(300) < 0.15)
    df, names = frame(spark, x, y)
    box = es.find_box(df)
    lows, highs, trajectory = brute_box(x, y.astype(float))
    assert [(s.n, s.positives) for s in box.steps] == trajectory
    assert box.limits() == {n: (lo, hi) for n, lo, hi in zip(names, lows, highs)}
    stats = es.box_statistics(df, [box.limits()]).first()
    assert stats.n == box.steps[-1].n


def test_planted_box_is_found_with_and_without_binning(spark, sf_dir):
    rule = materialise(fx.rule_rows(spark, sf_dir))
    for max_bins in (4096, 200):
        box = es.find_box(rule, max_bins=max_bins)
        assert box.accepted
        assert box.limits()["l_quantity"] == (36.0, 50.0) and box.limits()["l_discount"] == (0.0, 0.04)
        restricted = es.restricted_variables(box.limits_frame(spark), es.feature_ranges(rule, fx.RULE_FEATURES))
        assert rows(restricted.where("restricted"), "variable") == [("l_discount",), ("l_quantity",)]


def test_trajectory(spark, sf_dir):
    box = es.find_box(materialise(fx.rule_rows(spark, sf_dir)))
    steps = box.trajectory(spark).orderBy("step").collect()
    assert steps[0].mass == 1 and steps[0].coverage == 1 and steps[-1].density == 1
    peels = [s for s in steps if s.step == 0 or s.n < steps[s.step - 1].n]
    assert all(b.coverage <= a.coverage and b.density > a.density for a, b in zip(peels, peels[1:]))
    assert box.trajectory_limits(spark).count() == len(steps) * len(fx.RULE_FEATURES)


def test_weak_box_is_not_accepted(spark):
    rng = np.random.default_rng(8)
    df, names = frame(spark, rng.normal(size=(200, 2)), rng.random(200) < 0.1)
    box = es.find_box(df, threshold=0.99)
    assert not box.accepted
    x = np.array([r[:2] for r in df.collect()])
    assert box.limits()["f0"] == (x[:, 0].min(), x[:, 0].max())


def test_no_positive_rows(spark):
    df, _ = frame(spark, np.arange(20.0).reshape(10, 2), np.zeros(10))
    box = es.find_box(df)
    assert len(box.steps) == 1 and not box.accepted


def test_statistics_of_several_boxes(spark):
    df, _ = frame(spark, np.array([[1, 1], [2, 1], [3, 1], [4, 2]], dtype=float), [0, 1, 1, 0])
    out = es.box_statistics(df, [{"f0": (2, 3)}, {"f0": (2, 9), "f1": (1, 2)}, {"f0": (90, 99)}]).orderBy("box_index").collect()
    assert [(r.n, r.mass, r.density, r.coverage, r.res_dim) for r in out] == [
        (2, 0.5, 1.0, 1.0, 1), (3, 0.75, pytest.approx(2 / 3), 1.0, 1), (0, 0.0, 0.0, 0.0, 1)
    ]


def test_assessment_rounds_half_to_even(spark):
    stats = spark.createDataFrame(
        [(0, 0.5625, 0.25, 0.1, 2), (1, 0.0, 0.0, 0.0, 0), (2, None, 0.1, 0.1, 1)],
        "box_index int, density double, coverage double, mass double, res_dim int",
    )
    out = es.assess_boxes(stats)
    assert [tuple(r) for r in out.orderBy("box_index").collect()] == [(0, 0.562, 0.25, 0.346, 2, 0.1), (1, 0.0, 0.0, 0.0, 0, 0.0)]
    assert es.best_f1(out).first()[0] == 0.346
    assert es.best_f1(out.where("false")).first()[0] == 0.0


def test_restricted_and_ranked_variables(spark):
    schema = "variable string, low double, high double"
    limits = spark.createDataFrame([("a", 1.0, 2.0), ("b", 0.0, 1.0), ("c", float("-inf"), 0.5), ("d", 1e6, 2e6)], schema)
    ranges = spark.createDataFrame([("a", 0.0, 2.0), ("b", 5e-7, 1.0), ("c", 0.0, 1.0), ("d", 1e6 + 5, 2e6)], schema)
    found = es.restricted_variables(limits, ranges)
    assert rows(found.where("restricted"), "variable") == [("a",), ("c",)]
    inf = float("inf")
    assert [tuple(r) for r in es.rank_box_variables(found).collect()] == [("a", 1.0), ("b", inf), ("c", inf), ("d", inf)]


def test_box_points(spark):
    df, _ = frame(spark, np.array([[1, 1], [2, 1]], dtype=float), [0, 1])
    assert rows(es.box_points(df, {"f0": (2, 3)}, ["f0"])) == [(1.0, 0, False), (2.0, 1, True)]


def test_bins_of_skewed_values_stay_small(spark):
    rng = np.random.default_rng(9)
    x = np.column_stack([np.exp(rng.normal(size=3000) * 6), np.where(rng.random(3000) < 0.4, 0.0, rng.normal(size=3000))])
    df, names = frame(spark, x, np.zeros(3000))
    binning = fit_binning(df, names, max_bins=100)
    for j in range(2):
        lows, highs = binning.lows[j], binning.highs[j]
        assert (lows <= highs).all() and (highs[:-1] < lows[1:]).all() and len(lows) <= 600
        counts = np.array([((x[:, j] >= a) & (x[:, j] <= b)).sum() for a, b in zip(lows, highs)])
        assert counts.sum() == 3000
        assert all(n <= 60 or a == b for n, a, b in zip(counts, lows, highs))


def test_limits_do_not_depend_on_the_number_of_bins(spark):
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=4000), rng.exponential(size=4000), rng.integers(0, 9, 4000)])
    y = ((x[:, 0] > 0.35) & (x[:, 1] < 1.2)) | (rng.random(4000) < 0.1)
    df, names = frame(spark, x, y)
    lows, highs, trajectory = brute_box(x, y.astype(float))
    for max_bins in (8, 64, 40_000):
        box = es.find_box(df, max_bins=max_bins)
        assert [(s.n, s.positives) for s in box.steps] == trajectory
        assert box.limits() == {n: (lo, hi) for n, lo, hi in zip(names, lows, highs)}


def test_missing_values_are_refused(spark):
    df = spark.createDataFrame([(1.0, None, 1), (2.0, 3.0, 0)], "a double, b double, label int")
    with pytest.raises(ValueError, match="b"):
        es.find_box(df)


@pytest.mark.parametrize("seed", [0])
def test_rows_in_one_task_or_all_give_the_same_trajectory(spark, monkeypatch, seed):
    from ensemblescope.operators import boxes

    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=200), rng.integers(0, 9, 200)])
    y = ((x[:, 0] > 0.2) & (x[:, 1] > 3)) ^ (rng.random(200) < 0.1)
    df, names = frame(spark, x, y)
    rules = {"peel_alpha": 0.25, "paste_alpha": 0.25, "max_bins": 16}
    here = es.find_box(df, features=names, **rules)
    monkeypatch.setattr(boxes, "TASK_CELLS", 0)
    spread = es.find_box(df, features=names, **rules)
    assert here == spread and len(here.steps) > 2
    assert [(s.n, s.positives) for s in here.steps] == brute_box(x, y.astype(float), 0.25)[2]


def test_ruled_out_sides_are_not_counted_again(spark, monkeypatch):
    from ensemblescope.operators import boxes

    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 5))
    df, names = frame(spark, x, x[:, 0] > 0.5)
    asked = []
    plain = boxes._finish
    monkeypatch.setattr(boxes, "_finish", lambda rows, searches: asked.append(len(searches)) or plain(rows, searches))
    box = es.find_box(df, features=names, max_bins=64)
    pruned = boxes._promising
    tasks = boxes._TaskRows(list(np.ascontiguousarray(x.T)), x[:, 0] > 0.5)
    monkeypatch.setattr(boxes, "_promising", lambda searches, bounds: pruned(searches, bounds) or searches)
    found = boxes._search(tasks, tasks.binning(names, 64), 0.5, 0.05, 0.05, 0.05)
    kept = list(asked)
    monkeypatch.setattr(boxes, "_promising", lambda searches, bounds: searches)
    asked.clear()
    whole = boxes._search(tasks, tasks.binning(names, 64), 0.5, 0.05, 0.05, 0.05)
    assert found.steps == whole.steps == box.steps
    assert sum(kept) < sum(asked) / 2


def test_boxes_of_many_models_in_one_job(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    rows = [(0, [float(a), float(b)], int(a > 0.3)) for a, b in x] + [(1, [float(a)], int(a < -0.5)) for a, _ in x] + [(2, [None], 1), (2, [1.0], 0)]
    df = spark.createDataFrame(rows, "m int, x array<double>, y int").repartition(5)
    from ensemblescope.operators.boxes import find_boxes

    found = find_boxes(df, F.col("m"), F.col("x"), F.col("y"), {0: ["a", "b"], 1: ["a"], 2: ["z"], 3: ["none"]})
    assert set(found) == {0, 1, 2} and isinstance(found[2], ValueError)
    for m, d, y in ((0, 2, x[:, 0] > 0.3), (1, 1, x[:, 0] < -0.5)):
        one, names = frame(spark, x[:, :d], y)
        assert es.find_box(one, features=names).steps == found[m].steps
