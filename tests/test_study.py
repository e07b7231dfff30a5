import json
from pathlib import Path

import pytest

import ensemblescope as es
from ensemblescope import fixtures as fx
from ensemblescope.operators import boxes
from ensemblescope.plans import study


OPTIONS = es.StudyOptions(
    years=fx.YEARS, corr_threshold=1.0, num_samples=30, num_combinations=2, completeness=0.6, max_vars=3,
    boosted_trees={"n_trees": 3, "max_depth": 3}, forest={"n_trees": 10},
)


@pytest.fixture(scope="module")
def finished(spark, sf_dir, tmp_path_factory):
    output = str(tmp_path_factory.mktemp("study") / "out")
    long = es.tidy(fx.scenario_long(spark, sf_dir, sparse=True))
    return es.run_study(long, fx.sector_map(spark, sf_dir), OPTIONS, output), output


def test_records(finished):
    analyses, _ = finished
    assert [a.record["combination"] for a in analyses] == [1, 2]
    for a in analyses:
        r = a.record
        assert r["max_correlation"] <= 1.0 and r["n_scenarios"] == a.tables["filtered"].count()
        assert "error" not in r
        assert [r[b]["error"] for b in ("prim", "shap", "rf", "pca") if "error" in r[b]] == []
        assert "correlation" not in r
        assert r["pca"]["cumulative_variance"][-1] == pytest.approx(sum(r["pca"]["explained_variance"]))
        for block in ("shap", "rf"):
            values = r[block]["top_10_importance"]
            assert values == sorted(values, reverse=True) and len(values) == 10
        assert r["prim"]["n_restricted_vars"] == len(r["prim"]["restricted_vars"])
    assert analyses[0].record["n_scenarios"] >= analyses[1].record["n_scenarios"]


def test_files(spark, finished):
    analyses, output = finished
    base = Path(output)
    lines = [json.loads(x) for f in base.glob("study_summary/*.json") for x in f.read_text().splitlines()]
    assert [r["variables"] for r in sorted(lines, key=lambda r: r["combination"])] == [a.record["variables"] for a in analyses]
    summary = spark.read.option("header", True).csv(f"{output}/selection_summary")
    assert summary.columns == ["combination", "n_variables", "n_scenarios", "max_correlation", "variables"]
    report = spark.read.option("header", True).csv(f"{output}/report")
    assert report.count() == 2 and "top_shap" in report.columns
    for kind in ("box_assessment", "box_ranking", "shap_importance", "rf_importance", "filtered", "pca_scores", "correlation"):
        assert (base / kind / "combination=2").exists()


def test_raw_limits_undo_the_scaling(finished):
    analyses, _ = finished
    filtered, limits = analyses[0].tables["filtered"], analyses[0].tables["box_limits"].collect()
    for r in limits[:3]:
        low, high = filtered.selectExpr(f"min(`{r.variable}`)", f"max(`{r.variable}`)").first()
        assert low - 1e-6 <= r.raw_low <= r.raw_high <= high + 1e-6


def test_a_failing_block_is_recorded(spark, sf_dir, monkeypatch):
    def fail(*args, **kwargs):
        raise ValueError("no box today")

    monkeypatch.setattr(boxes, "find_boxes", fail)
    cells = study.prepare(es.tidy(fx.scenario_long(spark, sf_dir)), None, list(fx.YEARS))
    one = {"combination": 1, "variables": ["Brand#1", "Brand#2"], "n_scenarios": 10, "max_corr": 0.5}
    done = es.analyse_combination(cells, one, OPTIONS)
    assert done.record["prim"] == {"error": "no box today"} and "top_10_vars" in done.record["rf"]
    nothing = es.analyse_combination(cells, {**one, "variables": ["nope"]}, OPTIONS)
    assert "error" in nothing.record
    records = study.records_frame(spark, [done, nothing])
    report = es.combination_report(records).collect()
    assert len(report) == 2 and report[0].best_f1 is None and report[0].top_rf is not None
    assert report[0].error == "no box today" and report[1].error and report[1].top_rf is None


def test_other_errors_are_raised(spark, sf_dir, monkeypatch):
    def fail(*args, **kwargs):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(boxes, "find_boxes", fail)
    cells = study.prepare(es.tidy(fx.scenario_long(spark, sf_dir)), None, list(fx.YEARS))
    with pytest.raises(RuntimeError, match="executor lost"):
        es.analyse_combination(cells, {"combination": 1, "variables": ["Brand#1", "Brand#2"], "n_scenarios": 10, "max_corr": 0.5}, OPTIONS)


def test_records_name_sectors_classes_and_reach(finished):
    for analysis in finished[0]:
        record = analysis.record
        assert len(record["sectors"]) == len(record["variables"]) and "Unknown" not in record["sectors"]
        assert sum(record["class_counts"].values()) == analysis.tables["filtered"].count()
        assert 1 <= record["shap"]["n_vars_for_80_percent"] <= 2 * len(record["variables"])


def test_cells_are_gathered_once_for_all_combinations(spark, monkeypatch):
    """A cell meets its column once, however many combinations use it; rows are those of each combination alone."""
    table = [("m", f"s{s}", v, y, float(10 * s + i)) for s in range(6) for i, (v, y) in enumerate([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1)]) if (s + i) % 3]
    cells = spark.createDataFrame(table, "model string, scenario string, variable string, year int, value double")
    columns = {k: [("a", 1), ("b", 1), ("b", 2), ("c", 1)][: 2 + k % 3] for k in range(1, 9)}
    combinations = [{"combination": k, "variables": sorted({v for v, _ in c})} for k, c in columns.items()]
    joined, whole = [], study.small_table
    monkeypatch.setattr(study, "small_table", lambda spark, rows, schema: (joined.append((schema, rows)), whole(spark, rows, schema))[1])
    options = es.StudyOptions(years=(1, 2), completeness=0.9)
    found = study._complete_rows(cells, combinations, options, ["model", "scenario"], columns)
    assert sum(len(rows) for schema, rows in joined if "variable string" in schema) == 4
    expected = []
    for k, listed in columns.items():
        for s in range(6):
            held = {(v, y): value for _, name, v, y, value in table if name == f"s{s}"}
            x = [held.get(c) for c in listed]
            if sum(v is not None for v in x) >= int(len(listed) * 0.9):
                expected.append((k, "m", f"s{s}", x))
    assert 0 < len(expected) < 48
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert found.columns == ["combination", "model", "scenario", "x"]


def test_scratch_is_deleted(spark):
    from ensemblescope.session import materialise, scratch, shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    with scratch(spark):
        assert materialise(spark.range(5)).count() == 5
        assert set(folder.iterdir()) > before
    assert set(folder.iterdir()) == before
