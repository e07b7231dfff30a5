"""Plans of the operators that would hurt most if they were planned badly."""

import pytest

import ensemblescope as es
from ensemblescope import fixtures as fx
from ensemblescope.plans import study


@pytest.fixture(scope="module")
def cells(spark, sf_dir):
    return study.prepare(fx.long(spark, sf_dir), years=fx.YEARS)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def no_cross_join(plan):
    return "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_correlation_shuffles_once_for_vectors_and_once_for_pairs(cells):
    plan = plan_of(es.correlation_matrix(cells, 1996, ["Brand#1", "Brand#2"]))
    assert plan.count("Exchange hashpartitioning") == 2 and no_cross_join(plan)
    assert "EqualTo(year,1996)" in plan and "In(variable" in plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_support_reads_the_cells_once(spark, cells):
    sets = spark.createDataFrame([(0, ["Brand#1", "Brand#2"])], "sample_id long, variables array<string>")
    plan = plan_of(es.supporting_scenarios(cells, sets, [1996, 1998]))
    # The other scans are of the sets.
    assert plan.count("ReadSchema: struct<model:string") == 1 and no_cross_join(plan)


def test_coverage_combines_before_its_shuffles(cells):
    plan = plan_of(es.coverage_by_variable(cells, [1996, 1998]))
    assert "partial_bit_or" in plan and "partial_count" in plan
    assert "region" in plan and "ReadSchema" in plan and "SortAggregate" not in plan


def test_start_sets_need_no_join_and_no_shuffle(spark):
    plan = plan_of(es.sample_start_sets(spark, {"x": ["a", "b", "c"]}, 10, 2))
    assert "Exchange" not in plan and "Join" not in plan


def test_resolving_duplicates_combines_before_the_shuffle(spark, sf_dir):
    plan = plan_of(es.first_cells(fx.long(spark, sf_dir)))
    assert "partial_min_by" in plan and no_cross_join(plan)


def test_one_order_column_keeps_the_hash_aggregate(spark):
    df = spark.createDataFrame([("m", "s", "A", 2030, 1.0, 1)], "model string, scenario string, variable string, year int, value double, input_order long")
    plan = plan_of(es.first_cells(df))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_labels_of_known_size_do_not_shuffle_the_cells(spark, sf_dir, cells):
    mapping = fx.suppliers(spark, sf_dir).select("model", "scenario", "category")
    plan = plan_of(es.attach_category_map(cells.drop("temp_bucket"), mapping))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_a_hot_scenario_is_dealt_over_salts(spark, monkeypatch):
    from ensemblescope.operators import labelling

    rows = [("m", "hot" if k % 3 else f"s{k}", f"v{k}", float(k)) for k in range(3000)] + [("m", None, "v", 1.0), (None, "x", "v", 2.0)]
    df = spark.createDataFrame(rows, "model string, scenario string, variable string, value double").repartition(4)
    labels = spark.createDataFrame([("m", "hot", "a"), ("m", "hot", "b"), ("m", "s3", "c"), ("m", "s3", "c")], "model string, scenario string, bucket string")
    small = es.attach_label(df, labels, "bucket")
    monkeypatch.setattr(labelling, "MAP_SIDE_BYTES", 0)
    salted = es.attach_label(df, labels, "bucket")
    assert salted.columns == small.columns and "__label_salt" in plan_of(salted)
    assert sorted(map(repr, salted.collect())) == sorted(map(repr, small.collect())) and small.count() == 5002
    hot, salts = labelling._hot_scenarios(df, ["model", "scenario"])
    assert len(hot) == 1 and salts == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("tiles", [3, 10])
def test_copied_cells_grow_with_the_tiles(spark, tiles):
    from ensemblescope.operators import correlation

    names = [f"v{i:02d}" for i in range(30)]
    rows = [("m", f"s{k}", v, 2030, float((k * 7 + i * k * k) % 11 + i)) for k in range(12) for i, v in enumerate(names) if (i + k) % 5]
    cells = spark.createDataFrame(rows, "model string, scenario string, variable string, year int, value double").repartition(3)
    seen = []
    plain = correlation._co_moments

    def counted(pairs):
        seen.append(len(pairs))
        return plain(pairs)

    correlation._co_moments = counted
    try:
        whole = es.correlation_matrix(cells, 2030, names)
        cut = es.correlation_matrix(cells, 2030, names, tile=30 // tiles)
    finally:
        correlation._co_moments = plain
    assert seen == [1, tiles]
    plan = plan_of(cut)
    # The cells are cut before they are copied.
    assert plan.count("Generate explode") == 1 and no_cross_join(plan)

    def near(r):
        return r.var_a, r.var_b, r.n, None if r.r is None else round(r.r, 9)
    assert sorted(map(near, whole.collect()), key=repr) == sorted(map(near, cut.collect()), key=repr)
