"""Queries over the test tables and the SQL that must give the same rows."""

from __future__ import annotations

import importlib
import os
import sys
import warnings
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import ensemblescope as es
from ensemblescope import fixtures as fx
from ensemblescope.functions.fixed_values import CLUSTER_LABELS
from ensemblescope.functions.names import parsed_variable, parsed_year
from ensemblescope.operators import features
from ensemblescope.operators.projection import cumulative_variance, long_features
from ensemblescope.operators.reshape import small_table
from ensemblescope.plans import study
from ensemblescope.session import materialise, scratch_path
from ensemblescope.sources import column_groups, readers, schema, writers



def _optional(name: str):
    """A module that may have been deleted, or whose own extras may not be installed; other errors are raised."""
    try:
        return importlib.import_module(name)
    except ModuleNotFoundError as error:
        if error.name in EXTRAS:
            warnings.warn(f"{name} is left out: {error.name} is not installed", stacklevel=2)
        elif error.name not in ("corpus_pipeline", "ensemblescope.llm"):
            raise
        return None


#: What only the operators for training text need.
EXTRAS = ("public_tokenizers", "regex", "sentencepiece", "tiktoken", "tokenizers", "xxhash", "zstandard")

llm_queries = _optional("ensemblescope.llm.queries")
corpus_pipeline = _optional("corpus_pipeline")

YEARS = list(fx.YEARS)
SAMPLES = 1000
BOX = {"l_quantity": (30.0, 50.0), "l_discount": (0.0, 0.06)}
BOXES = [BOX, {"l_quantity": (36.0, 50.0), "l_discount": (0.0, 0.04)}, {"p_size": (10.0, 20.0)}]


def _r(column, digits: int = 4):
    return F.round(column, digits) + F.lit(0.0)


# -- reshape and labels -----------------------------------------------------------------


def q_tidy_long(spark, d):
    return fx.long(spark, d).drop("input_order")


def q_coverage_table(spark, d):
    return es.coverage_by_variable(fx.long(spark, d, sparse=True), YEARS)


def q_coverage_one(spark, d):
    return es.coverage_of(fx.long(spark, d, sparse=True), "Brand#7", YEARS)


def q_pivot_first(spark, d):
    cells = fx.cells(spark, d)
    return es.pivot_cells(cells, [(v, y) for v in fx.brands(spark, d) for y in YEARS])


def q_unpivot_years(spark, d):
    return es.unpivot_years(fx.semi_wide(fx.cells(spark, d)))


def q_parse_year_names(spark, d):
    parts = fx.read(spark, d, "part")
    kind = F.col("p_partkey") % 4
    name = (
        F.when(kind == 0, F.concat("p_brand", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")")))
        .when(kind == 1, F.concat("p_brand", F.lit("|"), "p_type", F.lit(" (incl. x) ( "), F.col("p_size").cast("string"), F.lit(" )")))
        .when(kind == 2, F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")))
        .otherwise(F.col("p_name"))
    )
    return parts.select("p_partkey", name.alias("name")).select(
        "p_partkey", "name", parsed_variable(F.col("name")).alias("variable"), parsed_year(F.col("name")).alias("year")
    )


def q_roundtrip_wide(spark, d):
    wide = es.pivot_cells(fx.cells(spark, d, sparse=True), [(v, y) for v in fx.brands(spark, d) for y in YEARS])
    return es.first_cells(es.tidy(wide), rule="smallest")


def q_shape_report(spark, d):
    return es.shape_report(fx.long(spark, d, sparse=True))


def _categories(spark, d):
    """Categories with stray blanks and two outside the map."""
    number = (F.col("s_suppkey") % 11).cast("string")
    name = F.when(F.col("s_suppkey") % 11 == 0, "failed-vetting").otherwise(F.concat(F.lit("C"), number))
    text = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" "), name, F.lit("  "))).otherwise(name)
    return fx.read(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 > 0, text).alias("category"))


def _bucket_query(unmapped):
    def query(spark, d):
        return _categories(spark, d).withColumn("temp_bucket", es.temp_bucket(F.col("category"), unmapped))

    return query


def q_bucket_counts(spark, d):
    scenarios = fx.suppliers(spark, d).withColumn("temp_bucket", es.temp_bucket(F.col("category")))
    return es.value_counts(scenarios, "temp_bucket")


def q_binary_target(spark, d):
    scenarios = _categories(spark, d).withColumn("temp_bucket", es.temp_bucket(F.col("category")))
    by_category = es.binary_target(scenarios.select("category"))
    return scenarios.select("s_suppkey", es.binary_target(scenarios).alias("label"), by_category.alias("strict_label"))


def q_display_labels(spark, d):
    rows = fx.scenario_long(spark, d).select(es.temp_bucket(F.col("category")).alias("bucket"))
    counted = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "bucket", es.display_label(F.col("bucket")).alias("label"), es.bucket_colour(F.col("bucket")).alias("colour"), "n"
    )


def q_sector_default(spark, d):
    parts = fx.read(spark, d, "part")
    mapping = parts.select(F.col("p_brand").alias("variable"), F.col("p_type").alias("sector"), F.col("p_partkey").alias("ordinal"))
    variables = parts.select(F.explode(F.array("p_brand", "p_name")).alias("variable"))
    counted = variables.groupBy("variable").agg(F.count(F.lit(1)).alias("n"))
    return es.assign_sector(counted, mapping).select("variable", "sector", "n")


def _wide_sector_map(spark, d):
    """A map that also lists variables the data does not have."""
    types = fx.read(spark, d, "part").select(F.col("p_type").alias("variable")).distinct()
    return fx.sector_map(spark, d).select("variable", "sector").unionByName(types.select("variable", F.lit("T").alias("sector")))


def q_sector_present(spark, d):
    return es.present_sector_variables(_wide_sector_map(spark, d), fx.long(spark, d))


def q_sector_absent(spark, d):
    return es.absent_sector_variables(_wide_sector_map(spark, d), fx.long(spark, d))


def q_category_join(spark, d):
    mapping = fx.suppliers(spark, d).select("model", "scenario", "category")
    return es.attach_category_map(fx.cells(spark, d).drop("temp_bucket"), mapping)


def q_bucket_join(spark, d):
    long = fx.cells(spark, d, sparse=True)
    per_scenario = long.groupBy("model", "scenario").agg(F.count(F.lit(1)).alias("n_cells"))
    return es.attach_label(per_scenario, long, "temp_bucket")


def _written_cells(spark, d, sparse=False):
    """Cells of the two years, written once for queries that read them several times."""
    return study.prepare(fx.long(spark, d, sparse), years=YEARS)


# -- completeness and correlation ---------------------------------------------------------


def q_completeness_filter(spark, d):
    return es.complete_scenarios(_written_cells(spark, d, sparse=True), fx.brands(spark, d), YEARS, 0.7)


def q_count_valid(spark, d):
    return es.count_complete(fx.long(spark, d, sparse=True), fx.brands(spark, d), YEARS, 0.7)


def q_corr_pairs(spark, d):
    pairs = es.correlation_pairs(_written_cells(spark, d), YEARS[0])
    return pairs.select("var_a", "var_b", "n", _r("r").alias("r"), _r("abs_r").alias("abs_r"))


def q_corr_matrix(spark, d):
    square = es.square_matrix(es.correlation_matrix(fx.cells(spark, d, sparse=True), YEARS[1], fx.brands(spark, d)))
    return square.select("var_a", "var_b", _r("r").alias("r"))


def q_corr_top_pairs(spark, d):
    top = es.top_pairs(es.correlation_matrix(_written_cells(spark, d), YEARS[0]), 10, mirrored=True)
    return top.select("var_a", "var_b", _r("abs_r").alias("abs_r"))


# -- selection -------------------------------------------------------------------------------


def _sectors(spark, d, cells):
    return es.sector_variables(fx.sector_map(spark, d), cells)


def _starts(spark, d, cells):
    return es.sample_start_sets(spark, _sectors(spark, d, cells), SAMPLES)


def q_sample_start_sets(spark, d):
    sets = _starts(spark, d, fx.long(spark, d))
    return sets.select("sample_id", F.posexplode("variables").alias("position", "variable"))


def q_sample_sectors(spark, d):
    sets = _starts(spark, d, fx.long(spark, d))
    return es.combination_sectors(sets, fx.sector_map(spark, d))


def q_set_max_corr(spark, d):
    cells = _written_cells(spark, d)
    top = es.set_max_correlation(_starts(spark, d, cells), es.correlation_matrix(cells, YEARS[0], fx.brands(spark, d)))
    return top.select("sample_id", _r("max_corr").alias("max_corr"))


def q_expanded_sets(spark, d):
    cells = _written_cells(spark, d)
    sectors = _sectors(spark, d, cells)
    matrix = es.correlation_matrix(cells, YEARS[0], fx.brands(spark, d))
    grown = es.expand_sets(es.sample_start_sets(spark, sectors, SAMPLES), sectors, matrix, 4, 0.2)
    return es.weakly_correlated(grown, 0.2).select(
        "sample_id", F.concat_ws(",", "variables").alias("variables"), _r("max_corr").alias("max_corr")
    )


def q_valid_counts_all_sets(spark, d):
    cells = _written_cells(spark, d, sparse=True)
    return es.supporting_scenarios(cells, _starts(spark, d, cells), YEARS, 0.8)


def _selected(spark, d):
    cells = _written_cells(spark, d, sparse=True)
    return es.select_variable_combinations(
        cells, _sectors(spark, d, cells), YEARS, min_vars=2, max_vars=3, corr_threshold=0.4, num_samples=SAMPLES
    )


def q_ranked_sets(spark, d):
    ranked = _selected(spark, d)
    return ranked.select(
        "sample_id", F.concat_ws(",", "variables").alias("variables"), "n_scenarios", _r("max_corr").alias("max_corr")
    )


def q_selection_summary(spark, d):
    top = es.number_combinations(es.rank_sets(_selected(spark, d), 10))
    summary = writers.selection_summary(top)
    path = writers.write_table(summary, scratch_path(spark, "summary"))
    numbers = "combination int, n_variables int, n_scenarios bigint, max_correlation double, variables string"
    back = spark.read.schema(numbers).option("header", True).csv(path)
    return back.withColumn("max_correlation", _r("max_correlation"))


# -- features ---------------------------------------------------------------------------------


def _matrix(spark, d):
    """Scaled matrix of the fuller scenarios, with keys and label."""
    filtered = materialise(es.complete_scenarios(_written_cells(spark, d, sparse=True), fx.brands(spark, d), YEARS, 0.6))
    labelled = filtered.withColumn("label", es.binary_target(filtered))
    matrix, scaling = es.scale_and_impute(labelled, es.feature_columns(filtered))
    return filtered, materialise(matrix), scaling


def _long_form(df):
    return es.unpivot_names(df, ["model", "scenario"]).select(
        "model", "scenario", "variable", "year", _r("value").alias("value")
    )


def q_mean_impute(spark, d):
    filtered, _, scaling = _matrix(spark, d)
    imputed = features.impute_mean(filtered, scaling)
    # Means of cents fall on rounding ties, their logarithms do not.
    cells = es.unpivot_names(imputed.drop("region", "temp_bucket"), ["model", "scenario"])
    return cells.select("model", "scenario", "variable", "year", _r(F.log("value"), 6).alias("log_value"))


def q_standardise(spark, d):
    return _long_form(_matrix(spark, d)[1].drop("region", "temp_bucket", "label"))


def q_feature_ranges(spark, d):
    return es.feature_ranges(fx.rule_rows(spark, d), fx.RULE_FEATURES)


def q_hash_split(spark, d):
    training = es.is_training_row(F.col("o_orderkey"), F.col("o_custkey"))
    return fx.read(spark, d, "orders").select("o_orderkey", "o_custkey", training.cast("int").alias("training"))


# -- boxes ---------------------------------------------------------------------------------------


def q_box_stats(spark, d):
    stats = es.box_statistics(fx.rule_rows(spark, d), BOXES)
    return stats.select("box_index", "n", *[_r(c, 6).alias(c) for c in ("mass", "density", "coverage")], "res_dim")


def q_box_assess(spark, d):
    return es.assess_boxes(es.box_statistics(fx.rule_rows(spark, d), BOXES))


def q_box_best_f1(spark, d):
    return es.best_f1(q_box_assess(spark, d))


def _restricted(spark, d):
    rows = fx.rule_rows(spark, d)
    ranges = es.feature_ranges(rows, fx.RULE_FEATURES)
    # The box limits of BOX, the data's own extremes elsewhere.
    limits = ranges
    for f, (low, high) in BOX.items():
        here = F.col("variable") == f
        limits = limits.withColumns(
            {"low": F.when(here, F.lit(low)).otherwise(F.col("low")), "high": F.when(here, F.lit(high)).otherwise(F.col("high"))}
        )
    return es.restricted_variables(limits, ranges)


def q_box_restricted(spark, d):
    return _restricted(spark, d)


def q_box_rank(spark, d):
    return es.rank_box_variables(_restricted(spark, d)).withColumn("width", _r("width"))


def q_peel_candidates(spark, d):
    peels = es.peel_candidates(fx.rule_rows(spark, d), {"l_quantity": (30.0, 50.0)})
    return peels.select("variable", "side", "bound", "removed", _r("mass", 6).alias("mass"), _r("mean", 6).alias("mean"))


def _found(spark, d):
    rows = materialise(fx.rule_rows(spark, d))
    return rows, es.find_box(rows)


def q_find_box(spark, d):
    rows, box = _found(spark, d)
    ranges = es.feature_ranges(rows, fx.RULE_FEATURES)
    return es.restricted_variables(box.limits_frame(spark), ranges).select("variable", "low", "high", "restricted")


def q_box_trajectory(spark, d):
    """First and last box, counted from the raw rows, and how many steps that count contradicts."""
    rows, box = _found(spark, d)
    counted = es.recount_steps(rows, box).withColumnRenamed("n", "rows_inside")
    both = box.trajectory(spark).join(counted, "step")
    wrong = (F.col("n") != F.col("rows_inside")) | (F.abs(F.col("density") * F.col("n") - F.col("positives")) > 1e-6)
    ends = {"first": F.col("step") == 0, "last": F.col("step") == len(box.steps) - 1}
    sums = [F.sum(F.when(at, F.col(c))).alias(f"{end}_{c}") for end, at in ends.items() for c in ("rows_inside", "positives")]
    return both.agg(*sums, F.count_if(wrong).alias("contradicted"))


def q_box_points(spark, d):
    points = es.box_points(fx.rule_rows(spark, d), BOX, list(BOX))
    return points.groupBy("in_box", "label").agg(
        F.count(F.lit(1)).alias("n"),
        _r(F.sum("l_quantity"), 2).alias("sum_quantity"),
        _r(F.sum("l_discount"), 2).alias("sum_discount"),
    )


# -- importance tables --------------------------------------------------------------------------


def q_class_metrics(spark, d):
    labelled = fx.quality_labels(spark, d)
    predicted = labelled.select("quality", (F.col("n_chars") >= 1000).cast("int").alias("prediction"))
    metrics = es.classification_metrics(predicted, "quality")
    return metrics.select("n", _r("accuracy", 6).alias("accuracy"), _r("f1", 6).alias("f1"))


def _variable_weights(spark, d):
    cells = fx.cells(spark, d, sparse=True)
    return cells.groupBy("variable").agg(F.sum("value").alias("importance"))


def q_importance_share(spark, d):
    shares = es.cumulative_share(_variable_weights(spark, d))
    return shares.select("variable", _r("importance", 2).alias("importance"), _r("share", 6).alias("share"))


def q_importance_count(spark, d):
    return es.variables_to_reach(_variable_weights(spark, d), 0.8)


def q_importance_top(spark, d):
    return es.top_variables(_variable_weights(spark, d), 10).select("variable", _r("importance", 2).alias("importance"))


def q_cumulative_variance(spark, d):
    number = F.substring_index("variable", "#", -1).cast("int")
    spread = fx.cells(spark, d).groupBy(number.alias("component")).agg(F.var_pop("value").alias("v"))
    # One row per variable, so a window over all of them is small.
    shares = spread.select("component", (F.col("v") / F.sum("v").over(Window.partitionBy())).alias("explained"))
    return cumulative_variance(shares).select("component", _r("explained", 6).alias("explained"), _r("cumulative", 6).alias("cumulative"))


def _dimensions(table):
    return [c for c in table.columns if c.startswith("e")]


def q_cluster_quartiles(spark, d):
    table = fx.embedding_matrix(spark, d)
    summary = es.box_plot_summary(table, "cluster", _dimensions(table))
    return summary.select("cluster", "variable", "n", *[_r(c).alias(c) for c in summary.columns if c not in ("cluster", "variable", "n")])


def q_combined_quartiles(spark, d):
    table = fx.embedding_matrix(spark, d)
    summary = es.combined_box_plot(table, "cluster", CLUSTER_LABELS, _dimensions(table))
    return summary.select("label", "variable", "n", *[_r(c).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")])


def q_cluster_label_map(spark, d):
    table = fx.read(spark, d, "embeddings")
    return table.select("vec_id", es.cluster_label(F.col("label"), CLUSTER_LABELS).alias("bucket"))


def q_top_per_cluster(spark, d):
    table = fx.embedding_matrix(spark, d)
    means = long_features(table, "cluster", _dimensions(table)).groupBy("cluster", "variable").agg(
        F.round(F.abs(F.avg("value")), 9).alias("importance")
    )
    return es.top_per_cluster(means, 10).select("cluster", "variable", _r("importance").alias("importance"))


# -- models: SQL checks what holds of any right result ---------------------------------------------


def _embedding_scaled(spark, d):
    table = fx.embedding_matrix(spark, d)
    scaled, _ = es.scale_and_impute(table, _dimensions(table))
    return materialise(scaled)


PLANTED = "Brand#7 (1996)"


def q_rf_importance(spark, d):
    """Forests for the label and for one that a single variable decides: it must lead, and shares add up to 1."""
    _, matrix, scaling = _matrix(spark, d)
    names = list(scaling.mean)
    planted = (F.col(f"`{PLANTED}`") > 0).cast("int")
    labels = F.explode(F.array(F.struct(F.lit(0).alias("model"), F.col("label").alias("y")), F.struct(F.lit(1).alias("model"), planted.alias("y"))))
    rows = matrix.select(es.feature_array(names).alias("x"), labels.alias("case")).select("x", "case.*")
    found = es.forest_models(rows, F.col("model"), F.col("x"), F.col("y"), dict.fromkeys((0, 1), names))
    whole = Window.partitionBy("model")
    leads = (F.col("model") == 1) & (F.col("importance") == F.max("importance").over(whole))
    return found.select("model", "variable", leads.alias("leads"), _r(F.sum("importance").over(whole), 6).alias("total"))


def q_cluster_rf(spark, d):
    """Top variables of each cluster, with one variable added that tells clusters apart."""
    table = _embedding_scaled(spark, d).withColumn("planted", F.col("cluster").cast("double"))
    found = es.cluster_importance(table, CLUSTER_LABELS, features=[*_dimensions(table), "planted"])
    top = F.max_by("variable", "importance")
    return found.groupBy("cluster", "bucket").agg(F.count(F.lit(1)).alias("n"), top.alias("top_variable"))


def _explained(spark, d):
    _, matrix, scaling = _matrix(spark, d)
    names = list(scaling.mean)
    importance, metrics, trees = es.shap_importance(matrix, fx.KEYS, features=names)
    return matrix, names, importance, metrics, trees


def _additive(matrix, names, trees, phi):
    """(keys, additive): whether a row's attributions add up to the margin that its walk down the trees gives."""
    walked = es.walked_margins(matrix, fx.KEYS, es.feature_array(names), trees.nodes, trees.start, 6)
    sums = phi.groupBy(*fx.KEYS).agg((F.sum("phi") + F.lit(trees.ensemble.base)).alias("told"))
    return walked.join(sums, fx.KEYS).select(*fx.KEYS, (F.abs(F.col("margin") - F.col("told")) < 1e-6).alias("additive"))


def q_shap_importance(spark, d):
    """Scenarios, those whose attributions add up, and variables whose importance is their mean absolute attribution."""
    matrix, names, importance, metrics, trees = _explained(spark, d)
    phi = materialise(es.shap_summary(matrix, trees, fx.KEYS, names))
    rows = _additive(matrix, names, trees, phi).agg(F.count(F.lit(1)).alias("n_scenarios"), F.count_if("additive").alias("n_additive"))
    means = phi.groupBy("variable").agg(F.avg(F.abs("phi")).alias("mean_phi")).join(importance, "variable")
    right = means.agg(F.count_if(F.abs(F.col("mean_phi") - F.col("importance")) < 1e-9).alias("n_variables"), F.count_if(F.col("importance") > 0).cast("boolean").alias("some_matter"))
    tested = metrics.select(F.col("accuracy").between(0, 1).alias("accuracy_ok"))
    # One row each.
    return rows.join(right, F.lit(True)).join(tested, F.lit(True))


def q_shap_summary(spark, d):
    """Every value of the summary plot over all variables, and whether its row's attributions add up."""
    matrix, names, importance, _, trees = _explained(spark, d)
    top = [r.variable for r in es.top_variables(importance, len(names)).collect()]
    phi = materialise(es.shap_summary(matrix, trees, fx.KEYS, top))
    rows = phi.join(_additive(matrix, names, trees, phi), fx.KEYS)
    return rows.select("model", "scenario", F.col("variable").alias("column"), _r("value").alias("value"), "additive")


def q_pca_scores(spark, d):
    """Squared length of every row on all components: that of the standardised row."""
    table = _embedding_scaled(spark, d)
    scores = es.principal_components(table, ["vec_id", "cluster"], n_components=len(_dimensions(table))).scores
    squares = F.aggregate(F.array(*[c for c in scores.columns if c.startswith("pc")]), F.lit(0.0), lambda a, v: a + v * v)
    return scores.select("vec_id", "cluster", _r(squares).alias("squared_length"))


def q_pca_variance(spark, d):
    """Per component: whether the variance of its scores is the share it is said to explain."""
    table = _embedding_scaled(spark, d)
    names = _dimensions(table)
    found = es.principal_components(table, ["vec_id", "cluster"])
    total = sum((F.var_pop(n) for n in names), F.lit(0.0))
    spread = F.array(*[F.struct(F.lit(k).alias("component"), F.var_pop(f"pc{k}").alias("spread")) for k in range(1, 6)])
    measured = found.scores.agg(spread.alias("spread")).select(F.inline("spread"))
    whole = table.agg(total.alias("whole"))
    right = F.abs(F.col("spread") / F.col("whole") - F.col("explained")) < 1e-9
    order = Window.orderBy("component")
    falls = F.coalesce(F.lag("explained").over(order) >= F.col("explained"), F.lit(True))
    # One row a component, and one row of totals.
    return found.variance.join(measured, "component").join(whole, F.lit(True)).select("component", right.alias("right"), falls.alias("falls"))


def q_pca_projection(spark, d):
    """Plot rows by bucket: how many, and how many have all coordinates."""
    _, matrix, scaling = _matrix(spark, d)
    scores = es.principal_components(matrix, [*fx.KEYS, "label"], list(scaling.mean)).scores
    points = es.bucket_projection(scores)
    filled = F.col("pc2").isNotNull() & F.col("pc3").isNotNull() & F.col("pc4").isNotNull()
    return points.groupBy("temp_bucket", "label", "colour").agg(F.count(F.lit(1)).alias("n"), F.count_if(filled).alias("n_filled"))


def q_pair_points(spark, d):
    """Points of every cluster, and how many are no longer than their standardised row."""
    table = _embedding_scaled(spark, d)
    projected = es.principal_components(table, ["vec_id", "cluster"], n_components=6)
    points = es.pair_points(projected.scores)
    parts = [c for c in points.columns if c.startswith("pc")]
    return points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count(F.struct(*parts)).alias("n_points"), F.lit(len(parts)).alias("n_components"))


def report_options():
    return study.StudyOptions(years=fx.YEARS, corr_threshold=0.5, completeness=0.7)


def q_combination_report(spark, d):
    """The report's lines, and whether each was labelled and explained as a whole."""
    analyses = study.run_study(fx.long(spark, d, sparse=True), fx.sector_map(spark, d), report_options())
    records = study.records_frame(spark, analyses)
    classes = F.aggregate(F.map_values("class_counts"), F.lit(0).cast("bigint"), lambda a, n: a + n)
    labelled = records.select("combination", classes.alias("n_labelled"))
    told = F.col("error").isNull() & (F.col("n_restricted") >= 0) & F.col("best_f1").between(0, 1) & F.col("top_shap").isNotNull()
    told &= F.col("top_rf").isNotNull() & F.col("variance_explained").between(0, 1)
    report = study.combination_report(records).join(labelled, "combination")
    return report.select("combination", "n_variables", "n_scenarios", _r("max_correlation").alias("max_correlation"), "n_labelled", F.coalesce(told, F.lit(False)).alias("explained"))


# -- sources and sinks -------------------------------------------------------------------------------


def q_csv_round_trip(spark, d):
    path = writers.write_table(fx.cells(spark, d), scratch_path(spark, "long") + ".csv")
    return readers.read_scenarios(spark, path)


def q_parquet_round_trip(spark, d):
    path = writers.write_long(fx.cells(spark, d), scratch_path(spark, "long") + ".parquet")
    return readers.read_scenarios(spark, path).where(F.col("year").isin(YEARS))


def q_pivot_file(spark, d):
    rows = fx.scenario_long(spark, d).orderBy("input_order").select("model", "scenario", "variable", "year", "value")
    # In file order, so that the first of several values is the one the tables' order says.
    source = writers.write_table(rows, scratch_path(spark, "source") + ".parquet", "parquet")
    wide = spark.read.parquet(study.pivot_file(spark, source, fmt="parquet"))
    return es.unpivot_names(wide).where("value is not null").select("model", "scenario", "variable", "year", "value")


def q_per_combination_files(spark, d):
    """The variables of the best combinations, a folder for each, read back."""
    top = es.number_combinations(es.rank_sets(_selected(spark, d), 10))
    listed = top.select("combination", F.posexplode("variables").alias("position", "variable"))
    path = writers.write_per_combination(listed, scratch_path(spark, "tables"))
    return spark.read.option("header", True).schema("position int, variable string, combination int").csv(path)


def q_record_files(spark, d):
    """The best combinations as JSON records, read back."""
    top = es.number_combinations(es.rank_sets(_selected(spark, d), 10)).select("combination", "variables", "n_scenarios")
    path = writers.write_records(top, scratch_path(spark, "records"))
    back = spark.read.schema("combination int, variables array<string>, n_scenarios bigint").json(path)
    return back.select("combination", F.concat_ws(",", "variables").alias("variables"), "n_scenarios")


def q_mixed_case_headers(spark, d):
    """A file whose headers are in any case, read as the canonical table; required columns are checked."""
    cells = fx.cells(spark, d).select("model", "scenario", "region", "variable", "year", "value")
    shouted = cells.withColumnsRenamed({"model": "Model", "scenario": "SCENARIO", "region": "rEgion", "variable": "VARIABLE"})
    path = writers.write_table(shouted, scratch_path(spark, "headers") + ".csv")
    back = readers.read_scenarios(spark, path)
    return schema.require_columns(back, ["model", "scenario", "region", "variable", "year", "value"])


def q_missing_columns(spark, d):
    """What the check of required columns says of every table."""
    wanted = ("s_name", "n_name", "l_orderkey", "text")
    rows = []
    for name in ("supplier", "nation", "lineitem", "documents"):
        try:
            schema.require_columns(fx.read(spark, d, name), wanted)
        except ValueError as error:
            rows.append((name, sum(f"'{c}'" in str(error).split("found")[0] for c in wanted), fx.read(spark, d, name).count()))
    return small_table(spark, rows, "name string, n_missing int, n_rows bigint")


def q_load_scenarios(spark, d):
    """A long file without categories and a category map, loaded as the labelled canonical table."""
    rows = fx.cells(spark, d).select("model", "scenario", "region", "variable", "year", "value")
    path = writers.write_table(rows, scratch_path(spark, "plain") + ".csv")
    mapping = fx.suppliers(spark, d).select(F.col("model").alias("Models"), F.col("scenario").alias("Scenarios"), F.col("category").alias("Category"))
    categories = writers.write_table(mapping, scratch_path(spark, "map") + ".csv")
    loaded = es.load_scenarios(spark, path, categories)
    return loaded.select(*fx.KEYS, "variable", "year", "value")


def q_column_groups_file(spark, d):
    """All cells as a wide table in column groups, read back as a long one."""
    cells = fx.cells(spark, d).drop("category")
    columns = es.present_columns(cells)
    path = column_groups.write_column_groups(cells, columns, scratch_path(spark, "wide") + column_groups.SUFFIX, width=16)
    return es.load_scenarios(spark, path)


def q_sector_map_file(spark, d):
    frame = fx.sector_map(spark, d).orderBy("ordinal").select(F.col("variable").alias("Variable"), F.col("sector").alias("Sector"))
    path = writers.write_table(frame.coalesce(1), scratch_path(spark, "sectors") + ".csv")
    return readers.read_sector_map(spark, path).select("variable", "sector")


def q_category_map_file(spark, d):
    frame = fx.suppliers(spark, d).select(
        F.col("model").alias("Models"), F.col("scenario").alias("Scenario"), F.col("category").alias("Categories")
    )
    path = writers.write_table(frame, scratch_path(spark, "categories") + ".csv")
    return readers.read_category_map(spark, path)


def q_rewrite_with_bucket(spark, d):
    source, target = scratch_path(spark, "main"), scratch_path(spark, "main-bucket")
    _categories(spark, d).write.parquet(source)
    return spark.read.parquet(writers.rewrite_with_bucket(spark, source, target, "category"))


def q_filtered_file(spark, d):
    filtered = es.complete_scenarios(_written_cells(spark, d, sparse=True), fx.brands(spark, d), YEARS, 0.7)
    path = writers.write_table(filtered, scratch_path(spark, "filtered") + ".csv")
    return readers.read_scenarios(spark, path)


def entry(spark: SparkSession) -> DataFrame:
    """Coverage of every variable over the two years, on the smallest tables."""
    return q_coverage_table(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name; each takes (spark, sf_dir)."""
    found = {n[2:]: f for n, f in globals().items() if n.startswith("q_")}
    for unmapped in ("trimmed", "raw", "null"):
        found[f"bucket_map_{unmapped}"] = _bucket_query(unmapped)
    return found | (llm_queries.queries() if llm_queries else {}) | ({"pipeline": corpus_pipeline.run} if corpus_pipeline else {})


def oracle_sql() -> dict[str, str]:
    """The same results as SQL, for every query that SQL can express."""
    from oracle import statements

    found = statements() | (llm_queries.oracle_sql() if llm_queries else {})
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
