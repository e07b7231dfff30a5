"""From a scenario table to explained variable combinations.

``prepare`` brings any layout into cells, ``choose_combinations`` ranks variable
sets, ``analyse_combinations`` explains them, ``run_study`` does it all. Every step
is one job, or a few, for all combinations together.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cache, reduce
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import binary_target
from ..operators import attribution, boxes, correlation, features, models, projection
from ..operators.coverage import complete_scenarios, needed_cells
from ..operators.features import is_training_row
from ..operators.labelling import attach_category_map, sector_variables
from ..operators.reshape import first_cells, keys_of, pivot_cells, present_columns, restrict, small_table, tidy
from ..operators.trees import feature_array
from ..operators.selection import number_combinations, rank_sets, select_variable_combinations
from ..session import materialise
from ..sources import column_groups, readers, writers

LABEL = "label"
SUMMARY_TOP = 10
PLOT_TOP = 15
#: Columns of a plain wide table; more go into column groups.
MOST_COLUMNS = 4000

RECORD = """
combination int, variables array<string>, sectors array<string>, n_scenarios bigint, max_correlation double,
class_counts map<string,bigint>,
prim struct<n_restricted_vars int, restricted_vars array<string>, best_f1 double, error string>,
shap struct<top_10_vars array<string>, top_10_importance array<double>, n_vars_for_80_percent bigint, error string>,
rf struct<top_10_vars array<string>, top_10_importance array<double>, n_vars_for_80_percent bigint, error string>,
pca struct<explained_variance array<double>, cumulative_variance array<double>, error string>,
error string
"""


@dataclass(frozen=True)
class StudyOptions:
    years: tuple[int, ...] = (2030, 2050)
    corr_year: int | None = None
    min_vars: int = 2
    max_vars: int = 5
    completeness: float = 0.8
    corr_threshold: float = 0.9
    num_samples: int = 1000
    num_combinations: int = 10
    distinct_sets: bool = False
    box_threshold: float = 0.5
    n_components: int = 5
    boosted_trees: dict = field(default_factory=dict)
    forest: dict = field(default_factory=dict)
    seed: int = 42


class Tables(Mapping):
    """Tables by name, each built when it is first asked for: a plan over many columns takes the driver a while."""

    def __init__(self):
        self._make: dict[str, Callable[[], DataFrame]] = {}
        self._made: dict[str, DataFrame] = {}

    def add(self, name: str, make: Callable[[], DataFrame]) -> None:
        self._make[name] = make

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._make)

    def __len__(self) -> int:
        return len(self._make)


@dataclass
class Analysis:
    """Tables of one combination by name, and its summary record."""

    record: dict
    tables: Tables = field(default_factory=Tables)


# -- preparing ------------------------------------------------------------------------


def pivot_file(
    spark: SparkSession, source: str, target: str | None = None, fmt: str = "csv", mode: str = "error", most_columns: int = MOST_COLUMNS
) -> str:
    """Long or semi-wide file -> wide file, one column per variable and year.

    Column names come from a first small job. An already wide file is kept as
    it is and its own path returned. More than ``most_columns`` columns are written
    as column groups (see ``sources.column_groups``) in a folder whose path ends in
    ``.groups``, which ``load_scenarios`` reads like any other file.
    """
    df = readers.read_scenarios(spark, source, input_order=True)
    if readers.is_wide(df):
        return source
    cells = materialise(first_cells(tidy(df, unmapped="raw")), "cells")
    columns = present_columns(cells)
    target = target or writers.default_output_path(source, fmt)
    if len(columns) > most_columns:
        return column_groups.write_column_groups(cells, columns, target.removesuffix(column_groups.SUFFIX) + column_groups.SUFFIX, mode=mode)
    return writers.write_table(pivot_cells(cells, columns), target, fmt, mode)


def load_scenarios(spark: SparkSession, path: str, category_map: str | None = None) -> DataFrame:
    """Canonical long table of a file in any layout, with buckets if it has them.

    A category map supplies the buckets of a file without categories.
    """
    if path.rstrip("/").endswith(column_groups.SUFFIX):
        long = column_groups.read_long(spark, path.rstrip("/"))
    else:
        long = tidy(readers.read_scenarios(spark, path, input_order=True))
    if category_map is None or "temp_bucket" in long.columns:
        return long
    mapped = attach_category_map(long, readers.read_category_map(spark, category_map))
    return mapped.drop("category")


def prepare(long: DataFrame, variables: list[str] | None = None, years=None, order_by=None) -> DataFrame:
    """Cells of the chosen variables and years, written once for all analyses."""
    return materialise(first_cells(restrict(long, variables, years), order_by=order_by), "cells")


def choose_combinations(cells: DataFrame, sectors: dict[str, list[str]], options: StudyOptions) -> DataFrame:
    """The numbered top combinations."""
    ranked = select_variable_combinations(
        cells,
        sectors,
        list(options.years),
        options.min_vars,
        options.max_vars,
        options.completeness,
        options.corr_threshold,
        options.num_samples,
        options.corr_year,
        options.seed,
    )
    return number_combinations(rank_sets(ranked, options.num_combinations, options.distinct_sets))


# -- combinations -----------------------------------------------------------------------


@dataclass(frozen=True)
class Prepared:
    """Rows of several combinations: ``filtered`` with raw, ``scaled`` with scaled features, both as arrays ``x``.

    ``columns`` names the features of ``filtered``, ``scaling`` those of
    ``scaled``; ``errors`` says why a combination has no rows.
    """

    keys: list[str]
    filtered: DataFrame
    scaled: DataFrame | None
    columns: dict[int, list[str]]
    scaling: dict[int, features.Scaling]
    sizes: dict[int, int]
    errors: dict[int, str]

    def names(self, number: int) -> list[str]:
        return list(self.scaling[number].mean)

    def filtered_of(self, number: int) -> DataFrame:
        """Wide table of a combination's scenarios, with nulls."""
        return self._wide(self.filtered, number, self.keys, self.columns[number])

    def matrix_of(self, number: int) -> DataFrame:
        """The same imputed and scaled, with the label."""
        return self._wide(self.scaled, number, [*self.keys, LABEL], self.names(number))

    def _wide(self, table: DataFrame, number: int, keep: list[str], names: list[str]) -> DataFrame:
        cells = [F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)]
        return table.where(F.col("combination") == number).select(*keep, *cells)


def _complete_rows(cells: DataFrame, combinations: list[dict], options: StudyOptions, keys: list[str], columns: dict[int, list]) -> DataFrame:
    """(combination, keys, x): scenarios that fill enough of a combination's columns, for all combinations in one pass.

    A scenario's cells are gathered once, whatever the number of combinations that use them.
    """
    spark = cells.sparkSession
    need = {k: needed_cells(len(c), options.completeness) for k, c in columns.items()}
    asked = {k: c for k, c in columns.items() if need[k] > 0}
    place = {c: i for i, c in enumerate(sorted({c for listed in asked.values() for c in listed}))}
    index = small_table(spark, [(v, y, i) for (v, y), i in place.items()], "variable string, year int, at int")
    used = restrict(cells, [v for v, _ in place], sorted({y for _, y in place})).where("value is not null")
    entries = F.map_from_entries(F.collect_list(F.struct("at", F.col("value").cast("double").alias("value"))))
    gathered = used.join(index, ["variable", "year"]).groupBy(*keys).agg(entries.alias("__cells"))
    gathered = gathered.where(F.size("__cells") >= min((need[k] for k in asked), default=0))
    held = F.transform(F.sequence(F.lit(0), F.lit(max(len(place) - 1, 0))), lambda i: F.try_element_at("__cells", i))
    wanted = small_table(spark, [(k, [place[c] for c in listed], need[k]) for k, listed in asked.items()], "combination int, __places array<int>, __need int")
    x = F.transform("__places", lambda i: F.get("__held", i))
    rows = gathered.select(*keys, held.alias("__held")).crossJoin(wanted).select("combination", *keys, x.alias("x"), "__need")
    rows = rows.where(F.size(F.array_compact("x")) >= F.col("__need")).drop("__need")
    for combination in combinations:
        # Nothing is required, so scenarios without any of the columns stay too.
        number = combination["combination"]
        if number in columns and need[number] <= 0:
            wide = complete_scenarios(cells, list(combination["variables"]), list(options.years), options.completeness, keys)
            names = [f"{v} ({y})" for v, y in columns[number]]
            rows = rows.unionByName(wide.select(F.lit(number).alias("combination"), *keys, feature_array(names).alias("x")))
    return rows


def prepare_combinations(cells: DataFrame, combinations: list[dict], options: StudyOptions) -> Prepared:
    """Filtered and scaled rows of all combinations: one write each, and one aggregate for all scales."""
    spark, keys = cells.sparkSession, keys_of(cells)
    years = list(dict.fromkeys(options.years))
    found = set(present_columns(cells, [v for c in combinations for v in c["variables"]], years))
    listed = {c["combination"]: [(v, y) for v in dict.fromkeys(c["variables"]) for y in years if (v, y) in found] for c in combinations}
    errors = {k: "none of the requested variable and year pairs is in the data" for k, c in listed.items() if not c}
    listed = {k: c for k, c in listed.items() if c}
    columns = {k: [f"{v} ({y})" for v, y in c] for k, c in listed.items()}
    filtered = materialise(_complete_rows(cells, combinations, options, keys, listed), "filtered")
    stats: dict[int, dict] = {}
    cells_of = filtered.select("combination", F.posexplode("x").alias("at", "value"))
    moments = cells_of.groupBy("combination", "at").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    # One row for each column of each combination.
    for r in moments.collect():
        stats.setdefault(r.combination, {})[r["at"]] = r.asDict()
    errors |= {k: "no scenario is complete enough" for k in columns if k not in stats}
    scaling = {k: features.scaling_of(s[0]["rows"], {columns[k][i]: s[i] for i in sorted(s)}) for k, s in stats.items()}
    sizes = {k: s[0]["rows"] for k, s in stats.items()}
    scaled = None
    try:
        label = binary_target(filtered)
    except ValueError as error:
        errors |= {k: str(error) for k in columns if k not in errors}
    else:
        scales = [(k, [columns[k].index(c) for c in s.mean], list(s.mean.values()), list(s.sd.values())) for k, s in scaling.items()]
        table = small_table(spark, scales, "of int, kept array<int>, mean array<double>, sd array<double>")

        def standard(place, i):
            mean = F.get("mean", i)
            return (F.coalesce(F.get("x", place), mean) - mean) / F.get("sd", i)

        joined = filtered.join(table, F.col("combination") == F.col("of"))
        scaled = materialise(joined.select("combination", *keys, label.alias(LABEL), F.transform("kept", standard).alias("x")), "matrix")
    return Prepared(keys, filtered, scaled, columns, scaling, sizes, errors)


def analyse_combinations(cells: DataFrame, combinations: list[dict], options: StudyOptions, sectors: dict[str, list[str]] | None = None) -> list[Analysis]:
    """All explanations of all combinations, each kind worked out for all of them together.

    A ValueError, which says that the data doesn't allow an explanation, is
    recorded and the other blocks go on. Everything else, such as lost executors
    or a missing configuration, is raised.
    """
    if not combinations:
        return []
    sector_of = {v: sector for sector, names in (sectors or {}).items() for v in names}
    results = {
        c["combination"]: Analysis(
            {
                "combination": c["combination"],
                "variables": list(c["variables"]),
                "sectors": [sector_of.get(v, "Unknown") for v in c["variables"]],
                "n_scenarios": c["n_scenarios"],
                "max_correlation": c["max_corr"],
            }
        )
        for c in combinations
    }
    data = prepare_combinations(cells, combinations, options)
    for k, error in data.errors.items():
        results[k].record["error"] = error
    live = {k: r for k, r in results.items() if k not in data.errors}
    if live:
        for k, result in live.items():
            result.tables.add("filtered", lambda k=k: data.filtered_of(k))
            result.record["class_counts"] = {}
        for r in data.scaled.groupBy("combination", LABEL).agg(F.count(F.lit(1)).alias("n")).collect():
            live[r.combination].record["class_counts"][str(r[LABEL])] = r.n
        for block, run in (("prim", _box_blocks), ("shap", _shap_blocks), ("rf", _forest_blocks), ("pca", _projection_blocks), ("correlation", _correlation_blocks)):
            _guarded(live, block, lambda run=run: run(live, data, cells, options))
    return list(results.values())


def analyse_combination(cells: DataFrame, combination: dict, options: StudyOptions, sectors: dict[str, list[str]] | None = None) -> Analysis:
    """All explanations of one combination."""
    return analyse_combinations(cells, [combination], options, sectors)[0]


def _guarded(live: dict[int, Analysis], block: str, run: Callable[[], dict[int, dict]]) -> None:
    """Record what a block says of each combination; its ValueError is every combination's."""
    try:
        outcome = run()
    except ValueError as error:
        outcome = {k: {"error": str(error)} for k in live}
    for k, said in outcome.items():
        live[k].record[block] = said


def _found_boxes(live, data: Prepared, options: StudyOptions) -> dict[int, boxes.Box | ValueError]:
    small = {k: data.names(k) for k in live if data.sizes[k] * len(data.names(k)) <= boxes.TASK_CELLS}
    found = {}
    if small:
        rows = data.scaled.where(F.col("combination").isin(list(small)))
        found = boxes.find_boxes(rows, F.col("combination"), F.col("x"), F.col(LABEL), small, options.box_threshold)
    for k in live:
        if k not in small:
            found[k] = boxes.find_box(data.matrix_of(k), LABEL, data.names(k), threshold=options.box_threshold)
    return found


def _box_blocks(live, data: Prepared, cells: DataFrame, options: StudyOptions) -> dict[int, dict]:
    spark = cells.sparkSession
    found = _found_boxes(live, data, options)
    outcome = {k: {"error": str(b)} for k, b in found.items() if isinstance(b, ValueError)}
    good = {k: b for k, b in found.items() if k not in outcome}
    statistics = small_table(spark, [(k, *b.statistics()) for k, b in good.items()], "box_index int, n bigint, mass double, density double, coverage double, res_dim int")
    best = {r.box_index: float(r.f1_score) for r in boxes.assess_boxes(statistics).collect()}
    ends = [(k, f, *b.limits()[f], *first) for k, b in good.items() for f, first in b.limits(0).items()]
    limits = small_table(spark, [e[:4] for e in ends], f"combination int, {boxes.LIMITS}")
    ranges = small_table(spark, [(*e[:2], *e[4:]) for e in ends], f"combination int, {boxes.LIMITS}")
    # One row for each feature of each combination.
    restricted = boxes.restricted_variables(limits, ranges, by=["combination", "variable"])
    touched: dict[int, set] = {k: set() for k in good}
    for r in restricted.where("restricted").select("combination", "variable").collect():
        touched[r.combination].add(r.variable)
    for k, box in good.items():
        in_order = [v for v in data.names(k) if v in touched[k]]
        outcome[k] = {"n_restricted_vars": len(in_order), "restricted_vars": in_order, "best_f1": best.get(k, 0.0)}
        _add_box_tables(live[k].tables, box, restricted.where(F.col("combination") == k).drop("combination"), in_order, data, k)
    return outcome


def _add_box_tables(tables: Tables, box: boxes.Box, restricted: DataFrame, in_order: list[str], data: Prepared, k: int) -> None:
    spark, scaling = restricted.sparkSession, data.scaling[k]

    def raw_limits() -> DataFrame:
        rows = [(v, scaling.to_raw(v, lo), scaling.to_raw(v, hi)) for v, (lo, hi) in box.limits().items()]
        return restricted.join(small_table(spark, rows, "variable string, raw_low double, raw_high double"), "variable")

    tables.add("box_assessment", lambda: boxes.assess_boxes(boxes.box_statistics(data.matrix_of(k), [box.limits()], LABEL)))
    tables.add("box_ranking", lambda: boxes.rank_box_variables(restricted))
    tables.add("box_limits", raw_limits)
    tables.add("box_trajectory", lambda: box.trajectory(spark))
    tables.add("box_points", lambda: boxes.box_points(data.matrix_of(k), box.limits(), in_order, LABEL))


def _shap_blocks(live, data: Prepared, cells: DataFrame, options: StudyOptions) -> dict[int, dict]:
    rows = data.scaled
    combination, x = F.col("combination"), F.col("x")
    names = {k: data.names(k) for k in live}
    training = is_training_row(*[F.col(k) for k in data.keys], seed=options.seed)
    trees = models.fit_boosted_models(rows, combination, x, F.col(LABEL), names, training, **options.boosted_trees)
    found = materialise(attribution.importances(rows, combination, x, {k: t.ensemble for k, t in trees.items()}, names), "shap")
    predicted = models.predictions(rows.where(~training), combination, x, LABEL, trees)
    top = _top_records(found)
    for k, result in live.items():
        shown = top[k].pop("all")[:PLOT_TOP]
        result.tables.add("shap_importance", lambda k=k: _importance_of(found, k))
        result.tables.add("shap_metrics", lambda k=k: models.classification_metrics(predicted.where(F.col("model") == k), LABEL))
        result.tables.add("shap_summary", lambda k=k, shown=shown: models.shap_summary(data.matrix_of(k), trees[k], data.keys, shown))
    return top


def _forest_blocks(live, data: Prepared, cells: DataFrame, options: StudyOptions) -> dict[int, dict]:
    names = {k: data.names(k) for k in live}
    found = models.forest_models(data.scaled, F.col("combination"), F.col("x"), F.col(LABEL), names, **{"seed": options.seed, **options.forest})
    top = _top_records(found)
    for k, result in live.items():
        result.tables.add("rf_importance", lambda k=k: _importance_of(found, k))
        top[k].pop("all")
    return top


def _importance_of(importances: DataFrame, number: int) -> DataFrame:
    mine = importances.where(F.col("model") == number).select("variable", "importance")
    return mine.orderBy(F.desc("importance"), "variable")


def _top_records(importances: DataFrame) -> dict[int, dict]:
    """What the records say of each model's importances; one row for each feature of each model is read."""
    by_model: dict[int, list] = {}
    for r in importances.collect():
        by_model.setdefault(r.model, []).append((-r.importance, r.variable))
    found = {}
    for k, rows in by_model.items():
        rows.sort()
        values, names = [-v for v, _ in rows], [n for _, n in rows]
        found[k] = {
            "top_10_vars": names[:SUMMARY_TOP],
            "top_10_importance": values[:SUMMARY_TOP],
            "n_vars_for_80_percent": models.number_to_reach(values, 0.8),
            "all": names,
        }
    return found


def _projection_blocks(live, data: Prepared, cells: DataFrame, options: StudyOptions) -> dict[int, dict]:
    found = projection.component_models(data.scaled, F.col("combination"), F.col("x"), {k: len(data.names(k)) for k in live})
    outcome = {}
    for k, (shares, loadings) in found.items():
        projected = cache(
            lambda k=k, shares=shares, loadings=loadings: projection.project(data.matrix_of(k), [*data.keys, LABEL], data.names(k), shares, loadings, options.n_components)
        )
        tables = live[k].tables
        tables.add("pca_variance", lambda projected=projected: projected().variance)
        tables.add("pca_scores", lambda projected=projected: projected().scores)
        if "temp_bucket" in data.keys:
            tables.add("pca_projection", lambda projected=projected: projection.bucket_projection(projected().scores))
        explained = [float(v) for v in shares[: options.n_components]]
        outcome[k] = {"explained_variance": explained, "cumulative_variance": list(accumulate(explained))}
    return outcome


def _correlation_blocks(live, data: Prepared, cells: DataFrame, options: StudyOptions) -> dict[int, dict]:
    """One matrix of all variables; each combination takes its part."""
    year = options.corr_year or options.years[0]
    names = sorted({v for r in live.values() for v in r.record["variables"]})
    matrix = materialise(correlation.correlation_matrix(cells, year, names), "correlation")
    for result in live.values():
        mine = result.record["variables"]

        def part(mine=mine) -> DataFrame:
            return matrix.where(F.col("var_a").isin(mine) & F.col("var_b").isin(mine))

        result.tables.add("correlation", lambda part=part: correlation.square_matrix(part()))
        result.tables.add("top_pairs", lambda part=part: correlation.top_pairs(part(), SUMMARY_TOP, mirrored=True))
    return {}


# -- the whole study ------------------------------------------------------------------


def run_study(
    long: DataFrame,
    sector_map: DataFrame,
    options: StudyOptions | None = None,
    output: str | None = None,
    order_by=None,
) -> list[Analysis]:
    """Select combinations, analyse each, and write all tables below ``output``.

    The tables of the result read scratch tables; to have these deleted, run the
    study inside ``session.scratch`` and use what lies below ``output`` afterwards.
    """
    options = options or StudyOptions()
    spark = long.sparkSession
    sectors = sector_variables(sector_map, long.where(F.col("value").isNotNull()))
    names = sorted({v for group in sectors.values() for v in group})
    years = sorted({*options.years, options.corr_year or options.years[0]})
    cells = prepare(long, names, years, order_by)
    chosen = materialise(choose_combinations(cells, sectors, options), "chosen")
    rows = [r.asDict() for r in chosen.orderBy("combination").collect()]
    analyses = analyse_combinations(cells, rows, options, sectors)
    if output is not None:
        write_study(spark, analyses, chosen, output)
    return analyses


def records_frame(spark: SparkSession, analyses: list[Analysis]) -> DataFrame:
    """One nested record per combination."""
    return spark.createDataFrame([a.record for a in analyses], RECORD)


def combination_report(records: DataFrame) -> DataFrame:
    """One flat line per combination; those that could not be analysed show their error."""
    failed = F.concat_ws("; ", F.col("error"), *[F.col(f"{b}.error") for b in ("prim", "shap", "rf", "pca")])
    return records.select(
        "combination",
        F.size("variables").alias("n_variables"),
        "n_scenarios",
        "max_correlation",
        F.col("prim.n_restricted_vars").alias("n_restricted"),
        F.col("prim.best_f1").alias("best_f1"),
        F.get("shap.top_10_vars", F.lit(0)).alias("top_shap"),
        F.get("rf.top_10_vars", F.lit(0)).alias("top_rf"),
        F.get("pca.cumulative_variance", F.size("pca.cumulative_variance") - 1).alias("variance_explained"),
        F.when(failed != "", failed).alias("error"),
    )


def write_study(spark: SparkSession, analyses: list[Analysis], chosen: DataFrame, output: str) -> None:
    """Summary CSV, one folder per table kind and combination, JSON records."""
    base = output.rstrip("/")
    writers.write_table(writers.selection_summary(chosen).coalesce(1), f"{base}/selection_summary")
    for name in dict.fromkeys(name for a in analyses for name in a.tables):
        _write_tables(name, [(a.record["combination"], a.tables[name]) for a in analyses if name in a.tables], base)
    for analysis in analyses:
        number = analysis.record["combination"]
        writers.write_records(records_frame(spark, [analysis]), f"{base}/run_summary/combination={number}")
    records = records_frame(spark, analyses)
    writers.write_records(records.coalesce(1), f"{base}/study_summary")
    writers.write_table(combination_report(records).coalesce(1), f"{base}/report")


def _write_tables(name: str, tables: list[tuple[int, DataFrame]], base: str) -> None:
    """One kind of table of all combinations, a folder per combination.

    Tables with the same columns go out in one write; filtered scenarios have
    other columns in every combination.
    """
    if len({tuple(t.columns) for _, t in tables}) == 1:
        numbered = [t.withColumn("combination", F.lit(number)) for number, t in tables]
        writers.write_per_combination(reduce(DataFrame.unionByName, numbered), f"{base}/{name}")
        return
    for number, table in tables:
        writers.write_table(table, f"{base}/{name}/combination={number}")
