"""Scenario discovery over large ensembles of model runs, on Spark DataFrames."""

from .functions.labels import binary_target, bucket_colour, cluster_label, display_label, temp_bucket
from .operators.attribution import importance as attribution_importance
from .operators.attribution import walked_margins
from .operators.boxes import (
    assess_boxes,
    best_f1,
    box_points,
    box_statistics,
    find_box,
    find_boxes,
    peel_candidates,
    rank_box_variables,
    recount_steps,
    restricted_variables,
)
from .operators.correlation import (
    correlation_matrix,
    correlation_pairs,
    set_max_correlation,
    square_matrix,
    top_pairs,
)
from .operators.coverage import complete_scenarios, count_complete, coverage_by_variable, coverage_of
from .operators.features import feature_ranges, is_training_row, scale_and_impute
from .operators.labelling import (
    absent_sector_variables,
    assign_sector,
    attach_category_map,
    attach_label,
    combination_sectors,
    present_sector_variables,
    sector_variables,
    value_counts,
)
from .operators.models import (
    classification_metrics,
    cluster_importance,
    cumulative_share,
    fit_boosted_models,
    forest_importance,
    forest_models,
    shap_importance,
    shap_summary,
    top_per_cluster,
    top_variables,
    variables_to_reach,
)
from .operators.projection import (
    box_plot_summary,
    bucket_projection,
    combined_box_plot,
    group_quantiles,
    pair_points,
    principal_components,
)
from .operators.reshape import (
    feature_columns,
    first_cells,
    pivot_cells,
    present_columns,
    shape_report,
    tidy,
    unpivot_names,
    unpivot_years,
)
from .operators.selection import (
    expand_sets,
    number_combinations,
    rank_sets,
    sample_start_sets,
    select_variable_combinations,
    supporting_scenarios,
    weakly_correlated,
)
from .operators.trees import feature_array
from .plans.study import (
    StudyOptions,
    analyse_combination,
    analyse_combinations,
    combination_report,
    load_scenarios,
    pivot_file,
    run_study,
)
from .session import get_session
from .sources.readers import read_category_map, read_scenarios, read_sector_map, read_table
from .sources.writers import rewrite_with_bucket, write_long, write_table

# Task code is shipped with the jobs, so executors need no installed package.
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
