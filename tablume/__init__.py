"""tablume: understand, clean, model and report on tables with Spark DataFrames."""

from tablume.operators.clean import (
    add_zscores,
    detect_outliers,
    drop_null_labels,
    flag_outliers,
    impute,
    impute_categorical,
    impute_numeric,
    label_drop_counts,
)
from tablume.operators.explore import (
    describe_numeric,
    explore,
    histogram,
    project,
    top_categories,
)
from tablume.operators.features import assemble, one_hot, pca, prepare, scale, string_index
from tablume.operators.models import (
    accuracy,
    cluster_sizes,
    feature_importance,
    load_model,
    rmse,
    save_model,
    score,
    silhouette,
    train_classifier,
    train_clusters,
    train_regressor,
)
from tablume.operators.plotdata import (
    hash_sample,
    actual_vs_predicted,
    boxplot_stats,
    cluster_points,
    diagonal,
    limit_sample,
    pairplot_points,
    scatter_bins,
    scatter_points,
    unpivot_numeric,
)
from tablume.operators.profile import (
    column_modes,
    column_types,
    correlation_matrix,
    distinct_counts,
    data_summary,
    few_distinct,
    missing_counts,
    null_counts,
    numeric_profile,
    numeric_summary,
    profile,
    sample_values,
    table_shape,
    top_values,
    top_values_wide,
    value_counts,
)
from tablume.operators.quantiles import exact_quantiles, quantile_table
from tablume.plans.advise import (
    classification_target,
    regression_target,
    suggest,
    suggest_analysis,
    target_table,
)
from tablume.plans.analyze import analyze
from tablume.plans.report import build_report, feature_info, transformation_notes
from tablume.sources.readers import (
    read,
    read_dataset,
    read_json_array,
    read_nested_json,
    read_version,
    to_json_rows,
    union_parts,
    write_dataset,
    write_version,
)
from tablume.sources.typed import cast_to_schema, invalid_rows, valid_rows

__version__ = "0.1.0"
