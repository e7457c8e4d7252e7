"""The automatic report as tables: features, transformations, three model runs, findings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablume.functions.columns import (
    as_double,
    categorical_columns,
    numeric_columns,
    require_numeric,
)
from tablume.functions.tables import per_column, small_table
from tablume.operators.features import Prepared, prepare
from tablume.operators.models import Trained, train_classifier, train_clusters, train_regressor
from tablume.operators.profile import table_shape
from tablume.plans.advise import can_cluster, classification_target, regression_target
from tablume.sources.readers import write_dataset

CLUSTERS = 3

# Titles, transformation notes, reasons for skipping and closing sentences.
REGRESSION_TITLE = "Regression (Linear Regression)"
CLASSIFICATION_TITLE = "Classification (Random Forest)"
CLUSTERING_TITLE = "Clustering (KMeans, k={k})"
NUMERIC_NOTE = (
    "Numeric Feature Handling",
    "Casting to DoubleType, Vector Assembly, Standardization",
)
CATEGORICAL_NOTE = ("Categorical Feature Handling", "String Indexing")
MISSING_NOTE = ("Missing Value Handling", "Rows with null labels are dropped")
TRAINED = "Models were successfully trained and evaluated. See above for details."
NOT_TRAINED = "No models could be successfully trained on this dataset."
NO_REGRESSION_TARGET = "Skipped: No suitable numeric target for regression."
NO_REGRESSION_FEATURES = "Skipped: Not enough features for regression."
NO_CLASSIFICATION_TARGET = "Skipped: No suitable target for classification."
NO_CLASSIFICATION_FEATURES = "Skipped: Not enough features for classification."
NO_CLUSTERING_FEATURES = "Skipped: Not enough numeric columns for clustering."
NO_ROWS = "Skipped: Cleaned data is empty."

_SUMMARY = (
    "task string, target string, features string, status string, metric string, "
    "value double, result string"
)


@dataclass
class Report:
    """``tables`` by name; ``models`` keeps the successful runs by task."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    models: dict[str, Trained] = field(default_factory=dict)

    def write(self, root: str, name: str, fmt: str = "parquet") -> dict[str, str]:
        """Write every table under ``root/name``, replacing an earlier report of that name."""
        return {
            table: write_dataset(df, root, f"{name}/{table}", "overwrite", fmt)
            for table, df in self.tables.items()
        }


def feature_info(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(feature, min, max, mean)`` of numeric columns rounded to four places, NULL if empty."""
    fields = require_numeric(df, numeric_columns(df) if columns is None else columns)

    def rounded(stat):
        return lambda f: F.round(stat(as_double(f)), 4)

    return per_column(
        df, fields, {"min": rounded(F.min), "max": rounded(F.max), "mean": rounded(F.avg)}
    ).withColumnRenamed("column", "feature")


def formatted_features(info: DataFrame) -> DataFrame:
    """:func:`feature_info` as text with four places, ``N/A`` for an empty column."""
    texts = [
        F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.4f", c)), F.lit("N/A")).alias(c)
        for c in ("min", "max", "mean")
    ]
    return info.select("feature", *texts)


def transformation_notes(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """``(task, transformation)`` rows for the kinds of columns present."""
    numeric = numeric_columns(df, exclude=exclude)
    categorical = categorical_columns(df, exclude=exclude)
    notes = []
    if numeric:
        notes.append(NUMERIC_NOTE)
    if categorical:
        notes.append(CATEGORICAL_NOTE)
    if notes:
        notes.append(MISSING_NOTE)
    return small_table(df.sparkSession, notes, "task string, transformation string")


class _NothingLeft(Exception):
    """No row has a target and every numeric feature."""


def _usable(prepared: Prepared) -> Prepared:
    if prepared.counts["used"] == 0:
        raise _NothingLeft
    return prepared


def _attempt(run: Callable[[], Trained]) -> tuple[Trained | None, str, str]:
    """One failing model run is reported and does not stop the others."""
    try:
        return run(), "ok", ""
    except _NothingLeft:
        return None, "skipped", NO_ROWS
    except Exception as error:
        reason = str(error).splitlines()[0] if str(error) else type(error).__name__
        return None, "failed", f"Failed: {reason}"


def build_report(
    df: DataFrame,
    order_by: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    regression_options: dict | None = None,
    classification_options: dict | None = None,
    clusters: int = CLUSTERS,
) -> Report:
    """Profile the table, pick targets, try three models and gather everything as tables."""
    spark = df.sparkSession
    numeric = numeric_columns(df, exclude=exclude)
    categorical = categorical_columns(df, exclude=exclude)
    everything = numeric + categorical
    keep = [c for c in order_by or ()]
    report, rows, findings = Report(), [], []

    def record(task, title, target, features, run, describe):
        shown = ", ".join(features)
        trained, status, problem = _attempt(run)
        if trained is None:
            rows.append((task, target, shown, status, None, None, problem))
            return
        metric, value, result, finding = describe(trained)
        report.models[task.lower()] = trained
        rows.append((title, target, shown, "ok", metric, value, result))
        findings.append(finding)
        report.tables[f"sample_{task.lower()}"] = trained.sample(order_by)

    def skipped(task, why):
        rows.append((task, None, None, "skipped", None, None, why))

    target = regression_target(df, exclude)
    features = [c for c in everything if c != target]
    if not target:
        skipped("Regression", NO_REGRESSION_TARGET)
    elif not features:
        skipped("Regression", NO_REGRESSION_FEATURES)
    else:
        record(
            "Regression", REGRESSION_TITLE, target, features,
            lambda: train_regressor(_usable(prepare(df, features, target, keep)), **(regression_options or {})),
            lambda t: ("rmse", t.metrics["rmse"], _text("RMSE: ", t.metrics["rmse"]),
                       _text("Regression RMSE: ", t.metrics["rmse"])),
        )

    label = classification_target(df, exclude)
    inputs = [c for c in everything if c != label]
    if not label:
        skipped("Classification", NO_CLASSIFICATION_TARGET)
    elif not inputs:
        skipped("Classification", NO_CLASSIFICATION_FEATURES)
    else:
        record(
            "Classification", CLASSIFICATION_TITLE, label, inputs,
            lambda: train_classifier(_usable(prepare(df, inputs, label, keep, classes=True)), **(classification_options or {})),
            lambda t: ("accuracy", t.metrics["accuracy"], _share("Accuracy: ", t.metrics["accuracy"]),
                       _share("Classification Accuracy: ", t.metrics["accuracy"])),
        )

    if not can_cluster(df, exclude):
        skipped("Clustering", NO_CLUSTERING_FEATURES)
    else:
        record(
            "Clustering", CLUSTERING_TITLE.format(k=clusters), None, numeric,
            lambda: train_clusters(_usable(prepare(df, numeric, keep=keep)), clusters),
            lambda t: ("clusters", float(clusters), f"Cluster Sizes: {_sizes(t)}",
                       f"Cluster sizes: {_sizes(t)}"),
        )

    report.tables["shape"] = table_shape(df)
    if numeric:
        report.tables["features"] = feature_info(df, numeric)
    report.tables["transformations"] = transformation_notes(df, exclude)
    report.tables["summary"] = small_table(spark, rows, _SUMMARY)
    report.tables["findings"] = small_table(
        spark, list(enumerate(findings, start=1)), "position int, finding string"
    )
    report.tables["conclusions"] = small_table(
        spark, [(TRAINED if report.models else NOT_TRAINED,)], "conclusion string"
    )
    return report


def _text(title: str, value: float | None) -> str:
    return title + ("N/A" if value is None else f"{value:.4f}")


def _share(title: str, value: float | None) -> str:
    return title + ("N/A" if value is None else f"{value * 100:.2f}%")


def _sizes(trained: Trained) -> str:
    return str({str(r["cluster"]): r["size"] for r in trained.tables["sizes"].collect()})
