"""Training, evaluation, saving and batch scoring of Spark ML pipelines.

A run fits the feature steps once, keeps only the feature vector and the label in a spillable
cache for the iterative fit and its evaluation, and assembles the pipeline model from the parts
already fitted. Metrics are one aggregate over that cache.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablume.functions.columns import col, is_null, is_numeric, require_columns
from tablume.functions.tables import small_table
from tablume.operators import trees
from tablume.operators.features import (
    FEATURES,
    LABEL,
    PREDICTION,
    RAW,
    Prepared,
    WideIndex,
    fit_features,
)
from tablume.sources.scratch import shared_folder
from tablume.sources.typed import ERRORS, cast_to_schema, input_fields

SEED = 42
#: k-means deals its points over this many partitions at least, and one for so many rows.
CLUSTER_PARTITIONS, ROWS_A_PARTITION = 8, 250_000
#: Rows of one part of an iterative fit at most; more rows take more parts, whatever the input has.
ROWS_A_FIT = 1_000_000
#: How many rows a point stands for.
WEIGHT = "_weight"
#: The row as it came in, carried through a pipeline.
ROW = "_scored_row"

# The algorithms and their default parameters.
REGRESSORS = {
    "linear_regression": (LinearRegression, {"maxIter": 100, "regParam": 0.1}),
    "random_forest_regressor": (
        RandomForestRegressor,
        {"numTrees": 100, "maxDepth": 10, "seed": SEED},
    ),
    "gbt_regressor": (GBTRegressor, {"maxIter": 50, "maxDepth": 5, "seed": SEED}),
}
CLASSIFIERS = {
    "random_forest": (RandomForestClassifier, {"numTrees": 100, "maxDepth": 10, "seed": SEED}),
    "logistic_regression": (LogisticRegression, {"maxIter": 100, "regParam": 0.1}),
    "gbt_classifier": (GBTClassifier, {"maxIter": 50, "maxDepth": 5, "seed": SEED}),
}
DEFAULT_CLUSTERS = 5
TRAINED = "Model trained successfully."
NOTHING_TO_EVALUATE = "Warning: no rows to evaluate."


@dataclass
class Trained:
    """A fitted pipeline with what is needed to score, explain and reproduce it."""

    task: str
    algorithm: str
    model: PipelineModel
    prepared: Prepared
    metrics: dict[str, float | int | None]
    message: str
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def schema(self) -> list[dict]:
        return self.prepared.schema

    def predict(self, df: DataFrame) -> DataFrame:
        """Every raw row with ``prediction`` and ``_errors``, as :func:`score` gives them."""
        return _predict_rows(df, self.model, self.prepared.wide)

    def predictions(self) -> DataFrame:
        """The training rows with their label and prediction."""
        scored = self.model.transform(self.prepared.df)
        return without_internals(scored, self.model).drop(*_index_columns(self.prepared.wide))

    def sample(self, order_by: Sequence[str] | None = None, n: int = 10) -> DataFrame:
        """The first ``n`` rows, in the given order, with features, label and prediction.

        Rows are picked before they are scored, so only ``n`` rows go through the model. Other
        columns can order the rows if preparation kept them.
        """
        names = self.prepared.features
        order = list(order_by or names)
        require_columns(self.prepared.df, order)
        first = self.prepared.usable().orderBy(*[col(o) for o in order]).limit(n)
        out = [col(n_) for n_ in names]
        if self.task == "regression":
            out.append(F.col(LABEL).alias(self.prepared.target))
        elif self.task == "classification":
            out.append(F.col(LABEL).alias(f"{self.prepared.target}_indexed_label"))
        last = "Assigned_Cluster_ID" if self.task == "clustering" else PREDICTION
        return self.model.transform(first).select(*out, F.col(PREDICTION).alias(last))

    def save(self, folder: str) -> str:
        """Save the pipeline and its input schema under a name not used before."""
        wide = dict(self.prepared.wide)
        if self.prepared.classes:
            wide[self.prepared.target] = self.prepared.classes
        return save_model(self.model, self.schema, folder, wide)


def _index_columns(names) -> list[str]:
    return [f"{n}_indexed" for n in names]


def working_columns(model: PipelineModel) -> list[str]:
    """The columns a pipeline's stages add on the way to ``prediction``, by name."""
    names = [RAW, FEATURES]
    for stage in model.stages:
        for param in ("outputCols", "outputCol", "rawPredictionCol", "probabilityCol"):
            if stage.hasParam(param) and stage.isDefined(param):
                value = stage.getOrDefault(param)
                names += value if isinstance(value, list) else [value]
        if isinstance(stage, StringIndexerModel):
            names += [c for c in _taken(stage) if c.startswith("_") and c.endswith("_text")]
    return [n for n in dict.fromkeys(names) if n != PREDICTION]


def _taken(stage) -> list[str]:
    """The columns that a stage reads, by name."""
    names = []
    for param in ("inputCols", "inputCol", "featuresCol"):
        if stage.hasParam(param) and stage.isDefined(param):
            value = stage.getOrDefault(param)
            names += value if isinstance(value, list) else [value]
    return names


def without_internals(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Drop the working columns a pipeline leaves behind; every other column stays."""
    return df.drop(*working_columns(model))


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Deal the rows of an iterative fit evenly over ``partitions``; None leaves them as they are.
    Fits to cells don't need it.

    The number is the caller's, so a result that depends on it can be repeated.
    """
    return df if partitions is None else df.repartition(partitions)


def _parts_of(rows: int) -> int | None:
    """Into how many parts the rows of an iterative fit are dealt; a few stay as they lie."""
    return -(-rows // ROWS_A_FIT) if rows > ROWS_A_FIT else None


def _estimator(catalogue: Mapping, algorithm: str, params: Mapping):
    if algorithm not in catalogue:
        raise ValueError(
            f"unsupported algorithm: {algorithm!r}; use one of {', '.join(catalogue)}"
        )
    cls, defaults = catalogue[algorithm]
    return cls(featuresCol=FEATURES, labelCol=LABEL, **{**defaults, **params})


def _fit(prepared: Prepared, estimator, holdout: float, evaluate, partitions: int | None):
    """Fit the features, then the estimator on cached vectors; evaluate on the same cache.

    With the shared folder set as checkpoint folder, boosting cuts its lineage as it goes.
    Tree ensembles are fitted to the rows' cells (see :mod:`tablume.operators.trees`).
    """
    if prepared.counts["used"] == 0:
        raise ValueError("no row has a target and every numeric feature")
    shared_folder(prepared.df.sparkSession)
    steps, transformed = fit_features(prepared)
    if trees.by_cells(estimator):
        return _fit_trees(prepared, estimator, holdout, evaluate, steps, transformed)
    if partitions is None and isinstance(estimator, LogisticRegression):
        partitions = _parts_of(prepared.counts["used"])
    kept = [FEATURES, LABEL] if prepared.target else [FEATURES]
    vectors = spread(transformed.select(*kept), partitions).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        training = testing = vectors
        if holdout:
            training, testing = vectors.randomSplit([1.0 - holdout, holdout], seed=SEED)
        fitted = estimator.fit(training)
        result = evaluate(fitted, fitted.transform(testing))
    finally:
        vectors.unpersist()
    return PipelineModel(stages=[*steps.stages, fitted]), result


def _fit_trees(prepared: Prepared, estimator, holdout: float, evaluate, steps, transformed: DataFrame):
    """Fit an ensemble to cells; without a holdout these are evaluated, each for all of its rows."""
    rows = transformed.select(*[col(c) for c in prepared.inputs], LABEL)
    training, n = rows, prepared.counts["used"]
    if holdout:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        training, testing = rows.randomSplit([1.0 - holdout, holdout], seed=SEED)
        n = training.count()
    try:
        stages, predictions, cells = trees.fit_cells(estimator, training, prepared.inputs, n)
        try:
            if holdout:
                result = evaluate(stages[-1], PipelineModel(stages=stages).transform(testing))
            else:
                result = evaluate(stages[-1], predictions, trees.CELL_ROWS, trees.CELL_VARIANCE)
        finally:
            cells.unpersist()
    finally:
        rows.unpersist()
    return PipelineModel(stages=[*steps.stages, *stages]), result


def accuracy(
    predictions: DataFrame, label: str = LABEL, prediction: str = PREDICTION, weight: str | None = None
) -> DataFrame:
    """``(total, correct, accuracy)``; accuracy is NULL when there are no rows. With ``weight`` a row
    stands for so many."""
    if weight:
        return _weighted_accuracy(predictions, label, prediction, weight)
    right = F.count_if(col(label) == col(prediction))
    total = F.count(F.lit(1))
    return predictions.agg(
        total.alias("total"),
        right.alias("correct"),
        F.try_divide(right.cast("double"), total.cast("double")).alias("accuracy"),
    )


def _weighted_accuracy(predictions: DataFrame, label: str, prediction: str, weight: str) -> DataFrame:
    right = F.when(col(label) == col(prediction), col(weight)).otherwise(0.0)
    total, correct = (F.coalesce(F.sum(c), F.lit(0.0)) for c in (col(weight), right))
    return predictions.agg(
        total.cast("bigint").alias("total"),
        correct.cast("bigint").alias("correct"),
        F.try_divide(correct, total).alias("accuracy"),
    )


def rmse(
    predictions: DataFrame, label: str = LABEL, prediction: str = PREDICTION,
    weight: str | None = None, variance: str | None = None,
) -> DataFrame:
    """``(total, rmse)`` over rows with both values. With ``weight`` a row stands for so many, whose
    labels have that ``variance`` around the given one."""
    error = col(label).cast("double") - col(prediction).cast("double")
    if weight:
        squares = col(weight) * (error * error + (col(variance) if variance else 0.0))
        return predictions.agg(
            F.sum(col(weight)).cast("bigint").alias("total"),
            F.sqrt(F.sum(squares) / F.sum(col(weight))).alias("rmse"),
        )
    return predictions.agg(
        F.count(error).alias("total"), F.sqrt(F.avg(error * error)).alias("rmse")
    )


def silhouette(
    predictions: DataFrame, features: str = FEATURES, prediction: str = PREDICTION,
    weight: str | None = None,
) -> float:
    """Mean silhouette by squared distance; needs at least two clusters."""
    evaluator = ClusteringEvaluator(
        featuresCol=features, predictionCol=prediction, metricName="silhouette"
    )
    return (evaluator.setWeightCol(weight) if weight else evaluator).evaluate(predictions)


def cluster_sizes(predictions: DataFrame, prediction: str = PREDICTION) -> DataFrame:
    """``(cluster, size)``."""
    return predictions.groupBy(col(prediction).alias("cluster")).agg(
        F.count(F.lit(1)).alias("size")
    )


def train_regressor(
    prepared: Prepared, algorithm: str = "linear_regression", holdout: float = 0.0,
    partitions: int | None = None, **params,
) -> Trained:
    """Fit a regressor; metrics are ``rmse`` and the row counts, on the training rows by default."""
    estimator = _estimator(REGRESSORS, algorithm, params)
    model, row = _fit(prepared, estimator, holdout, lambda _, p, *cells: rmse(p, LABEL, PREDICTION, *cells).first(), partitions)
    metrics = {"rmse": row["rmse"], "total": row["total"], **prepared.counts}
    message = TRAINED if row["total"] else NOTHING_TO_EVALUATE
    return Trained("regression", algorithm, model, prepared, metrics, message)


def train_classifier(
    prepared: Prepared, algorithm: str = "random_forest", holdout: float = 0.0,
    partitions: int | None = None, **params,
) -> Trained:
    """Fit a classifier; metrics are accuracy with correct and total counts, and row counts."""
    estimator = _estimator(CLASSIFIERS, algorithm, params)
    if algorithm == "gbt_classifier":
        _require_binary(prepared)
    model, row = _fit(prepared, estimator, holdout, lambda _, p, *cells: accuracy(p, LABEL, PREDICTION, *cells[:1]).first(), partitions)
    metrics = {
        "accuracy": row["accuracy"],
        "correct": row["correct"],
        "total": row["total"],
        **prepared.counts,
    }
    message = TRAINED if row["total"] else NOTHING_TO_EVALUATE
    return Trained("classification", algorithm, model, prepared, metrics, message)


def _require_binary(prepared: Prepared) -> None:
    if prepared.labels is not None:
        fits = len(prepared.labels) <= 2
    else:
        fits = prepared.df.agg(F.count_if(~F.col(LABEL).isin(0.0, 1.0))).first()[0] == 0
    if not fits:
        raise ValueError("gbt_classifier handles two classes only, labelled 0 and 1")


def train_clusters(
    prepared: Prepared, k: int = DEFAULT_CLUSTERS, seed: int = SEED, with_silhouette: bool = False,
    partitions: int | None = None,
) -> Trained:
    """Fit k-means; ``tables`` holds cluster sizes and centres.

    Equal rows become one weighted point. The points are dealt by hash and sorted, over a number
    of partitions that follows from the number of rows (or is given), so the starting centres and
    the clusters don't depend on how the input is split. ``with_silhouette`` adds that metric for
    two more passes over the cached points.
    """
    if prepared.counts["used"] == 0:
        raise ValueError("no row has every numeric feature")
    steps = prepared.pipeline.fit(prepared.df)
    if partitions is None:
        partitions = max(CLUSTER_PARTITIONS, -(-prepared.counts["used"] // ROWS_A_PARTITION))
    points = _weighted_points(prepared.df, steps, prepared.inputs, partitions).persist(StorageLevel.MEMORY_AND_DISK)
    estimator = KMeans(
        featuresCol=FEATURES, predictionCol=PREDICTION, weightCol=WEIGHT, k=k, seed=seed
    )
    try:
        fitted = estimator.fit(points)
        predictions = fitted.transform(points)
        found = predictions.groupBy(PREDICTION).agg(F.sum(WEIGHT).cast("bigint").alias("size"))
        size = {r[PREDICTION]: r["size"] for r in found.collect()}
        sizes = [size.get(c, 0) for c in range(len(fitted.clusterCenters()))]
        score_ = silhouette(predictions, weight=WEIGHT) if with_silhouette else None
    finally:
        points.unpersist()
    model = PipelineModel(stages=[*steps.stages, fitted])
    spark = prepared.df.sparkSession
    metrics = {"k": k, "total": sum(sizes), "silhouette": score_, **prepared.counts}
    trained = Trained(
        "clustering", "kmeans", model, prepared, metrics, TRAINED
    )
    trained.tables["sizes"] = small_table(
        spark, list(enumerate(sizes)), "cluster int, size bigint"
    )
    trained.tables["centers"] = cluster_centers(spark, model, prepared)
    return trained


def _weighted_points(
    df: DataFrame, steps: PipelineModel, inputs: Sequence[str], partitions: int
) -> DataFrame:
    """The different feature vectors and how many rows have each, in an order of their own.

    Rows are counted by the assembler's plain inputs, so vectors are made of the different rows
    only. These are dealt and sorted before they are scaled: the scaler's figures are sums whose last
    digit depends on the input's partitions, the raw values are not.
    """
    *first, _, scaler = steps.stages
    names = [f"v{i}" for i in range(len(inputs))]
    plain = [col(c).cast("double").alias(n) for c, n in zip(inputs, names)]
    raw = PipelineModel(stages=first).transform(df).select(*plain)
    for n in names:  # rows that the assembler leaves out
        raw = raw.where(F.col(n).isNotNull() & ~F.isnan(n))
    counted = raw.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT))
    points = counted.select(F.array(*names).alias("values"), WEIGHT)
    dealt = points.repartition(partitions, "values").sortWithinPartitions("values")
    vectors = dealt.select(array_to_vector("values").alias(RAW), WEIGHT)
    return scaler.transform(vectors).select(FEATURES, WEIGHT)


def cluster_centers(spark: SparkSession, model: PipelineModel, prepared: Prepared) -> DataFrame:
    """``(cluster, position, feature, value, original_value)`` in the caller's feature order.

    ``value`` is in the standardised units the model works in, ``original_value`` in the units
    of the assembled column.
    """
    kmeans, scaler = model.stages[-1], model.stages[-2]
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    rows = [
        (c, i, name, float(center[i]), float(center[i] * std[i] + mean[i]))
        for c, center in enumerate(kmeans.clusterCenters())
        for i, name in enumerate(prepared.features)
    ]
    return small_table(
        spark,
        rows,
        "cluster int, position int, feature string, value double, original_value double",
    )


def feature_importance(trained: Trained) -> DataFrame:
    """``(feature, importance)`` of a tree model, least important first."""
    fitted = trained.model.stages[-1]
    if not hasattr(fitted, "featureImportances"):
        raise ValueError(f"{trained.algorithm} has no feature importances")
    weights = fitted.featureImportances.toArray()
    rows = [(n, float(w)) for n, w in zip(trained.prepared.features, weights)]
    return small_table(
        trained.prepared.df.sparkSession, rows, "feature string, importance double"
    ).orderBy("importance", "feature")


def save_model(
    model: PipelineModel,
    schema: Sequence[Mapping],
    folder: str,
    wide: Mapping[str, WideIndex] | None = None,
) -> str:
    """Save a pipeline model with its input schema and wide dictionaries beside it; returns the
    path."""
    path = f"{folder.rstrip('/')}/spark_model_{uuid.uuid4()}"
    model.write().overwrite().save(path)
    schema = [dict(entry) for entry in schema]
    for i, (name, numbers) in enumerate((wide or {}).items()):
        numbers.ranked.write.parquet(f"{path}/dictionaries/{i}")
        entry = next(e for e in schema if e["name"] == name)
        entry["dictionary"] = {"folder": f"dictionaries/{i}", "size": numbers.size}
    spark = SparkSession.getActiveSession()
    lines = spark.createDataFrame([(json.dumps(list(schema)),)], "value string")
    lines.coalesce(1).write.mode("overwrite").text(f"{path}/input_schema")
    return path


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[dict]]:
    """A saved pipeline model and its input schema (empty if it was saved without one)."""
    model = PipelineModel.load(path)
    try:
        schema = json.loads(spark.read.text(f"{path.rstrip('/')}/input_schema").first()[0])
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        schema = []
    return model, schema


def score(
    df: DataFrame,
    path: str,
    schema: Sequence[Mapping] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Score a whole table (or stream) of raw rows with a saved pipeline.

    Features are typed by the model's input schema. Every row stays: one with an absent numeric
    feature or an unreadable value has a NULL ``prediction`` and says why in ``_errors``; an
    absent category counts as the model's own slot for nulls, as in training. The result has the
    kept columns, the features, ``prediction`` and ``_errors``; it is a map-only plan.

    A model saved without a schema scores the rows as they are typed; all their columns stay, and
    ``prediction`` and ``_errors`` are added as above (columns of these names are replaced).
    """
    model, saved = load_model(df.sparkSession, path)
    wanted = list(schema or saved)
    if not wanted:
        return _predict_rows(df, model, {})
    names = [e["name"] for e in input_fields(wanted)]
    kept = [n for n in dict.fromkeys(keep) if n not in names]
    typed = cast_to_schema(df, wanted, kept, absent_categories=True)
    fields = [typed.schema[n] for n in names]
    # the assembler gets a number in every row, and the caller the row as it was
    typed = typed.withColumn(ROW, F.struct(*[col(c) for c in typed.columns]))
    for entry in input_fields(wanted):
        if about := entry.get("dictionary"):
            ranked = df.sparkSession.read.parquet(f"{path.rstrip('/')}/{about['folder']}")
            typed = WideIndex(ranked, about["size"]).add(typed, entry["name"])
    extra = [c for c in typed.columns if c not in (*kept, *names, ROW, ERRORS)]
    whole = typed.withColumns(
        {f.name: F.when(is_null(f), F.lit(0).cast(f.dataType)).otherwise(col(f.name))
         for f in fields if is_numeric(f.dataType)}
    )
    scored = model.transform(whole.select(*[col(n) for n in [*names, *extra]], ROW))
    _require_prediction(scored)
    row = F.col(ROW)
    fit = F.size(row[ERRORS]) == 0
    return scored.select(
        *[row[n].alias(n) for n in [*kept, *names]],
        F.when(fit, F.col(PREDICTION)).alias(PREDICTION),
        row[ERRORS].alias(ERRORS),
    )


def _predict_rows(df: DataFrame, model: PipelineModel, wide: Mapping[str, WideIndex]) -> DataFrame:
    """All columns and rows of ``df`` with ``prediction`` and ``_errors``.

    The assembler would drop a row that lacks a number, so it gets a zero there, and the row a
    NULL prediction and a message instead.
    """
    gone = (*working_columns(model), *_index_columns(wide), PREDICTION, ERRORS)
    kept = [c for c in df.columns if c not in gone]
    made = set(working_columns(model))
    read = dict.fromkeys(n for stage in model.stages for n in _taken(stage) if n not in made)
    numbers = [df.schema[n] for n in read if n in kept and is_numeric(df.schema[n].dataType)]
    problems = F.array(
        *[F.when(is_null(f), F.lit(f"missing required feature: {f.name}")) for f in numbers]
    ).cast("array<string>")
    rows = df.withColumn(ROW, F.struct(*[col(c) for c in df.columns])).withColumn(
        ERRORS, F.filter(problems, lambda e: e.isNotNull())
    )
    for name, dictionary in wide.items():
        rows = dictionary.add(rows, name)
    whole = rows.withColumns(
        {f.name: F.when(is_null(f), F.lit(0).cast(f.dataType)).otherwise(col(f.name)) for f in numbers}
    )
    scored = model.transform(whole.drop(PREDICTION))
    _require_prediction(scored)
    return scored.select(
        *[F.col(ROW)[c].alias(c) for c in kept],
        F.when(F.size(ERRORS) == 0, F.col(PREDICTION)).alias(PREDICTION),
        ERRORS,
    )


def _require_prediction(scored: DataFrame) -> None:
    if PREDICTION not in scored.columns:
        raise ValueError("the saved pipeline gives no prediction column")


def feature_arrays(df: DataFrame, vector: str, output: str) -> DataFrame:
    """A vector column as a plain array column, for sinks and SQL."""
    return df.withColumn(output, vector_to_array(col(vector)))
