"""Training, metrics, scoring and the report.

A one-feature ridge line has a closed form, so linear training, scoring with a saved pipeline,
prediction samples and plot points are all checked exactly. Tree, logistic and k-means fits
depend on random choices and are registered without SQL.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.registry import query, rounded, table
from tablume.operators import models as ops
from tablume.operators.features import MAX_LABELS, prepare
from tablume.plans.analyze import analyze
from tablume.plans.report import build_report
from tablume.sources.scratch import scratch_path

_LINE = (
    "WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, "
    "stddev_samp(l_quantity) AS sx, stddev_pop(l_quantity) AS px, "
    "stddev_pop(l_extendedprice) AS py, covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem), "
    "f AS (SELECT mx, my, sx, (c / sx) / ((px * px / (sx * sx)) * (1 + 0.1 / py)) AS b FROM s)"
)
_PREDICTED = "my + b * (l_quantity - mx) / sx"


def _line(spark, folder, keep=("l_orderkey", "l_linenumber")):
    lines = table(spark, folder, "lineitem")
    prepared = prepare(lines, ["l_quantity"], "l_extendedprice", keep=keep)
    return ops.train_regressor(prepared)


def _metrics(spark, trained, names):
    rows = [(n, None if trained.metrics[n] is None else float(trained.metrics[n])) for n in names]
    return spark.createDataFrame(rows, "metric string, value double")


@query(
    "train_linear",
    _LINE
    + " SELECT round(min(b), 4) AS coefficient, round(min(my), 4) AS intercept, "
    f"round(sqrt(avg(pow(l_extendedprice - ({_PREDICTED}), 2))), 4) AS rmse, count(*) AS total "
    "FROM lineitem, f",
)
def train_linear(spark, folder):
    trained = _line(spark, folder)
    fitted = trained.model.stages[-1]
    row = (
        round(float(fitted.coefficients[0]), 4),
        round(float(fitted.intercept), 4),
        round(float(trained.metrics["rmse"]), 4),
        trained.metrics["total"],
    )
    return spark.createDataFrame(
        [row], "coefficient double, intercept double, rmse double, total bigint"
    )


@query(
    "prediction_sample",
    _LINE
    + f" SELECT l_quantity, l_extendedprice, round({_PREDICTED}, 4) AS prediction FROM lineitem, f "
    "ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity LIMIT 10",
)
def prediction_sample(spark, folder):
    order = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"]
    return rounded(_line(spark, folder).sample(order), 4, "prediction")


@query(
    "score_saved_model",
    _LINE
    + f" SELECT l_orderkey, l_linenumber, l_quantity, round({_PREDICTED}, 4) AS prediction "
    "FROM lineitem, f",
)
def score_saved_model(spark, folder):
    path = _line(spark, folder).save(scratch_path(spark, "models"))
    raw = table(spark, folder, "lineitem").withColumn(
        "l_quantity", F.col("l_quantity").cast("string")
    )
    scored = ops.score(raw, path, keep=["l_orderkey", "l_linenumber"])
    return rounded(scored, 4, "prediction").drop("_errors")


@query(
    "score_bad_rows",
    _LINE
    + f" SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 11 = 0 OR l_orderkey % 7 = 0 "
    f"THEN NULL ELSE round({_PREDICTED}, 4) END AS prediction, CASE WHEN l_orderkey % 11 = 0 "
    "THEN 'missing required feature: l_quantity' WHEN l_orderkey % 7 = 0 "
    "THEN 'invalid value for feature l_quantity: expected double' ELSE '' END AS errors "
    "FROM lineitem, f",
)
def score_bad_rows(spark, folder):
    path = _line(spark, folder).save(scratch_path(spark, "models"))
    raw = table(spark, folder, "lineitem").withColumn(
        "l_quantity",
        F.when(F.col("l_orderkey") % 11 == 0, None)
        .when(F.col("l_orderkey") % 7 == 0, "many")
        .otherwise(F.col("l_quantity").cast("string")),
    )
    scored = ops.score(raw, path, keep=["l_orderkey", "l_linenumber"])
    return rounded(scored, 4, "prediction").select(
        "l_orderkey", "l_linenumber", "prediction", F.array_join("_errors", ",").alias("errors")
    )


@query(
    "score_without_schema",
    _LINE
    + f" SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 > 0 THEN round({_PREDICTED}, 4) END "
    "AS prediction, CASE WHEN l_orderkey % 7 = 0 THEN 'missing required feature: l_quantity' ELSE '' "
    "END AS errors FROM lineitem, f",
)
def score_without_schema(spark, folder):
    """A pipeline saved by itself keeps every row too."""
    path = scratch_path(spark, "models")
    _line(spark, folder).model.save(path)
    raw = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "if(l_orderkey % 7 > 0, l_quantity, NULL) AS l_quantity"
    )
    return rounded(ops.score(raw, path), 4, "prediction").select(
        "l_orderkey", "l_linenumber", "prediction", F.array_join("_errors", ",").alias("errors")
    )


def _scored_like_training(spark, folder, max_labels):
    """How many rows are predicted, and how many inputs score otherwise than in training."""
    lines = table(spark, folder, "lineitem").withColumn(
        "l_returnflag", F.when(F.col("l_orderkey") % 5 > 0, F.col("l_returnflag"))
    )
    features = ["l_quantity", "l_returnflag"]
    trained = ops.train_regressor(
        prepare(lines, features, "l_extendedprice", max_labels=max_labels)
    )
    path = trained.save(scratch_path(spark, "models"))

    def by_input(df):
        return df.groupBy("l_quantity", "l_returnflag").agg(
            F.count("prediction").alias("n"), F.round(F.avg("prediction"), 6).alias("prediction")
        )

    scored, known = by_input(ops.score(lines, path)), by_input(trained.predictions())
    wrong = scored.exceptAll(known).count()
    return scored.agg(F.sum("n").alias("predicted"), F.lit(wrong).alias("wrong"))


@query("score_null_categories", "SELECT count(*) AS predicted, 0 AS wrong FROM lineitem")
def score_null_categories(spark, folder):
    return _scored_like_training(spark, folder, MAX_LABELS)


@query("score_wide_categories", "SELECT count(*) AS predicted, 0 AS wrong FROM lineitem")
def score_wide_categories(spark, folder):
    """The dictionary stands beside the model and is joined in training and scoring."""
    return _scored_like_training(spark, folder, 2)


@query(
    "metric_accuracy",
    "SELECT count(*) AS total, count(*) FILTER (WHERE label = prediction) AS correct, "
    "round(count(*) FILTER (WHERE label = prediction) / CAST(count(*) AS DOUBLE), 8) AS accuracy "
    "FROM (SELECT CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS label, "
    "CASE WHEN l_extendedprice > 50000 THEN 1.0 ELSE 0.0 END AS prediction FROM lineitem)",
)
def metric_accuracy(spark, folder):
    pairs = table(spark, folder, "lineitem").selectExpr(
        "CASE WHEN l_quantity > 25 THEN 1.0D ELSE 0.0D END AS label",
        "CASE WHEN l_extendedprice > 50000 THEN 1.0D ELSE 0.0D END AS prediction",
    )
    return rounded(ops.accuracy(pairs, "label"), 8, "accuracy")


@query(
    "metric_rmse",
    "SELECT count(*) AS total, round(sqrt(avg(pow(l_extendedprice - 2000 * l_quantity, 2))), 4) "
    "AS rmse FROM lineitem",
)
def metric_rmse(spark, folder):
    pairs = table(spark, folder, "lineitem").selectExpr(
        "l_extendedprice AS label", "2000 * l_quantity AS prediction"
    )
    return rounded(ops.rmse(pairs, "label"), 4, "rmse")


_CLUSTERED = (
    "SELECT l_quantity AS x, l_discount * 100 AS y, CASE WHEN l_quantity + l_linenumber < 20 THEN 0 "
    "WHEN l_quantity + l_linenumber < 40 THEN 1 ELSE 2 END AS prediction FROM {lineitem}"
)
_CLUSTER_STATS = (
    "SELECT prediction AS c, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, "
    "sum(x * x + y * y) AS ss FROM p GROUP BY 1"
)


@query(
    "metric_silhouette",
    f"WITH p AS (SELECT row_number() OVER () AS id, * FROM ({_CLUSTERED.format(lineitem='lineitem')})), "
    f"k AS ({_CLUSTER_STATS}), d AS (SELECT id, prediction = c AS own, "
    "x * x + y * y + ss / n - 2 * (x * sx + y * sy) / n AS away, n FROM p, k), "
    "v AS (SELECT id, max(CASE WHEN own THEN away * n / (n - 1) END) AS a, "
    "min(CASE WHEN NOT own THEN away END) AS b FROM d GROUP BY id) "
    "SELECT round(avg((b - a) / greatest(a, b)), 8) AS silhouette FROM v",
)
def metric_silhouette(spark, folder):
    points = spark.sql(
        _CLUSTERED.format(lineitem="{lineitem}"), lineitem=table(spark, folder, "lineitem")
    )
    vectors = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(points)
    value = ops.silhouette(vectors, "features")
    return spark.createDataFrame([(round(value, 8),)], "silhouette double")


_REGRESSION = (["l_quantity", "l_discount", "l_tax", "l_returnflag"], "l_extendedprice")
_BINARY = (["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"], "l_linestatus")
_MANY = (["l_quantity", "l_extendedprice", "l_discount", "l_linestatus"], "l_returnflag")


def _trained(spark, folder, train, columns, algorithm):
    features, target = columns
    prepared = prepare(table(spark, folder, "lineitem"), features, target)
    return train(prepared, algorithm, partitions=spark.sparkContext.defaultParallelism)


@query("train_rf_regressor")
def train_rf_regressor(spark, folder):
    trained = _trained(spark, folder, ops.train_regressor, _REGRESSION, "random_forest_regressor")
    return _metrics(spark, trained, ["rmse", "total"])


@query("train_gbt_regressor")
def train_gbt_regressor(spark, folder):
    trained = _trained(spark, folder, ops.train_regressor, _REGRESSION, "gbt_regressor")
    return _metrics(spark, trained, ["rmse", "total"])


@query("train_rf_classifier")
def train_rf_classifier(spark, folder):
    trained = _trained(spark, folder, ops.train_classifier, _MANY, "random_forest")
    return _metrics(spark, trained, ["accuracy", "correct", "total"])


@query("train_logistic")
def train_logistic(spark, folder):
    trained = _trained(spark, folder, ops.train_classifier, _MANY, "logistic_regression")
    return _metrics(spark, trained, ["accuracy", "correct", "total"])


@query("train_gbt_classifier")
def train_gbt_classifier(spark, folder):
    trained = _trained(spark, folder, ops.train_classifier, _BINARY, "gbt_classifier")
    return _metrics(spark, trained, ["accuracy", "correct", "total"])


def _clusters(spark, folder, features=("l_quantity", "l_extendedprice", "l_discount"), k=5):
    lines = table(spark, folder, "lineitem")
    keep = ("l_orderkey", "l_linenumber")
    return ops.train_clusters(prepare(lines, list(features), keep=keep), k)


@query(
    "train_kmeans",
    "SELECT 'k' AS metric, 5.0::DOUBLE AS value UNION ALL SELECT m, count(*)::DOUBLE FROM lineitem, "
    "(VALUES ('total'), ('rows'), ('used')) AS v(m) GROUP BY m",
)
def train_kmeans(spark, folder):
    trained = _clusters(spark, folder)
    return _metrics(spark, trained, ["k", "total", "rows", "used"])


@query("cluster_sizes")
def cluster_sizes(spark, folder):
    return ops.cluster_sizes(_clusters(spark, folder).predictions())


@query("cluster_centers")
def cluster_centers(spark, folder):
    return _clusters(spark, folder).tables["centers"]


@query("feature_importance")
def feature_importance(spark, folder):
    trained = _trained(spark, folder, ops.train_regressor, _REGRESSION, "gbt_regressor")
    return ops.feature_importance(trained)


# A target that is a threshold of one feature with few values has one best answer.
_THRESHOLD = "CASE WHEN l_linenumber > 4 THEN 'late' ELSE 'early' END"
_FEATURES = ["l_linenumber", "l_noise"]


def _threshold_rows(spark, folder):
    # the second feature tells nothing: it is the same for all lines of an order of seven or more
    return table(spark, folder, "lineitem").selectExpr(
        "l_linenumber", "l_orderkey % 3 AS l_noise", f"{_THRESHOLD} AS target",
        "CASE WHEN l_linenumber > 4 THEN 10.0D ELSE 2.0D END AS step",
    )


_ALL_RIGHT = "SELECT '{name}' AS algorithm, 1.0::DOUBLE AS accuracy, count(*) AS correct, count(*) AS total FROM lineitem"


@query(
    "classify_threshold",
    " UNION ALL ".join(_ALL_RIGHT.format(name=n) for n in ("random_forest", "logistic_regression", "gbt_classifier")),
)
def classify_threshold(spark, folder):
    """Every classifier finds a class that is a threshold of one feature."""
    params = {
        "random_forest": {"numTrees": 5, "maxDepth": 3, "featureSubsetStrategy": "all"},
        "logistic_regression": {"regParam": 0.0},
        "gbt_classifier": {"maxIter": 3},
    }
    rows = []
    for name, chosen in params.items():
        prepared = prepare(_threshold_rows(spark, folder), _FEATURES, "target")
        m = ops.train_classifier(prepared, name, **chosen).metrics
        rows.append((name, float(m["accuracy"]), m["correct"], m["total"]))
    return spark.createDataFrame(
        rows, "algorithm string, accuracy double, correct bigint, total bigint"
    )


@query(
    "regress_step",
    "SELECT n AS algorithm, 0.0::DOUBLE AS rmse, count(*) AS total FROM lineitem, "
    "(VALUES ('random_forest_regressor'), ('gbt_regressor')) AS v(n) GROUP BY n",
)
def regress_step(spark, folder):
    """Tree regressors find a step of one feature."""
    params = {
        "random_forest_regressor": {"numTrees": 3, "maxDepth": 3, "featureSubsetStrategy": "all"},
        "gbt_regressor": {"maxIter": 3},
    }
    rows = []
    for name, chosen in params.items():
        m = ops.train_regressor(prepare(_threshold_rows(spark, folder), _FEATURES, "step"), name, **chosen).metrics
        rows.append((name, round(abs(float(m["rmse"])), 6), m["total"]))
    return spark.createDataFrame(rows, "algorithm string, rmse double, total bigint")


@query(
    "importance_of_step",
    "SELECT 'l_noise' AS feature, 0.0::DOUBLE AS importance UNION ALL SELECT 'l_linenumber', "
    "CASE WHEN count(DISTINCT l_linenumber) > 1 THEN 1.0 ELSE 0.0 END::DOUBLE FROM lineitem",
)
def importance_of_step(spark, folder):
    prepared = prepare(_threshold_rows(spark, folder), _FEATURES, "step")
    trained = ops.train_regressor(prepared, "gbt_regressor", maxIter=3)
    return rounded(ops.feature_importance(trained), 4, "importance")


_FAR = "SELECT l_linenumber % 2 * 1000 + l_discount AS x, l_linenumber % 2 * 1000 + l_tax AS y FROM {lineitem}"


@query(
    "cluster_far_groups",
    f"SELECT row_number() OVER (ORDER BY avg(x)) AS place, count(*) AS size, round(avg(x), 6) AS x, "
    f"round(avg(y), 6) AS y FROM ({_FAR.format(lineitem='lineitem')}) GROUP BY x > 500",
)
def cluster_far_groups(spark, folder):
    """Groups far apart are found whatever the start: their sizes and means."""
    rows = spark.sql(_FAR.format(lineitem="{lineitem}"), lineitem=table(spark, folder, "lineitem"))
    trained = ops.train_clusters(prepare(rows, ["x", "y"]), 2)
    centers = trained.tables["centers"].groupBy("cluster").agg(
        *[F.round(F.max(F.when(F.col("feature") == c, F.col("original_value"))), 6).alias(c) for c in "xy"]
    )
    place = F.row_number().over(Window.orderBy("x"))
    return centers.join(trained.tables["sizes"], "cluster").select(
        place.cast("bigint").alias("place"), "size", "x", "y"
    )


@query(
    "analyze_classes",
    "SELECT 1.0::DOUBLE AS accuracy, count(*) AS correct, count(*) AS total FROM lineitem",
)
def analyze_classes(spark, folder):
    rows = _threshold_rows(spark, folder)
    forest = {"numTrees": 3, "maxDepth": 3, "featureSubsetStrategy": "all"}
    found = analyze(rows, "classification", _FEATURES, "target", **forest).metrics
    row = (found["accuracy"], found["correct"], found["total"])
    return spark.createDataFrame([row], "accuracy double, correct bigint, total bigint")


@query(
    "analyze_clusters",
    f"SELECT count(*) AS size FROM ({_FAR.format(lineitem='lineitem')}) GROUP BY x > 500",
)
def analyze_clusters(spark, folder):
    rows = spark.sql(_FAR.format(lineitem="{lineitem}"), lineitem=table(spark, folder, "lineitem"))
    return analyze(rows, "clustering", ["x", "y"], k=2).tables["sizes"].select("size")


@query("report_summary")
def report_summary(spark, folder):
    customers = table(spark, folder, "customer")
    report = build_report(customers, ["c_custkey"], exclude=["c_custkey", "c_name"])
    return report.tables["summary"]


@query(
    "report_tasks",
    "SELECT CASE WHEN count(DISTINCT c_nationkey) > 10 THEN 'c_nationkey' ELSE 'c_acctbal' END AS target, "
    "'Regression (Linear Regression)' AS task, CASE WHEN count(DISTINCT c_nationkey) > 10 "
    "THEN 'c_acctbal, c_mktsegment' ELSE 'c_nationkey, c_mktsegment' END AS features, 'ok' AS status FROM customer "
    "UNION ALL SELECT CASE WHEN count(DISTINCT c_mktsegment) BETWEEN 2 AND 10 THEN 'c_mktsegment' END, "
    "'Classification (Random Forest)', 'c_nationkey, c_acctbal', 'ok' FROM customer "
    "UNION ALL SELECT NULL, 'Clustering (KMeans, k=3)', 'c_nationkey, c_acctbal', 'ok'",
)
def report_tasks(spark, folder):
    """The targets and features that the report chooses, and that every task succeeds."""
    return report_summary(spark, folder).select("task", "target", "features", "status")
