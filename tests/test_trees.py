from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

import tablume as t
from tablume.operators import trees


@pytest.fixture(scope="module")
def lines(spark):
    """3,000 rows of 12 different inputs, with labels that differ within them."""
    rows = spark.range(3000, numPartitions=3).selectExpr(
        "double(id % 4) AS a", "double(id % 3) AS b", "id % 4 * 5 + id % 3 + pow(id % 7, 2) AS y",
        "IF((id % 4 + id % 3 + id % 5) > 4, 'p', 'q') AS c",
    )
    return rows.persist()


@pytest.mark.parametrize(
    "estimator, name, target",
    [
        (GBTRegressor, "gbt_regressor", "y"), (GBTClassifier, "gbt_classifier", "c"),
        (RandomForestRegressor, "random_forest_regressor", "y"), (RandomForestClassifier, "random_forest", "c"),
    ],
)
def test_ensembles_get_cells_instead_of_rows(monkeypatch, lines, estimator, name, target):
    seen, fit = [], estimator.fit
    monkeypatch.setattr(estimator, "fit", lambda self, rows, *more: (seen.append(rows.count()), fit(self, rows, *more))[1])
    train = t.train_regressor if target == "y" else t.train_classifier
    chosen = {"maxIter": 2} if "gbt" in name else {"numTrees": 3}
    trained = train(t.prepare(lines, ["a", "b"], target), name, **chosen)
    assert max(seen) <= 12 * 8  # draws of a task may give a cell more than one point
    assert trained.metrics["total"] == 3000


def test_boosting_cells_is_boosting_rows(lines):
    prepared = t.prepare(lines, ["a", "b"], "y")
    trained = t.train_regressor(prepared, "gbt_regressor", maxIter=5, maxDepth=2)
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(lines)
    plain = GBTRegressor(featuresCol="x", labelCol="y", maxIter=5, maxDepth=2, seed=42).fit(rows)
    want = plain.transform(rows).groupBy("a", "b").agg(F.avg("prediction")).collect()
    got = trained.predict(lines).groupBy("a", "b").agg(F.avg("prediction")).collect()
    assert {(r[0], r[1]): pytest.approx(r[2]) for r in want} == {(r[0], r[1]): r[2] for r in got}
    error = plain.transform(rows).select(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
    assert trained.metrics["rmse"] == pytest.approx(error)


def test_a_forest_predicts_what_its_bootstraps_mean(lines):
    trained = t.train_regressor(
        t.prepare(lines, ["a", "b"], "y"), "random_forest_regressor", numTrees=20, featureSubsetStrategy="all"
    )
    means = lines.groupBy("a", "b").agg(F.avg("y").alias("m"), F.stddev("y").alias("s"))
    for r in trained.predict(lines).join(means, ["a", "b"]).dropDuplicates(["a", "b"]).collect():
        assert 0 < abs(r["prediction"] - r["m"]) < 5 * r["s"] / np.sqrt(250)
    assert len(trained.model.stages[-1].trees) == 20


def test_draws_are_those_of_rows(spark):
    forest = RandomForestClassifier(numTrees=400, seed=1)
    cells = spark.createDataFrame([([1.0], 0.0, 50.0)], f"bins array<float>, {trees.LABEL} double, {trees.CELL_ROWS} double")
    w = np.array(trees._drawn(cells, forest, 50, 1, False).first()["w"])
    assert abs(w.mean() - 50) < 2 and 30 < w.var() < 75  # one draw for all rows would vary by 2,500


def test_draws_do_not_depend_on_partitions(lines):
    def rmse(rows):
        return t.train_regressor(t.prepare(rows, ["a", "b"], "y"), "random_forest_regressor", numTrees=3).metrics["rmse"]

    assert rmse(lines.repartition(5)) == pytest.approx(rmse(lines), rel=1e-9)


def test_least_instances_are_rows(lines):
    def depth(least):
        return t.train_regressor(
            t.prepare(lines, ["a", "b"], "y"), "gbt_regressor", maxIter=1, minInstancesPerNode=least
        ).model.stages[-1].trees[0].depth

    assert depth(100) > 0 and depth(2000) == 0


def test_thresholds_between_values_and_evenly():
    assert trees.thresholds(np.array([1.0, 2, 2, 4]), 32) == [1.5, 3.0]
    assert trees.thresholds(np.arange(100.0), 4) == [24.5, 49.5, 74.5]
