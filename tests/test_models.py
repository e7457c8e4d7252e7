from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

import tablume as t
from conftest import by_column
from tablume.operators import models
from tablume.operators.models import cluster_sizes
from tablume.sources.scratch import scratch_path


@pytest.fixture(scope="module")
def students(spark):
    """Hours 1..12 in eight groups; attendance rises with hours, passing needs seven hours."""
    return spark.range(96).selectExpr(
        "id",
        "CAST(1 + id % 12 AS INT) AS hours",
        "CAST(30 + 5 * (1 + id % 12) + 2 * (id % 5) AS INT) AS attendance",
        "CAST(id % 12 >= 6 AS INT) AS passed",
        "CASE WHEN id % 12 >= 6 THEN 'yes' ELSE 'no' END AS verdict",
        "id % 12 >= 3 AS early",
    )


def test_text_features_train_and_score_raw_rows(spark, students):
    """One pipeline, fitted once, from raw string and boolean columns."""
    prepared = t.prepare(students, ["hours", "verdict", "early"], "attendance", keep=["id"])
    trained = t.train_regressor(prepared)
    assert 0 < trained.metrics["rmse"] < 5 and trained.metrics["total"] == 96
    path = trained.save(scratch_path(spark, "test-models"))
    raw = students.select("id", "hours", "verdict", "early")
    scored = t.score(raw, path, keep=["id"])
    assert scored.columns == ["id", "hours", "verdict", "early", "prediction", "_errors"]
    wanted = {r["id"]: r["prediction"] for r in trained.predictions().collect()}
    assert all(math.isclose(r["prediction"], wanted[r["id"]]) for r in scored.collect())


def test_scoring_types_rows_and_keeps_bad_ones(spark, students):
    path = t.train_regressor(t.prepare(students, ["hours", "early"], "attendance")).save(
        scratch_path(spark, "test-models")
    )
    _, schema = t.load_model(spark, path)
    assert [e["name"] for e in schema] == ["hours", "early", "attendance"]
    rows = [("5", "TRUE"), ("5.5", "true"), (None, "true"), ("7", None), ("8", "no")]
    raw = spark.createDataFrame(rows, "hours string, early string")
    typed = t.cast_to_schema(raw, schema)
    assert t.valid_rows(typed).count() == 2 and t.invalid_rows(typed).count() == 3
    found = {(r["hours"], r["early"]): r for r in t.score(raw, path, keep=["hours"]).collect()}
    assert len(found) == 5 - 1  # the unreadable and the absent hours both read as NULL
    assert found[7, None]["prediction"] is not None and found[7, None]["_errors"] == []
    assert t.score(raw, path).filter("prediction IS NULL AND size(_errors) = 1").count() == 2
    assert t.score(raw, path).count() == 5


def test_null_categories_score_as_in_training(spark, students):
    gaps = students.selectExpr("id AS _id", "hours", "nullif(verdict, 'yes') AS verdict", "attendance")
    trained = t.train_regressor(t.prepare(gaps, ["hours", "verdict"], "attendance", keep=["_id"]))
    assert trained.metrics["used"] == 96
    known = trained.predictions()
    assert "_id" in known.columns and not {"verdict_indexed", "_features"} & set(known.columns)
    wanted = {r["_id"]: r["prediction"] for r in known.collect()}
    path = trained.save(scratch_path(spark, "test-models"))
    scored = t.score(gaps.drop("attendance"), path, keep=["_id"]).collect()
    assert {r["_id"]: r["prediction"] for r in scored} == wanted and len(scored) == 96


def test_every_row_stays_without_a_schema(spark, students):
    """Rows that lack a number get no prediction and a message, whichever way they are scored."""
    trained = t.train_regressor(t.prepare(students, ["hours", "verdict", "early"], "attendance"))
    path = scratch_path(spark, "test-models")
    trained.model.save(path)
    rows = students.selectExpr(
        "id", "CASE WHEN id % 4 > 0 THEN hours END AS hours", "verdict", "early", "'x' AS prediction"
    )
    for scored in (t.score(rows, path), trained.predict(rows)):
        assert scored.columns == ["id", "hours", "verdict", "early", "prediction", "_errors"]
        found = scored.collect()
        assert len(found) == 96
        for r in found:
            assert (r["prediction"] is None) == (r["id"] % 4 == 0) == (r["hours"] is None)
            assert r["_errors"] == (["missing required feature: hours"] if r["id"] % 4 == 0 else [])


def test_model_plots_cover_all_rows(spark):
    rows = spark.range(3000).selectExpr("id", "CAST(id % 50 AS DOUBLE) AS x", "CAST(id AS DOUBLE) AS y")
    trained = t.train_regressor(t.prepare(rows, ["x"], "y"))
    assert t.actual_vs_predicted(trained).count() == 3000
    clusters = t.train_clusters(t.prepare(rows, ["x", "y"]), 2, partitions=2)
    assert t.cluster_points(clusters).filter("kind = 'point'").count() == 3000
    wide = spark.range(20).selectExpr("id", *[f"id + {i} AS c{i}" for i in range(7)])
    named = [f"c{i}" for i in range(7)]
    assert t.pairplot_points(wide, ["id"], named, 5).columns == named


def test_scoring_a_stream(spark, students, tmp_path):
    path = t.train_regressor(t.prepare(students, ["hours"], "attendance")).save(
        scratch_path(spark, "test-models")
    )
    students.select("id", "hours").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, hours int").parquet(str(tmp_path / "in"))
    scored = t.score(stream, path, keep=["id"])
    assert scored.isStreaming
    run = (
        scored.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "marks"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 96


@pytest.mark.parametrize(
    "algorithm,params",
    [
        ("linear_regression", {}),
        ("random_forest_regressor", {"numTrees": 5, "maxDepth": 4}),
        ("gbt_regressor", {"maxIter": 3, "maxDepth": 3}),
    ],
)
def test_regressors_beat_the_mean(students, algorithm, params):
    spread = students.agg(F.stddev_pop("attendance")).first()[0]
    trained = t.train_regressor(t.prepare(students, ["hours"], "attendance"), algorithm, **params)
    assert trained.metrics["rmse"] < spread


@pytest.mark.parametrize(
    "algorithm,params",
    [
        ("random_forest", {"numTrees": 5, "maxDepth": 4}),
        ("logistic_regression", {}),
        ("gbt_classifier", {"maxIter": 3, "maxDepth": 3}),
    ],
)
def test_classifiers_separate_clear_classes(students, algorithm, params):
    trained = t.train_classifier(t.prepare(students, ["hours"], "verdict"), algorithm, **params)
    m = trained.metrics
    assert (m["accuracy"], m["correct"], m["total"]) == (1.0, 96, 96)
    sample = trained.sample()
    assert sample.columns == ["hours", "verdict_indexed_label", "prediction"]
    assert sample.count() == 10


def test_unknown_algorithms(students):
    prepared = t.prepare(students, ["hours"], "passed")
    for train in (t.train_regressor, t.train_classifier):
        with pytest.raises(ValueError, match="unsupported algorithm"):
            train(prepared, "oracle")


def test_gbt_refuses_three_classes(students):
    three = students.withColumn("grade", F.col("hours") % 3)
    with pytest.raises(ValueError, match="two classes"):
        t.train_classifier(t.prepare(three, ["hours"], "grade"), "gbt_classifier")


def test_holdout_is_evaluated_apart(students):
    trained = t.train_regressor(t.prepare(students, ["hours"], "attendance"), holdout=0.3)
    assert 0 < trained.metrics["total"] < 96


def test_clusters(spark):
    df = spark.range(300).selectExpr(
        "id", "CAST(100 * (id % 3) AS DOUBLE) + id % 7 AS x", "CAST(id % 3 AS DOUBLE) AS y"
    )
    trained = t.train_clusters(t.prepare(df, ["x", "y"], keep=["id"]), 3, with_silhouette=True)
    assert 0.9 < trained.metrics["silhouette"] <= 1.0
    sizes = by_column(trained.tables["sizes"], "cluster")
    assert sorted(s["size"] for s in sizes.values()) == [100, 100, 100]
    predictions = trained.predictions()
    assert {r["cluster"]: r["size"] for r in cluster_sizes(predictions).collect()} == {
        c: s["size"] for c, s in sizes.items()
    }
    means = predictions.groupBy("prediction").agg(F.avg("x").alias("x")).collect()
    centers = {
        r["cluster"]: r["original_value"]
        for r in trained.tables["centers"].filter("feature = 'x'").collect()
    }
    assert all(math.isclose(centers[r["prediction"]], r["x"], rel_tol=1e-6) for r in means)
    plot = t.cluster_points(trained, ["id"], 50)
    assert plot.filter("kind = 'point'").count() == 50 and plot.filter("kind = 'center'").count() == 3
    assert trained.sample(["id"]).columns == ["x", "y", "Assigned_Cluster_ID"]


def test_cluster_points_are_counted_by_plain_columns(spark):
    """Vectors are made of the different rows, after the shuffle that counts them."""
    rows = spark.sql(
        "SELECT * FROM VALUES (1, 0.0D, 'a'), (1, -0.0D, 'a'), (2, 3.0D, NULL), (NULL, 3.0D, 'a'), "
        "(2, double('NaN'), 'b'), (2, 3.0D, NULL) AS t(x, y, z)"
    )
    prepared = t.prepare(rows, ["x", "y", "z"])
    steps = prepared.pipeline.fit(prepared.df)
    points = models._weighted_points(prepared.df, steps, prepared.inputs, 2)
    assert sorted(r[models.WEIGHT] for r in points.collect()) == [2.0, 2.0]
    plan = points._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [v0" in plan and "vector_to_array" not in plan.lower()


def test_clusters_do_not_depend_on_partitions(spark):
    """The same sizes and centres however the rows lie, a third of them copies of one row."""
    rows = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 5D ELSE pmod(xxhash64(id), 1000) / 10 END AS x",
        "CASE WHEN id % 3 = 0 THEN 5D ELSE pmod(xxhash64(id, 1), 1000) / 7 END AS y",
    )
    found = []
    for df in (rows, rows.repartition(3), rows.repartition(11).sortWithinPartitions("y"), rows.orderBy("x")):
        trained = t.train_clusters(t.prepare(df, ["x", "y"]), 4)
        centers = {
            (r["cluster"], r["feature"]): round(r["original_value"], 9)
            for r in trained.tables["centers"].collect()
        }
        found.append(([r["size"] for r in trained.tables["sizes"].collect()], centers))
    assert all(f == found[0] for f in found)
    sizes, centers = found[0]
    # every row is in the group of its nearest centre, by a plain computation
    std = trained.model.stages[-2].std
    plain = [0] * 4
    for r in rows.collect():
        far = [
            sum(((r[n] - centers[c, n]) / std[i]) ** 2 for i, n in enumerate(("x", "y")))
            for c in range(4)
        ]
        plain[far.index(min(far))] += 1
    assert plain == sizes and sum(sizes) == 3000


def test_staff_cluster_sizes(staff):
    trained = t.train_clusters(t.prepare(staff, ["age", "id", "salary"]), 3)
    assert sum(r["size"] for r in trained.tables["sizes"].collect()) == 5


def test_cluster_plot_needs_two_or_three_features(students):
    trained = t.train_clusters(t.prepare(students, ["hours"]), 2)
    with pytest.raises(ValueError, match="two or three"):
        t.cluster_points(trained, ["hours"])


def test_importance_is_sorted_and_whole(students):
    prepared = t.prepare(students, ["hours", "id"], "attendance")
    trained = t.train_regressor(prepared, "random_forest_regressor", numTrees=5, maxDepth=4)
    rows = t.feature_importance(trained).collect()
    assert [r["importance"] for r in rows] == sorted(r["importance"] for r in rows)
    assert math.isclose(sum(r["importance"] for r in rows), 1.0) and rows[-1]["feature"] == "hours"


def test_importance_needs_trees(students):
    trained = t.train_regressor(t.prepare(students, ["hours"], "attendance"))
    with pytest.raises(ValueError, match="importances"):
        t.feature_importance(trained)


def test_no_complete_rows(spark):
    df = spark.createDataFrame([(1.0, None)], "y double, x double")
    with pytest.raises(ValueError, match="every numeric feature"):
        t.train_regressor(t.prepare(df, ["x"], "y"))


def test_metrics_of_nothing(spark):
    nothing = spark.createDataFrame([], "label double, prediction double")
    assert t.accuracy(nothing, "label").first().asDict() == {
        "total": 0, "correct": 0, "accuracy": None
    }
    assert t.rmse(nothing, "label").first()["rmse"] is None


def test_reserved_names(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "prediction double, y double")
    with pytest.raises(ValueError, match="reserved"):
        t.prepare(df, ["prediction"], "y")


def test_user_columns_called_label_and_features(spark):
    df = spark.range(20).selectExpr("CAST(id AS DOUBLE) AS label", "id * 2 AS features", "id AS y")
    trained = t.train_regressor(t.prepare(df, ["label", "features"], "y"))
    assert trained.metrics["total"] == 20


def test_numeric_classes_need_no_numbering(spark):
    rows = spark.range(200).selectExpr(
        "id", "CAST(id % 10 AS DOUBLE) AS x", "CAST(CASE WHEN id % 10 > 4 THEN 1 ELSE -1 END AS INT) AS y",
        "CASE WHEN id % 10 > 4 THEN 0.5 ELSE 2.5 END AS z",
    )
    for target in ("y", "z"):
        trained = t.analyze(rows, "classification", ["x"], target, keep=["id"], algorithm="gbt_classifier", maxIter=2)
        assert trained.metrics["accuracy"] == 1.0 and len(trained.prepared.labels) == 2
        assert trained.sample(["id"], 3).count() == 3


def test_many_rows_of_an_iterative_fit_are_dealt(spark, students, monkeypatch):
    """No part of the cached rows holds more than its bound, whatever the input's parts hold."""
    dealt = []
    real = models.spread
    monkeypatch.setattr(models, "ROWS_A_FIT", 20)
    monkeypatch.setattr(models, "spread", lambda df, n: dealt.append(real(df, n)) or dealt[-1])
    prepared = t.prepare(students.coalesce(1), ["hours"], "verdict")
    trained = t.train_classifier(prepared, "logistic_regression", regParam=0.0)
    assert trained.metrics["accuracy"] == 1.0 and trained.metrics["total"] == 96
    assert max(len(part) for part in dealt[0].rdd.glom().collect()) <= 20
