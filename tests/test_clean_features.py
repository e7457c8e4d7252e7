from __future__ import annotations

import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import tablume as t
from conftest import by_column
from tablume.operators.features import FEATURES, LABEL, fit_features, ranked_values
from tablume.sources.scratch import scratch_path


def test_no_nulls_left(people):
    filled = t.impute(people)
    assert all(r["null_count"] == 0 for r in t.null_counts(filled).collect())
    rows = {r["id"]: r for r in filled.collect()}
    assert rows[2]["age"] == 34 and rows[3]["salary"] == 57500.0
    assert rows[4]["department"] == "HR"
    assert filled.schema["age"].dataType == people.schema["age"].dataType


def test_all_null_text_stays(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "x int, s string")
    assert t.impute(df).filter("s IS NULL").count() == 2


def test_null_may_be_the_most_frequent_value(spark):
    df = spark.createDataFrame([("a",), (None,), (None,), (None,)], "s string")
    assert t.impute_categorical(df).filter("s = 'a'").count() == 4


@pytest.mark.parametrize("strategy,age", [("mean", 34), ("median", 32), ("mode", 30)])
def test_strategies(people, strategy, age):
    assert t.impute_numeric(people, strategy).filter("id = 2").first()["age"] == age


def test_modes_of_long_integers_and_floats_are_exact(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (9007199254740993L, CAST(0.1 AS FLOAT), 1.50BD), (NULL, NULL, NULL) AS v(l, f, d)"
    )
    rows = t.impute_numeric(df, "mode").distinct().collect()
    assert len(rows) == 1 and rows[0]["l"] == 9007199254740993


def test_nothing_to_impute_from(spark):
    df = spark.sql("SELECT CAST(NULL AS INT) AS x")
    for strategy in ("mean", "median", "mode"):
        with pytest.raises(ValueError, match="no values to impute from in: x"):
            t.impute_numeric(df, strategy)


def test_unknown_strategy(people):
    with pytest.raises(ValueError, match="strategy"):
        t.impute_numeric(people, "guess")


def test_boolean_and_date_modes_keep_their_type(spark):
    df = spark.sql("SELECT * FROM VALUES (true, DATE'2024-01-01'), (NULL, NULL) AS v(b, d)")
    filled = t.impute(df)
    assert filled.schema == df.schema or [f.dataType for f in filled.schema] == [f.dataType for f in df.schema]
    assert filled.filter("b AND d = DATE'2024-01-01'").count() == 2


def test_scaling_skips_absent_values(people):
    scaled = t.scale(people, ["age", "salary"])
    rows = scaled.select(vector_to_array("scaled_features").alias("v")).collect()
    assert len(rows) == 3
    for i in range(2):
        values = [r["v"][i] for r in rows]
        assert math.isclose(sum(values), 0, abs_tol=1e-9)
        assert math.isclose(sum(v * v for v in values) / 2, 1.0)
    low_high = t.scale(people, ["age"], "minmax").select(
        F.min(vector_to_array("scaled_features")[0]), F.max(vector_to_array("scaled_features")[0])
    ).first()
    assert tuple(low_high) == (0.0, 1.0)


def test_unknown_scaling(people):
    with pytest.raises(ValueError, match="scaling"):
        t.scale(people, ["age"], "robust")


def test_encoding(people):
    encoded = t.one_hot(people, ["department"])
    rows = {r["id"]: r for r in encoded.collect()}
    assert rows[2]["department_indexed"] == 0.0 and rows[1]["department_indexed"] == 1.0
    assert rows[4]["department_indexed"] == 2.0
    assert rows[4]["department_encoded"].size == 2 and rows[4]["department_encoded"].numNonzeros() == 0
    assert rows[1]["department_encoded"].toArray().tolist() == [0.0, 1.0]
    assert rows[4]["department"] is None


def test_indexing_booleans(spark):
    df = spark.createDataFrame([(True,), (False,), (True,), (None,)], "b boolean")
    found = [r["b_indexed"] for r in t.string_index(df, ["b"]).collect()]
    assert found == [0.0, 1.0, 0.0, 2.0]


def test_sorted_numbering_equals_the_indexer(spark):
    df = spark.range(0, 9000, 1, 6).selectExpr(
        "id",
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL "
        "ELSE CAST(id % 2500 AS STRING) END AS v",
    )
    near = t.string_index(df, ["v"]).select("id", "v_indexed")
    far = t.string_index(df, ["v"], max_labels=10).select("id", "v_indexed")
    assert near.exceptAll(far).count() == 0 and far.count() == 9000
    ranked, total = ranked_values(df, "v")
    assert ranked.select(F.min("index"), F.max("index"), F.count_distinct("index")).first() == (
        0, total - 1, total
    )


def test_wide_dictionaries_encode_and_prepare_alike(spark):
    df = spark.range(100).selectExpr("id", "CAST(id % 30 AS STRING) AS v", "CAST(id AS INT) AS n")
    near, far = t.one_hot(df, ["v"]), t.one_hot(df, ["v"], max_labels=10)
    assert {(r["id"], r["v_encoded"]) for r in near.collect()} == {
        (r["id"], r["v_encoded"]) for r in far.collect()
    }
    small, large = (t.prepare(df, ["v"], "n", keep=["id"], max_labels=m) for m in (100, 10))
    assert not small.wide and set(large.wide) == {"v"}
    found = [
        {r["id"]: r["prediction"] for r in t.train_regressor(p).predictions().collect()}
        for p in (small, large)
    ]
    assert found[0].keys() == found[1].keys()
    assert all(abs(found[0][k] - found[1][k]) < 1e-9 for k in found[0])


def test_targets_of_many_classes_train_alike(spark):
    """More classes than a model's dictionary may hold: numbered by the stored table instead."""
    df = spark.range(120).selectExpr("id", "concat('c', id % 12) AS v", "CAST(id % 12 AS INT) AS n")
    few, many = (t.prepare(df, ["n"], "v", keep=["id"], max_labels=m) for m in (100, 5))
    assert len(few.labels) == 12 and many.labels is None and many.classes.size == 12
    numbered = [{r["id"]: r[LABEL] for r in p.df.collect()} for p in (few, many)]
    assert numbered[0] == numbered[1]
    trained = t.train_classifier(many, numTrees=3, maxDepth=6)
    assert trained.metrics["total"] == 120 and trained.metrics["accuracy"] > 0.5
    path = trained.save(scratch_path(spark, "test-models"))
    assert t.score(df, path, keep=["id"]).count() == 120
    floats = df.selectExpr("id", "n", "n / 2 AS z")
    halves = t.prepare(floats, ["n"], "z", keep=["id"], max_labels=5, classes=True)
    assert halves.classes.size == 12 and halves.df.select(LABEL).distinct().count() == 12
    plain = t.prepare(floats, ["z"], "n", max_labels=5, classes=True)
    assert plain.classes is None and plain.labels is None


def test_preparation_reads_the_source_twice(spark):
    """One read for the counts and all dictionaries, one for the scaler."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        reads.add(1)
        yield from batches

    rows = spark.range(0, 40, 1, 1).selectExpr(
        "CAST(id % 7 AS STRING) AS a", "CAST(id % 3 AS STRING) AS b", "CAST(id AS INT) AS n", "id % 2 = 0 AS y"
    )
    df = rows.mapInPandas(counted, rows.schema)
    prepared = t.prepare(df, ["a", "b", "n"], "y")
    assert reads.value == 1
    fit_features(prepared)
    assert reads.value == 2


def test_pca(people):
    projected, ratios = t.pca(people, ["age", "salary"], 1)
    assert "pca_features" in projected.columns and len(ratios) == 1
    assert projected.count() == 3 and 0.99 < ratios[0] <= 1.0


def test_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [1] * 30 + [100]], "x double")
    row = t.detect_outliers(df, ["x"]).first()
    assert row["count"] == 1 and math.isclose(row["percentage"], 100 / 31)
    assert t.flag_outliers(df, ["x"]).filter("x_outlier").count() == 1
    assert t.detect_outliers(df, ["x"], method="iqr").count() == 0
    constant = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert t.detect_outliers(constant, ["x"]).first()["count"] == 0


def test_label_counts(people):
    assert t.label_drop_counts(people, "age").first().asDict() == {
        "rows_before": 5, "rows_after": 4, "removed": 1
    }


def test_prepare_keeps_names_and_counts(people):
    p = t.prepare(people, ["salary", "department", "age"], "age", keep=["id"])
    assert p.features == ["salary", "department"]
    assert p.inputs == ["salary", "department_indexed"]
    assert p.schema[-1] == {"name": "age", "original_type": "int", "is_target": True}
    assert p.counts == {"rows": 5, "labelled": 4, "used": 3}
    assert {"age", "id", LABEL} <= set(p.df.columns)
    assert fit_features(p)[1].select(FEATURES).count() == 3


def test_prepare_drops_null_text_labels_first(people):
    p = t.prepare(people, ["age"], "department")
    assert p.labels == ["HR", "IT"] and p.df.count() == 4


def test_prepare_accepts_every_number_and_boolean(spark):
    df = spark.sql(
        "SELECT CAST(id AS BIGINT) AS l, CAST(id AS DECIMAL(9, 2)) AS d, CAST(id AS FLOAT) AS f, "
        "CAST(id AS SMALLINT) AS s, id % 2 = 0 AS b, id % 3 = 0 AS y FROM range(30)"
    )
    p = t.prepare(df, ["l", "d", "f", "s", "b"], "y")
    model, transformed = fit_features(p)
    assert transformed.count() == 30 and p.labels == ["false", "true"]


@pytest.mark.parametrize(
    "features,target,message",
    [
        ([], "x", "no feature"),
        (["x"], "x", "no feature"),
        (["nope"], "x", "not found"),
        (["x"], "nope", "not found"),
        (["day"], "x", "cannot be used"),
        (["x"], "empty", "no rows are left"),
    ],
)
def test_prepare_errors(spark, features, target, message):
    df = spark.sql("SELECT 1 AS x, DATE'2024-01-01' AS day, CAST(NULL AS STRING) AS empty")
    with pytest.raises(ValueError, match=message):
        t.prepare(df, features, target)


def test_one_hot_of_many_labels_names_no_slot(spark):
    """Neither the plan nor a row holds as much as there are labels."""
    df = spark.range(3000).selectExpr("id", "IF(id > 0, string(id), NULL) AS v")
    encoded = t.one_hot(df, ["v"], max_labels=100)
    assert encoded.schema["v_encoded"].metadata == {"ml_attr": {"num_attrs": 2999}}
    rows = {r["id"]: r["v_encoded"] for r in encoded.collect()}
    assert rows[0].size == 2999 and rows[0].numNonzeros() == 0
    assert {int(v.indices[0]) for i, v in rows.items() if i} == set(range(2999))
