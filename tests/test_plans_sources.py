from __future__ import annotations

import json

import pytest

import tablume as t
from conftest import by_column
from tablume.operators.models import Trained
from tablume.plans.report import formatted_features
from tablume.sources.scratch import scratch_path

QUICK = {"numTrees": 3, "maxDepth": 3}


def test_suggestions(spark):
    df = spark.range(40).selectExpr(
        "id AS many", "id % 3 AS few", "1 AS one", "CAST(id AS DECIMAL(9, 2)) AS exact",
        "CASE WHEN id % 10 = 9 THEN NULL ELSE id % 10 END AS nine_and_null",
        "'x' AS text", "true AS flag", "current_date() AS day",
    )
    assert t.suggest(df) == ["clustering", "exploratory"]
    wanted = {
        "many": ["regression"],
        "few": ["classification", "regression"],
        "one": ["exploratory"],
        "exact": ["regression"],
        "nine_and_null": ["regression"],
        "text": ["classification"],
        "flag": ["classification"],
        "day": ["exploratory"],
    }
    assert {c: t.suggest(df, c) for c in df.columns} == wanted
    found = {}
    for r in t.suggest_analysis(df).orderBy("column", "position").collect():
        found.setdefault(r["column"], []).append(r["suggestion"])
    assert found == wanted
    with pytest.raises(ValueError, match="not found"):
        t.suggest(df, "nope")


def test_targets(spark):
    df = spark.range(40).selectExpr("id % 4 AS few", "id AS many", "CAST(id AS STRING) AS text")
    assert t.regression_target(df) == "many"
    assert t.regression_target(df, exclude=["many"]) == "few"
    assert t.classification_target(df) == "few"
    named = df.selectExpr("*", "CASE WHEN few > 1 THEN 'a' ELSE 'b' END AS half")
    assert t.classification_target(named) == "half"
    assert t.regression_target(df.select("text")) is None
    assert t.classification_target(df.select("text")) is None


def test_dispatch(spark, staff):
    tables = t.analyze(staff, "exploratory", exclude=["id"])
    assert set(tables) == {"numeric", "histogram", "categorical"}
    assert isinstance(t.analyze(staff, "clustering", ["age", "salary"], k=2), Trained)
    trained = t.analyze(staff, "regression", ["age", "id"], "age")
    assert trained.prepared.features == ["id"]
    with pytest.raises(ValueError, match="unsupported analysis"):
        t.analyze(staff, "astrology")
    with pytest.raises(ValueError, match="needs a target"):
        t.analyze(staff, "regression", ["age"])


def test_report_of_staff(staff, spark):
    report = t.build_report(staff, ["id"], classification_options=QUICK)
    info = by_column(report.tables["features"], "feature")
    assert (info["age"]["min"], info["age"]["max"], info["age"]["mean"]) == (28, 42, 34.6)
    assert (info["salary"]["min"], info["salary"]["max"], info["salary"]["mean"]) == (45000, 70000, 56000)
    summary = by_column(report.tables["summary"], "task")
    assert set(summary) == {
        "Regression (Linear Regression)", "Classification (Random Forest)", "Clustering (KMeans, k=3)"
    }
    assert all(r["status"] == "ok" for r in summary.values())
    assert summary["Regression (Linear Regression)"]["result"].startswith("RMSE: ")
    assert summary["Classification (Random Forest)"]["result"].endswith("%")
    assert report.tables["transformations"].count() == 3
    assert report.tables["findings"].count() == 3
    texts = by_column(formatted_features(report.tables["features"]), "feature")
    assert texts["age"]["mean"] == "34.6000"
    root = scratch_path(spark, "reports")
    paths = report.write(root, "staff")
    assert spark.read.parquet(paths["summary"]).count() == 3


def test_one_failing_model_does_not_stop_the_others(spark):
    df = spark.range(30).selectExpr("id AS a", "id * 2 AS b", "CASE WHEN id > 9 THEN 'x' ELSE 'y' END AS c")
    report = t.build_report(df, regression_options={"regParam": -1.0}, classification_options=QUICK)
    status = {r["task"].split(" ")[0]: r["status"] for r in report.tables["summary"].collect()}
    assert status == {"Regression": "failed", "Classification": "ok", "Clustering": "ok"}


def test_report_without_usable_columns(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    report = t.build_report(df)
    assert {r["status"] for r in report.tables["summary"].collect()} == {"skipped"}
    assert "No models" in report.tables["conclusions"].first()[0]


def test_report_of_rows_with_no_complete_features(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    report = t.build_report(df)
    results = {r["task"]: r["result"] for r in report.tables["summary"].collect()}
    assert results["Clustering"] == "Skipped: Cleaned data is empty."


def test_csv_types(spark, tmp_path):
    path = tmp_path / "staff.csv"
    path.write_text(
        "id,name,salary,hired,skills,trained\n"
        '1,John,75000.50,2022-06-15,"Python,SQL",true\n'
        '2,Sarah,65000.75,2023-01-10,"Marketing",false\n'
    )
    df = t.read(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema] == [
        "int", "string", "double", "date", "string", "boolean"
    ]
    assert df.filter("id = 1").first()["skills"] == "Python,SQL"
    declared = t.read(spark, str(path), schema="id bigint, name string, salary double, hired date, skills string, trained boolean")
    assert declared.schema["id"].dataType.simpleString() == "bigint"


def test_json_shapes(spark, tmp_path):
    records = [{"id": i, "skills": ["a", "b"], "salary": 1.5 * i} for i in range(5)]
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in records))
    (tmp_path / "array.json").write_text(json.dumps(records, indent=1))
    (tmp_path / "nested.json").write_text(
        json.dumps({"data": records, "metadata": {"total_records": 5}}, indent=1)
    )
    for df in (
        t.read(spark, str(tmp_path / "lines.json"), "json"),
        t.read_json_array(spark, str(tmp_path / "array.json")),
        t.read_nested_json(spark, str(tmp_path / "nested.json")),
    ):
        assert df.count() == 5 and df.schema["skills"].dataType.simpleString() == "array<string>"
    with pytest.raises(ValueError, match="rows"):
        t.read_nested_json(spark, str(tmp_path / "nested.json"), "rows")


def test_unknown_formats(spark, staff):
    with pytest.raises(ValueError, match="unsupported file format"):
        t.read(spark, "x", "xlsx")
    with pytest.raises(ValueError, match="write mode"):
        t.write_dataset(staff, "x", "y", mode="sideways")


def test_datasets_keep_types(spark):
    df = spark.sql("SELECT TIMESTAMP'2024-01-02 03:04:05' AS moment, CAST('NaN' AS DOUBLE) AS x")
    root = scratch_path(spark, "datasets")
    for _ in range(2):
        t.write_dataset(df, root, "d")
    back = t.read_dataset(spark, root, "d")
    assert back.schema == df.schema or [f.dataType for f in back.schema] == [f.dataType for f in df.schema]
    assert back.count() == 2
    t.write_dataset(df, root, "d", "overwrite")
    assert t.read_dataset(spark, root, "d").count() == 1


def test_json_rows_keep_nulls_and_nesting(spark):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, array(1, 2) AS c")
    assert json.loads(t.to_json_rows(df).first()["json"]) == {"a": 1, "b": None, "c": [1, 2]}


def test_json_rows_have_no_nan(spark):
    df = spark.sql("SELECT CAST('NaN' AS DOUBLE) AS a, CAST('Infinity' AS FLOAT) AS b, 1.5D AS c")
    assert json.loads(t.to_json_rows(df).first()["json"]) == {"a": None, "b": None, "c": 1.5}


def test_versions_replace_a_dataset_in_one_step(spark):
    root = scratch_path(spark, "datasets")
    with pytest.raises(ValueError, match="no published version"):
        t.read_version(spark, root, "d")
    t.write_version(spark.range(10), root, "d")
    before = t.read_version(spark, root, "d")
    t.write_version(before.filter("id < 4"), root, "d")
    assert t.read_version(spark, root, "d").count() == 4 and before.count() == 10
    broken = spark.range(5).selectExpr("if(id = 3, raise_error('no'), id) AS id")
    with pytest.raises(Exception, match="no"):
        t.write_version(broken, root, "d")
    assert t.read_version(spark, root, "d").count() == 4
    t.write_version(t.read_version(spark, root, "d").limit(0), root, "d")
    assert t.read_version(spark, root, "d").columns == ["id"]
    assert t.read_version(spark, root, "d").count() == 0


def test_datasets_in_other_formats(spark, staff):
    root = scratch_path(spark, "datasets")
    t.write_dataset(staff, root, "staff", fmt="csv", header=True)
    back = t.read_dataset(spark, root, "staff", "csv", header=True, inferSchema=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, staff.collect()))


def test_typed_rows(spark):
    schema = [
        {"name": "n", "original_type": "int"},
        {"name": "l", "original_type": "bigint"},
        {"name": "x", "original_type": "decimal(10,2)"},
        {"name": "b", "original_type": "boolean"},
        {"name": "u", "original_type": "mystery"},
        {"name": "gone", "original_type": "int"},
        {"name": "y", "original_type": "double", "is_target": True},
    ]
    df = spark.sql("SELECT '7' AS n, '9000000000' AS l, '1.5' AS x, 'TRUE' AS b, 4 AS u")
    row = t.cast_to_schema(df, schema).first()
    assert (row["n"], row["l"], row["x"], row["b"], row["u"]) == (7, 9000000000, 1.5, True, "4")
    assert row["_errors"] == ["missing required feature: gone"]
    with pytest.raises(ValueError, match="name and original_type"):
        t.cast_to_schema(df, [{"name": "n"}])
    numbers = spark.sql("SELECT 0 AS b UNION ALL SELECT 2")
    found = t.cast_to_schema(numbers, [{"name": "b", "original_type": "boolean"}]).collect()
    assert [r["b"] for r in found] == [False, True]


def test_union_matches_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, n int")
    assert sorted(tuple(r) for r in t.union_parts([a, b]).collect()) == [(1, "x"), (2, "y")]


def test_scatter_bins_cover_all_rows(spark):
    df = spark.range(1000).selectExpr("id AS x", "CASE WHEN id % 10 = 0 THEN NULL ELSE id * id END AS y")
    bins = t.scatter_bins(df, "x", "y", 7)
    assert sum(r["count"] for r in bins.collect()) == 900
    flat = t.scatter_bins(df.selectExpr("1 AS x", "2 AS y"), "x", "y", 7).collect()
    assert [(r["x_bin"], r["y_bin"], r["count"]) for r in flat] == [(0, 0, 1000)]


def test_plot_columns_are_checked(staff):
    with pytest.raises(ValueError, match="not numeric"):
        t.scatter_points(staff, "age", "name", ["id"])
    with pytest.raises(ValueError, match="box plot"):
        t.boxplot_stats(staff, ["name"])
    assert t.pairplot_points(staff, ["id"], n=3).count() == 3


def test_declared_schema_and_bad_values(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("a,b\n1,x\ntwo,y\n")
    read = t.read(spark, str(path), "csv", "a int, b string", corrupt="bad").collect()
    assert [(r["a"], r["b"], r["bad"]) for r in read] == [(1, "x", None), (None, "y", "two,y")]
    with pytest.raises(Exception, match="(?i)malformed"):
        t.read(spark, str(path), "csv", "a int, b string", strict=True).collect()
    with pytest.raises(ValueError):
        t.read(spark, str(path), "csv", strict=True)


def test_values_that_no_cast_reads(spark):
    rows = spark.sql("SELECT array(1) AS a, timestamp'2020-01-01' AS b, 5 AS c, 'x' AS d")
    schema = [{"name": n, "original_type": k} for n, k in (("a", "int"), ("b", "int"), ("c", "int"), ("d", "string"))]
    row = t.cast_to_schema(rows, schema).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == (None, None, 5, "x")
    assert len(row["_errors"]) == 2
