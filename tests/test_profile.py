from __future__ import annotations

import datetime
import math
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

import tablume as t
import tablume.operators.profile as profile_module
from conftest import by_column


def test_summary_of_people(people):
    assert t.table_shape(people).first().asDict() == {"rows": 5, "columns": 5}
    profile = by_column(t.profile(people))
    assert profile["age"]["null_count"] == profile["salary"]["null_count"] == 1
    assert profile["name"]["null_count"] == profile["department"]["null_count"] == 1
    assert profile["department"]["distinct_count"] == 2
    assert profile["age"]["mean"] == 34.25
    assert math.isclose(profile["age"]["std"], 4.349329450233295)
    assert profile["name"]["mean"] is None and profile["name"]["kind"] == "categorical"


def test_distinct_with_and_without_null(people):
    plain = by_column(t.distinct_counts(people, ["department", "age"]))
    with_null = by_column(t.distinct_counts(people, ["department", "age"], with_null=True))
    assert (plain["department"]["distinct_count"], with_null["department"]["distinct_count"]) == (2, 3)
    assert (plain["age"]["distinct_count"], with_null["age"]["distinct_count"]) == (4, 5)


def test_approximate_distinct(spark):
    df = spark.range(5000).selectExpr("id", "CAST(NULL AS INT) AS nothing")
    rows = by_column(t.distinct_counts(df, approx=True, with_null=True))
    assert abs(rows["id"]["distinct_count"] - 5000) < 500
    assert rows["nothing"]["distinct_count"] == 1


def test_every_type_profiles_under_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    df = spark.sql(
        "SELECT * FROM VALUES "
        "(1Y, 1.5BD, CAST('NaN' AS DOUBLE), '', true, DATE'2024-01-02', "
        " TIMESTAMP'2024-01-02 03:04:05', array(1), X'AB'),"
        "(2Y, NULL, 0.0D, 'x', NULL, NULL, NULL, NULL, NULL),"
        "(2Y, 1.5BD, -0.0D, NULL, true, DATE'2023-01-02', NULL, array(2), X'AB') "
        "AS v(tiny, exact, real, text, flag, day, moment, list, raw)"
    )
    p = by_column(t.profile(df))
    assert p["real"]["null_count"] == 1 and p["real"]["distinct_count"] == 1
    assert (p["text"]["null_count"], p["text"]["missing_count"]) == (1, 2)
    assert p["list"]["distinct_count"] is None and p["list"]["null_count"] == 1
    assert p["raw"]["distinct_count"] == 1 and p["flag"]["distinct_count"] == 1
    assert (p["day"]["first"], p["day"]["last"]) == ("2023-01-02", "2024-01-02")
    assert p["exact"]["mean"] == 1.5 and p["tiny"]["max"] == 2.0


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, s string")
    p = by_column(t.profile(df))
    assert p["x"]["missing_pct"] is None and p["x"]["mean"] is None
    assert p["s"]["distinct_count"] == 0 and p["s"]["row_count"] == 0
    outliers = t.detect_outliers(df, ["x"]).first()
    assert outliers["count"] == 0 and outliers["percentage"] is None
    assert t.top_values(df).count() == 0


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None)], "`a.b` double, `c d``e` string")
    p = by_column(t.profile(df))
    assert p["a.b"]["mean"] == 1.5 and p["c d`e"]["null_count"] == 1
    assert by_column(t.describe_numeric(df))["a.b"]["p50"] == 1.5
    assert t.impute(df).filter("`c d``e` IS NULL").count() == 0


def test_wide_table_is_profiled_in_groups(spark):
    df = spark.range(10).selectExpr(*[f"id + {i} AS c{i}" for i in range(130)])
    rows = by_column(t.numeric_profile(df))
    assert len(rows) == 130 and rows["c129"]["min"] == 129.0


def test_top_values_ties_and_gate(spark):
    rows = [("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,), ("c",)]
    df = spark.createDataFrame(rows, "v string")
    with_null = [(r["value"], r["count"]) for r in t.top_values(df, k=3, with_nulls=True).orderBy("rank").collect()]
    assert with_null == [(None, 3), ("a", 2), ("b", 2)]
    assert t.top_values(df, max_distinct=3).count() == 0
    assert t.top_values(df, max_distinct=4).count() == 3


def test_few_distinct_is_exact_beyond_the_first_rows(spark):
    df = spark.range(0, 20000, 1, 1).selectExpr(
        "id", "CASE WHEN id < 19000 THEN 0 ELSE id END AS late", "id % 3 AS few",
        "CASE WHEN id = 19999 THEN NULL ELSE 1 END AS gap",
    )
    found = t.few_distinct(df, ["id", "late", "few", "gap"], 10)
    assert found == {"id": None, "late": None, "few": 3, "gap": 2}


def test_summary_quartiles_are_values(spark):
    df = spark.range(10001).selectExpr("id AS x")
    exact = t.numeric_summary(df).first()
    assert (exact["p25"], exact["p50"], exact["p75"], exact["count"]) == (2500, 5000, 7500, 10001)
    near = t.numeric_summary(df, approx=True).first()
    assert abs(near["p50"] - 5000) < 40 and near["p25"] == int(near["p25"])
    small = t.numeric_summary(spark.range(4).selectExpr("id AS x"), approx=True).first()
    assert (small["p25"], small["p50"], small["p75"]) == (0, 1, 2)


def test_sample_values_follow_the_row_order(spark):
    df = spark.createDataFrame([(3, "c"), (1, None), (2, "b"), (9, "z")], "k int, v string")
    rows = t.sample_values(df, ["k"], ["v"], k=2).orderBy("position").collect()
    assert [r["value"] for r in rows] == ["b", "c"]


def test_modes_ignore_nulls_and_take_the_smallest(spark):
    rows = [(10, "y", True), (9, "x", True), (10, "x", None), (9, "y", False), (None, None, None), (None, None, False)]
    df = spark.createDataFrame(rows, "n int, s string, b boolean")
    modes = by_column(t.column_modes(df, ["n", "s", "b"]))
    assert (modes["n"]["mode"], modes["s"]["mode"], modes["b"]["mode"]) == ("9", "x", "false")


def test_correlation_over_shared_rows(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, 4.5, 5.0), (3.0, 5.0, 5.0), (4.0, None, 5.0), (None, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, fixed double")
    r = {(x["x"], x["y"]): x["r"] for x in t.correlation_matrix(df).collect()}
    assert len(r) == 9
    wanted = df.select("a", "b", "fixed").toPandas().corr()
    assert math.isclose(r["a", "b"], wanted.loc["a", "b"], rel_tol=1e-12)
    assert r["a", "b"] == r["b", "a"] and r["a", "a"] == 1.0
    assert r["a", "fixed"] is None and r["fixed", "fixed"] is None


def test_correlation_of_many_columns(spark):
    df = spark.range(200).selectExpr(*[f"(id * {i + 3}) % {i + 11} AS c{i}" for i in range(14)])
    r = {(x["x"], x["y"]): x["r"] for x in t.correlation_matrix(df).collect()}
    wanted = df.toPandas().corr()
    assert len(r) == 14 * 14
    assert all(math.isclose(v, wanted.loc[k], rel_tol=1e-9, abs_tol=1e-12) for k, v in r.items())


def test_correlation_needs_two_columns(spark):
    with pytest.raises(ValueError, match="two numeric"):
        t.correlation_matrix(spark.createDataFrame([(1, "a")], "x int, s string"))


def test_unknown_column_is_named(people):
    with pytest.raises(ValueError, match="'nope'"):
        t.value_counts(people, ["nope"])


def test_hot_value_counts(spark):
    df = spark.range(0, 30000, 1, 6).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS v")
    top = t.top_values(df, k=2).orderBy("rank").collect()
    assert (top[0]["value"], top[0]["count"], top[1]["count"]) == ("hot", 10000, 1)
    assert t.distinct_counts(df).first()["distinct_count"] == 20001


def test_dates_print_in_top_values(spark):
    df = spark.createDataFrame([(datetime.date(2024, 1, 2),)], "d date")
    assert t.top_categories(df).first()["value"] == "2024-01-02"


def test_correlations_of_many_columns(spark):
    wide = spark.range(200).selectExpr(
        "id", "CASE WHEN id % 3 > 0 THEN id * id END AS gaps", "7.1 AS fixed",
        "CASE WHEN id = 5 THEN DOUBLE('Infinity') ELSE DOUBLE(id) END AS endless",
        *[f"CAST(id % {n + 2} AS DOUBLE) AS c{n}" for n in range(56)],
    )
    r = {(x["x"], x["y"]): x["r"] for x in t.correlation_matrix(wide).collect()}
    assert len(r) == 3600
    assert r["id", "fixed"] is None and r["fixed", "fixed"] is None and r["id", "endless"] is None
    for a, b in (("id", "gaps"), ("gaps", "c5"), ("c1", "c8")):
        assert r[a, b] == r[b, a]
        assert math.isclose(r[a, b], wide.select(F.corr(a, b)).first()[0], rel_tol=1e-9)


def test_data_summary_of_odd_columns(spark):
    rows = [
        (1, "a", None, "2024-01-01 00:00:00.5", [1], b"x"), (2, "", 1.5, "1969-12-31 23:59:59", None, None),
        (3, "a", float("nan"), None, [2], b"x"), (4, None, -2.0, "0001-01-01 00:00:00", [], b""),
    ]
    df = spark.createDataFrame(rows, "`a.b` long, s string, x double, t string, l array<int>, z binary")
    df = df.withColumns({"n": F.expr("CAST(t AS TIMESTAMP_NTZ)"), "d": F.expr("CAST(t AS DATE)"), "t": F.expr("CAST(t AS TIMESTAMP)")})
    got = by_column(t.data_summary(df, order_by=["a.b"], k=2, top=2, correlations=True))
    assert list(got) == ["a.b", "s", "x", "t", "l", "z", "n", "d"]
    assert got["s"]["null_count"] == 1 and got["s"]["missing_count"] == 2 and got["s"]["samples"] == ["a", ""]
    assert [tuple(v) for v in got["s"]["top_values"]] == [("a", 2), ("", 1)]
    assert got["x"]["null_count"] == 2 and got["x"]["distinct_count"] == 2 and got["x"]["max"] == 1.5
    assert got["t"]["first"] == got["n"]["first"] == "0001-01-01 00:00:00"
    assert got["t"]["last"] == got["n"]["last"] == "2024-01-01 00:00:00.5" and got["d"]["last"] == "2024-01-01"
    assert got["l"]["distinct_count"] is None and got["l"]["samples"] == [] and got["l"]["row_count"] == 4
    assert got["a.b"]["correlations"]["x"] == pytest.approx(-1.0) and got["s"]["correlations"] is None
    empty = by_column(t.data_summary(df.where("false")))
    assert {r["row_count"] for r in empty.values()} == {0} and empty["s"]["distinct_count"] == 0
    assert empty["x"]["mean"] is None and empty["x"]["samples"] == [] and empty["t"]["first"] is None
    assert t.data_summary(df.select("l")).first()["top_values"] == []


def test_scans_do_not_grow_with_the_columns(spark, tmp_path):
    wide = spark.range(50).select(*[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(60)])
    wide.write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))

    def scans(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        # what a reused exchange would have read is not read again
        return len(set(re.findall(r"FileScan[^\n]*\[(c0#\d+)", plan.split("== Initial Plan ==")[0])))

    assert scans(t.profile(wide)) <= 3 and scans(t.data_summary(wide, order_by=["c0", "c1"])) <= 3


def test_correlations_far_from_the_first_rows(spark):
    rng = np.random.default_rng(3)
    x = 1e9 + rng.normal(0, 1, 4000)
    y = x * 0.5 + rng.normal(0, 0.2, 4000)
    rows = [(None, float("nan"))] * 1500 + list(zip(x.tolist(), y.tolist()))
    df = spark.createDataFrame(rows, "x double, y double").coalesce(1)
    got = {(r.x, r.y): r.r for r in t.correlation_matrix(df).collect()}
    assert got["x", "y"] == pytest.approx(np.corrcoef(x - 1e9, y - 5e8)[0, 1], abs=1e-6)


def test_hash_sample(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("g"))
    one = {r.id for r in t.hash_sample(df.repartition(5), ["id"], 500, seed=1).collect()}
    assert one == {r.id for r in t.hash_sample(df.coalesce(1), ["id"], 500, seed=1).collect()}
    assert len(one) == 500 and 2200 < sum(one) / 500 < 2800
    assert one != {r.id for r in t.hash_sample(df, ["id"], 500, seed=2).collect()}
    points = t.scatter_points(df, "id", "g", ["id"], 50, seed=1).collect()
    assert {r.x for r in points} <= one and len(points) == 50
    with pytest.raises(ValueError):
        t.hash_sample(df, [])


def test_top_values_of_wide_columns(spark):
    """The same as counting every value, with frequent values, without any, and with ties."""
    df = spark.range(6000).selectExpr(
        "CASE WHEN id % 10 < 4 THEN concat('hot', id % 10) ELSE concat('v', id) END AS mixed",
        "CAST(id AS STRING) AS alone", "id % 3000 AS pairs", "CAST(NULL AS STRING) AS none",
        "CASE WHEN id < 3 THEN 'few' END AS few", "id % 7 / 2 AS halves",
    )
    for buckets in (1, 50, 4096):
        wanted = t.top_values(df, k=6).collect()
        assert sorted(t.top_values_wide(df, k=6, buckets=buckets).collect()) == sorted(wanted)
    assert t.top_values_wide(df.limit(0), ["mixed"]).count() == 0


def test_wide_columns_shuffle_few_values(spark):
    """Beside the buckets only values that share one with a frequent value are counted."""
    counted = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            counted.add(len(batch))
            yield batch

    df = spark.range(0, 40_000, 1, 4).selectExpr("if(id % 4 = 0, concat('hot', id % 80), concat('v', id)) AS v")
    original = profile_module._largest_in

    def watched(values, chosen, k):
        buckets = F.broadcast(chosen.select("column", "bucket"))
        values.join(buckets, ["column", "bucket"], "left_semi").select("value").distinct().mapInPandas(
            seen, "value string"
        ).count()
        return original(values, chosen, k)

    profile_module._largest_in = watched
    try:
        assert t.top_values_wide(df, k=10).select("count").distinct().first()[0] == 500
    finally:
        profile_module._largest_in = original
    assert counted.value < 1000  # of 30,020 different values
