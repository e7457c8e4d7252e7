"""Exact quantiles against NumPy, with sketches too small to hold the data."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablume import boxplot_stats, exact_quantiles, histogram, quantile_table

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def frame(spark, values, parts=4):
    rows = [(None if v is None else float(v),) for v in values]
    return spark.createDataFrame(rows, "x double").repartition(parts)


def shapes():
    rng = np.random.default_rng(7)
    heavy = np.exp(rng.normal(0, 6, 4000))
    one_third = np.where(rng.random(6000) < 1 / 3, 42.0, rng.normal(40, 5, 6000))
    return {
        "uniform": rng.random(5000),
        "heavy tail": heavy,
        "one value holds a third": one_third,
        "two values": np.repeat([1.0, 2.0], [700, 300]),
        "constant": np.full(500, 3.25),
        "one row": np.array([5.0]),
        "two rows": np.array([1.0, 2.0]),
        "negative and tiny": np.concatenate([rng.normal(0, 1e-12, 999), [-1e9, 1e9]]),
    }


@pytest.mark.parametrize("size", [4096, 128])
@pytest.mark.parametrize("name", list(shapes()))
def test_matches_numpy(spark, name, size):
    values = shapes()[name]
    found = exact_quantiles(frame(spark, values), ["x"], PROBABILITIES, size=size)["x"]
    assert np.allclose(found, np.quantile(values, PROBABILITIES), rtol=1e-12, atol=0)


def test_nulls_and_nans_do_not_count(spark):
    df = frame(spark, [3.0, None, float("nan"), 1.0, 2.0])
    assert exact_quantiles(df, ["x"], [0.0, 0.5, 1.0])["x"] == [1.0, 2.0, 3.0]


def test_no_values(spark):
    df = frame(spark, [None, float("nan")])
    assert exact_quantiles(df, ["x"], [0.5])["x"] == [None]
    assert quantile_table(df, ["x"], [0.5]).collect()[0]["value"] is None


def test_many_columns(spark):
    df = spark.range(1000).selectExpr(*[f"id * {i + 1} AS c{i}" for i in range(30)])
    found = exact_quantiles(df, df.columns, [0.5])
    assert found == {f"c{i}": [499.5 * (i + 1)] for i in range(30)}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=120))
def test_small_integers(spark, values):
    found = exact_quantiles(frame(spark, values, 3), ["x"], [0.25, 0.5, 0.9], size=32)["x"]
    assert np.allclose(found, np.quantile(values, [0.25, 0.5, 0.9]))


def numpy_bins(values):
    counts, edges = np.histogram(values, bins="auto")
    return [(i, e, f, int(c)) for i, (c, e, f) in enumerate(zip(counts, edges[:-1], edges[1:]))]


@pytest.mark.parametrize("name", ["uniform", "one value holds a third", "two values", "constant",
                                  "one row"])
def test_histogram_matches_numpy(spark, name):
    values = shapes()[name]
    found = sorted(
        (r["bin"], r["lo"], r["hi"], r["count"]) for r in histogram(frame(spark, values)).collect()
    )
    wanted = numpy_bins(values)
    assert [f[3] for f in found] == [w[3] for w in wanted]
    assert np.allclose([f[1:3] for f in found], [w[1:3] for w in wanted], rtol=1e-12)


def test_histogram_of_whole_numbers_never_splits_units(spark):
    values = np.random.default_rng(3).integers(0, 5, 400)
    df = spark.createDataFrame([(int(v),) for v in values], "x int")
    found = sorted((r["bin"], r["count"]) for r in histogram(df).collect())
    assert [c for _, c in found] == list(np.histogram(values, bins="auto")[0])


def test_histogram_without_values(spark):
    rows = histogram(frame(spark, [None])).collect()
    assert [(r["bin"], r["lo"], r["hi"], r["count"]) for r in rows] == [(0, 0.0, 1.0, 0)]


def test_histogram_needs_finite_range(spark):
    with pytest.raises(ValueError, match="finite"):
        histogram(frame(spark, [1.0, float("inf")]))


def test_boxplot_whiskers_are_values(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 100.0])
    row = boxplot_stats(df).first()
    assert (row["whisker_low"], row["whisker_high"], row["outliers"]) == (1.0, 5.0, 1)
    assert (row["q1"], row["median"], row["q3"]) == (2.25, 3.5, 4.75)


def test_tiny_sketches_end_and_long_integers_stay_exact(spark):
    rows = spark.range(1000).selectExpr("id * 2 + 9007199254740993 AS big")
    for size in (8, 64, 4096):
        found = exact_quantiles(rows, ["big"], [0.0, 0.5, 1.0], interpolate=False, size=size)
        assert found == {"big": [9007199254740993, 9007199254741991, 9007199254742991]}
    with pytest.raises(ValueError):
        exact_quantiles(rows, ["big"], [0.5], size=4)
