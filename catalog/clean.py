"""Imputation, label filtering, z-scores and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import gaps_sql, query, rounded, table, union_sql, with_gaps
from tablume.operators import clean
from tablume.operators.features import LABEL, prepare
from tablume.operators.profile import column_modes


@query(
    "label_cast",
    gaps_sql("orders")
    + " SELECT o_orderkey, o_totalprice, o_custkey, CAST(o_custkey AS DOUBLE) AS label FROM t "
    "WHERE o_custkey IS NOT NULL",
)
def label_cast(spark, folder):
    orders = with_gaps(spark, folder, "orders").withColumn(
        "o_totalprice", F.when(~F.isnan("o_totalprice"), F.col("o_totalprice"))
    )
    prepared = prepare(orders, ["o_totalprice"], "o_custkey", keep=["o_orderkey"])
    return prepared.df.withColumnRenamed(LABEL, "label")


@query(
    "drop_null_labels",
    gaps_sql("orders")
    + " SELECT o_orderkey, o_orderstatus, o_totalprice FROM t WHERE o_totalprice IS NOT NULL",
)
def drop_null_labels(spark, folder):
    kept = clean.drop_null_labels(with_gaps(spark, folder, "orders"), "o_totalprice")
    return kept.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "label_drop_counts",
    gaps_sql("orders")
    + " SELECT count(*) AS rows_before, count(o_totalprice) AS rows_after, "
    "count(*) - count(o_totalprice) AS removed FROM t",
)
def label_drop_counts(spark, folder):
    return clean.label_drop_counts(with_gaps(spark, folder, "orders"), "o_totalprice")


_Z = "abs((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events))"


@query(
    "outlier_rows",
    f"SELECT event_id, value, {_Z} > 3 AS value_outlier FROM events",
)
def outlier_rows(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    return clean.flag_outliers(events, ["value"])


def _outlier_sql(source: str, column: str, threshold: float) -> str:
    x = f"CAST({column} AS DOUBLE)"
    z = f"abs(({x} - (SELECT avg({x}) FROM {source})) / (SELECT stddev_samp({x}) FROM {source}))"
    count = f"count(*) FILTER (WHERE {z} > {threshold})"
    return (
        f" SELECT '{column}' AS \"column\", {count} AS \"count\", "
        f"round({count} * 100.0 / count(*), 6) AS percentage FROM {source}"
    )


_OUTLIERS = ["l_quantity", "l_extendedprice", "l_tax"]


@query("outlier_counts", union_sql([_outlier_sql("lineitem", c, 1.5) for c in _OUTLIERS]))
def outlier_counts(spark, folder):
    lines = table(spark, folder, "lineitem")
    return rounded(clean.detect_outliers(lines, _OUTLIERS, threshold=1.5), 6, "percentage")


@query(
    "outlier_counts_gaps",
    gaps_sql("orders")
    + union_sql([_outlier_sql("t", c, 1.6) for c in ("o_totalprice", "o_custkey")]),
)
def outlier_counts_gaps(spark, folder):
    found = clean.detect_outliers(
        with_gaps(spark, folder, "orders"), ["o_totalprice", "o_custkey"], threshold=1.6
    )
    return rounded(found, 6, "percentage")


@query(
    "zscore",
    gaps_sql("orders")
    + " SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM t)) / "
    "(SELECT stddev_samp(o_totalprice) FROM t), 6) AS o_totalprice_zscore FROM t",
)
def zscore(spark, folder):
    orders = with_gaps(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    scored = clean.add_zscores(orders, ["o_totalprice"])
    return rounded(scored, 6, "o_totalprice_zscore").drop("o_totalprice")


_IMPUTED = ["o_custkey", "o_totalprice"]


def _imputed(spark, folder, strategy):
    orders = with_gaps(spark, folder, "orders").select("o_orderkey", *_IMPUTED)
    filled = clean.impute_numeric(orders, strategy, _IMPUTED)
    return rounded(filled, 4, "o_totalprice")


@query(
    "impute_mean",
    gaps_sql("orders")
    + " SELECT o_orderkey, coalesce(o_custkey, CAST(trunc((SELECT avg(o_custkey) FROM t)) AS BIGINT)) "
    "AS o_custkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM t)), 4) "
    "AS o_totalprice FROM t",
)
def impute_mean(spark, folder):
    return _imputed(spark, folder, "mean")


@query(
    "impute_median",
    gaps_sql("orders")
    + " SELECT o_orderkey, coalesce(o_custkey, (SELECT quantile_disc(o_custkey, 0.5) FROM t)) "
    "AS o_custkey, round(coalesce(o_totalprice, (SELECT quantile_disc(o_totalprice, 0.5) FROM t)), 4) "
    "AS o_totalprice FROM t",
)
def impute_median(spark, folder):
    return _imputed(spark, folder, "median")


_LONG = (
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey * 2 + 9007199254740993 END AS big, "
    "9007199254740992 - o_custkey % 3 AS few FROM {orders}"
)


@query(
    "impute_median_bigint",
    f"WITH t AS ({_LONG.format(orders='orders')}) "
    "SELECT o_orderkey, coalesce(big, (SELECT quantile_disc(big, 0.5) FROM t)) AS big FROM t",
)
def impute_median_bigint(spark, folder):
    """Long whole numbers stay exact where doubles would not."""
    rows = spark.sql(_LONG.format(orders="{orders}"), orders=table(spark, folder, "orders"))
    return clean.impute_numeric(rows, "median", ["big"]).select("o_orderkey", "big")


@query(
    "column_mode_bigint",
    f"WITH t AS ({_LONG.format(orders='orders')}), n AS (SELECT 'few' AS c, few AS v, count(*) AS k "
    "FROM t GROUP BY few UNION ALL SELECT 'big', big, count(*) FROM t WHERE big IS NOT NULL GROUP BY big) "
    "SELECT c AS \"column\", CAST(v AS VARCHAR) AS mode, k AS \"count\" FROM n "
    "QUALIFY row_number() OVER (PARTITION BY c ORDER BY k DESC, v) = 1",
)
def column_mode_bigint(spark, folder):
    rows = spark.sql(_LONG.format(orders="{orders}"), orders=table(spark, folder, "orders"))
    return column_modes(rows, ["big", "few"])


def _mode(column: str) -> str:
    return (
        f"(SELECT {column} FROM t WHERE {column} IS NOT NULL GROUP BY {column} "
        f"ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


@query(
    "impute_mode",
    gaps_sql("orders")
    + f" SELECT o_orderkey, coalesce(o_custkey, {_mode('o_custkey')}) AS o_custkey, "
    f"round(coalesce(o_totalprice, {_mode('o_totalprice')}), 4) AS o_totalprice FROM t",
)
def impute_mode(spark, folder):
    return _imputed(spark, folder, "mode")


@query(
    "impute_categorical",
    gaps_sql("customer")
    + f" SELECT c_custkey, coalesce(c_mktsegment, {_mode('c_mktsegment')}) AS c_mktsegment FROM t",
)
def impute_categorical(spark, folder):
    customers = with_gaps(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return clean.impute_categorical(customers)
