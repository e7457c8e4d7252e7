"""The tables behind plots."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.models import _LINE, _PREDICTED, _clusters, _line
from catalog.registry import gaps_sql, query, rounded, table, union_sql, with_gaps
from tablume.operators import plotdata

_ORDER = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"]
_SORTED = "ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_partkey LIMIT 1000"


@query("limit_sample", f"SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem {_SORTED}")
def limit_sample(spark, folder):
    sample = plotdata.limit_sample(table(spark, folder, "lineitem"), _ORDER)
    return sample.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query(
    "unpivot_numeric",
    union_sql(
        [
            f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM lineitem"
            for c in ("l_linenumber", "l_quantity", "l_discount")
        ]
    ),
)
def unpivot_numeric(spark, folder):
    return plotdata.unpivot_numeric(
        table(spark, folder, "lineitem"), ["l_linenumber", "l_quantity", "l_discount", "l_returnflag"]
    )


def _box_sql(source: str, column: str) -> str:
    x = f"CAST({column} AS DOUBLE)"
    return (
        f" SELECT '{column}' AS \"column\", round(min(q1), 4) AS q1, round(min(q2), 4) AS median, "
        f"round(min(q3), 4) AS q3, "
        f"min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS whisker_low, "
        f"max(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS whisker_high, "
        f"count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers "
        f"FROM (SELECT {x} AS x FROM {source}), (SELECT quantile_cont({x}, 0.25) AS q1, "
        f"quantile_cont({x}, 0.5) AS q2, quantile_cont({x}, 0.75) AS q3 FROM {source})"
    )


@query("boxplot_stats", union_sql([_box_sql("events", c) for c in ("value", "user_id")]))
def boxplot_stats(spark, folder):
    boxes = plotdata.boxplot_stats(table(spark, folder, "events"), ["value", "user_id"])
    return rounded(boxes, 4, "q1", "median", "q3")


@query(
    "boxplot_stats_gaps",
    gaps_sql("orders") + union_sql([_box_sql("t", c) for c in ("o_totalprice", "o_custkey")]),
)
def boxplot_stats_gaps(spark, folder):
    boxes = plotdata.boxplot_stats(
        with_gaps(spark, folder, "orders"), ["o_totalprice", "o_custkey", "o_orderstatus"]
    )
    return rounded(boxes, 4, "q1", "median", "q3")


@query("scatter_points", f"SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem {_SORTED}")
def scatter_points(spark, folder):
    return plotdata.scatter_points(
        table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", _ORDER
    )


@query(
    "scatter_bins",
    "WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, "
    "max(l_extendedprice) AS d FROM lineitem) SELECT x_bin, y_bin, round(min(a) + x_bin * "
    "((min(b) - min(a)) / 20), 6) AS x_lo, round(min(c) + y_bin * ((min(d) - min(c)) / 20), 6) AS y_lo, "
    'count(*) AS "count" FROM (SELECT a, b, c, d, '
    "least(CAST(floor((l_quantity - a) / (b - a) * 20) AS BIGINT), 19) AS x_bin, "
    "least(CAST(floor((l_extendedprice - c) / (d - c) * 20) AS BIGINT), 19) AS y_bin "
    "FROM lineitem, s) GROUP BY x_bin, y_bin",
)
def scatter_bins(spark, folder):
    bins = plotdata.scatter_bins(
        table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", 20
    )
    return rounded(bins, 6, "x_lo", "y_lo")


@query(
    "pairplot_points",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem " + _SORTED,
)
def pairplot_points(spark, folder):
    return plotdata.pairplot_points(table(spark, folder, "lineitem"), _ORDER)


@query(
    "actual_vs_predicted",
    _LINE
    + f" SELECT l_extendedprice AS actual, round({_PREDICTED}, 4) AS predicted FROM lineitem, f",
)
def actual_vs_predicted(spark, folder):
    return rounded(plotdata.actual_vs_predicted(_line(spark, folder)), 4, "predicted")


@query(
    "prediction_diagonal",
    _LINE
    + f" SELECT least(min(l_extendedprice), round(min({_PREDICTED}), 4)) AS low, "
    f"greatest(max(l_extendedprice), round(max({_PREDICTED}), 4)) AS high FROM lineitem, f",
)
def prediction_diagonal(spark, folder):
    trained = _line(spark, folder)
    points = trained.predictions().select(
        F.col("l_extendedprice").alias("actual"), F.col("prediction").alias("predicted")
    )
    return rounded(plotdata.diagonal(points), 4, "low", "high")


@query("cluster_points")
def cluster_points(spark, folder):
    trained = _clusters(spark, folder, ("l_quantity", "l_discount"), 3)
    return plotdata.cluster_points(trained)


@query(
    "cluster_point_totals",
    "SELECT 'point' AS kind, count(*) AS n, round(sum(l_quantity), 2) AS x, round(sum(l_discount), 2) AS y "
    "FROM lineitem UNION ALL SELECT 'center', 3, NULL, NULL",
)
def cluster_point_totals(spark, folder):
    """All rows are points; k centres stand beside them."""
    trained = _clusters(spark, folder, ("l_quantity", "l_discount"), 3)
    points = F.col("kind") == "point"
    return plotdata.cluster_points(trained).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.when(points, F.col("x"))), 2).alias("x"),
        F.round(F.sum(F.when(points, F.col("y"))), 2).alias("y"),
    )


@query(
    "hash_sample",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem "
    "ORDER BY md5('7' || chr(31) || l_orderkey || chr(31) || l_linenumber), l_orderkey, l_linenumber, "
    "l_quantity, l_extendedprice LIMIT 1000",
)
def hash_sample(spark, folder):
    lines = table(spark, folder, "lineitem")
    lines = lines.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return plotdata.hash_sample(lines, ["l_orderkey", "l_linenumber"], seed=7)
