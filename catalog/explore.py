"""Exploration of chosen columns and advice on targets."""

from __future__ import annotations

from catalog.profile import _top_sql
from catalog.registry import gaps_sql, query, rounded, table, union_sql, with_gaps
from tablume.operators import explore
from tablume.plans import advise


@query(
    "project_features",
    "SELECT l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus FROM lineitem",
)
def project_features(spark, folder):
    return explore.project(
        table(spark, folder, "lineitem"), exclude=["l_orderkey", "l_shipdate"]
    )


def _describe_sql(table_name: str, column: str) -> str:
    quartiles = ", ".join(
        f"round(quantile_cont(CAST({column} AS DOUBLE), {p}), 4) AS p{int(p * 100)}"
        for p in (0.25, 0.5, 0.75)
    )
    return (
        f" SELECT '{column}' AS \"column\", CAST(min({column}) AS DOUBLE) AS \"min\", {quartiles}, "
        f"CAST(max({column}) AS DOUBLE) AS \"max\", round(avg({column}), 4) AS mean, "
        f"round(stddev_samp({column}), 4) AS std FROM {table_name}"
    )


_DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("explore_numeric", union_sql([_describe_sql("lineitem", c) for c in _DESCRIBED]))
def explore_numeric(spark, folder):
    described = explore.describe_numeric(table(spark, folder, "lineitem"), _DESCRIBED)
    return rounded(described, 4, "p25", "p50", "p75", "mean", "std")


@query(
    "explore_numeric_gaps",
    gaps_sql("orders") + union_sql([_describe_sql("t", c) for c in ("o_custkey", "o_totalprice")]),
)
def explore_numeric_gaps(spark, folder):
    described = explore.describe_numeric(
        with_gaps(spark, folder, "orders"), ["o_custkey", "o_totalprice"]
    )
    return rounded(described, 4, "p25", "p50", "p75", "mean", "std")


_CATEGORIES = ["o_orderpriority", "o_orderstatus", "o_orderdate"]


@query(
    "explore_categorical",
    union_sql([_top_sql("orders", c, 10, False) for c in _CATEGORIES]),
)
def explore_categorical(spark, folder):
    return explore.top_categories(table(spark, folder, "orders"))


_EVENTS = ["event_type", "user_id"]


@query("top_categories_events", union_sql([_top_sql("events", c, 10, False) for c in _EVENTS]))
def top_categories_events(spark, folder):
    return explore.top_categories(table(spark, folder, "events"), _EVENTS)


def _histogram_sql(source: str, column: str, whole: bool) -> str:
    width = "least(greatest(2 * (q3 - q1) * pow(n, -1.0 / 3.0), (hi - lo) / sqrt(n) / 2), (hi - lo) / (log2(n) + 1))"
    if whole:
        width = f"greatest({width}, 1.0)"
    edge = "lo + (i {plus}) * ((hi - lo) / bins)"
    return f"""
    SELECT '{column}' AS "column", i AS bin, round({edge.format(plus='')}, 6) AS lo,
           round(CASE WHEN i + 1 = bins THEN hi ELSE {edge.format(plus='+ 1')} END, 6) AS hi,
           coalesce(c, 0) AS "count"
    FROM (
      SELECT s.*, unnest(generate_series(CAST(0 AS BIGINT), bins - 1)) AS i
      FROM (SELECT *, CAST(ceil((hi - lo) / {width}) AS BIGINT) AS bins FROM (
        SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi,
               CAST(count({column}) AS DOUBLE) AS n,
               quantile_cont(CAST({column} AS DOUBLE), 0.25) AS q1,
               quantile_cont(CAST({column} AS DOUBLE), 0.75) AS q3 FROM {source})) s) e
    LEFT JOIN (
      SELECT CASE WHEN x < lo + g * ((hi - lo) / bins) THEN g - 1
                  WHEN g < bins - 1 AND x >= lo + (g + 1) * ((hi - lo) / bins) THEN g + 1
                  ELSE g END AS b, count(*) AS c
      FROM (SELECT x, lo, hi, bins, least(CAST(floor((x - lo) / (hi - lo) * bins) AS BIGINT), bins - 1) AS g
        FROM (SELECT CAST({column} AS DOUBLE) AS x FROM {source} WHERE {column} IS NOT NULL),
          (SELECT *, CAST(ceil((hi - lo) / {width}) AS BIGINT) AS bins FROM (
            SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi,
                   CAST(count({column}) AS DOUBLE) AS n,
                   quantile_cont(CAST({column} AS DOUBLE), 0.25) AS q1,
                   quantile_cont(CAST({column} AS DOUBLE), 0.75) AS q3 FROM {source})))
      GROUP BY 1) k ON k.b = e.i"""


_BINNED = {"l_quantity": False, "l_extendedprice": False, "l_suppkey": True}


@query(
    "histogram_auto",
    union_sql([_histogram_sql("lineitem", c, whole) for c, whole in _BINNED.items()]),
)
def histogram_auto(spark, folder):
    bins = explore.histogram(table(spark, folder, "lineitem"), list(_BINNED))
    return rounded(bins, 6, "lo", "hi")


@query(
    "histogram_gaps",
    gaps_sql("orders")
    + union_sql([_histogram_sql("t", "o_totalprice", False), _histogram_sql("t", "o_custkey", True)]),
)
def histogram_gaps(spark, folder):
    bins = explore.histogram(with_gaps(spark, folder, "orders"), ["o_totalprice", "o_custkey"])
    return rounded(bins, 6, "lo", "hi")


def _distinct_sql(source: str, column: str) -> str:
    return (
        f"(SELECT count(DISTINCT {column}) + max(CASE WHEN {column} IS NULL THEN 1 ELSE 0 END) "
        f"FROM {source})"
    )


def _suggest_sql(source: str, column: str, numeric: bool, categorical: bool) -> str:
    d = _distinct_sql(source, column)
    head = f" SELECT '{column}' AS \"column\", CAST(position AS INTEGER) AS position, suggestion FROM "
    if categorical:
        return head + "(SELECT 1 AS position, 'classification' AS suggestion)"
    if not numeric:
        return head + "(SELECT 1 AS position, 'exploratory' AS suggestion)"
    return (
        head + "(SELECT p AS position, CASE WHEN d > 1 AND d < 10 THEN "
        "CASE p WHEN 1 THEN 'classification' ELSE 'regression' END WHEN d >= 10 THEN 'regression' "
        f"ELSE 'exploratory' END AS suggestion FROM (SELECT {d} AS d), "
        "(SELECT unnest([1, 2]) AS p) WHERE p = 1 OR (d > 1 AND d < 10))"
    )


_ADVISED = {
    "l_orderkey": "numeric",
    "l_partkey": "numeric",
    "l_suppkey": "numeric",
    "l_linenumber": "numeric",
    "l_quantity": "numeric",
    "l_extendedprice": "numeric",
    "l_discount": "numeric",
    "l_tax": "numeric",
    "l_returnflag": "categorical",
    "l_linestatus": "categorical",
    "l_shipdate": "other",
}


@query(
    "suggest_analysis",
    union_sql(
        [
            _suggest_sql("lineitem", c, kind == "numeric", kind == "categorical")
            for c, kind in _ADVISED.items()
        ]
    ),
)
def suggest_analysis(spark, folder):
    return advise.suggest_analysis(table(spark, folder, "lineitem"))


def _first_sql(choices: list[tuple[str, str]], fallback: str) -> str:
    cases = " ".join(f"WHEN {test} THEN '{column}'" for column, test in choices)
    return f"CASE {cases} ELSE {fallback} END"


_PART = "(SELECT p_size % 4 AS p_class, p_size, p_retailprice, p_type, p_brand FROM part)"
_NUMBERS = ["p_class", "p_size", "p_retailprice"]


def _advised_parts(spark, folder):
    return table(spark, folder, "part").selectExpr(
        "p_size % 4 AS p_class", "p_size", "p_retailprice", "p_type", "p_brand"
    )


@query(
    "pick_regression_target",
    "SELECT "
    + _first_sql([(c, f"{_distinct_sql(_PART, c)} > 10") for c in _NUMBERS], "'p_class'")
    + " AS target",
)
def pick_regression_target(spark, folder):
    targets = advise.target_table(_advised_parts(spark, folder))
    return targets.filter("task = 'regression'").select("target")


@query(
    "pick_classification_target",
    "SELECT "
    + _first_sql(
        [
            (c, f"{_distinct_sql(_PART, c)} BETWEEN 2 AND 10")
            for c in ("p_type", "p_brand", *_NUMBERS)
        ],
        "NULL",
    )
    + " AS target",
)
def pick_classification_target(spark, folder):
    targets = advise.target_table(_advised_parts(spark, folder))
    return targets.filter("task = 'classification'").select("target")
