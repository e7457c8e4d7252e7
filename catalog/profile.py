"""Column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import gaps_sql, query, rounded, table, union_sql, with_gaps
from tablume.operators import profile
from tablume.plans.report import feature_info as build_feature_info

_LINE_NUMBERS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
]
_LINE_COLUMNS = [*_LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
_CUSTOMER = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]
_ORDERS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]


@query("table_shape", 'SELECT count(*) AS "rows", CAST(11 AS BIGINT) AS "columns" FROM lineitem')
def table_shape(spark, folder):
    return profile.table_shape(table(spark, folder, "lineitem"))


_TYPES = {
    "o_orderkey": ("bigint", "numeric"),
    "o_custkey": ("bigint", "numeric"),
    "o_totalprice": ("double", "numeric"),
    "o_orderpriority": ("string", "categorical"),
    "o_orderstatus": ("string", "categorical"),
}


@query(
    "column_types",
    gaps_sql("orders")
    + union_sql(
        [
            f" SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{t}' AS type, "
            f"'{k}' AS kind, count(*) - count({c}) AS null_count FROM t"
            for i, (c, (t, k)) in enumerate(_TYPES.items())
        ]
    ),
)
def column_types(spark, folder):
    orders = with_gaps(spark, folder, "orders")
    return profile.column_types(orders).join(profile.null_counts(orders), "column")


@query(
    "profile_nulls",
    gaps_sql("orders")
    + union_sql(
        [f" SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count FROM t" for c in _ORDERS]
    ),
)
def profile_nulls(spark, folder):
    return profile.null_counts(with_gaps(spark, folder, "orders"))


def _missing_sql(column: str) -> str:
    test = f"{column} IS NULL" + (f" OR {column} = ''" if column == "c_mktsegment" else "")
    count = f"count(*) FILTER (WHERE {test})"
    return (
        f" SELECT '{column}' AS \"column\", {count} AS missing_count, "
        f"round({count} * 100.0 / count(*), 6) AS missing_pct FROM t"
    )


@query("profile_missing", gaps_sql("customer") + union_sql([_missing_sql(c) for c in _CUSTOMER]))
def profile_missing(spark, folder):
    return rounded(profile.missing_counts(with_gaps(spark, folder, "customer")), 6, "missing_pct")


@query(
    "profile_distinct",
    union_sql(
        [
            f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM lineitem"
            for c in _LINE_COLUMNS
        ]
    ),
)
def profile_distinct(spark, folder):
    return profile.distinct_counts(table(spark, folder, "lineitem"))


@query(
    "distinct_with_null",
    gaps_sql("customer")
    + union_sql(
        [
            f" SELECT '{c}' AS \"column\", count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL "
            f"THEN 1 ELSE 0 END) AS distinct_count FROM t"
            for c in _CUSTOMER
        ]
    ),
)
def distinct_with_null(spark, folder):
    return profile.distinct_counts(with_gaps(spark, folder, "customer"), with_null=True)


def _sample_sql(column: str) -> str:
    return (
        f" SELECT * FROM (SELECT '{column}' AS \"column\", CAST(row_number() OVER "
        f"(ORDER BY c_custkey) AS INTEGER) AS position, CAST({column} AS VARCHAR) AS value "
        f"FROM t WHERE {column} IS NOT NULL) WHERE position <= 5"
    )


@query(
    "sample_values",
    gaps_sql("customer") + union_sql([_sample_sql(c) for c in _CUSTOMER]),
)
def sample_values(spark, folder):
    return profile.sample_values(with_gaps(spark, folder, "customer"), ["c_custkey"])


def _moments_sql(table_name: str, column: str) -> str:
    return (
        f" SELECT '{column}' AS \"column\", CAST(min({column}) AS DOUBLE) AS \"min\", "
        f"CAST(max({column}) AS DOUBLE) AS \"max\", round(avg({column}), 4) AS mean, "
        f"round(stddev_samp({column}), 4) AS std FROM {table_name}"
    )


@query("profile_numeric", union_sql([_moments_sql("lineitem", c) for c in _LINE_NUMBERS]))
def profile_numeric(spark, folder):
    return rounded(profile.numeric_profile(table(spark, folder, "lineitem")), 4, "mean", "std")


def _summary_sql(column: str) -> str:
    quartiles = ", ".join(
        f"CAST(quantile_disc({column}, {p}) AS DOUBLE) AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75)
    )
    return (
        f" SELECT '{column}' AS \"column\", count({column}) AS \"count\", "
        f"round(avg({column}), 4) AS mean, round(stddev_samp({column}), 4) AS stddev, "
        f"CAST(min({column}) AS DOUBLE) AS \"min\", {quartiles}, "
        f"CAST(max({column}) AS DOUBLE) AS \"max\" FROM t"
    )


@query(
    "numeric_summary",
    gaps_sql("orders") + union_sql([_summary_sql(c) for c in ("o_custkey", "o_totalprice")]),
)
def numeric_summary(spark, folder):
    orders = with_gaps(spark, folder, "orders")
    summary = profile.numeric_summary(orders, ["o_custkey", "o_totalprice"])
    return rounded(summary, 4, "mean", "stddev")


def _top_sql(source: str, column: str, k: int, nulls: bool, gate: int | None = None) -> str:
    rows = f"SELECT CAST({column} AS VARCHAR) AS value FROM {source}"
    if not nulls:
        rows += f" WHERE {column} IS NOT NULL"
    counted = f"SELECT value, count(*) AS n FROM ({rows}) GROUP BY value"
    few = f" AND (SELECT count(*) FROM ({counted})) <= {gate}" if gate else ""
    return (
        f" SELECT '{column}' AS \"column\", \"rank\", value, n AS \"count\" FROM (SELECT value, n, "
        f"CAST(row_number() OVER (ORDER BY n DESC, value NULLS LAST) AS INTEGER) AS \"rank\" "
        f"FROM ({counted})) WHERE \"rank\" <= {k}{few}"
    )


_TOP = ["o_orderpriority", "o_orderstatus", "o_orderkey"]


@query(
    "top_values_5",
    gaps_sql("orders") + union_sql([_top_sql("t", c, 5, True, 999) for c in _TOP]),
)
def top_values_5(spark, folder):
    return profile.top_values(
        with_gaps(spark, folder, "orders"), _TOP, k=5, with_nulls=True, max_distinct=999
    )


# nearly every line has a text of its own, but some are written often
_LINE_TEXTS = (
    "CASE WHEN l_orderkey % 9 < 3 THEN concat('often ', CAST(l_suppkey % 4 + l_orderkey % 9 AS VARCHAR(9))) "
    "ELSE concat('line ', CAST(l_orderkey AS VARCHAR(20)), ' of ', CAST(l_linenumber AS VARCHAR(9)), ' ', "
    "CAST(l_partkey AS VARCHAR(20))) END AS text, CAST(l_suppkey AS VARCHAR(20)) AS supplier, "
    "CASE WHEN l_linenumber < 3 THEN l_returnflag END AS flag"
)


def _wide_sql(column: str) -> str:
    return (
        f" SELECT '{column}' AS \"column\", CAST(i AS INTEGER) AS \"rank\", {column} AS \"value\", n AS \"count\" FROM "
        f"(SELECT {column}, n, row_number() OVER (ORDER BY n DESC, {column}) AS i FROM (SELECT {column}, "
        f"count(*) AS n FROM t WHERE {column} IS NOT NULL GROUP BY 1)) WHERE i <= 5"
    )


@query(
    "top_values_wide",
    f"WITH t AS (SELECT {_LINE_TEXTS} FROM lineitem)"
    + union_sql([_wide_sql(c) for c in ("text", "supplier", "flag")]),
)
def top_values_wide(spark, folder):
    lines = spark.sql(f"SELECT {_LINE_TEXTS} FROM {{lines}}", lines=table(spark, folder, "lineitem"))
    return profile.top_values_wide(lines, k=5)


def _mode_sql(column: str) -> str:
    return (
        f" SELECT '{column}' AS \"column\", CAST(v AS VARCHAR) AS \"mode\", n AS \"count\" FROM "
        f"(SELECT {column} AS v, count(*) AS n FROM t WHERE {column} IS NOT NULL "
        f"GROUP BY {column} ORDER BY n DESC, v LIMIT 1)"
    )


_MODES = ["c_nationkey", "c_mktsegment", "c_custkey"]


@query("column_mode", gaps_sql("customer") + union_sql([_mode_sql(c) for c in _MODES]))
def column_mode(spark, folder):
    return profile.column_modes(with_gaps(spark, folder, "customer"), _MODES)


_CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_fixed"]
_CORRELATED_INPUT = (
    "SELECT CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_quantity END AS l_quantity, "
    "l_extendedprice + 1000 * l_quantity AS l_extendedprice, "
    "CASE WHEN l_orderkey % 4 = 1 THEN NULL ELSE l_discount END AS l_discount, l_tax, "
    "CAST(1 AS DOUBLE) AS l_fixed FROM {lineitem}"
)


@query(
    "correlation_matrix",
    f"WITH t AS ({_CORRELATED_INPUT.format(lineitem='lineitem')})"
    + union_sql(
        [
            f" SELECT '{a}' AS x, '{b}' AS y, round(CASE WHEN min(l_fixed) = max(l_fixed) "
            f"AND 'l_fixed' IN ('{a}', '{b}') THEN NULL ELSE corr({a}, {b}) END, 8) AS r FROM t"
            for a in _CORRELATED
            for b in _CORRELATED
        ]
    ),
)
def correlation_matrix(spark, folder):
    lines = spark.sql(
        _CORRELATED_INPUT.format(lineitem="{lineitem}"), lineitem=table(spark, folder, "lineitem")
    )
    return rounded(profile.correlation_matrix(lines), 8, "r")


@query(
    "feature_info",
    union_sql(
        [
            f"SELECT '{c}' AS feature, round(CAST(min({c}) AS DOUBLE), 4) AS \"min\", "
            f"round(CAST(max({c}) AS DOUBLE), 4) AS \"max\", round(avg({c}), 4) AS mean "
            f"FROM lineitem"
            for c in _LINE_NUMBERS
        ]
    ),
)
def feature_info(spark, folder):
    return build_feature_info(table(spark, folder, "lineitem"))


_PROFILE_TYPES = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
    "l_returnflag": "string",
    "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}


def _profile_sql(position: int, column: str) -> str:
    dtype = _PROFILE_TYPES[column]
    number, moment = column in _LINE_NUMBERS, dtype.startswith("timestamp")
    kind = "numeric" if number else "temporal" if moment else "categorical"
    stats = {
        "min": f"min({column})",
        "max": f"max({column})",
        "mean": f"round(avg({column}), 4)",
        "std": f"round(stddev_samp({column}), 4)",
    }
    numbers = ", ".join(
        f"CAST({e if number else 'NULL'} AS DOUBLE) AS \"{n}\"" for n, e in stats.items()
    )
    ends = ", ".join(
        f"CAST({f'{f}({column})' if moment else 'NULL'} AS VARCHAR) AS \"{n}\""
        for n, f in (("first", "min"), ("last", "max"))
    )
    return (
        f"SELECT '{column}' AS \"column\", CAST({position} AS INTEGER) AS position, '{dtype}' AS type, "
        f"'{kind}' AS kind, count(*) AS row_count, count(*) - count({column}) AS null_count, "
        f"count(*) - count({column}) AS missing_count, CAST(0 AS DOUBLE) AS missing_pct, {numbers}, "
        f"{ends}, count(DISTINCT {column}) AS distinct_count FROM lineitem"
    )


@query("profile", union_sql([_profile_sql(i, c) for i, c in enumerate(_PROFILE_TYPES)]))
def profile_table(spark, folder):
    return rounded(profile.profile(table(spark, folder, "lineitem")), 4, "mean", "std")


_SUMMARY_TYPES = {
    "o_orderkey": ("bigint", "numeric"),
    "o_custkey": ("bigint", "numeric"),
    "o_orderpriority": ("string", "categorical"),
    "o_orderstatus": ("string", "categorical"),
    "o_orderdate": ("date", "temporal"),
}


def _data_summary_sql(position: int, column: str) -> str:
    dtype, kind = _SUMMARY_TYPES[column]
    absent = f"{column} IS NULL" + (f" OR {column} = ''" if kind == "categorical" else "")
    numbers = {n: "CAST(NULL AS DOUBLE)" for n in ("min", "max", "mean", "std")}
    if kind == "numeric":
        numbers = {
            "min": f"CAST(min({column}) AS DOUBLE)", "max": f"CAST(max({column}) AS DOUBLE)",
            "mean": f"round(avg({column}), 4)", "std": f"round(stddev_samp({column}), 4)",
        }
    ends = [f"CAST({f}({column}) AS VARCHAR)" if kind == "temporal" else "CAST(NULL AS VARCHAR)" for f in ("min", "max")]
    values = f"SELECT CAST({column} AS VARCHAR) AS v, o_orderkey AS k FROM t WHERE {column} IS NOT NULL"
    samples = f"(SELECT string_agg(v, '|' ORDER BY k) FROM (SELECT * FROM ({values}) ORDER BY k LIMIT 5))"
    top = (
        f"(SELECT string_agg(v || ':' || n, '|' ORDER BY n DESC, v) FROM (SELECT v, count(*) AS n "
        f"FROM ({values}) GROUP BY v ORDER BY n DESC, v LIMIT 10))"
    )
    return (
        f" SELECT CAST({position} AS INTEGER) AS position, '{column}' AS \"column\", '{dtype}' AS type, "
        f"'{kind}' AS kind, count(*) AS row_count, count(*) - count({column}) AS null_count, "
        f"count(*) FILTER (WHERE {absent}) AS missing_count, "
        f"round(count(*) FILTER (WHERE {absent}) * 100.0 / count(*), 6) AS missing_pct, "
        f"count(DISTINCT {column}) AS distinct_count, "
        + ", ".join(f'{sql} AS "{n}"' for n, sql in numbers.items())
        + f", {ends[0]} AS first, {ends[1]} AS last, coalesce({samples}, '') AS samples, "
        f"coalesce({top}, '') AS top_values FROM t"
    )


_SUMMARY_ROWS = (
    "o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey END AS o_custkey, "
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END "
    "AS o_orderpriority, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate"
)


@query(
    "data_summary",
    f"WITH t AS (SELECT {_SUMMARY_ROWS} FROM orders)"
    + union_sql([_data_summary_sql(i, c) for i, c in enumerate(_SUMMARY_TYPES)]),
)
def data_summary(spark, folder):
    orders = spark.sql(f"SELECT {_SUMMARY_ROWS} FROM {{orders}}", orders=table(spark, folder, "orders"))
    found = profile.data_summary(orders, order_by=["o_orderkey"])
    tops = F.transform("top_values", lambda v: F.concat(v["value"], F.lit(":"), v["count"].cast("string")))
    return rounded(found, 4, "mean", "std").withColumns(
        {
            "missing_pct": F.round("missing_pct", 6),
            "samples": F.array_join("samples", "|"),
            "top_values": F.array_join(tops, "|"),
        }
    )
