"""Scaling, indexing, one-hot, assembly, PCA and preparation for training."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.registry import gaps_sql, query, table, values_of, with_gaps
from tablume.operators import features as ops

_KEPT = "SELECT * FROM t WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL"
_COLUMNS = ["o_custkey", "o_totalprice"]


def _scaled(spark, folder, method):
    orders = with_gaps(spark, folder, "orders")
    scaled = ops.scale(orders, _COLUMNS, method)
    return scaled.select(
        "o_orderkey",
        *values_of(vector_to_array("scaled_features"), ["custkey_scaled", "price_scaled"]),
    )


def _standard(column: str) -> str:
    return f"({column} - (SELECT avg({column}) FROM k)) / (SELECT stddev_samp({column}) FROM k)"


def _minmax(column: str) -> str:
    low, high = f"(SELECT min({column}) FROM k)", f"(SELECT max({column}) FROM k)"
    return f"CAST({column} - {low} AS DOUBLE) / ({high} - {low})"


def _scaled_sql(rule) -> str:
    return (
        gaps_sql("orders")
        + f", k AS ({_KEPT}) SELECT o_orderkey, round({rule('o_custkey')}, 6) AS custkey_scaled, "
        f"round({rule('o_totalprice')}, 6) AS price_scaled FROM k"
    )


@query("scale_standard", _scaled_sql(_standard))
def scale_standard(spark, folder):
    return _scaled(spark, folder, "standard")


@query("scale_minmax", _scaled_sql(_minmax))
def scale_minmax(spark, folder):
    return _scaled(spark, folder, "minmax")


def _joined_index_sql(source_sql: str, key: str, column: str) -> str:
    return (
        f"{source_sql}, r AS (SELECT v, row_number() OVER (ORDER BY n DESC, v) - 1 AS i FROM "
        f"(SELECT CAST({column} AS VARCHAR) AS v, count(*) AS n FROM t WHERE {column} IS NOT NULL "
        f"GROUP BY 1)) SELECT {key}, CAST(coalesce(i, (SELECT count(*) FROM r)) AS DOUBLE) "
        f"AS {column}_indexed FROM t LEFT JOIN r ON v = CAST({column} AS VARCHAR)"
    )


@query("string_index", _joined_index_sql(gaps_sql("customer"), "c_custkey", "c_mktsegment"))
def string_index(spark, folder):
    customers = with_gaps(spark, folder, "customer")
    return ops.string_index(customers, ["c_mktsegment"]).select("c_custkey", "c_mktsegment_indexed")


@query("string_index_wide", _joined_index_sql(gaps_sql("orders"), "o_orderkey", "o_custkey"))
def string_index_wide(spark, folder):
    """The distributed numbering used when a dictionary is too wide for a fitted indexer."""
    orders = with_gaps(spark, folder, "orders").withColumn(
        "o_custkey", F.col("o_custkey").cast("string")
    )
    indexed = ops.string_index(orders, ["o_custkey"], max_labels=100)
    return indexed.select("o_orderkey", "o_custkey_indexed")


@query(
    "one_hot_wide",
    gaps_sql("orders")
    + ", r AS (SELECT v, row_number() OVER (ORDER BY n DESC, CAST(v AS VARCHAR)) - 1 AS i FROM "
    "(SELECT o_custkey AS v, count(*) AS n FROM t WHERE o_custkey IS NOT NULL GROUP BY 1)) "
    "SELECT o_orderkey, CAST((SELECT count(*) FROM r) AS INT) AS slots, i AS slot "
    "FROM t LEFT JOIN r ON v = o_custkey",
)
def one_hot_wide(spark, folder):
    """One slot for each label also where the dictionary is too wide for a model."""
    orders = with_gaps(spark, folder, "orders").withColumn(
        "o_custkey", F.col("o_custkey").cast("string")
    )
    encoded = ops.one_hot(orders, ["o_custkey"], max_labels=100)
    # the vector's own parts: as an array each row would have as many zeros as there are labels
    parts = F.unwrap_udt("o_custkey_encoded")
    place = F.array_position(parts["values"], F.lit(1.0))
    slot = F.when(place > 0, F.get(parts["indices"], (place - 1).cast("int"))).cast("bigint")
    return encoded.select("o_orderkey", parts["size"].alias("slots"), slot.alias("slot"))


@query(
    "prepare_ml_wide",
    gaps_sql("customer")
    + " SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_name) - 1 AS DOUBLE) AS c_name_indexed "
    "FROM t JOIN (SELECT c_custkey, c_name FROM customer) USING (c_custkey) "
    "WHERE c_acctbal IS NOT NULL",
)
def prepare_ml_wide(spark, folder):
    """Preparation numbers a feature of any width; here a name for each row."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    rows = with_gaps(spark, folder, "customer").join(customers, "c_custkey")
    prepared = ops.prepare(rows, ["c_name"], "c_acctbal", keep=["c_custkey"], max_labels=100)
    return prepared.df.select("c_custkey", "c_name_indexed")


@query(
    "prepare_ml_one_pass",
    gaps_sql("customer")
    + ", r AS (SELECT v, row_number() OVER (ORDER BY n DESC, v) - 1 AS i FROM (SELECT c_mktsegment AS v, "
    "count(*) AS n FROM t WHERE c_mktsegment IS NOT NULL GROUP BY 1)), l AS (SELECT c_custkey, "
    "row_number() OVER (ORDER BY c_name) - 1 AS label FROM customer) SELECT c_custkey, "
    "CAST(coalesce(i, (SELECT count(*) FROM r)) AS DOUBLE) AS c_mktsegment_indexed, "
    "CAST(label AS DOUBLE) AS label FROM t JOIN l USING (c_custkey) LEFT JOIN r ON v = c_mktsegment "
    "WHERE c_acctbal IS NOT NULL",
)
def prepare_ml_one_pass(spark, folder):
    """Dictionaries of all columns from one grouped count; here each row is a class of its own."""
    names = table(spark, folder, "customer").select("c_custkey", "c_name")
    rows = with_gaps(spark, folder, "customer").join(names, "c_custkey")
    prepared = ops.prepare(
        rows, ["c_mktsegment", "c_acctbal"], "c_name", keep=["c_custkey"], max_labels=100
    )
    _, vectors = ops.fit_features(prepared)
    return vectors.select("c_custkey", "c_mktsegment_indexed", F.col(ops.LABEL).alias("label"))


_SLOTS = [f"slot_{i}" for i in range(6)]


@query(
    "one_hot",
    "WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS p_type "
    "FROM part), r AS (SELECT v, row_number() OVER (ORDER BY n DESC, v) - 1 AS i FROM (SELECT "
    "p_type AS v, count(*) AS n FROM t WHERE p_type IS NOT NULL GROUP BY 1)) SELECT p_partkey, "
    + ", ".join(
        f"CAST(CASE WHEN i = {i} THEN 1 ELSE 0 END AS DOUBLE) AS {s}" for i, s in enumerate(_SLOTS)
    )
    + " FROM t LEFT JOIN r ON v = p_type",
)
def one_hot(spark, folder):
    parts = table(spark, folder, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS p_type"
    )
    encoded = ops.one_hot(parts, ["p_type"])
    return encoded.select("p_partkey", *values_of(vector_to_array("p_type_encoded"), _SLOTS))


@query(
    "assemble_features",
    gaps_sql("orders")
    + f" SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS first, o_totalprice AS second FROM ({_KEPT})",
)
def assemble_features(spark, folder):
    assembled = ops.assemble(with_gaps(spark, folder, "orders"), _COLUMNS)
    return assembled.select(
        "o_orderkey", *values_of(vector_to_array("features_vector"), ["first", "second"])
    )


@query(
    "prepare_ml",
    gaps_sql("customer")
    + ", l AS (SELECT * FROM t WHERE c_acctbal IS NOT NULL), r AS (SELECT v, row_number() OVER "
    "(ORDER BY n DESC, v) - 1 AS i FROM (SELECT c_mktsegment AS v, count(*) AS n FROM l "
    "WHERE c_mktsegment IS NOT NULL GROUP BY 1)), k AS (SELECT c_custkey, c_acctbal, "
    "CAST(c_nationkey AS DOUBLE) AS nation, CAST(coalesce(i, (SELECT count(*) FROM r)) AS DOUBLE) "
    "AS segment FROM l LEFT JOIN r ON v = c_mktsegment WHERE c_nationkey IS NOT NULL) "
    f"SELECT c_custkey, c_acctbal AS label, round({_standard('nation')}, 6) AS nation, "
    f"round({_standard('segment')}, 6) AS segment FROM k",
)
def prepare_ml(spark, folder):
    prepared = ops.prepare(
        with_gaps(spark, folder, "customer"),
        ["c_nationkey", "c_mktsegment"],
        "c_acctbal",
        keep=["c_custkey"],
    )
    _, transformed = ops.fit_features(prepared)
    return transformed.select(
        "c_custkey",
        F.col(ops.LABEL).alias("label"),
        *values_of(vector_to_array(ops.FEATURES), ["nation", "segment"]),
    )


_PCA_INPUT = "(SELECT l_quantity AS x, l_extendedprice / 1000 + l_quantity AS y FROM lineitem)"
_PCA_PARTS = (
    f"WITH m AS (SELECT var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM {_PCA_INPUT}), "
    "e AS (SELECT a, b, c, (a + b + sqrt((a - b) * (a - b) + 4 * c * c)) / 2 AS big, "
    "(a + b - sqrt((a - b) * (a - b) + 4 * c * c)) / 2 AS small FROM m)"
)


def _pca(spark, folder):
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_quantity AS x", "l_extendedprice / 1000 + l_quantity AS y"
    )
    return ops.pca(lines, ["x", "y"], 2)


@query(
    "pca_variance",
    _PCA_PARTS
    + " SELECT CAST(1 AS INTEGER) AS component, round(big / (big + small), 8) AS ratio FROM e UNION ALL "
    "SELECT CAST(2 AS INTEGER), round(small / (big + small), 8) FROM e",
)
def pca_variance(spark, folder):
    _, ratios = _pca(spark, folder)
    rows = [(i, ratio) for i, ratio in enumerate(ratios, start=1)]
    return spark.createDataFrame(rows, "component int, ratio double").withColumn(
        "ratio", F.round("ratio", 8)
    )


@query(
    "pca_project",
    _PCA_PARTS
    + ", d AS (SELECT c / sqrt(c * c + (big - a) * (big - a)) AS u, "
    "(big - a) / sqrt(c * c + (big - a) * (big - a)) AS w FROM e) "
    "SELECT l_orderkey, l_linenumber, round(abs(l_quantity * u + (l_extendedprice / 1000 + l_quantity) * w), 5) AS first, "
    "round(abs(l_quantity * w - (l_extendedprice / 1000 + l_quantity) * u), 5) AS second "
    "FROM lineitem, d",
)
def pca_project(spark, folder):
    """Absolute values, because the direction of a component's axis is arbitrary."""
    projected, _ = _pca(spark, folder)
    axes = vector_to_array("pca_features")
    return projected.select(
        "l_orderkey",
        "l_linenumber",
        F.round(F.abs(F.get(axes, 0)), 5).alias("first"),
        F.round(F.abs(F.get(axes, 1)), 5).alias("second"),
    )
