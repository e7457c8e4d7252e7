"""Scans, sinks and typed ingestion, each on files Spark writes from a given table first."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, table
from tablume.sources import readers, typed
from tablume.sources.scratch import scratch_path

_ORDER_COLUMNS = [
    "o_orderkey",
    "o_custkey",
    "o_orderstatus",
    "o_totalprice",
    "CAST(o_orderdate AS DATE) AS o_orderdate",
    "o_orderpriority",
]
#: Records per document where a format holds one document per file.
_DOCUMENT = 50_000


@query(
    "scan_csv",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
    "strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders",
)
def scan_csv(spark, folder):
    path = scratch_path(spark, "csv")
    table(spark, folder, "orders").selectExpr(*_ORDER_COLUMNS).write.csv(path, header=True)
    return readers.read(spark, path, "csv").select(
        F.col("o_orderkey").cast("bigint"),
        F.col("o_custkey").cast("bigint"),
        "o_orderstatus",
        "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        "o_orderpriority",
    )


@query(
    "scan_csv_bad_values",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END AS o_custkey, "
    "CASE WHEN o_orderkey % 7 = 0 THEN concat(o_orderkey, ',many') END AS bad FROM orders",
)
def scan_csv_bad_values(spark, folder):
    """A value that does not read as declared is NULL and its record is kept beside it."""
    path = scratch_path(spark, "csv")
    table(spark, folder, "orders").selectExpr(
        "o_orderkey", "if(o_orderkey % 7 = 0, 'many', string(o_custkey)) AS o_custkey"
    ).write.csv(path, header=True)
    return readers.read(
        spark, path, "csv", "o_orderkey bigint, o_custkey bigint", corrupt="bad"
    )


@query(
    "scan_json",
    "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, "
    "c_mktsegment FROM customer",
)
def scan_json(spark, folder):
    path = scratch_path(spark, "json")
    table(spark, folder, "customer").write.json(path)
    return readers.read(spark, path, "json").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"
    )


@query(
    "scan_parquet",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem "
    "WHERE l_discount >= 0.05",
)
def scan_parquet(spark, folder):
    lines = readers.read(spark, f"{folder}/lineitem.parquet", "parquet")
    return lines.filter("l_discount >= 0.05").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )


def _documents(spark, folder, document):
    """One JSON document per file; the unique key bounds how many records each one holds."""
    records = F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))
    path = scratch_path(spark, "documents")
    (
        table(spark, folder, "customer")
        .groupBy(F.floor(F.col("c_custkey") / _DOCUMENT))
        .agg(F.to_json(document(records)).alias("value"))
        .select("value")
        .write.option("maxRecordsPerFile", 1)
        .text(path)
    )
    return path


_CUSTOMER_RECORDS = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"


@query("scan_json_array", _CUSTOMER_RECORDS)
def scan_json_array(spark, folder):
    path = _documents(spark, folder, lambda records: records)
    return readers.read_json_array(spark, path).select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment"
    )


@query("scan_json_nested", _CUSTOMER_RECORDS)
def scan_json_nested(spark, folder):
    def wrapped(records):
        facts = F.struct(F.count(F.lit(1)).alias("total_records"), F.lit("1.0").alias("version"))
        return F.struct(records.alias("data"), facts.alias("metadata"))

    path = _documents(spark, folder, wrapped)
    return readers.read_nested_json(spark, path).select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment"
    )


@query("dataset_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def dataset_roundtrip(spark, folder):
    root = scratch_path(spark, "datasets")
    customers = table(spark, folder, "customer")
    readers.write_dataset(customers.filter("c_acctbal >= 0"), root, "customers")
    readers.write_dataset(customers.filter("c_acctbal < 0"), root, "customers")
    return readers.read_dataset(spark, root, "customers")


@query("dataset_overwrite", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def dataset_overwrite(spark, folder):
    root = scratch_path(spark, "datasets")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    readers.write_dataset(parts.select("p_partkey"), root, "parts", "overwrite")
    readers.write_dataset(parts, root, "parts", "overwrite")
    return readers.read_dataset(spark, root, "parts")


@query(
    "dataset_self_overwrite",
    "SELECT c_custkey, round(2 * c_acctbal, 2) AS c_acctbal FROM customer WHERE c_acctbal >= 0",
)
def dataset_self_overwrite(spark, folder):
    """A dataset is replaced by rows read from itself."""
    root = scratch_path(spark, "datasets")
    readers.write_version(table(spark, folder, "customer"), root, "customers")
    kept = readers.read_version(spark, root, "customers").filter("c_acctbal >= 0")
    readers.write_version(kept, root, "customers")
    again = readers.read_version(spark, root, "customers")
    doubled = again.select("c_custkey", F.round(2 * F.col("c_acctbal"), 2).alias("c_acctbal"))
    readers.write_version(doubled, root, "customers")
    return readers.read_version(spark, root, "customers")


_CAST_SCHEMA = [
    {"name": "nation", "original_type": "int", "is_target": False},
    {"name": "balance", "original_type": "double", "is_target": False},
    {"name": "segment", "original_type": "string", "is_target": False},
    {"name": "owes", "original_type": "boolean", "is_target": False},
    {"name": "label", "original_type": "double", "is_target": True},
]
_CAST_RAW = (
    "SELECT c_custkey, "
    "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN '3.7' "
    "ELSE CAST(c_nationkey AS VARCHAR(20)) END AS nation, "
    "CASE WHEN c_custkey % 11 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR(40)) END AS balance, "
    "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS segment, "
    "CASE WHEN c_acctbal < 0 THEN 'True' ELSE 'no' END AS owes FROM {customer}"
)


@query(
    "cast_to_schema",
    f"WITH raw AS ({_CAST_RAW.format(customer='customer')}), typed AS (SELECT *, "
    "CASE WHEN nation = '3.7' THEN NULL ELSE TRY_CAST(nation AS INTEGER) END AS nation_value, "
    "TRY_CAST(balance AS DOUBLE) AS balance_value FROM raw) "
    "SELECT c_custkey, nation_value AS nation, balance_value AS balance, segment, "
    "lower(owes) = 'true' AS owes, concat_ws('; ', "
    "CASE WHEN nation IS NULL THEN 'missing required feature: nation' "
    "WHEN nation_value IS NULL THEN 'invalid value for feature nation: expected int' END, "
    "CASE WHEN balance IS NULL THEN 'missing required feature: balance' "
    "WHEN balance_value IS NULL THEN 'invalid value for feature balance: expected double' END, "
    "CASE WHEN segment IS NULL THEN 'missing required feature: segment' END) AS errors FROM typed",
)
def cast_to_schema(spark, folder):
    raw = spark.sql(
        _CAST_RAW.format(customer="{customer}"), customer=table(spark, folder, "customer")
    )
    result = typed.cast_to_schema(raw, _CAST_SCHEMA, keep=["c_custkey"])
    return result.withColumn("errors", F.array_join(typed.ERRORS, "; ")).drop(typed.ERRORS)


@query(
    "to_json_rows",
    "SELECT '{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || "
    "'\",\"o_orderpriority\":' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' "
    "ELSE '\"' || o_orderpriority || '\"' END || '}' AS json FROM orders",
)
def to_json_rows(spark, folder):
    orders = table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        "o_orderstatus",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority",
    )
    return readers.to_json_rows(orders)


@query("union_parts", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def union_parts(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return readers.union_parts(
        [orders.filter(F.col("o_orderstatus") == s) for s in ("F", "O")]
        + [orders.filter(~F.col("o_orderstatus").isin("F", "O"))]
    )
