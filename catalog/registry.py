"""Registration of queries and their SQL, and the input tables they share.

The test tables hold no absent values. The ``*_GAPS`` selections blank out single *values* of
some rows (never rows) so that null handling is exercised; the same text runs in Spark and in
the checking engine.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CUSTOMER_GAPS = [
    "c_custkey",
    "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey",
    "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal",
    "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '' "
    "ELSE c_mktsegment END AS c_mktsegment",
]
ORDERS_GAPS = [
    "o_orderkey",
    "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey END AS o_custkey",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN CAST('NaN' AS DOUBLE) "
    "ELSE o_totalprice END AS o_totalprice",
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority",
    "o_orderstatus",
]


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` gives the same columns and rows."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_gaps(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(spark, folder, name).selectExpr(*GAPS[name])


GAPS = {"customer": CUSTOMER_GAPS, "orders": ORDERS_GAPS}


def gaps_sql(name: str, alias: str = "t") -> str:
    """The selection with gaps as a common table expression; NaN is turned into NULL there."""
    inner = f"SELECT {', '.join(GAPS[name])} FROM {name}"
    if name == "orders":
        inner = (
            "SELECT o_orderkey, o_custkey, CASE WHEN isnan(o_totalprice) THEN NULL "
            f"ELSE o_totalprice END AS o_totalprice, o_orderpriority, o_orderstatus FROM ({inner})"
        )
    return f"WITH {alias} AS ({inner})"


def union_sql(parts: Sequence[str]) -> str:
    return " UNION ALL ".join(parts)


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


def values_of(vector: Column, names: Sequence[str], places: int = 6) -> list[Column]:
    """The elements of an array column as columns."""
    return [F.round(F.get(vector, i), places).alias(n) for i, n in enumerate(names)]
