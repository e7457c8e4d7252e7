"""Turning one-row aggregates into long result tables, and small driver-side facts into tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablume.functions.columns import col

#: Aggregate expressions computed together. Wider tables are aggregated in several groups of
#: columns, each group reading only its own columns: no byte is read twice, and the generated code
#: of each group stays small enough to be compiled (beyond about fifty it runs several times slower).
AGGREGATES_TOGETHER = 48

FieldStat = Callable[[T.StructField], Column]


def chunks(items: Sequence, size: int) -> list[Sequence]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("no columns to work on")
    return reduce(DataFrame.unionByName, parts)


def per_column(
    df: DataFrame, fields: Sequence[T.StructField], stats: Mapping[str, FieldStat]
) -> DataFrame:
    """One row per column with the given aggregates, from a single pass over the table.

    Every aggregate is a plain declarative one with a constant-size buffer, so a task sends one
    row to the final merge however large the table is.
    """
    parts = []
    for group in chunks(fields, max(1, AGGREGATES_TOGETHER // len(stats))):
        wide = df.agg(
            *[
                stat(field).alias(f"{name}_{i}")
                for i, field in enumerate(group)
                for name, stat in stats.items()
            ]
        )
        rows = [
            F.struct(
                F.lit(field.name).alias("column"),
                *[F.col(f"{name}_{i}").alias(name) for name in stats],
            )
            for i, field in enumerate(group)
        ]
        parts.append(wide.select(F.inline(F.array(*rows))))
    return union_all(parts)


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A table of facts already on the driver (schema facts, model coefficients, statuses)."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def long_values(
    df: DataFrame,
    columns: Mapping[str, Column],
    keep: Sequence[str] = (),
    name: str = "column",
    value: str = "value",
) -> DataFrame:
    """Unpivot: one row per (kept columns, column name, value); all values share one type."""
    kept = [col(k) for k in keep]
    wide = df.select(*kept, *[expr.alias(label) for label, expr in columns.items()])
    return wide.unpivot(kept, [col(c) for c in columns], name, value)
