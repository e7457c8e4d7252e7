"""Exploration of chosen columns: describe, automatic histograms, top categories."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablume.functions.columns import (
    as_double,
    col,
    fields_of,
    is_countable,
    is_numeric,
    numeric_columns,
    require_numeric,
)
from tablume.functions.tables import long_values, small_table, union_all
from tablume.operators.profile import numeric_profile, top_values
from tablume.operators.quantiles import exact_quantiles, sized_quantiles

Names = Sequence[str] | None


def project(df: DataFrame, columns: Names = None, exclude: Sequence[str] = ()) -> DataFrame:
    """The chosen columns (default: all) without the excluded ones."""
    fields = fields_of(df, columns or None, exclude)
    if not fields:
        raise ValueError("no columns selected")
    return df.select(*[col(f.name) for f in fields])


_QUARTILES = [0.25, 0.5, 0.75]


def describe_numeric(df: DataFrame, columns: Names = None) -> DataFrame:
    """``(column, min, p25, p50, p75, max, mean, std)`` with exact interpolated quartiles.

    Decimals are searched as doubles, so those beyond 2^53 are as exact as a double is.
    """
    names = numeric_columns(df) if columns is None else list(columns)
    return _described(df, names, exact_quantiles(df, names, _QUARTILES))


def _described(df: DataFrame, names: Sequence[str], quartiles: dict[str, list[float | None]]) -> DataFrame:
    table = small_table(
        df.sparkSession,
        [(name, *quartiles[name]) for name in names],
        "column string, p25 double, p50 double, p75 double",
    )
    return numeric_profile(df, names).join(table, "column").select(
        "column", "min", "p25", "p50", "p75", "max", "mean", "std"
    )


def top_categories(df: DataFrame, columns: Names = None, k: int = 10) -> DataFrame:
    """``(column, rank, value, count)`` of non-numeric columns, nulls left out."""
    if columns is None:
        columns = [
            f.name for f in df.schema.fields if not is_numeric(f.dataType) and is_countable(f.dataType)
        ]
    return top_values(df, columns, k)


def bin_count(n: int, low: float, high: float, iqr: float, whole: bool) -> int:
    """How many equal bins the automatic rule uses for ``n`` values between ``low`` and ``high``.

    The width is the narrower of the Sturges width and the Freedman-Diaconis width, the latter
    never below half the square-root width; whole-number columns never use bins narrower than 1.
    """
    spread = high - low
    if n == 0 or spread == 0:
        return 1
    robust = max(2.0 * iqr * n ** (-1.0 / 3.0), spread / math.sqrt(n) / 2.0)
    width = min(robust, spread / (math.log2(n) + 1.0))
    if whole and width < 1.0:
        width = 1.0
    return max(math.ceil(spread / width), 1)


def histogram(
    df: DataFrame, columns: Names = None, bins: int | None = None
) -> DataFrame:
    """``(column, bin, lo, hi, count)`` with automatic bins, empty bins included.

    Two rounds: exact range and quartiles choose the bins, then one pass counts rows per
    (column, bin) with the edges as literals. All bins are half open but the last. Bins are
    generated by Spark, since a large spread can ask for up to ``2 * sqrt(rows)`` of them.
    """
    fields = require_numeric(df, numeric_columns(df) if columns is None else columns)
    if not fields:
        raise ValueError("no numeric columns for a histogram")
    return _histogram(df, fields, bins, *sized_quantiles(df, [f.name for f in fields], _MARKS))


#: The range and the quartiles.
_MARKS = [0.0, *_QUARTILES, 1.0]


def _histogram(
    df: DataFrame,
    fields: Sequence[T.StructField],
    bins: int | None,
    marks: dict[str, list[float | None]],
    sizes: dict[str, int],
) -> DataFrame:
    buckets, frames = {}, []
    for f in fields:
        low, q1, _, q3, high = marks[f.name]
        n = sizes[f.name]
        if n and not (math.isfinite(low) and math.isfinite(high)):
            raise ValueError(f"the range of {f.name!r} is not finite: [{low}, {high}]")
        if n == 0:
            low, high, count = 0.0, 1.0, bins or 1
        elif low == high:
            low, high, count = low - 0.5, high + 0.5, bins or 1
        else:
            whole = isinstance(f.dataType, T.IntegralType)
            count = bins or bin_count(n, low, high, q3 - q1, whole)
        buckets[f.name] = _bucket(as_double(f), low, high, count)
        frames.append(_bins(df, f.name, low, high, count))
    counted = (
        long_values(df, buckets, value="bin")
        .filter(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        union_all(frames)
        .join(counted, ["column", "bin"], "left")
        .select("column", "bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("count"))
    )


def _edge(index: Column, low: float, high: float, count: int) -> Column:
    step = (high - low) / count
    return F.when(index == count, F.lit(high)).otherwise(F.lit(low) + index * F.lit(step))


def _bucket(x: Column, low: float, high: float, count: int) -> Column:
    """Bin of a value; a first guess off by rounding is moved to agree with the printed edges."""
    guess = F.least(
        F.floor((x - F.lit(low)) / F.lit(high - low) * F.lit(count)), F.lit(count - 1).cast("bigint")
    )
    return (
        F.when(x.isNull(), None)
        .when(x < _edge(guess, low, high, count), guess - 1)
        .when((x >= _edge(guess + 1, low, high, count)) & (guess < count - 1), guess + 1)
        .otherwise(guess)
    )


def _bins(df: DataFrame, name: str, low: float, high: float, count: int) -> DataFrame:
    b = F.col("id")
    return df.sparkSession.range(count).select(
        F.lit(name).alias("column"),
        b.alias("bin"),
        _edge(b, low, high, count).alias("lo"),
        _edge(b + 1, low, high, count).alias("hi"),
    )


def explore(df: DataFrame, columns: Names = None) -> dict[str, DataFrame]:
    """All exploration tables for the chosen columns that apply to them."""
    chosen = project(df, columns)
    tables = {}
    if names := numeric_columns(chosen):
        # one search serves both
        marks, sizes = sized_quantiles(chosen, names, _MARKS)
        tables["numeric"] = _described(chosen, names, {n: m[1:4] for n, m in marks.items()})
        tables["histogram"] = _histogram(chosen, require_numeric(chosen, names), None, marks, sizes)
    if len(numeric_columns(chosen)) < len(chosen.columns):
        tables["categorical"] = top_categories(chosen)
    return tables
