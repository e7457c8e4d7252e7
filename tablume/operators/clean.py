"""Cleaning: imputation, label filtering, z-scores and outliers.

Statistics are aggregated once, come back as one bounded row, and are applied as literals in a
map-only projection, so the table itself is never shuffled or collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablume.functions.columns import (
    as_double,
    col,
    fields_of,
    is_countable,
    is_numeric,
    is_null,
    numeric_columns,
    require_columns,
    require_numeric,
)
from tablume.functions.stats import percent, zscore
from tablume.functions.tables import per_column, small_table
from tablume.operators.profile import column_modes
from tablume.operators.quantiles import exact_quantiles

Names = Sequence[str] | None
STRATEGIES = ("mean", "median", "mode")
OUTLIER_METHODS = ("zscore",)


def impute_numeric(
    df: DataFrame, strategy: str = "mean", columns: Names = None
) -> DataFrame:
    """Fill numeric nulls and NaNs in place with the column's mean, median or mode.

    Columns keep their type, so a mean filled into a whole-number column is truncated. The
    median is an actual value (the lower of the two in the middle).
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unsupported strategy: {strategy!r}; use one of {', '.join(STRATEGIES)}")
    fields = fields_of(df, numeric_columns(df, columns))
    if not fields:
        return df
    fill = _fill_values(df, [f.name for f in fields], strategy)
    empty = [name for name, value in fill.items() if value is None]
    if empty:
        raise ValueError("no values to impute from in: " + ", ".join(empty))
    return df.withColumns(
        {
            f.name: F.when(is_null(f), F.lit(fill[f.name]).cast(f.dataType)).otherwise(col(f.name))
            for f in fields
        }
    )


def _fill_values(df: DataFrame, names: Sequence[str], strategy: str) -> dict:
    """Value per column, ``None`` where there is none; modes as text, so long integers stay exact."""
    if strategy == "median":
        return {n: v[0] for n, v in exact_quantiles(df, names, [0.5], interpolate=False).items()}
    if strategy == "mean":
        return {n: mean for n, (mean, _) in _moments(df, names).items()}
    found = {r["column"]: r["mode"] for r in column_modes(df, names).collect()}
    return {n: found.get(n) for n in names}


def impute_categorical(df: DataFrame, columns: Names = None) -> DataFrame:
    """Fill nulls of non-numeric columns with the column's most frequent value.

    All modes come from one pass that groups (column, value); a column holding nothing but
    nulls stays as it is.
    """
    fields = [
        f for f in fields_of(df, columns) if not is_numeric(f.dataType) and is_countable(f.dataType)
    ]
    if not fields:
        return df
    modes = {r["column"]: r["mode"] for r in column_modes(df, [f.name for f in fields]).collect()}
    filled = {
        f.name: F.coalesce(col(f.name), F.lit(modes[f.name]).cast(f.dataType))
        for f in fields
        if f.name in modes
    }
    return df.withColumns(filled) if filled else df


def impute(df: DataFrame, strategy: str = "mean") -> DataFrame:
    """Fill every column: numerics by ``strategy``, all others by their mode."""
    return impute_categorical(impute_numeric(df, strategy))


def drop_null_labels(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is present (neither NULL nor NaN)."""
    require_columns(df, [target])
    return df.filter(~is_null(df.schema[target]))


def label_drop_counts(df: DataFrame, target: str) -> DataFrame:
    """``(rows_before, rows_after, removed)`` of :func:`drop_null_labels`, in one aggregate."""
    require_columns(df, [target])
    absent = F.count_if(is_null(df.schema[target]))
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("rows_before"), (total - absent).alias("rows_after"), absent.alias("removed")
    )


def _moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    fields = require_numeric(df, columns)
    rows = per_column(
        df,
        fields,
        {"mean": lambda f: F.avg(as_double(f)), "std": lambda f: F.stddev_samp(as_double(f))},
    ).collect()
    return {r["column"]: (r["mean"], r["std"]) for r in rows}


def _scores(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    moments = _moments(df, columns)
    return {f.name: zscore(as_double(f), *moments[f.name]) for f in fields_of(df, columns)}


def add_zscores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<c>_zscore``, NULL where the value is absent or the column does not vary."""
    return df.withColumns({f"{n}_zscore": z for n, z in _scores(df, columns).items()})


def flag_outliers(
    df: DataFrame, columns: Sequence[str], method: str = "zscore", threshold: float = 3.0
) -> DataFrame:
    """Add boolean ``<c>_outlier``: is the value more than ``threshold`` deviations off the mean?"""
    if method not in OUTLIER_METHODS:
        return df
    return df.withColumns(
        {f"{n}_outlier": F.abs(z) > F.lit(threshold) for n, z in _scores(df, columns).items()}
    )


def detect_outliers(
    df: DataFrame, columns: Sequence[str], method: str = "zscore", threshold: float = 3.0
) -> DataFrame:
    """``(column, count, percentage)`` of outliers over all rows; other methods find nothing."""
    schema = "column string, count bigint, percentage double"
    if method not in OUTLIER_METHODS:
        return small_table(df.sparkSession, [], schema)
    scores = _scores(df, columns)
    flags = {n: F.abs(z) > F.lit(threshold) for n, z in scores.items()}
    return per_column(
        df,
        fields_of(df, columns),
        {
            "count": lambda f: F.count_if(flags[f.name]),
            "percentage": lambda f: percent(F.count_if(flags[f.name]), F.count(F.lit(1))),
        },
    )
