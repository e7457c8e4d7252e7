"""Column profiles of a whole table: shape, types, nulls, distincts, moments, top values, r.

Everything that fits a constant-size buffer is computed together in one aggregate over the
table. Only distinct counts and top values shuffle, and then only one row per distinct value and
task, because Spark combines equal values before the exchange; a hot value therefore costs no
more than a rare one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablume.functions.columns import (
    as_double,
    as_key,
    as_text,
    col,
    fields_of,
    is_countable,
    is_floating,
    is_missing,
    is_null,
    is_numeric,
    kind_of,
    numeric_columns,
    quoted,
    require_columns,
    require_numeric,
)
from tablume.functions.sketches import SKETCH_SIZE, quantile_sketches
from tablume.functions.stats import percent
from tablume.functions.tables import chunks, long_values, per_column, small_table, union_all
from tablume.operators.quantiles import exact_quantiles
from tablume.sources.scratch import cut_lineage

#: Hash buckets of a column in :func:`top_values_wide`, columns handled together (their buckets are
#: broadcast), and how many of the fullest buckets are counted first.
VALUE_BUCKETS, COLUMNS_BUCKETED, BUCKETS_FIRST = 65_536, 8, 64

Names = Sequence[str] | None


def table_shape(df: DataFrame) -> DataFrame:
    """``(rows, columns)``: only row counts are read, no column data."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns")
    )


def column_types(df: DataFrame, columns: Names = None) -> DataFrame:
    """``(position, column, type, kind)`` from the schema alone."""
    fields = fields_of(df, columns)
    rows = [(i, f.name, f.dataType.simpleString(), kind_of(f.dataType)) for i, f in enumerate(fields)]
    return small_table(
        df.sparkSession, rows, "position int, column string, type string, kind string"
    )


def null_counts(df: DataFrame, columns: Names = None) -> DataFrame:
    """``(column, null_count)`` with NULL and NaN counted."""
    return per_column(
        df, fields_of(df, columns), {"null_count": lambda f: F.count_if(is_null(f))}
    )


def missing_counts(df: DataFrame, columns: Names = None) -> DataFrame:
    """``(column, missing_count, missing_pct)``; empty strings are missing too."""
    return per_column(
        df,
        fields_of(df, columns),
        {
            "missing_count": lambda f: F.count_if(is_missing(f)),
            "missing_pct": lambda f: percent(F.count_if(is_missing(f)), F.count(F.lit(1))),
        },
    )


def numeric_profile(df: DataFrame, columns: Names = None) -> DataFrame:
    """``(column, min, max, mean, std)`` of numeric columns; std is the sample one."""
    fields = require_numeric(df, numeric_columns(df) if columns is None else columns)
    return per_column(
        df,
        fields,
        {
            "min": lambda f: F.min(as_double(f)),
            "max": lambda f: F.max(as_double(f)),
            "mean": lambda f: F.avg(as_double(f)),
            "std": lambda f: F.stddev_samp(as_double(f)),
        },
    )


def numeric_summary(
    df: DataFrame, columns: Names = None, approx: bool = False, sketch_size: int = SKETCH_SIZE
) -> DataFrame:
    """``summary()`` in long form: count, mean, stddev, min, quartiles, max.

    The quartiles are actual values, not interpolated. ``approx`` reads them off one sketch, whose
    4096 values put their ranks within 0.2 % of the rows, and saves the passes that settle them.
    """
    fields = require_numeric(df, numeric_columns(df) if columns is None else columns)
    moments = per_column(
        df,
        fields,
        {
            "count": lambda f: F.count(as_double(f)),
            "mean": lambda f: F.avg(as_double(f)),
            "stddev": lambda f: F.stddev_samp(as_double(f)),
            "min": lambda f: F.min(as_double(f)),
            "max": lambda f: F.max(as_double(f)),
        },
    )
    ranks = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    if approx:
        quartiles = quantile_sketches(df, fields, ranks, size=sketch_size)
    else:
        found = exact_quantiles(
            df, [f.name for f in fields], list(ranks.values()), interpolate=False
        )
        quartiles = small_table(
            df.sparkSession,
            [(name, *[None if v is None else float(v) for v in values]) for name, values in found.items()],
            "column string, p25 double, p50 double, p75 double",
        )
    return moments.join(quartiles, "column").select(
        "column", "count", "mean", "stddev", "min", "p25", "p50", "p75", "max"
    )


_KEY_FORMS = ("bigint", "double", "string")


def _distinct_keys(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """``(column, distinct_count, distinct_with_null)`` for columns that occur.

    One scan: every value becomes a narrow typed key beside its column's number, and tasks pass on
    one row for each distinct key.
    """
    parts, used = [], set()
    for i, f in enumerate(fields):
        form, key = as_key(f)
        used.add(form)
        parts.append((i, form, key))
    forms = [form for form in _KEY_FORMS if form in used]
    structs = [
        F.struct(
            F.lit(i).alias("i"),
            *[(key if form == own else F.lit(None)).cast(form).alias(form) for form in forms],
        )
        for i, own, key in parts
    ]
    names = F.element_at(F.array(*[F.lit(f.name) for f in fields]), F.col("i") + 1)
    present = reduce(lambda a, b: a | b, [F.col(form).isNotNull() for form in forms])
    return (
        df.select(F.explode(F.array(*structs)).alias("k"))
        .select("k.*")
        .distinct()
        .groupBy("i")
        .agg(F.count_if(present).alias("distinct_count"), F.count(F.lit(1)).alias("distinct_with_null"))
        .select(names.alias("column"), "distinct_count", "distinct_with_null")
    )


def distinct_counts(
    df: DataFrame,
    columns: Names = None,
    with_null: bool = False,
    approx: bool = False,
    rsd: float = 0.02,
) -> DataFrame:
    """``(column, distinct_count)``; nested columns, which cannot be grouped, get NULL.

    ``with_null`` counts NULL as one more value. ``approx`` replaces the exchange of distinct
    values by a constant-size sketch with relative error ``rsd``.
    """
    fields = fields_of(df, columns)
    usable = [f for f in fields if is_countable(f.dataType)]
    if approx:
        counts = per_column(
            df,
            usable,
            {
                "distinct_count": lambda f: F.approx_count_distinct(as_key(f)[1], rsd)
                + (F.max(is_null(f).cast("int")) if with_null else F.lit(0)),
            },
        )
    else:
        wanted = "distinct_with_null" if with_null else "distinct_count"
        counts = _distinct_keys(df, usable).select("column", F.col(wanted).alias("distinct_count"))
    names = small_table(
        df.sparkSession,
        [(f.name, is_countable(f.dataType)) for f in fields],
        "column string, countable boolean",
    )
    filled = F.when(F.col("countable"), F.coalesce("distinct_count", F.lit(0)))
    return names.join(counts, "column", "left").select(
        "column", filled.cast("bigint").alias("distinct_count")
    )


def few_distinct(
    df: DataFrame, columns: Sequence[str], limit: int, with_null: bool = True
) -> dict[str, int | None]:
    """Distinct count of each column where it is at most ``limit``, else ``None``; exact.

    A few first rows are looked at before anything is shuffled: a column showing more than
    ``limit`` values there is settled, since the whole table cannot hold fewer. Identifier and
    free-text columns drop out this way, and only the rest are counted over the whole table.
    """
    fields = [f for f in fields_of(df, columns) if is_countable(f.dataType)]
    answer: dict[str, int | None] = {f.name: None for f in fields_of(df, columns)}
    if not fields:
        return answer
    keys = [as_key(f)[1] for f in fields]
    first = df.select(
        *[F.when(k.isNotNull(), F.xxhash64(k)).alias(f"k{i}") for i, k in enumerate(keys)]
    ).take(20 * limit + 100)
    open_ = [
        f
        for i, f in enumerate(fields)
        if len({r[i] for r in first if with_null or r[i] is not None}) <= limit
    ]
    if open_:
        counts = distinct_counts(df, [f.name for f in open_], with_null=with_null).collect()
        for r in counts:
            if r["distinct_count"] <= limit:
                answer[r["column"]] = r["distinct_count"]
    return answer


def value_counts(df: DataFrame, columns: Sequence[str], with_nulls: bool = False) -> DataFrame:
    """``(column, value, count)``: how often each printed value occurs in each column."""
    fields = fields_of(df, columns)
    nested = [f.name for f in fields if not is_countable(f.dataType)]
    if nested:
        raise ValueError("values cannot be counted in: " + ", ".join(nested))
    values = long_values(df, {f.name: as_text(f) for f in fields})
    if not with_nulls:
        values = values.filter(F.col("value").isNotNull())
    return values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(
    df: DataFrame,
    columns: Names = None,
    k: int = 10,
    with_nulls: bool = False,
    max_distinct: int | None = None,
) -> DataFrame:
    """``(column, rank, value, count)``: the ``k`` most frequent values, ties by value.

    With ``max_distinct`` only columns holding at most that many values (NULL included) are
    listed. Ranking keeps ``k`` rows per column and task before its exchange.
    """
    fields = [f for f in fields_of(df, columns) if is_countable(f.dataType)]
    names = [f.name for f in fields]
    if max_distinct is not None:
        few = few_distinct(df, names, max_distinct)
        names = [n for n in names if few[n] is not None]
    if not names:
        return small_table(
            df.sparkSession, [], "column string, rank int, value string, count bigint"
        )
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc_nulls_last("value"))
    return (
        value_counts(df, names, with_nulls)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("column", "rank", "value", "count")
    )


def top_values_wide(
    df: DataFrame, columns: Names = None, k: int = 10, buckets: int = VALUE_BUCKETS
) -> DataFrame:
    """:func:`top_values` without NULL, for columns that hold very many different values.

    Counting every value shuffles a row for each. Here a first read counts hash buckets, at most
    ``buckets`` narrow rows a column and task. A second counts the values of the fullest buckets, which
    gives a count that the last of the ``k`` has at least; no value of a bucket with fewer rows can be
    among them, so a third read counts the values of the other buckets only. The result is exact. Where
    the ``k`` largest counts stand out that is few values; where no value is frequent all buckets
    remain and :func:`top_values` does the same with fewer reads.
    """
    names = [f.name for f in fields_of(df, columns) if is_countable(f.dataType)]
    if not names:
        return top_values(df, names, k)
    parts = [_top_of_buckets(df, group, k, buckets) for group in chunks(names, COLUMNS_BUCKETED)]
    return union_all(parts)


def _top_of_buckets(df: DataFrame, names: Sequence[str], k: int, buckets: int) -> DataFrame:
    values = long_values(df, {f.name: as_text(f) for f in fields_of(df, names)})
    bucket = F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int").alias("bucket")
    values = values.filter(F.col("value").isNotNull()).select("column", "value", bucket)
    sums = cut_lineage(values.groupBy("column", "bucket").agg(F.count(F.lit(1)).alias("n")))
    fullest = Window.partitionBy("column").orderBy(F.desc("n"), "bucket")
    first = sums.withColumn("place", F.row_number().over(fullest)).filter(
        F.col("place") <= BUCKETS_FIRST + k
    )
    known = _largest_in(values, first, k)
    least = known.groupBy("column").agg(
        F.when(F.count(F.lit(1)) == k, F.min("count")).otherwise(0).alias("least")
    )
    # a row a bucket at most, however large the table is
    open_ = sums.join(F.broadcast(least), "column").filter(F.col("n") >= F.col("least"))
    return _largest_in(values, open_, k)


def _largest_in(values: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values of each column within the chosen buckets."""
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return (
        values.join(F.broadcast(chosen.select("column", "bucket")), ["column", "bucket"], "left_semi")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("column", "rank", "value", "count")
    )


def column_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, mode, count)``: most frequent non-null value, the smallest on a tie.

    Numeric ties compare as numbers. All-null columns give no row.
    """
    fields = fields_of(df, columns)
    whole = [f.name for f in fields if isinstance(f.dataType, (T.IntegralType, T.DecimalType))]
    floating = [f.name for f in fields if is_floating(f.dataType)]

    def number(names, kind):
        value = F.col("value").try_cast(kind)
        return F.when(F.col("column").isin(names), value) if names else F.lit(None).cast(kind)

    rank = F.struct(
        (-F.col("count")).alias("n"),
        number(whole, "decimal(38,18)" if any_scale(fields) else "decimal(38,0)").alias("whole"),
        number(floating, "double").alias("number"),
        F.col("value").alias("text"),
    )
    return (
        value_counts(df, [f.name for f in fields])
        .groupBy("column")
        .agg(F.min_by("value", rank).alias("mode"), F.max("count").alias("count"))
    )


def any_scale(fields: Sequence[T.StructField]) -> bool:
    """Whether a decimal among the columns has places after the point."""
    return any(isinstance(f.dataType, T.DecimalType) and f.dataType.scale for f in fields)


def sample_values(
    df: DataFrame, order_by: Sequence[str], columns: Names = None, k: int = 5
) -> DataFrame:
    """``(column, position, value)``: the first ``k`` non-null values in the given row order.

    One scan: the columns are put on top of each other, and each task passes on ``k`` rows a
    column at most.
    """
    require_columns(df, order_by)
    fields = [f for f in fields_of(df, columns) if is_countable(f.dataType)]
    if not fields:
        raise ValueError("no columns to sample")
    keys = [f"_k{i}" for i in range(len(order_by))]
    keyed = df.withColumns({k: col(o) for k, o in zip(keys, order_by)})
    values = long_values(keyed, {f.name: as_text(f) for f in fields}, keep=keys)
    order = Window.partitionBy("column").orderBy(*keys, "value")
    return (
        values.filter(F.col("value").isNotNull())
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= k)
        .select("column", "position", "value")
    )


#: Share of a column's squares below which its spread is rounding noise.
_NOISE = 1e-13
#: Squares about the trial centres may be so many times those about the means; else one more scan.
_FAR = 1e4
_FIRST_ROWS = 1000


def correlation_matrix(df: DataFrame, columns: Names = None) -> DataFrame:
    """``(x, y, r)`` for every ordered pair of numeric columns, over rows where both are present.

    One scan whatever the number of columns: tasks multiply batches of rows, taken about centres
    found in the first rows, and sum the products in one matrix each. Where a column turns out to
    lie far from its centre, a second scan uses the means. Columns have slots for presence and
    squares only in batches in which they have gaps. A column that does not vary, or holds an
    infinity, has NULL correlations. Fewer than two numeric columns is an error.
    """
    fields = require_numeric(df, numeric_columns(df) if columns is None else columns)
    if len(fields) < 2:
        raise ValueError("a correlation matrix needs at least two numeric columns")
    p = len(fields)
    values = df.select(*[as_double(f).alias(f"v{i}") for i, f in enumerate(fields)])
    first = np.array([list(r) for r in values.take(_FIRST_ROWS)], float).reshape(-1, p)
    first[~np.isfinite(first)] = np.nan
    seen = np.isfinite(first).sum(axis=0)
    centre = np.divide(np.nansum(first, axis=0), seen, out=np.zeros(p), where=seen > 0)
    sums = _product_sums(values, centre)
    n, total, squares = np.diag(sums.n), np.diag(sums.x), np.diag(sums.xx)
    shift = np.divide(total, n, out=np.zeros(p), where=n > 0)
    if np.any(squares > _FAR * np.maximum(squares - n * shift**2, 0)):
        sums = _product_sums(values, centre + shift)
    r = _correlations(sums)
    rows = [
        (a.name, b.name, None if np.isnan(r[i, j]) else float(r[i, j]))
        for i, a in enumerate(fields)
        for j, b in enumerate(fields)
    ]
    return small_table(df.sparkSession, rows, "x string, y string, r double")


@dataclass
class _Sums:
    """Over the rows that have both columns: their number, the sum and the squares of the first
    column's deviations and the products of both's. ``varies`` tells the columns with two values
    or more and no infinity."""

    n: np.ndarray
    x: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    varies: np.ndarray


def _product_sums(values: DataFrame, centre: np.ndarray) -> _Sums:
    p = len(centre)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, x, xx, xy = (np.zeros((p, p)) for _ in range(4))
        low, high = np.full(p, np.inf), np.full(p, -np.inf)
        for batch in batches:
            rows = np.empty((batch.num_rows, p))
            for i in range(p):
                rows[:, i] = batch.column(i).to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore"):
                low, high = np.fmin(low, np.fmin.reduce(rows, initial=np.inf)), np.fmax(
                    high, np.fmax.reduce(rows, initial=-np.inf)
                )
                there = np.isfinite(rows)
                rows -= centre
            rows[~there] = 0.0
            gaps = np.flatnonzero(~there.all(axis=0))
            xy += rows.T @ rows
            total, squares = rows.sum(axis=0), (rows * rows).sum(axis=0)
            n += len(rows)
            x += total[:, None]
            xx += squares[:, None]
            if len(gaps):
                # what is counted where the other column has a gap
                absent = (~there[:, gaps]).astype(float)
                x[:, gaps] -= rows.T @ absent
                xx[:, gaps] -= (rows * rows).T @ absent
                share = absent.T @ absent
                here = absent.sum(axis=0)
                n[gaps, :] -= here[:, None]
                n[:, gaps] -= here[None, :]
                n[np.ix_(gaps, gaps)] += share
        for i in range(p):
            yield pa.RecordBatch.from_pydict(
                {
                    "i": pa.array([i], pa.int32()),
                    "v": pa.array([np.concatenate([n[i], x[i], xx[i], xy[i]])], pa.list_(pa.float64())),
                    "low": pa.array([low[i]]),
                    "high": pa.array([high[i]]),
                }
            )

    found = (
        values.mapInArrow(multiply, "i int, v array<double>, low double, high double")
        .groupBy("i")
        .agg(Summarizer.sum(array_to_vector("v")).alias("v"), F.min("low").alias("low"), F.max("high").alias("high"))
        .collect()
    )
    n, x, xx, xy = (np.zeros((p, p)) for _ in range(4))
    varies = np.zeros(p, bool)
    for r in found:
        i, parts = r["i"], r["v"].toArray().reshape(4, p)
        n[i], x[i], xx[i], xy[i] = parts
        varies[i] = np.isfinite(r["low"]) and np.isfinite(r["high"]) and r["low"] < r["high"]
    return _Sums(n, x, xx, xy, varies)


def _correlations(s: _Sums) -> np.ndarray:
    """Pairwise correlations; NaN where a column does not vary over the rows that a pair shares."""
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = s.xx - s.x * s.x / s.n
        flat = ~(spread > _NOISE * s.xx)
        both = (s.xy - s.x * s.x.T / s.n) / np.sqrt(spread * spread.T)
    both[flat | flat.T | ~s.varies[:, None] | ~s.varies[None, :]] = np.nan
    np.fill_diagonal(both, np.where(s.varies, 1.0, np.nan))
    return np.clip(both, -1.0, 1.0)


def profile(df: DataFrame, columns: Names = None, approx_distinct: bool = False) -> DataFrame:
    """The whole column profile, one row per column in schema order, from two scans at any width
    (three where whole numbers or dates are dense enough to be counted in bitmaps).

    ``first`` and ``last`` print the range of date and timestamp columns; ``min`` to ``std``
    belong to numeric ones.
    """
    fields = fields_of(df, columns)
    facts = column_facts(df, fields)
    counts = distinct_counts(df, [f.name for f in fields], approx=approx_distinct)
    return facts.join(counts, "column").orderBy("position").select(
        "column", "position", "type", "kind", "row_count", "null_count", "missing_count", "min", "max",
        "mean", "std", "first", "last", "missing_pct", "distinct_count",
    )


def column_facts(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """Types, counts of rows, nulls and missing values, and moments or ranges of all columns.

    Every value becomes one struct of the same type, whatever its column, and one grouped aggregate
    over the column's number keeps them apart. So one scan does for any number of columns, and the
    generated code doesn't grow with them; tasks send one row a column.
    """
    parts = []
    for i, f in enumerate(fields):
        null, number, whole = is_null(f), F.lit(None).cast("double"), F.lit(None).cast("bigint")
        if is_numeric(f.dataType):
            number = as_double(f)
        elif kind_of(f.dataType) == "temporal":
            whole = _ticks(f)
        parts.append(
            F.struct(
                F.lit(i).alias("position"), null.alias("null"), is_missing(f).alias("missing"),
                number.alias("x"), whole.alias("t"),
            )
        )
    stats = (
        df.select(F.explode(F.array(*parts)).alias("v"))
        .select("v.*")
        .groupBy("position")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_if("null").alias("null_count"),
            F.count_if("missing").alias("missing_count"),
            F.min("x").alias("min"),
            F.max("x").alias("max"),
            F.avg("x").alias("mean"),
            F.stddev_samp("x").alias("std"),
            F.min("t").alias("low"),
            F.max("t").alias("high"),
        )
    )
    shown = {
        name: F.coalesce(
            F.lit(None).cast("string"),
            *[
                F.when(F.col("position") == i, _tick_text(f, F.col(ticks)))
                for i, f in enumerate(fields)
                if kind_of(f.dataType) == "temporal"
            ],
        )
        for name, ticks in (("first", "low"), ("last", "high"))
    }
    zero = F.lit(0).cast("bigint")
    counts = {n: F.coalesce(F.col(n), zero) for n in ("row_count", "null_count", "missing_count")}
    return (
        column_types(df, [f.name for f in fields])
        .join(stats, "position", "left")
        .withColumns(counts | shown)
        .withColumn("missing_pct", percent(F.col("missing_count"), F.col("row_count")))
        .drop("low", "high")
    )


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _ticks(field: T.StructField) -> Column:
    """A date's days, a timestamp's microseconds since 1970."""
    if isinstance(field.dataType, T.DateType):
        return F.unix_date(col(field.name)).cast("bigint")
    if isinstance(field.dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, {quoted(field.name)})")
    return F.unix_micros(col(field.name))


def _tick_text(field: T.StructField, ticks: Column) -> Column:
    if isinstance(field.dataType, T.DateType):
        return F.date_from_unix_date(ticks.cast("int")).cast("string")
    if isinstance(field.dataType, T.TimestampNTZType):
        interval = F.make_dt_interval(secs=(ticks.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))
        return (F.expr(_EPOCH) + interval).cast("string")
    return F.timestamp_micros(ticks).cast("string")


def data_summary(
    df: DataFrame,
    columns: Names = None,
    order_by: Sequence[str] | None = None,
    k: int = 5,
    top: int = 10,
    correlations: bool = False,
) -> DataFrame:
    """One row per column in schema order with everything a first look asks for.

    ``column, position, type, kind, row_count, null_count, missing_count, missing_pct, min, max,
    mean, std, first, last`` as in :func:`profile`, ``distinct_count`` (NULL left out; NULL for
    nested columns), ``samples`` (the first ``k`` present values in the order of ``order_by``, else
    of the input), ``top_values`` (the ``top`` most frequent present values with their counts, ties
    by value) and, if asked for, ``correlations`` with every other numeric column by name.

    Three scans at any width: facts, values (distinct counts and top values come out of one
    exchange) and samples; correlations take one or two more.
    """
    fields = fields_of(df, columns)
    countable = [f for f in fields if is_countable(f.dataType)]
    out = column_facts(df, fields)
    if countable:
        names = [f.name for f in countable]
        values = value_counts(df, names)
        # both read the same counts, so that they share one exchange
        distinct = (
            values.groupBy("column")
            .agg(F.count(F.lit(1)).alias("distinct_count"), F.sum("count").alias("present"))
            .where("present > 0")
        )
        order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
        entry = F.struct("rank", "value", "count")
        tops = (
            values.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= top)
            .groupBy("column")
            .agg(F.sort_array(F.collect_list(entry)).alias("top_values"))
        )
        ordered = df if order_by else df.withColumn("_row", F.monotonically_increasing_id())
        samples = (
            sample_values(ordered, order_by or ["_row"], names, k)
            .groupBy("column")
            .agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("samples"))
        )
        out = (
            out.join(distinct.drop("present"), "column", "left")
            .join(tops, "column", "left")
            .join(samples, "column", "left")
        )
    else:
        nothing = {"distinct_count": "bigint", "top_values": "array<struct<rank:int,value:string,count:bigint>>",
                   "samples": "array<struct<position:int,value:string>>"}
        out = out.withColumns({n: F.lit(None).cast(t) for n, t in nothing.items()})
    known = F.col("column").isin([f.name for f in countable])
    pair = "transform(top_values, t -> named_struct('value', t.value, 'count', t.count))"
    out = out.withColumns(
        {
            "distinct_count": F.when(known, F.coalesce("distinct_count", F.lit(0).cast("bigint"))),
            "samples": F.coalesce(F.col("samples")["value"], F.array().cast("array<string>")),
            "top_values": F.coalesce(F.expr(pair), F.array().cast("array<struct<value:string,count:bigint>>")),
        }
    )
    chosen = [
        "column", "position", "type", "kind", "row_count", "null_count", "missing_count", "missing_pct",
        "distinct_count", "min", "max", "mean", "std", "first", "last", "samples", "top_values",
    ]
    numeric = [f.name for f in fields if is_numeric(f.dataType)]
    if correlations and len(numeric) > 1:
        with_others = (
            correlation_matrix(df, numeric)
            .where("x != y")
            .groupBy(F.col("x").alias("column"))
            .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("y", "r")))).alias("correlations"))
        )
        out, chosen = out.join(with_others, "column", "left"), [*chosen, "correlations"]
    return out.orderBy("position").select(*chosen)
