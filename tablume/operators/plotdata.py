"""The tables behind plots.

Summaries and model plots cover the whole table; samples are bounded top-k rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablume.functions.columns import (
    as_double,
    col,
    fields_of,
    is_numeric,
    kind_of,
    numeric_columns,
    require_columns,
    require_numeric,
)
from tablume.functions.tables import long_values, per_column, small_table
from tablume.operators.features import LABEL, PREDICTION
from tablume.operators.models import Trained
from tablume.operators.quantiles import exact_quantiles

PLOT_POINTS = 1000
PAIRPLOT_COLUMNS = 5


def limit_sample(df: DataFrame, order_by: Sequence[str], n: int = PLOT_POINTS) -> DataFrame:
    """The first ``n`` rows in the given order: a bounded top-k, not a sort of the table."""
    require_columns(df, order_by)
    return df.orderBy(*[col(o) for o in order_by]).limit(n)


def hash_sample(
    df: DataFrame, key: Sequence[str], n: int = PLOT_POINTS, seed: int = 42
) -> DataFrame:
    """``n`` rows of the whole table, the same ones however it is stored or split.

    Rows are ranked by a hash of the columns ``key`` and the seed, and the ``n`` smallest are kept:
    every set of ``n`` different keys is as likely as any other, and only ``n`` rows a task are
    held. Rows of equal keys follow each other by the other columns; nulls hash like any value.
    """
    require_columns(df, key)
    if not key:
        raise ValueError("a sample needs columns that tell rows apart")
    name = "_rank"
    while name in df.columns:
        name = f"_{name}"
    text = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("\x00")) for k in key])
    others = [
        col(f.name) for f in df.schema.fields
        if f.name not in key and kind_of(f.dataType) not in ("nested", "other")
    ]
    ranked = df.withColumn(name, F.md5(F.encode(text, "UTF-8")))
    return ranked.orderBy(name, *[col(k) for k in key], *others).limit(n).drop(name)


def _sample(
    df: DataFrame, order_by: Sequence[str], n: int, seed: int | None
) -> DataFrame:
    return limit_sample(df, order_by, n) if seed is None else hash_sample(df, order_by, n, seed)


def unpivot_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(feature, value)``: the numeric ones of the chosen columns on top of each other."""
    names = numeric_columns(df, columns)
    if not names:
        raise ValueError("no numeric columns to unpivot")
    return long_values(
        df, {f.name: as_double(f) for f in fields_of(df, names)}, name="feature", value="value"
    )


def boxplot_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, q1, median, q3, whisker_low, whisker_high, outliers)`` per numeric column.

    Quartiles are exact; whiskers reach the furthest values within 1.5 interquartile ranges of
    the box, and what lies beyond counts as outliers.
    """
    names = numeric_columns(df, columns)
    if not names:
        raise ValueError("no numeric columns for a box plot")
    boxes = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    fences = {}
    for n, (q1, _, q3) in boxes.items():
        reach = 1.5 * (q3 - q1) if q1 is not None else None
        fences[n] = (None, None) if reach is None else (q1 - reach, q3 + reach)

    def within(f):
        low, high = fences[f.name]
        x = as_double(f)
        return F.when((x >= F.lit(low)) & (x <= F.lit(high)), x)

    whiskers = per_column(
        df,
        fields_of(df, names),
        {
            "whisker_low": lambda f: F.min(within(f)),
            "whisker_high": lambda f: F.max(within(f)),
            "outliers": lambda f: F.count(as_double(f)) - F.count(within(f)),
        },
    )
    table = small_table(
        df.sparkSession,
        [(n, *box) for n, box in boxes.items()],
        "column string, q1 double, median double, q3 double",
    )
    return table.join(whiskers, "column")


def scatter_points(
    df: DataFrame, x: str, y: str, order_by: Sequence[str], n: int = PLOT_POINTS,
    seed: int | None = None,
) -> DataFrame:
    """``(x, y)`` of the first ``n`` rows in the given order, or with a ``seed`` of a uniform sample
    of the table by these columns."""
    require_numeric(df, [x, y])
    return _sample(df, order_by, n, seed).select(col(x).alias("x"), col(y).alias("y"))


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """``(x_bin, y_bin, x_lo, y_lo, count)`` of all rows on a ``bins`` by ``bins`` grid."""
    fx, fy = require_numeric(df, [x, y])
    lo_x, hi_x, lo_y, hi_y = df.agg(
        F.min(as_double(fx)), F.max(as_double(fx)), F.min(as_double(fy)), F.max(as_double(fy))
    ).first()

    def cell(field, low, high):
        width = F.lit(high).cast("double") - F.lit(low).cast("double")
        share = F.try_divide(as_double(field) - F.lit(low), width)
        return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1).cast("bigint"))

    def start(cell_column, low, high):
        return F.lit(low) + F.col(cell_column) * F.lit((high - low) / bins)

    counted = (
        df.filter(as_double(fx).isNotNull() & as_double(fy).isNotNull())
        .groupBy(cell(fx, lo_x, hi_x).alias("x_bin"), cell(fy, lo_y, hi_y).alias("y_bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    if lo_x is None or lo_y is None:
        lo_x = hi_x = lo_y = hi_y = 0.0
    return counted.select(
        "x_bin",
        "y_bin",
        start("x_bin", lo_x, hi_x).alias("x_lo"),
        start("y_bin", lo_y, hi_y).alias("y_lo"),
        "count",
    )


def pairplot_points(
    df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None,
    n: int = PLOT_POINTS, seed: int | None = None,
) -> DataFrame:
    """The named numeric columns (default: the first five) of the first ``n`` rows in the order, or
    with a ``seed`` of a uniform sample of the table by these columns."""
    names = numeric_columns(df, columns)
    if columns is None:
        names = names[:PAIRPLOT_COLUMNS]
    if not names:
        raise ValueError("no numeric columns for a pair plot")
    return _sample(df, order_by, n, seed).select(*[col(c) for c in names])


def _rows_to_plot(trained: Trained, order_by: Sequence[str] | None, n: int | None) -> DataFrame:
    rows = trained.prepared.usable()
    if n is None:
        return rows
    if not order_by:
        raise ValueError("the first rows need an order")
    return limit_sample(rows, order_by, n)


def actual_vs_predicted(
    trained: Trained, order_by: Sequence[str] | None = None, n: int | None = None
) -> DataFrame:
    """``(actual, predicted)`` points of all usable training rows, or of the first ``n``.

    :func:`scatter_bins` over the result counts them on a grid.
    """
    return trained.model.transform(_rows_to_plot(trained, order_by, n)).select(
        F.col(LABEL).alias("actual"), F.col(PREDICTION).alias("predicted")
    )


def diagonal(points: DataFrame) -> DataFrame:
    """``(low, high)``: the ends of the line of perfect prediction."""
    return points.agg(
        F.least(F.min("actual"), F.min("predicted")).alias("low"),
        F.greatest(F.max("actual"), F.max("predicted")).alias("high"),
    )


def cluster_points(
    trained: Trained, order_by: Sequence[str] | None = None, n: int | None = None
) -> DataFrame:
    """``(kind, cluster, x, y[, z])``: points of all rows (or the first ``n``) and all centres.

    Centres are given in the units of the features. Only two or three numeric features can be
    plotted.
    """
    names = trained.prepared.features
    if len(names) not in (2, 3):
        raise ValueError("cluster plots take two or three features")
    for f in fields_of(trained.prepared.df, names):
        if not is_numeric(f.dataType):
            raise ValueError(f"cluster plots take numeric features, not {f.name!r}")
    axes = dict(zip(names, "xyz"))
    points = trained.model.transform(_rows_to_plot(trained, order_by, n)).select(
        F.lit("point").alias("kind"),
        F.col(PREDICTION).alias("cluster"),
        *[col(c).cast("double").alias(a) for c, a in axes.items()],
    )
    centers = trained.tables["centers"].groupBy("cluster").agg(
        *[
            F.max(F.when(F.col("feature") == c, F.col("original_value"))).alias(a)
            for c, a in axes.items()
        ]
    )
    return points.unionByName(centers.withColumn("kind", F.lit("center")))
