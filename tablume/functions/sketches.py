"""Quantile sketches merged in two levels.

A sketch buffer is large (about 100 KB), and a plain global aggregate would send one per task
and column to a single merging task. Grouping by a fixed number of buckets first spreads that
merge over many tasks; only the bucket results meet at the end.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablume.functions.columns import as_double
from tablume.functions.tables import chunks, union_all

#: Up to this many values a sketch holds every one of them, so its answers are exact.
SKETCH_SIZE = 4096
_LEAST_BUCKETS = 64
_COLUMNS_PER_AGGREGATE = 12


def rank_slack(size: int) -> float:
    """Share of the values by which a rank read from a sketch of that size hardly ever errs."""
    return 3.5 / size**0.9


def sketch_row(
    df: DataFrame,
    sketches: Mapping[str, Column],
    counts: Mapping[str, Column] | None = None,
    ranges: Mapping[str, Column] | None = None,
    size: int = SKETCH_SIZE,
    whole: Collection[str] = (),
) -> DataFrame:
    """One row with a merged sketch per entry, sums of 0/1 conditions, and ``<name>_min/max``.

    The entries in ``whole`` are bigint and are sketched as such. Tasks are merged in as many
    groups as the root of their number, so that no step merges more than that many sketches.
    """
    counts, ranges = counts or {}, ranges or {}
    part = F.spark_partition_id()
    # 64 groups up to 4,096 tasks, 256 up to 65,536, then 1,024
    bucket = (
        F.when(part < 4096, part % _LEAST_BUCKETS)
        .when(part < 65536, _LEAST_BUCKETS + part % 256)
        .otherwise(_LEAST_BUCKETS + 256 + part % 1024)
    )
    first = df.groupBy(bucket.alias("bucket")).agg(
        *[
            (F.kll_sketch_agg_bigint if n in whole else F.kll_sketch_agg_double)(c, size).alias(n)
            for n, c in sketches.items()
        ],
        *[F.count_if(c).alias(n) for n, c in counts.items()],
        *[F.min(c).alias(f"{n}_min") for n, c in ranges.items()],
        *[F.max(c).alias(f"{n}_max") for n, c in ranges.items()],
    )
    return first.agg(
        *[
            (F.kll_merge_agg_bigint if n in whole else F.kll_merge_agg_double)(n, size).alias(n)
            for n in sketches
        ],
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts],
        *[F.min(f"{n}_min").alias(f"{n}_min") for n in ranges],
        *[F.max(f"{n}_max").alias(f"{n}_max") for n in ranges],
    )


def read_sketches(
    spark: SparkSession, wanted: Sequence[tuple[bytes, Sequence[float], bool]]
) -> list[list[float | int]]:
    """Values at the given ranks of sketches (with whether they hold whole numbers) already on the
    driver, read in one go."""
    if not wanted:
        return []
    # a table of values is worked out by the planner, without a job
    row: Row = spark.sql("SELECT * FROM VALUES (1) AS t(one)").select(
        *[
            (F.kll_sketch_get_quantile_bigint if whole else F.kll_sketch_get_quantile_double)(
                F.lit(bytearray(sketch)), F.lit(list(ranks))
            ).alias(f"q{i}")
            for i, (sketch, ranks, whole) in enumerate(wanted)
        ]
    ).first()
    return [list(q) for q in row]


def quantile_sketches(
    df: DataFrame,
    fields: Sequence[T.StructField],
    ranks: Mapping[str, float],
    size: int = SKETCH_SIZE,
) -> DataFrame:
    """``(column, <one column per rank>)`` of approximate quantiles that are actual values."""
    parts = []
    for group in chunks(fields, _COLUMNS_PER_AGGREGATE):
        names = [f"q{i}" for i in range(len(group))]
        seen = sketch_row(
            df,
            {n: as_double(f) for n, f in zip(names, group)},
            counts={f"{n}_n": as_double(f).isNotNull() for n, f in zip(names, group)},
            size=size,
        )
        at = F.array(*[F.lit(float(r)) for r in ranks.values()])
        read = seen.select(
            *[
                F.when(F.col(f"{n}_n") > 0, F.kll_sketch_get_quantile_double(n, at)).alias(n)
                for n in names
            ]
        )
        rows = [
            F.struct(
                F.lit(f.name).alias("column"),
                *[F.get(F.col(n), i).alias(r) for i, r in enumerate(ranks)],
            )
            for n, f in zip(names, group)
        ]
        parts.append(read.select(F.inline(F.array(*rows))))
    return union_all(parts)
