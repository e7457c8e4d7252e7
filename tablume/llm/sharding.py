"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the records uniformly over buckets that fit in memory, by a seeded hash; pass
two puts each bucket in an order drawn by Fisher-Yates. The buckets, one after the other, are the
shuffled data set; it is cut into shards whose counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablume.llm.common import durable, fresh

BUCKET_BYTES = 32 << 20
#: A bucket's permutation is one array; short records must not make it long.
BUCKET_ROWS = 100_000


def size_of(text: Column) -> Column:
    """Bytes of the text in UTF-8 (null: none), and one for the record's end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def placed(
    df: DataFrame,
    shards: int = 16,
    seed: int = 0,
    size: Column | None = None,
    bucket_bytes: int = BUCKET_BYTES,
    bucket_rows: int = BUCKET_ROWS,
    stable: bool = False,
) -> DataFrame:
    """Every row of ``df`` with ``size, bucket, shard, slot`` (law: ``rows``).

    ``size`` defaults to that of the column ``text``. ``slot`` counts from 0 without gaps in each
    shard, and shards follow one another in the shuffled order, so a shard is a run of buckets.
    Repeated rows are separate records, a null text is empty, an empty table gives an empty
    result, and columns of ``df`` with the names of the new ones are replaced.

    Whole rows are shuffled once, to a partition for each run of buckets; a bucket is one array
    there. Partitions come in the order of buckets. The rows are written first, so that each later
    step sees the same ones after a lost executor, unless ``df`` is ``stable``: a plain scan or a
    written table. Buckets take rows evenly, whatever their keys.
    """
    own = ("size", "bucket", "shard", "slot")
    row, start, rows, record = (fresh(df, n) for n in ("row", "start", "rows", "record"))
    base = (
        df.withColumn("size", size_of(F.col("text")) if size is None else size)
        .drop(*own[1:])
        .withColumn(row, F.monotonically_increasing_id())
    )
    if not stable:
        base = durable(base, "records")
    all_bytes, all_rows = base.agg(F.sum("size"), F.count("*")).first()
    buckets = max(1, -(-(all_bytes or 0) // bucket_bytes), -(-all_rows // bucket_rows))
    # pass one: a uniform scatter
    scattered = base.withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(seed), row), F.lit(buckets)).cast("int")
    )
    counts = durable(scattered.groupBy("bucket").agg(F.count("*").alias(rows)), "buckets")
    # one row for each bucket is summed
    starts = counts.select(
        "bucket", (F.sum(rows).over(Window.orderBy("bucket")) - F.col(rows)).alias(start)
    )
    # pass two: a Fisher-Yates shuffle of each bucket; rows come to it in one order
    drawn = (
        scattered.repartitionByRange(buckets, "bucket")
        .sortWithinPartitions("bucket", row)
        .groupBy("bucket")
        .agg(F.collect_list(F.struct(*[c for c in base.columns if c != row])).alias(record))
        .select("bucket", F.posexplode(F.shuffle(record, F.lit(seed))).alias("slot", record))
    )
    # the place among all records decides: shards are equal runs of places
    return (
        drawn.join(F.broadcast(starts), "bucket")
        .select(f"{record}.*", "bucket", (F.col(start) + F.col("slot")).alias("slot"))
        .withColumn("shard", F.expr(f"int(slot * {shards} div {max(1, all_rows)})"))
        .withColumn("slot", F.expr(f"slot - (shard * {all_rows}L + {shards - 1}) div {shards}"))
    )


def write_shards(placed_rows: DataFrame, path: str, parts: int | None = None) -> None:
    """Write one folder for each shard; its files, by name, hold its records by slot.

    ``parts`` range partitions share the work, so that a shard may be larger than a task. Rows as
    ``placed`` gives them are in the order of buckets already and need none.
    """
    if parts is not None:
        placed_rows = placed_rows.repartitionByRange(parts, "shard", "slot")
    placed_rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of written shards, with columns as in ``schema`` and their ``shard``."""
    return spark.read.schema(f"{schema}, shard int").parquet(path)
