"""Exact de-duplication by progressive refinement.

Rows are grouped by the length of their normalised text, rows that share a length by a hash of
its first characters, and only rows that share both by a hash of the full text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablume.llm.common import durable, fresh

PREFIX_CHARS = 256
#: Keys of groups that a task may hold to spare other rows the full hash (8 bytes each).
KEYS_HELD = 2_000_000
#: Dropped rows that a task may hold to leave them out (some 150 bytes each); beyond, rows are joined.
DROPPED_HELD = 500_000


def normalised(text: Column) -> Column:
    """Null counts as empty; every run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_groups(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    hash_all: bool = False,
    keys_held: int = KEYS_HELD,
) -> DataFrame:
    """For every row of ``df``: ``id, keep_id, group_size, kept, sha256``, narrow and durable.

    Of equal texts the row with the smallest id stays (a null id comes last; of rows with the
    same id one stays). ``sha256`` is null where no other row shares length and prefix hash,
    unless ``hash_all`` asks for it everywhere: such a row is alone, whatever its full text is.
    An empty table gives an empty result. Only the two named columns are read, so clashing names
    of other columns don't matter.

    Only narrow rows are shuffled: lengths, prefix hashes and full hashes. Counts are combined
    before each exchange, so one group may hold any share of the rows. The lengths, and the keys
    that survive both cheap levels, are given to every task only where they are counted to be
    ``keys_held`` at most; beyond, lengths are joined and all rows hashed in full, with the same
    result.
    """
    text = normalised(F.col(text_column))
    named = df.select(F.col(id_column).alias("id"), text.alias("text"))
    length = F.length("text").alias("length")
    prefix = F.xxhash64(F.substring("text", 1, PREFIX_CHARS)).alias("prefix")
    by_length = durable(
        named.groupBy(length).agg(F.count("*").alias("n")).where("n > 1").select("length"),
        "lengths",
    )
    # a frequent length would meet in one task of a shuffled join
    lengths = F.broadcast(by_length) if by_length.count() <= keys_held else by_length
    level_one = named.select(length, prefix).join(lengths, "length", "left_semi")
    keys = durable(
        level_one.groupBy("length", "prefix").agg(F.count("*").alias("n")).where("n > 1"),
        "prefix-groups",
    ).select("length", "prefix")
    looked = named.select("id", "text", length, prefix)
    if keys.count() <= keys_held:
        looked = looked.join(
            F.broadcast(keys.withColumn("open", F.lit(True))), ["length", "prefix"], "left"
        )
    else:
        looked = looked.withColumn("open", F.lit(True))
    full = F.sha2(F.encode("text", "UTF-8"), 256)
    hashed = durable(
        looked.select(
            "id",
            F.coalesce("open", F.lit(False)).alias("open"),
            (full if hash_all else F.when(F.col("open"), full)).alias("sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "full-hashes",
    )
    first = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    groups = (
        hashed.where("open")
        .groupBy("sha256")
        .agg(F.min(first).alias("first"), F.count("*").alias("group_size"))
    )
    several = hashed.where("open").join(groups, "sha256")
    alone = hashed.where("NOT open")
    return several.select(
        "id",
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("first.row") == F.col("row")).alias("kept"),
        "sha256",
    ).unionByName(
        alone.select(
            "id",
            F.col("id").alias("keep_id"),
            F.lit(1).cast("bigint").alias("group_size"),
            F.lit(True).alias("kept"),
            "sha256",
        )
    )


def exact_dedup(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", dropped_held: int = DROPPED_HELD
) -> DataFrame:
    """The rows of ``df`` that stay, one of each set of equal texts, with all their columns.

    Rows that share an id and a text stay once; rows that share only an id are told apart by
    their text. A null id is an id like any other. Whole rows are shuffled only where a row that
    stays is repeated, or where more than ``dropped_held`` rows go.
    """
    copies = exact_groups(df, id_column, text_column).where("sha256 IS NOT NULL")
    key = fresh(df, "key")
    rows = durable(
        copies.groupBy(_key(F.col("id"), F.col("sha256")).alias(key)).agg(
            F.max("kept").alias("kept"), F.count("*").alias("times")
        ),
        "copies",
    )
    full = F.sha2(F.encode(normalised(F.col(text_column)), "UTF-8"), 256)
    keyed = df.withColumn(key, _key(F.col(id_column), full))

    def held(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if keys.count() <= dropped_held else keys

    stay = keyed.join(held(rows.where("NOT kept").select(key)), key, "left_anti")
    repeated = rows.where("kept AND times > 1").select(key)
    if repeated.limit(1).count():
        repeated = held(repeated)
        once = stay.join(repeated, key, "left_semi").dropDuplicates([key])
        stay = stay.join(repeated, key, "left_anti").unionByName(once)
    return stay.select(*df.columns)


def _key(row_id: Column, sha256: Column) -> Column:
    return F.concat_ws("/", sha256, row_id.cast("string"))
