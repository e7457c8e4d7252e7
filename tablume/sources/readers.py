"""Scans of CSV, JSON and Parquet, and named datasets kept as files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablume.functions.columns import clean, col, is_floating
from tablume.functions.tables import union_all

#: What a pointer to a published version holds.
POINTER = "number bigint, version string"
FILE_FORMATS = ("csv", "json", "parquet")


def read(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    sampling_ratio: float | None = None,
    corrupt: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Scan files of one format: CSV with a header, JSON Lines, or Parquet.

    Without ``schema`` the types are inferred, which for CSV and JSON costs one extra pass over
    the text; give a schema (or a sampling ratio) for large text inputs. Parquet carries its
    own schema.

    With a schema, text that does not read as declared becomes NULL; ``corrupt`` names a column
    that then holds the whole record, and ``strict`` fails the read instead.
    """
    if fmt not in FILE_FORMATS:
        raise ValueError(f"unsupported file format: {fmt!r}; use one of {', '.join(FILE_FORMATS)}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if (corrupt or strict) and (schema is None or fmt == "parquet"):
        raise ValueError("corrupt and strict need a schema and a text format")
    if strict:
        reader = reader.option("mode", "FAILFAST")
    if schema is not None:
        if corrupt:
            parsed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
            schema = T.StructType([*parsed.fields, T.StructField(corrupt, T.StringType())])
            reader = reader.option("columnNameOfCorruptRecord", corrupt)
        reader = reader.schema(schema)
    elif fmt != "parquet":
        if fmt == "csv":
            reader = reader.option("inferSchema", True)
        if sampling_ratio is not None:
            reader = reader.option("samplingRatio", sampling_ratio)
    return reader.load(path if isinstance(path, str) else list(path))


def read_json_array(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """Scan files that each hold one JSON array of records.

    Such a file cannot be split, so parallelism comes from the number of files; store bulk data
    as JSON Lines or Parquet.
    """
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path if isinstance(path, str) else list(path))


def read_nested_json(
    spark: SparkSession,
    path: str | Sequence[str],
    records: str = "data",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Scan wrapper documents such as ``{"data": [...], "metadata": {...}}``: one row per record."""
    wrapped = read_json_array(spark, path, schema)
    if records not in wrapped.columns:
        raise ValueError(f"no {records!r} array in the document")
    return wrapped.select(F.inline(col(records)))


def dataset_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def read_dataset(
    spark: SparkSession, root: str, name: str, fmt: str = "parquet", **options
) -> DataFrame:
    """Read a named dataset. ``fmt`` may be any source the session knows, connectors included."""
    return spark.read.format(fmt).options(**options).load(dataset_path(root, name))


def write_dataset(
    df: DataFrame, root: str, name: str, mode: str = "append", fmt: str = "parquet", **options
) -> str:
    """Append to, or with ``mode='overwrite'`` replace, a named dataset; types are kept."""
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unsupported write mode: {mode!r}; use append or overwrite")
    path = dataset_path(root, name)
    df.write.format(fmt).mode(mode).options(**options).save(path)
    return path


def write_version(df: DataFrame, root: str, name: str) -> str:
    """Replace a named dataset by ``df`` in one step, also while it, or ``df`` itself, is being read.

    The rows are written aside, and only when all of them are there a pointer to them is added, a file
    that appears whole or not at all. A failing write leaves the old rows, and readers that began
    before go on with theirs. Of two writers at once, one wins whole. Older versions stay until
    their folders are removed.
    """
    path, version = dataset_path(root, name), uuid.uuid4().hex
    df.write.parquet(f"{path}/versions/{version}")
    last = _published(df.sparkSession, path)
    pointer = [(last[0] + 1 if last else 1, version)]
    added = df.sparkSession.createDataFrame(pointer, POINTER).coalesce(1)
    added.write.mode("append").json(f"{path}/published")
    return path


def read_version(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows that :func:`write_version` published last."""
    path = dataset_path(root, name)
    last = _published(spark, path)
    if not last:
        raise ValueError(f"no published version of {name!r}")
    return spark.read.parquet(f"{path}/versions/{last[1]}")


def _published(spark: SparkSession, path: str) -> Row | None:
    """The last pointer of a dataset: its number and version."""
    try:
        pointers = spark.read.schema(POINTER).json(f"{path}/published")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return pointers.orderBy(F.desc("number"), F.desc("version")).first()


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts (UNION ALL), matched by column name."""
    return union_all(parts)


def _json_value(field: T.StructField) -> Column:
    value = clean(field)
    if is_floating(field.dataType):
        value = F.when(F.abs(value) != F.lit(float("inf")), value)
    return value


def to_json_rows(df: DataFrame, column: str = "json") -> DataFrame:
    """Every row as one JSON record string.

    Nulls are written, so records keep all keys; NaN and infinities, which JSON lacks, are null.
    """
    everything = F.struct(*[_json_value(f).alias(f.name) for f in df.schema.fields])
    return df.select(F.to_json(everything, {"ignoreNullFields": "false"}).alias(column))
