"""Raw rows to typed rows under a declared input schema, with failures kept as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablume.functions.columns import col, is_null, kind_of, quoted

ERRORS = "_errors"

# Declared type names and the Spark type each is read as.
DECLARED_TYPES = {
    "integer": "int",
    "int": "int",
    "smallint": "int",
    "tinyint": "int",
    "long": "bigint",
    "bigint": "bigint",
    "double": "double",
    "float": "double",
    "decimal": "double",
    "string": "string",
    "boolean": "boolean",
}


def spark_type(declared: str) -> str:
    """Unknown names are read as strings; ``decimal(10,2)`` counts as ``decimal``."""
    return DECLARED_TYPES.get(declared.lower().split("(")[0].strip(), "string")


def _typed(source: T.StructField, target: str) -> Column:
    """The value as its declared type; NULL where it doesn't read as one, or is of a kind that
    never does (nested and binary values; dates and times as numbers or booleans)."""
    raw = col(source.name)
    kind = kind_of(source.dataType)
    if kind in ("nested", "other") or kind == "temporal" and target != "string":
        return F.lit(None).cast(target)
    if target != "boolean":
        return raw.try_cast(target)
    if isinstance(source.dataType, T.BooleanType):
        return raw
    if isinstance(source.dataType, T.NumericType):
        return raw != 0
    return F.lower(raw.cast("string")) == "true"


def input_fields(schema: Sequence[Mapping]) -> list[Mapping]:
    """The non-target entries of an input schema; an entry without name or type is an error."""
    for entry in schema:
        if not entry.get("name") or not entry.get("original_type"):
            raise ValueError(f"input schema entry needs name and original_type: {dict(entry)}")
    fields = [e for e in schema if not e.get("is_target")]
    if not fields:
        raise ValueError("the input schema has no feature columns")
    return fields


def cast_to_schema(
    df: DataFrame,
    schema: Sequence[Mapping],
    keep: Sequence[str] = (),
    absent_categories: bool = False,
) -> DataFrame:
    """Type each declared feature; ``_errors`` lists what is wrong with the row (empty = usable).

    A value that is absent or does not read as its declared type leaves NULL and a message, in
    one narrow pass without a shuffle; so does a not-a-number. With ``absent_categories`` an
    absent string or boolean is no error. A feature the table lacks altogether is reported on
    every row. Split the result with :func:`valid_rows` and :func:`invalid_rows`.
    """
    values, errors = [], []
    for entry in input_fields(schema):
        name, declared = entry["name"], entry["original_type"]
        target = spark_type(declared)
        absent = F.lit(f"missing required feature: {name}")
        if name not in df.columns:
            values.append(F.lit(None).cast(target).alias(name))
            errors.append(absent)
            continue
        value = _typed(df.schema[name], target)
        wrong = F.lit(f"invalid value for feature {name}: expected {declared}")
        values.append(value.alias(name))
        missing = is_null(df.schema[name])
        if absent_categories and target in ("string", "boolean"):
            errors.append(F.when(col(name).isNotNull() & value.isNull(), wrong))
        else:
            unread = value.isNull() | F.isnan(value) if target == "double" else value.isNull()
            errors.append(F.when(missing, absent).when(unread, wrong))
    kept = [F.col(quoted(k)) for k in keep]
    problems = F.filter(F.array(*errors), lambda e: e.isNotNull())
    return df.select(*kept, *values, problems.alias(ERRORS))


def valid_rows(typed: DataFrame) -> DataFrame:
    return typed.filter(F.size(ERRORS) == 0).drop(ERRORS)


def invalid_rows(typed: DataFrame) -> DataFrame:
    return typed.filter(F.size(ERRORS) > 0)

