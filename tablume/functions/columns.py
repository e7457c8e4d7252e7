"""One definition of numeric / categorical / temporal / nested, used by every operator.

Three different ideas of an absent value are kept apart on purpose:

* *null*    - SQL NULL, plus NaN for float and double columns;
* *missing* - null, plus the empty string for string columns;
* *clean*   - the column with NaN turned into NULL, so aggregates skip both alike.

All tests branch on the declared type, so no expression here can raise a cast error under
ANSI mode.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = (T.StringType, T.CharType, T.VarcharType)
_FLOATING = (T.FloatType, T.DoubleType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, _TEXT)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, _FLOATING)


def is_categorical(dtype: T.DataType) -> bool:
    return is_text(dtype) or isinstance(dtype, T.BooleanType)


def kind_of(dtype: T.DataType) -> str:
    """``numeric``, ``categorical``, ``temporal``, ``nested`` or ``other``."""
    if is_numeric(dtype):
        return "numeric"
    if is_categorical(dtype):
        return "categorical"
    if isinstance(dtype, _TEMPORAL):
        return "temporal"
    if isinstance(dtype, _NESTED):
        return "nested"
    return "other"


def is_countable(dtype: T.DataType) -> bool:
    """Can values of this type be grouped and printed (distinct counts, top values)?"""
    return kind_of(dtype) in ("numeric", "categorical", "temporal") or isinstance(
        dtype, T.BinaryType
    )


def quoted(name: str) -> str:
    """The column name as a SQL identifier (safe for dots, spaces and backticks)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(
            "column(s) not found: " + ", ".join(repr(n) for n in absent)
            + "; the table has " + ", ".join(repr(n) for n in df.columns)
        )


def fields_of(
    df: DataFrame, names: Sequence[str] | None = None, exclude: Sequence[str] = ()
) -> list[T.StructField]:
    """Schema fields of the chosen columns (default: all), each once, in the order asked for."""
    if names is not None:
        require_columns(df, names)
    wanted = dict.fromkeys(df.columns if names is None else names)
    return [df.schema[n] for n in wanted if n not in exclude]


def numeric_columns(
    df: DataFrame, names: Sequence[str] | None = None, exclude: Sequence[str] = ()
) -> list[str]:
    return [f.name for f in fields_of(df, names, exclude) if is_numeric(f.dataType)]


def categorical_columns(
    df: DataFrame, names: Sequence[str] | None = None, exclude: Sequence[str] = ()
) -> list[str]:
    return [f.name for f in fields_of(df, names, exclude) if is_categorical(f.dataType)]


def require_numeric(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    fields = fields_of(df, names)
    wrong = [f"{f.name} ({f.dataType.simpleString()})" for f in fields if not is_numeric(f.dataType)]
    if wrong:
        raise ValueError("not numeric: " + ", ".join(wrong))
    return fields


def require_plain_names(names: Iterable[str]) -> None:
    """Model stages address columns by bare name, so dots and backticks cannot be used there."""
    odd = [n for n in names if "." in n or "`" in n]
    if odd:
        raise ValueError("rename column(s) before modelling: " + ", ".join(repr(n) for n in odd))


def is_null(field: T.StructField) -> Column:
    c = col(field.name)
    return (c.isNull() | F.isnan(c)) if is_floating(field.dataType) else c.isNull()


def is_missing(field: T.StructField) -> Column:
    c = col(field.name)
    return (c.isNull() | (c == "")) if is_text(field.dataType) else is_null(field)


def clean(field: T.StructField) -> Column:
    c = col(field.name)
    return F.when(~F.isnan(c), c) if is_floating(field.dataType) else c


def as_double(field: T.StructField) -> Column:
    return clean(field).cast("double")


def as_text(field: T.StructField) -> Column:
    """Printable value; the two floating zeros print alike, NaN counts as NULL."""
    value = clean(field)
    if is_floating(field.dataType):
        value = value + F.lit(0.0).cast(field.dataType)
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(value)
    return value.cast("string")


def as_key(field: T.StructField) -> tuple[str, Column]:
    """A narrow comparable key for distinct counting: (``bigint``/``double``/``string``, column).

    Whole numbers, booleans, dates and timestamps share the ``bigint`` form, so one narrow
    grouping serves many columns without printing every value.
    """
    dtype = field.dataType
    value = clean(field)
    if isinstance(dtype, T.IntegralType):
        return "bigint", value.cast("bigint")
    if isinstance(dtype, T.BooleanType):
        return "bigint", value.cast("int").cast("bigint")
    if isinstance(dtype, T.DateType):
        return "bigint", F.unix_date(value).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return "bigint", F.unix_micros(value)
    if is_floating(dtype):
        return "double", value.cast("double")
    return "string", as_text(field)
