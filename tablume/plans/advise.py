"""Which analysis suits a table or a target column, and which columns make good targets.

The rules only ask whether a column has few distinct values, so they never count a wide column
in full (see :func:`tablume.operators.profile.few_distinct`). NULL counts as a value here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablume.functions.columns import (
    categorical_columns,
    fields_of,
    is_categorical,
    is_numeric,
    numeric_columns,
    require_columns,
)
from tablume.functions.tables import small_table
from tablume.operators.profile import few_distinct

#: Fewer distinct numbers than this can be read as classes.
CLASS_LIMIT = 10


def suggest(df: DataFrame, target: str | None = None) -> list[str]:
    """Analyses that suit the target column, or the table as a whole without one."""
    if target is None:
        return ["clustering", "exploratory"]
    require_columns(df, [target])
    return _suggestions(df, [target])[target]


def _suggestions(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    fields = fields_of(df, columns)
    numeric = [f.name for f in fields if is_numeric(f.dataType)]
    few = few_distinct(df, numeric, CLASS_LIMIT - 1) if numeric else {}
    out = {}
    for f in fields:
        if is_categorical(f.dataType):
            out[f.name] = ["classification"]
        elif f.name not in few:
            out[f.name] = ["exploratory"]
        elif few[f.name] is None:
            out[f.name] = ["regression"]
        elif few[f.name] > 1:
            out[f.name] = ["classification", "regression"]
        else:
            out[f.name] = ["exploratory"]
    return out


def suggest_analysis(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, position, suggestion)`` for every column taken as the target."""
    names = [f.name for f in fields_of(df, columns)]
    rows = [
        (name, i, kind)
        for name, kinds in _suggestions(df, names).items()
        for i, kind in enumerate(kinds, start=1)
    ]
    return small_table(df.sparkSession, rows, "column string, position int, suggestion string")


def regression_target(df: DataFrame, exclude: Sequence[str] = ()) -> str | None:
    """The first numeric column with more than ten distinct values, else the first numeric one."""
    names = numeric_columns(df, exclude=exclude)
    few = few_distinct(df, names, CLASS_LIMIT) if names else {}
    many = [n for n in names if few[n] is None]
    return (many or names or [None])[0]


def classification_target(df: DataFrame, exclude: Sequence[str] = ()) -> str | None:
    """The first string or boolean column with two to ten distinct values, else such a number."""
    for names in (categorical_columns(df, exclude=exclude), numeric_columns(df, exclude=exclude)):
        few = few_distinct(df, names, CLASS_LIMIT) if names else {}
        classes = [n for n in names if few[n] is not None and few[n] > 1]
        if classes:
            return classes[0]
    return None


def can_cluster(df: DataFrame, exclude: Sequence[str] = ()) -> bool:
    return len(numeric_columns(df, exclude=exclude)) >= 2


def target_table(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """``(task, target)``; the target is NULL where no column qualifies."""
    rows = [
        ("regression", regression_target(df, exclude)),
        ("classification", classification_target(df, exclude)),
    ]
    return small_table(df.sparkSession, rows, "task string, target string")
