"""One entry point for exploration, regression, classification and clustering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablume.functions.columns import fields_of, require_columns
from tablume.operators.explore import explore
from tablume.operators.features import prepare
from tablume.operators.models import Trained, train_classifier, train_clusters, train_regressor

KINDS = ("exploratory", "regression", "classification", "clustering")


def analyze(
    df: DataFrame,
    kind: str,
    features: Sequence[str] | None = None,
    target: str | None = None,
    exclude: Sequence[str] = (),
    keep: Sequence[str] = (),
    **options,
) -> dict[str, DataFrame] | Trained:
    """Run one kind of analysis on the chosen columns (default: all but the excluded ones).

    Exploration gives result tables; the others give a trained model with its metrics and
    tables, and its samples can be ordered by the columns in ``keep``. ``options`` go to the trainer (``algorithm``, ``k``, ``holdout``, parameters).
    """
    if kind not in KINDS:
        raise ValueError(f"unsupported analysis: {kind!r}; use one of {', '.join(KINDS)}")
    names = [f.name for f in fields_of(df, features or None, exclude)]
    if kind == "exploratory":
        return explore(df, names)
    if kind == "clustering":
        return train_clusters(prepare(df, [n for n in names if n != target], keep=keep), **options)
    if not target:
        raise ValueError(f"{kind} needs a target column")
    require_columns(df, [target])
    prepared = prepare(df, names, target, keep, classes=kind == "classification")
    train = train_regressor if kind == "regression" else train_classifier
    return train(prepared, **options)
