"""Exact quantiles with linear interpolation, without sorting or gathering the table.

The built-in ``percentile`` keeps every distinct value of a column in one task, so it cannot be
used on a column of unknown width. Here each wanted order statistic is bracketed instead. A
first pass sketches the column and gives two actual values around the wanted rank. The next pass
counts exactly how many rows lie below, on and strictly between them and sketches the rows in
between in the same scan: once those fit a sketch whole, the wanted row is read out of it,
otherwise the sketch gives the next, closer bracket. A bracket holds some two hundred times fewer
rows each round: one round does for a million rows, three or four for a trillion.

The counts are exact, so a bracket that missed is noticed and replaced, and a sketch is read as
the answer only when the rows it covers were counted to fit it whole: it then holds each of them. Passes read only the needed columns, shuffle nothing but
sketch buffers, and hold constant-size state.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablume.functions.columns import as_double, col, require_numeric
from tablume.functions.sketches import SKETCH_SIZE, rank_slack, read_sketches, sketch_row
from tablume.functions.tables import chunks, small_table

#: Columns or brackets followed in one aggregate; more are followed in further aggregates.
_PER_PASS = 12


@dataclass
class _Target:
    """One order statistic being searched: the row of 0-based ``rank`` within ``column``."""

    column: str
    rank: int
    low: float | int
    high: float | int
    bottom: float | int
    top: float | int
    whole: bool = False
    value: float | int | None = None

    @property
    def bracket(self) -> tuple[str, float, float]:
        return self.column, self.low, self.high


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    interpolate: bool = True,
    size: int = SKETCH_SIZE,
) -> dict[str, list[float | None]]:
    """Per column, the value at each probability; ``None`` where the column has no values.

    Without ``interpolate`` it is an actual value: the first whose share of values up to and
    including it reaches the probability. Whole-number columns are searched as whole numbers, so
    long integers stay exact; decimals are searched as doubles, so those beyond 2^53 are as exact as
    a double is.
    """
    return sized_quantiles(df, columns, probabilities, interpolate, size)[0]


def sized_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    interpolate: bool = True,
    size: int = SKETCH_SIZE,
) -> tuple[dict[str, list[float | None]], dict[str, int]]:
    """:func:`exact_quantiles` together with each column's number of values."""
    if not 8 <= size <= 65535:
        raise ValueError(f"a sketch holds 8 to 65535 values, not {size}")
    fields = require_numeric(df, columns)
    places = _between_ranks if interpolate else _at_rank
    whole = [isinstance(f.dataType, T.IntegralType) for f in fields]
    values = df.select(
        *[
            (col(f.name).cast("bigint") if w else as_double(f)).alias(f"v{i}")
            for i, (f, w) in enumerate(zip(fields, whole))
        ]
    )
    names = {f.name: f"v{i}" for i, f in enumerate(fields)}
    sizes, targets = _first_look(
        values,
        list(names.values()),
        lambda n: [places(n, p)[:2] for p in probabilities],
        size,
        {v for v, w in zip(names.values(), whole) if w},
    )
    pending = [t for t in targets if t.value is None]
    while pending:
        for brackets in chunks(list(dict.fromkeys(t.bracket for t in pending)), _PER_PASS):
            _look_around(values, brackets, [t for t in pending if t.bracket in brackets], size)
        pending = [t for t in pending if t.value is None]
    found = {(t.column, t.rank): t.value for t in targets}

    def answer(v: str, p: float) -> float | None:
        if sizes[v] == 0:
            return None
        below, above, part = places(sizes[v], p)
        low, high = found[v, below], found[v, above]
        if not interpolate:
            return low
        return float(low) if low == high else low + (high - low) * part

    answers = {name: [answer(v, p) for p in probabilities] for name, v in names.items()}
    return answers, {name: sizes[v] for name, v in names.items()}


def quantile_table(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """``(column, probability, value)`` with exact linear-interpolation quantiles."""
    answers = exact_quantiles(df, columns, probabilities)
    rows = [
        (name, float(p), value)
        for name, values in answers.items()
        for p, value in zip(probabilities, values)
    ]
    return small_table(df.sparkSession, rows, "column string, probability double, value double")


def _between_ranks(n: int, p: float) -> tuple[int, int, float]:
    """The two 0-based ranks around a probability and how far it lies between them."""
    at = p * (n - 1)
    below = math.floor(at)
    return below, min(math.ceil(at), n - 1), at - below


def _at_rank(n: int, p: float) -> tuple[int, int, float]:
    rank = max(math.ceil(p * n) - 1, 0)
    return rank, rank, 0.0


def _around(low: int, high: int, n: int, size: int) -> list[float]:
    """Sketch ranks safely below the row of rank ``low`` and above the row of rank ``high``."""
    slack = min(rank_slack(size), 0.25)  # so that every round leaves out rows
    return [max((low + 0.5) / n - slack, 0.0), min((high + 0.5) / n + slack, 1.0)]


def _first_look(values, columns, places, size, whole) -> tuple[dict[str, int], list[_Target]]:
    """Size, range and first brackets of every column, in one pass."""
    spark, sizes, targets = values.sparkSession, {}, []
    for group in chunks(columns, _PER_PASS):
        row = sketch_row(
            values,
            {v: F.col(v) for v in group},
            counts={f"{v}_n": F.col(v).isNotNull() for v in group},
            ranges={v: F.col(v) for v in group},
            size=size,
            whole=whole,
        ).first()
        for v in group:
            sizes[v] = row[f"{v}_n"]
        filled = [v for v in group if sizes[v]]
        pairs = {v: dict.fromkeys(places(sizes[v])) for v in filled}
        reads = [
            (row[v], [e for low, high in pairs[v] for e in _around(low, high, sizes[v], size)], v in whole)
            for v in filled
        ]
        for v, ends in zip(filled, read_sketches(spark, reads)):
            wanted = {}
            for i, pair in enumerate(pairs[v]):
                for rank in pair:
                    wanted.setdefault(rank, ends[2 * i : 2 * i + 2])
            targets += [
                _target(v, rank, sizes[v], bracket, row[f"{v}_min"], row[f"{v}_max"], v in whole)
                for rank, bracket in wanted.items()
            ]
    return sizes, targets


def _target(column, rank, n, bracket, bottom, top, whole) -> _Target:
    """The first and the last row are the range's ends and need no search."""
    known = bottom if rank == 0 else top if rank == n - 1 else None
    return _Target(column, rank, *bracket, bottom, top, whole, known)


def _inside(bracket) -> Column:
    v, low, high = bracket
    return (F.col(v) > F.lit(low)) & (F.col(v) < F.lit(high))


def _look_around(values: DataFrame, brackets, targets: list[_Target], size: int) -> None:
    """Exact counts around each bracket and a sketch of its inside, in one scan: they settle a
    target or place it inside a closer bracket."""
    counts, sketches, whole = {}, {}, set()
    for i, bracket in enumerate(brackets):
        v, low, high = bracket
        counts |= {
            f"below_{i}": F.col(v) < F.lit(low),
            f"low_{i}": F.col(v) == F.lit(low),
            f"inside_{i}": _inside(bracket),
            f"high_{i}": F.col(v) == F.lit(high),
        }
        sketches[f"s{i}"] = F.when(_inside(bracket), F.col(v))
        if any(t.whole for t in targets if t.bracket == bracket):
            whole.add(f"s{i}")
    row = sketch_row(values, sketches, counts=counts, size=size, whole=whole).first()
    unsettled = []
    for t in targets:
        i = brackets.index(t.bracket)
        before, inside = row[f"below_{i}"] + row[f"low_{i}"], row[f"inside_{i}"]
        high = row[f"high_{i}"] if t.high > t.low else 0
        place = t.rank - before
        if t.rank < row[f"below_{i}"]:
            t.low, t.high = t.bottom, t.low
        elif place < 0:
            t.value = t.low
        elif place >= inside + high:
            t.low, t.high = t.high, t.top
        elif place >= inside:
            t.value = t.high
        else:
            ranks = [(place + 0.5) / inside] if inside <= size else _around(place, place, inside, size)
            unsettled.append((t, row[f"s{i}"], ranks))
    reads = [(sketch, ranks, t.whole) for t, sketch, ranks in unsettled]
    for (t, _, ranks), ends in zip(unsettled, read_sketches(values.sparkSession, reads)):
        if len(ranks) == 1:
            t.value = ends[0]
        else:
            t.low = ends[0] if ranks[0] > 0 else t.low
            t.high = ends[1] if ranks[1] < 1 else t.high
