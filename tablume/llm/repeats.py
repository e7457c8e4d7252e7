"""Substring deduplication by recompression: words of passages that start at two places or more go.

Every text is parsed bottom-up. One round names runs of equal tokens, the next ones name pairs: a
hash deals all symbols into left and right ones, and a left symbol followed by a right one becomes
one symbol. A symbol's name is a hash of its words, so every task gives a passage the same name
without asking another, and whether two neighbours are joined depends on these two alone. Equal
windows therefore hold equal symbols in their interior: only a symbol at the edge can be joined
with something outside, and an edge symbol of the wrong side is taken off each round.

The widest interior symbol of a window's highest level is its *anchor*. It depends on the window's
words alone, so equal windows share it at one offset, and a window whose anchor no other place has
is unique. What Spark shuffles is one row for an anchor with all its windows (about eight words),
not one for each word: anchors are counted, those seen once are dropped, those whose whole
surroundings are alike everywhere are repeats without further ado, and only windows of the rest are
compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablume.llm.common import (
    _INVERSE,
    _PRIME,
    WHITE_SPACE,
    Words,
    _powers_to,
    durable,
    fresh,
    mixed,
    slices,
)

WINDOW = 35
#: Rounds that name pairs; a round makes symbols about a third wider.
ROUNDS = 7
#: Bits of the two maps by which tasks leave anchors out early. Their size is fixed: beyond many
#: times as many shared anchors they only stop helping.
MAP_BITS = 25

SEEN = "symbol long, context long"
PLACES = "id long, mark long, symbol long, first long, number long, windows array<long>"


class _Spans:
    """Hashes of any run of words of a slice, from one running sum."""

    def __init__(self, words: Words):
        n = len(words.hash)
        self.up, self.down = _powers_to(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(words.hash + _PRIME) * self.up[:n], out=self.total[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - begin).astype(np.uint64)
        return mixed((self.total[end] - self.total[begin]) * self.down[begin] + size * _INVERSE)


class _Core:
    """For every window the part of the parse that depends on its own words alone.

    ``left`` and ``right`` are word places; both are edges of symbols of the present level.
    """

    def __init__(self, start: np.ndarray, size: int):
        self.left, self.right = start.copy(), start + size

    def runs(self, begin: np.ndarray, end: np.ndarray, of_word: np.ndarray) -> None:
        """The first and the last run may go on outside."""
        self.left = end[of_word[self.left]]
        self.right = np.maximum(begin[of_word[self.right - 1]], self.left)

    def pairs(self, begin: np.ndarray, end: np.ndarray, of_word: np.ndarray, is_left: np.ndarray) -> None:
        """A first symbol of the right side or a last one of the left side may be joined outside."""
        live = self.left < self.right
        first = of_word[np.minimum(self.left, len(of_word) - 1)]
        last = of_word[self.right - 1]
        left = np.where(live & ~is_left[first], end[first], self.left)
        right = np.where(live & is_left[last], begin[last], self.right)
        self.left, self.right = left, np.maximum(right, left)


def _widest(width: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The widest symbol (the first of several) among those from ``low`` to before ``high``."""
    n = len(width)
    rank = width * n + (n - 1 - np.arange(n))
    levels, span = [rank], 1
    while 2 * span <= int((high - low).max(initial=1)):
        before = levels[-1]
        longer = before.copy()
        longer[: n - span] = np.maximum(before[: n - span], before[span:])
        levels.append(longer)
        span *= 2
    level = np.log2(high - low).astype(np.int64)
    # guard against rounding of the logarithm
    level -= (1 << level) > high - low
    table = np.stack(levels)
    best = np.maximum(table[level, low], table[level, high - (1 << level)])
    return n - 1 - best % n


def _anchors(words: Words, size: int, rounds: int):
    """``(start, begin, end)`` of all windows and their anchors; a window without one has begin =
    end."""
    counts = words.counts
    lengths = np.maximum(counts - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), lengths)
    start = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + words.first[text]
    begin_of, end_of = start.copy(), start.copy()
    n = len(words.hash)
    if not len(start):
        return _Spans(words), text, start, begin_of, end_of
    spans = _Spans(words)
    core = _Core(start, size)
    edge = np.zeros(n + 1, bool)
    edge[words.first] = True
    fixed = edge.copy()  # symbols never cross texts
    name = words.hash
    edge[1:n] |= name[1:] != name[:-1]
    for level in range(rounds + 1):
        if level:
            salt = np.uint64((level * int(_INVERSE)) & 0xFFFFFFFFFFFFFFFF)
            is_left = (mixed(name ^ salt) & np.uint64(1)).astype(bool)
            core.pairs(begin, end, of_word, is_left)  # noqa: F821
            joined = is_left[:-1] & ~is_left[1:] & ~fixed[begin[1:]]  # noqa: F821
            edge[begin[1:][joined]] = False  # noqa: F821
        places = np.flatnonzero(edge[:n])
        begin, end = places, np.append(places[1:], n)
        of_word = np.cumsum(edge[:n]) - 1
        if not level:
            core.runs(begin, end, of_word)
        name = spans.of(begin, end)
        whole = np.flatnonzero(core.left < core.right)
        low = of_word[core.left[whole]]
        high = of_word[core.right[whole] - 1] + 1
        if len(whole):
            chosen = _widest(end - begin, low, high)
            begin_of[whole], end_of[whole] = begin[chosen], end[chosen]
    return spans, text, start, begin_of, end_of


class Anchors:
    """The anchors of a slice, each with the consecutive windows that have it."""

    def __init__(self, words: Words, size: int, rounds: int):
        spans, text, start, begin, end = _anchors(words, size, rounds)
        self.spans, self.size = spans, size
        bare = begin == end
        new = np.ones(len(start), bool)
        new[1:] = (
            (text[1:] != text[:-1]) | (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
            | bare[1:] | bare[:-1]
        )
        first = np.flatnonzero(new)
        self.number = np.diff(first, append=len(start))
        self.text, self.start = text[first], start[first]
        last = self.start + self.number - 1 + size
        # a window without an interior symbol stands for itself
        alone = bare[first]
        self.symbol = spans.of(
            np.where(alone, self.start, begin[first]), np.where(alone, last, end[first])
        )
        self.symbol[alone] = mixed(self.symbol[alone] ^ _INVERSE)
        self.context = mixed(spans.of(self.start, last) + _PRIME)

    def windows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of some anchors, and how many each has."""
        number = self.number[rows]
        total = np.cumsum(number)
        start = np.arange(total[-1] if len(total) else 0) - np.repeat(total - number - self.start[rows], number)
        return self.spans.of(start, start + self.size), number


def _slices(batch: pa.RecordBatch, size: int, rounds: int):
    for at, to, data, offsets in slices(batch.column("text")):
        words = Words(data, offsets, WHITE_SPACE, lower=False)
        yield at, to, words, Anchors(words, size, rounds)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _shared(texts: DataFrame, size: int, rounds: int) -> DataFrame:
    """``symbol, mixed`` of the anchors that several places have; mixed: not all surroundings are
    alike."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, found in _slices(batch, size, rounds):
                yield pa.RecordBatch.from_arrays(
                    [_signed(found.symbol), _signed(found.context)], names=["symbol", "context"]
                )

    seen = texts.select("text").mapInArrow(look, SEEN).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high")
    )
    return durable(
        seen.where("n > 1").select("symbol", (F.col("low") != F.col("high")).alias("mixed")),
        "shared-anchors",
    )


def _map(symbols: DataFrame, bits: int) -> np.ndarray:
    """A map of ``2 ** bits`` bits with those of the symbols set, whatever their number."""
    words = (
        symbols.select(F.shiftrightunsigned("symbol", 64 - bits).alias("place"))
        .select(
            F.shiftright("place", 6).alias("word"),
            F.expr("shiftleft(1L, CAST(place & 63 AS INT))").alias("bit"),
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << max(bits - 6, 0), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _in_map(symbols: np.ndarray, words: np.ndarray) -> np.ndarray:
    bits = int(len(words)).bit_length() + 5
    place = symbols >> np.uint64(64 - bits)
    bit = words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))
    return (bit & np.uint64(1)).astype(bool)


def _candidates(texts: DataFrame, maps: Broadcast, size: int, rounds: int) -> DataFrame:
    """A row for each anchor that may be shared, with its windows where they may differ."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, mixed_ones = maps.value
        for batch in batches:
            for at, _, words, found in _slices(batch, size, rounds):
                rows = np.flatnonzero(_in_map(found.symbol, shared))
                open_ = _in_map(found.symbol[rows], mixed_ones)
                hashes, number = found.windows(rows[open_])
                lists = np.zeros(len(rows) + 1, np.int32)
                lists[1:][open_] = number
                text = found.text[rows]
                key = pa.array(at + text)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(key),
                        batch.column("mark").take(key),
                        _signed(found.symbol[rows]),
                        pa.array(found.start[rows] - words.first[text]),
                        pa.array(found.number[rows]),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(lists, dtype=np.int32)), _signed(hashes)),
                    ],
                    names=["id", "mark", "symbol", "first", "number", "windows"],
                )

    return texts.mapInArrow(look, PLACES)


def _mark(text_column: str) -> Column:
    return F.xxhash64(text_column, F.length(text_column))


def repeated_windows(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    window: int = WINDOW, rounds: int = ROUNDS, map_bits: int = MAP_BITS,
) -> DataFrame:
    """``id, mark, first, number``: ``number`` windows from word ``first`` on start elsewhere too.

    ``mark`` is a hash of the text, so that rows that share an id are told apart; rows that share
    both are equal and have the same windows, which may be listed for each of them.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    texts = documents.select(
        F.col(id_column).cast("long").alias("id"),
        _mark(text_column).alias("mark"),
        F.col(text_column).alias("text"),
    )
    shared = _shared(texts, window, rounds)
    maps = documents.sparkSession.sparkContext.broadcast(
        (_map(shared, map_bits), _map(shared.where("mixed"), map_bits))
    )
    places = durable(
        _candidates(texts, maps, window, rounds).join(shared, "symbol"), "shared-places"
    )
    alike = places.where("NOT mixed").select("id", "mark", "first", "number")
    each = places.where("mixed").select(
        "id", "mark", "symbol", "first", F.posexplode("windows").alias("k", "window")
    )
    # written, so that the join deals rows out itself and can split a hot window
    again = durable(
        each.groupBy("symbol", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
        "repeated-windows",
    )
    single = each.join(again, ["symbol", "window"]).select(
        "id", "mark", (F.col("first") + F.col("k")).alias("first"), F.lit(1).cast("long").alias("number")
    )
    return alike.unionByName(single)


def _kept(rows: DataFrame, window: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, number = batch.column("first"), batch.column("number")
            for at, to, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, WHITE_SPACE, lower=False)
                counts, n = words.counts, len(words.hash)
                f, k = first.slice(at, to - at), number.slice(at, to - at)
                lengths = f.value_lengths().fill_null(0).to_numpy()
                start = f.flatten().to_numpy() + np.repeat(words.first[:-1], lengths)
                end = start + k.flatten().to_numpy() + window - 1
                edges = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
                keep = np.cumsum(edges[:n]) == 0
                kept = np.flatnonzero(keep)
                # the kept words, each with a space before it
                size = words.end[kept] - words.start[kept] + 1
                total = np.cumsum(size)
                from_ = np.arange(total[-1] if len(total) else 0) + np.repeat(
                    words.start[kept] - 1 - total + size, size
                )
                joined = data[from_]
                joined[total - size] = 0x20
                ends = np.concatenate([[0], total])[np.searchsorted(kept, words.first)]
                texts = [joined[a + 1 : b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                gone = counts - np.diff(np.searchsorted(kept, words.first))
                part = batch.slice(at, to - at)
                columns = {name: part.column(name) for name in part.schema.names}
                columns["n_words"] = pa.array(counts.astype(np.int64))
                columns["n_removed"] = pa.array(gone.astype(np.int64))
                columns["kept"] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict(
                    {name: columns[name] for name in ("id", "n_words", "n_removed", "kept")}
                )

    return rows.mapInArrow(cut, "id long, n_words long, n_removed long, kept string")


def substring_dedup(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    window: int = WINDOW, rounds: int = ROUNDS, map_bits: int = MAP_BITS,
) -> DataFrame:
    """``id, n_words, n_removed, kept`` for every row of ``documents``.

    Words are what white space separates, unchanged. A word goes where it is inside ``window``
    consecutive words of its row that also start at another place, in the same row or another;
    ``kept`` has the other words, joined by one space. Windows are judged on the input, so all
    places of a passage go. A null text has no words; an empty text, or one shorter than a window,
    loses nothing; repeated rows lose whatever they share; other columns are not read. Words and
    windows are told apart by two 64-bit hashes.

    A very long text is one row of one task, as it is in the input. ``rounds`` and ``map_bits``
    change the work, never the result.
    """
    found = repeated_windows(documents, id_column, text_column, window, rounds, map_bits)
    spans = found.distinct().groupBy("id", "mark").agg(
        F.collect_list("first").alias("first"), F.collect_list("number").alias("number")
    )
    row, mark = fresh(documents, "row"), fresh(documents, "mark")
    spans = spans.withColumnsRenamed({"id": row, "mark": mark})
    texts = documents.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")
    )
    same = F.col("id").eqNullSafe(F.col(row)) & (_mark("text") == F.col(mark))
    return _kept(texts.join(spans, same, "left").select("id", "text", "first", "number"), window)
