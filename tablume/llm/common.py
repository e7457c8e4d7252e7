"""Helpers shared by the operators: durable tables, row numbers and words as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablume.sources.scratch import scratch_path

WHITE_SPACE = bytes([0x20, *range(0x09, 0x0E)])
NON_ALNUM = bytes(
    i for i in range(0x80) if not (0x30 <= i <= 0x39 or 0x41 <= i <= 0x5A or 0x61 <= i <= 0x7A)
)
#: Texts are worked on in slices of so many bytes (one longer text is a slice of its own).
SLICE_BYTES = 1 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def durable(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the cluster's shared folder and read from there.

    Later readers see the same rows in the same parts, also after an executor is lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spread(df: DataFrame, per_part: int, rows: int, *columns: str) -> DataFrame:
    """Hash partitions of about ``per_part`` rows of the ``rows`` there are."""
    return df.repartition(max(1, -(-rows // per_part)), *columns)


# --- words as arrays -------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * _PRIME)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_PRIME, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
        if size > 8 * SLICE_BYTES:
            up, down = _powers
            _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
            return up, down
    return _powers[0], _powers[1]


def byte_hashes(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = _BYTE_VALUE
) -> np.ndarray:
    """64-bit hashes of the bytes from each ``start`` to its ``end``, wherever they stand."""
    up, down = _powers_to(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=total[1:])
    size = (end - start).astype(np.uint64)
    return mixed((total[end] - total[start]) * down[start] + size * _PRIME)


class Words:
    """The words of a slice of texts.

    ``start`` and ``end`` are byte places in ``data``; ``hash`` is a 64-bit hash of each word (A-Z
    in lower case if asked); ``first`` has, for each text, the number of its first word, with the
    total at the end. A text that is null has no words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: bytes, lower: bool):
        self.data, self.offsets = data, offsets
        inside = np.ones(256, bool)
        inside[list(separators)] = False
        word = inside[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = edge[:n].copy()
        before[1:] |= ~word[:-1]
        after = edge[1:].copy()
        after[:-1] |= ~word[1:]
        if n:
            before[0] = after[-1] = True
        self.start = np.flatnonzero(word & before)
        self.end = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.start, offsets)
        values = _BYTE_VALUE
        if lower:
            values = values.copy()
            values[65:91] = values[97:123]
        self.hash = byte_hashes(data, self.start, self.end, values)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from, to, bytes, offsets)`` of runs of rows of about SLICE_BYTES."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    content = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(places, places[at] + SLICE_BYTES, "right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, to, content[places[at] : places[to]], places[at : to + 1] - places[at]
        at = to


def windows(words: Words, size: int, whole_if_shorter: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words, and for each text where its windows start.

    Windows never cross texts. With ``whole_if_shorter`` a text of fewer words, but not none, is
    one window.
    """
    h, counts = words.hash, words.counts
    lengths = np.maximum(counts - size + 1, 0)
    if whole_if_shorter:
        lengths = np.where((counts > 0) & (counts < size), 1, lengths)
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(lengths, out=first[1:])
    place = np.arange(first[-1]) - np.repeat(first[:-1] - words.first[:-1], lengths)
    width = np.minimum(np.repeat(counts, lengths), size)
    return hashes_at(h, place, width, size), first


def hashes_at(h: np.ndarray, place: np.ndarray, width: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``width`` words from each ``place``; ``size`` is the largest width.

    The hash depends on the words alone, not on ``size``.
    """
    out = width.astype(np.uint64) * _PRIME
    if not len(place):
        return out
    least = width.min()
    for k in range(size):
        longer = mixed(out + h[np.minimum(place + k, len(h) - 1)])
        out = longer if k < least else np.where(k < width, longer, out)
    return out
