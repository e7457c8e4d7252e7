"""Packing into fixed-length sequences: best fit, then a swap-based local search.

Documents are cut only where they are longer than a sequence. The pieces are dealt evenly over
groups that are packed independently: best fit by decreasing length gives a start, and then
moves, one-for-one and two-for-one exchanges between underfull bins raise the sum of squared
fills, so that the emptiest bins run out.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablume.llm.common import durable, fresh
from tablume.llm.tokens import pieces, tokenizer, with_end

CAPACITY = 2048
#: Pieces of a group: each group leaves one bin underfull at most that others could have filled.
GROUP_PIECES = 20_000
#: Passes of the local search; it stops sooner when a pass changes nothing.
PASSES = 30

PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    df: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text",
    capacity: int = CAPACITY, end: int = 0,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` of all texts as token ids with ``end`` after each.

    A null or empty text is the id ``end`` alone. Repeated rows give their pieces again. The ids
    themselves stay in the task that made them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path)
        for batch in batches:
            for at, to, ids, first in encoder.encoded(batch.column(1)):
                ids, first = with_end(ids, first, end)
                text, piece, start, length = pieces(first, capacity)
                data = ids.astype("<u4").tobytes()
                begin = first[text] + start
                crc = [
                    zlib.crc32(data[4 * b : 4 * (b + n)])
                    for b, n in zip(begin.tolist(), length.tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at).take(pa.array(text)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    return df.select(F.col(id_column).cast("long").alias("id"), text_column).mapInArrow(cut, PIECES)


class Bins:
    """Bins of one group, by the room they have left; every item is a number with a length."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.capacity = capacity
        self.length = lengths.tolist()
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, set[int]] = defaultdict(set)

    def best_fit(self) -> None:
        """Each item, the longest first, goes where it leaves the least room."""
        open_rooms = np.zeros(self.capacity + 1, np.int64)
        for item in sorted(range(len(self.length)), key=lambda i: (-self.length[i], i)):
            size = self.length[item]
            fits = np.flatnonzero(open_rooms[size:])[:1]
            if len(fits):
                room = size + int(fits[0])
                bin_ = self.by_room[room].pop()
                open_rooms[room] -= 1
            else:
                bin_, room = len(self.items), self.capacity
                self.items.append([])
                self.room.append(room)
            self.items[bin_].append(item)
            self.room[bin_] = room - size
            self.by_room[room - size].add(bin_)
            open_rooms[room - size] += 1

    def _change(self, bin_: int, out: list[int], into: list[int]) -> None:
        self.by_room[self.room[bin_]].discard(bin_)
        for i in out:
            self.items[bin_].remove(i)
        self.items[bin_] += into
        self.room[bin_] += sum(self.length[i] for i in out) - sum(self.length[i] for i in into)
        self.by_room[self.room[bin_]].add(bin_)

    def _exchange(self, a: int, from_a: list[int], b: int, from_b: list[int]) -> bool:
        """Exchange items if both bins still hold them and the squared fill grows."""
        gain = sum(self.length[i] for i in from_a) - sum(self.length[i] for i in from_b)
        if gain > self.room[b] or -gain > self.room[a]:
            return False
        fill_a, fill_b = self.capacity - self.room[a], self.capacity - self.room[b]
        if (fill_a - gain) ** 2 + (fill_b + gain) ** 2 <= fill_a**2 + fill_b**2:
            return False
        self._change(a, from_a, from_b)
        self._change(b, from_b, from_a)
        return True

    def _emptied(self, a: int) -> bool:
        """Give the items of bin ``a`` to fuller bins, exchanging where none fits; true if changed.

        For an item of length n a bin with room r takes it for one item of length n - r or more
        but less than n, or for two that add up to that: afterwards it has no more room than
        before, and ``a`` has more.
        """
        changed = False
        for item in sorted(self.items[a], key=lambda i: -self.length[i]):
            if item not in self.items[a]:
                continue
            size = self.length[item]
            done = False
            for room in self.rooms_with_bins(a):
                for b in list(self.by_room[room])[:4]:
                    if b == a or self.room[b] > self.room[a]:
                        continue
                    if size <= room:
                        done = self._exchange(a, [item], b, [])
                    else:
                        done = self._swap(a, item, b)
                    if done:
                        break
                if done:
                    break
            changed |= done
        return changed

    def rooms_with_bins(self, a: int) -> list[int]:
        return sorted(
            (r for r, bins in self.by_room.items() if bins and 0 < r <= self.room[a]),
        )

    def _swap(self, a: int, item: int, b: int) -> bool:
        size, room = self.length[item], self.room[b]
        others = sorted(self.items[b], key=lambda i: self.length[i])
        sizes = [self.length[i] for i in others]
        # one for one: the shortest that makes enough room
        for i, n in zip(others, sizes):
            if size - room <= n < size:
                return self._exchange(a, [item], b, [i])
        # two for one
        low, high = 0, len(others) - 1
        best = None
        while low < high:
            both = sizes[low] + sizes[high]
            if both >= size:
                high -= 1
            else:
                if both >= size - room and (best is None or both < best[0]):
                    best = (both, others[low], others[high])
                low += 1
        return best is not None and self._exchange(a, [item], b, [best[1], best[2]])

    def improve(self) -> None:
        """Local search: from the emptiest bins, until a pass changes nothing."""
        least = -(-sum(self.length) // self.capacity)
        for _ in range(PASSES):
            if sum(1 for x in self.items if x) <= least:
                return
            underfull = sorted((b for b, x in enumerate(self.items) if x and self.room[b]), key=lambda b: -self.room[b])
            changed = False
            for bin_ in underfull:
                if self.items[bin_]:
                    changed |= self._emptied(bin_)
                    if not self.items[bin_]:
                        self.by_room[self.room[bin_]].discard(bin_)
            if not changed:
                return


def pack_group(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each item; bins are numbered from 0 without gaps."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.improve()
    number = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    used = 0
    for items in bins.items:
        at = 0
        for i in items:
            number[i], offset[i] = used, at
            at += bins.length[i]
        used += bool(items)
    return number, offset


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The rows of ``cut`` (any with ``length``, 1 to ``capacity``) with ``sequence_id, offset``.

    Offsets in a sequence are gapless from 0. The rows are written and numbered first; the number
    alone decides the group, so no key, however frequent, makes a group large. Columns of ``cut``
    called ``sequence_id`` or ``offset`` are replaced. An empty table gives an empty result.
    """
    row, group = fresh(cut, "row"), fresh(cut, "group")
    narrow = durable(
        cut.drop("sequence_id", "offset").withColumn(row, F.monotonically_increasing_id()),
        "pieces",
    )
    groups = max(1, -(-narrow.count() // group_pieces))
    names = [c for c in narrow.columns if c != row]
    schema = narrow.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(row, ignore_index=True)
        number, offset = pack_group(frame["length"].to_numpy(np.int64), capacity)
        return frame[names].assign(sequence_id=(int(key[0]) << 32) + number, offset=offset)

    numbered = narrow.withColumn(
        group, F.pmod(F.xxhash64(row), F.lit(groups)).cast("int")
    )
    return numbered.groupBy(group).applyInPandas(packed, schema)
