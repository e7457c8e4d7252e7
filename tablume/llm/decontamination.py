"""Benchmark decontamination by a prefix-filtered set join.

Every window of a benchmark item is a set of word shingles that must all be in a document, so one
shingle is the window's necessary prefix: the one that is rarest in the corpus. Documents are
probed for prefixes only; a hit fixes where the window would start, bounds rule out starts before
a document or ends after it, and the whole window is then compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablume.llm.common import NON_ALNUM, Words, durable, fresh, hashes_at, slices, windows

WINDOW = 13
SHINGLE = 5
#: Windows that tasks hold at once (about 150 bytes each); more of them are matched block by block.
BLOCK_WINDOWS = 200_000
_READ_ITEMS = 1_000
#: Contaminated rows that tasks may hold to leave them out (16 bytes each); beyond, rows are joined.
IDS_HELD = 1_000_000

MATCHES = "id long, key long, n_words long, hits array<int>, items array<string>"


class Block:
    """Windows of benchmark items as arrays, with the words they use."""

    def __init__(self, items: list[tuple[str, str]], size: int, shingle: int):
        self.vocabulary: dict[int, bytes] = {}
        item, hashes, length, grams, gram_of, offset = [], [], [], [], [], []
        at = 0
        texts = pa.array([text for _, text in items], pa.large_string())
        for first, _, data, offsets in slices(texts):
            words = Words(data, offsets, NON_ALNUM, lower=True)
            lower = data.copy()
            capital = (lower >= 65) & (lower <= 90)
            lower[capital] += 32
            for i, h in enumerate(words.hash.tolist()):
                if h not in self.vocabulary:
                    self.vocabulary[h] = lower[words.start[i] : words.end[i]].tobytes()
            for k in range(len(offsets) - 1):
                begin, end = int(words.first[k]), int(words.first[k + 1])
                n = min(size, end - begin)
                if not n:
                    continue
                g = min(shingle, n)
                starts = np.arange(begin, end - n + 1)
                hashes.append(hashes_at(words.hash, starts, np.full(len(starts), n), n))
                length.append(np.full(len(starts), n))
                item += [items[first + k][0]] * len(starts)
                places = (starts[:, None] + np.arange(n - g + 1)).ravel()
                grams.append(hashes_at(words.hash, places, np.full(len(places), g), g))
                gram_of.append(np.repeat(at + np.arange(len(starts)), n - g + 1))
                offset.append(np.tile(np.arange(n - g + 1), len(starts)))
                at += len(starts)
        some = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.item = np.array(item, object)
        self.hash, self.length = some(hashes, np.uint64), some(length, np.int64)
        self.gram, self.gram_of = some(grams, np.uint64), some(gram_of, np.int64)
        self.offset = some(offset, np.int64)
        self.shingle = shingle
        self.known = np.unique(self.gram)

    def widths(self) -> list[int]:
        return sorted(set(np.minimum(self.length, self.shingle).tolist()))

    def choose(self, counts: np.ndarray) -> None:
        """Keep each window's rarest shingle; a window with one that no document has can't occur."""
        often = counts[np.searchsorted(self.known, self.gram)]
        order = np.lexsort((self.offset, self.gram, often, self.gram_of))
        _, first = np.unique(self.gram_of[order], return_index=True)
        chosen = order[first]
        chosen = chosen[often[chosen] > 0]
        chosen = chosen[np.argsort(self.gram[chosen], kind="stable")]
        self.prefix, self.window, self.at = self.gram[chosen], self.gram_of[chosen], self.offset[chosen]
        del self.gram, self.gram_of, self.offset


def _blocks(benchmark: DataFrame, id_column: str, text_column: str, size: int, limit: int):
    """Items of the benchmark in runs of about ``limit`` windows; the driver holds one run."""
    rows = benchmark.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")),
        F.coalesce(F.col(text_column), F.lit("")),
    ).toLocalIterator()
    items, windows_in = [], 0
    while some := list(islice(rows, _READ_ITEMS)):
        for item, text in some:
            items.append((item, text))
            windows_in += max(1, len(text) // 2 - size)  # at most
            if windows_in >= limit:
                yield items
                items, windows_in = [], 0
    yield items


def _counts(texts: DataFrame, held: Broadcast, widths: list[int], number: int) -> np.ndarray:
    """How often each known shingle occurs in all texts; a row a shingle and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value.known
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, NON_ALNUM, lower=True)
                for width in widths:
                    place = _among(windows(words, width, False)[0], known)[0]
                    total += np.bincount(place, minlength=len(known))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"shingle": there, "n": total[there]})

    found = (
        texts.select("text")
        .mapInArrow(count, "shingle long, n long")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    out = np.zeros(number, np.int64)
    out[found["shingle"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _among(hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hashes that are known: their places in ``known`` and in ``hashes``."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # 16 bits rule out most hashes before the search
    maybe = np.zeros(1 << 16, bool)
    maybe[known & np.uint64(0xFFFF)] = True
    candidates = np.flatnonzero(maybe[hashes & np.uint64(0xFFFF)])
    place = np.minimum(np.searchsorted(known, hashes[candidates]), len(known) - 1)
    same = known[place] == hashes[candidates]
    return place[same], candidates[same]


def _matches(words: Words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word, length, window)`` of every occurrence of a window."""
    starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    prefixes, begin, times = np.unique(block.prefix, return_index=True, return_counts=True)
    text_end = np.repeat(words.first[1:], words.counts)
    text_start = np.repeat(words.first[:-1], words.counts)
    for width in block.widths():
        hashes, first = windows(words, width, False)
        place, where = _among(hashes, prefixes)
        text = np.searchsorted(first, where, "right") - 1
        word = where - first[text] + words.first[text]
        # each occurrence with all windows that have this prefix
        n = times[place]
        entry = np.repeat(begin[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        word, window = np.repeat(word, n), block.window[entry]
        start = word - block.at[entry]
        right = np.minimum(block.length[window], block.shingle) == width
        right &= (start >= text_start[word]) & (start + block.length[window] <= text_end[word])
        starts.append(start[right])
        found.append(window[right])
    start, window = np.concatenate(starts), np.concatenate(found)
    length = block.length[window]
    size = int(length.max()) if len(length) else 1
    same = hashes_at(words.hash, start, length, size) == block.hash[window]
    return start[same], length[same], window[same]


def _verified(words: Words, block: Block, hit: np.ndarray) -> bool:
    """Whether the words at ``hit`` are the benchmark's words, byte by byte."""
    unique, example = np.unique(words.hash[hit], return_index=True)
    for h, i in zip(unique.tolist(), hit[example].tolist()):
        word = words.word(i).translate(_LOWER)
        if block.vocabulary.get(h) != word:
            return False
    return True


_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _probe(keyed: DataFrame, held: Broadcast, every_row: bool) -> DataFrame:
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        for batch in batches:
            for at, to, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, NON_ALNUM, lower=True)
                start, length, window = _matches(words, block)
                edges = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(edges, start, 1)
                np.add.at(edges, start + length, -1)
                hit = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
                if not _verified(words, block, hit):
                    raise RuntimeError("two words of one 64-bit hash; use another hash")
                text = np.searchsorted(words.first, hit, "right") - 1
                of_match = np.searchsorted(words.first, start, "right") - 1
                items: dict[int, set[str]] = {}
                for t, w in set(zip(of_match.tolist(), window.tolist())):
                    items.setdefault(t, set()).add(block.item[w])
                hits = np.split((hit - words.first[text]).astype(np.int32), np.searchsorted(text, np.arange(1, to - at)))
                rows = [i for i in range(to - at) if every_row or len(hits[i])]
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(rows, pa.int64())),
                        part.column("key").take(pa.array(rows, pa.int64())),
                        pa.array(words.counts[rows], pa.int64()),
                        pa.array([hits[i] for i in rows], pa.list_(pa.int32())),
                        pa.array([sorted(items.get(i, ())) for i in rows], pa.list_(pa.string())),
                    ],
                    names=["id", "key", "n_words", "hits", "items"],
                )

    return keyed.mapInArrow(probe, MATCHES)


def contamination(
    documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id",
    text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``id, n_words, hits, items`` for every row of ``documents``.

    Words are runs of ASCII letters (A-Z in lower case), digits and non-ASCII characters. Every
    ``window`` consecutive words of an item is a window, an item of fewer words, but not none, is
    one. ``hits`` has the places of words inside any occurrence of a window, ``items`` the ids (as
    text, sorted) of the items with occurring windows. A null or empty text has no words and no
    hits; repeated rows each give a row; items that share an id are one item with the windows of
    all; a null item id is the empty text; an empty benchmark hits nothing. Other columns are not
    read.

    The benchmark is read in blocks of bounded size, and each block is matched with all documents
    in one pass that shuffles nothing but counts; results of several blocks are joined by document.
    """
    spark = documents.sparkSession
    texts = documents.select(
        F.col(id_column).cast("long").alias("id"),
        _key(text_column).alias("key"),
        F.col(text_column).alias("text"),
    )
    found = []
    for items in _blocks(benchmark, item_column, item_text, window, block_windows):
        block = Block(items, window, shingle)
        if found and not len(block.hash):
            continue
        with_counts = spark.sparkContext.broadcast(block)
        block.choose(_counts(texts, with_counts, block.widths(), len(block.known)))
        found.append(_probe(texts, spark.sparkContext.broadcast(block), not found))
    out = found[0]
    if len(found) > 1:
        more = found[1]
        for one in found[2:]:
            more = more.unionByName(one)
        # rows of one id and text have the same hits
        more = more.groupBy("id", "key").agg(
            F.array_distinct(F.flatten(F.collect_set("hits"))).alias("more_hits"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("more_items"),
        )
        same = out["id"].eqNullSafe(more["id"]) & (out["key"] == more["key"])
        out = out.join(more, same, "left").select(
            out["id"],
            out["key"],
            "n_words",
            F.array_union("hits", F.coalesce("more_hits", F.array().cast("array<int>"))).alias("hits"),
            F.array_sort(
                F.array_union("items", F.coalesce("more_items", F.array().cast("array<string>")))
            ).alias("items"),
        )
    return out.select("id", "key", "n_words", "hits", "items")


def contaminated(found: DataFrame) -> DataFrame:
    """``found`` with counts of hits and items, and whether hits are a twentieth of the words or
    more."""
    n_hit = F.size("hits").cast("bigint")
    return found.withColumns(
        {
            "n_hit": n_hit,
            "n_items": F.size("items").cast("bigint"),
            "contaminated": (n_hit > 0) & (20 * n_hit >= F.col("n_words")),
        }
    )


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of ``documents`` that are not contaminated, with all their columns."""
    found = contaminated(contamination(documents, benchmark, id_column, text_column))
    row, key = fresh(documents, "row"), fresh(documents, "key")
    dirty = durable(
        found.where("contaminated").select(F.col("id").alias(row), F.col("key").alias(key)),
        "contaminated",
    )
    few = dirty.count() <= IDS_HELD
    same = F.col(id_column).eqNullSafe(F.col(row)) & (_key(text_column) == F.col(key))
    return documents.join(F.broadcast(dirty) if few else dirty, same, "left_anti")


def _key(text_column: str):
    return F.xxhash64(text_column, F.length(text_column))
