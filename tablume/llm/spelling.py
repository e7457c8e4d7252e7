"""Spelling variants: every word with the much more frequent word one edit away.

Words are counted first. All words one deletion or one replacement away from a word are generated
(an insertion is a deletion seen from the other word) and probed in blocked Bloom filters of the
vocabulary, one for each word length. Only positives are shuffled, to an exact join with the
vocabulary that removes the false ones. Filters have a bounded size: a longer vocabulary is cut
into parts that are probed one after the other.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablume.llm.common import _INVERSE, _PRIME, Words, durable, mixed, slices

LEAST_CHARS = 5
LEAST_COUNT = 3
#: A word's form is so many times as frequent as the word, or more.
RATIO = 2
#: One run in so many (by a hash of row and run) is read with a character left out.
NOISE = 97

#: Bits of a filter for each word, and bits set in one block of 64.
WORD_BITS = 32
_SET = 5
#: Bytes of filters that tasks hold at once; words beyond are probed in further rounds.
ROUND_BYTES = 64 << 20
#: Words of so many characters or more share their filters.
LONGEST = 48
_AT_ONCE = 1 << 20

_SEPARATORS = bytes(
    i for i in range(256) if not (65 <= i <= 90 or 97 <= i <= 122 or i == 0xC3 or 0x80 <= i <= 0xBF)
)


# --- words and their counts --------------------------------------------------------------------


def _crc_step() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_STEP = _crc_step()


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """The runs of letters (A-Z in lower case) and their bytes; letters are a-z and U+00C0 to
    U+00FF, whose first byte is always C3."""
    low = data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    second = np.zeros(len(low), bool)
    second[1:] = low[:-1] == 0xC3
    low[(low >= 0x80) & (low != 0xC3) & ~second] = 0x20
    return Words(low, offsets, _SEPARATORS, lower=False), low


def _checksums(prefixes: list[bytes], words: list[bytes], row: np.ndarray, word: np.ndarray) -> np.ndarray:
    """crc32 of the prefix of ``row`` followed by ``word``, for arrays of both.

    The checksum of a prefix is carried on over as many zero bytes as the word has, once for each
    prefix and length, and the word's own is added.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    own = np.array([zlib.crc32(w) for w in words], np.uint32)
    out = np.empty(len(row), np.uint32)
    longest = min(int(sizes.max(initial=0)), 64)
    carried = np.empty((longest + 1, len(prefixes)), np.uint32)
    carried[0] = [zlib.crc32(p) for p in prefixes]
    for k in range(longest):
        carried[k + 1] = (carried[k] >> 8) ^ _STEP[carried[k] & 0xFF]
    size = sizes[word]
    short = size <= longest
    out[short] = carried[size[short], row[short]] ^ own[word[short]]
    for i in np.flatnonzero(~short).tolist():
        out[i] = zlib.crc32(words[word[i]], int(carried[0, row[i]]))
    return out


def _counted(batches: Iterator[pa.RecordBatch], noise: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id").to_pylist()
        for at, to, data, offsets in slices(batch.column("text")):
            words, _ = _runs(data, offsets)
            _, example, word = np.unique(words.hash, return_index=True, return_inverse=True)
            texts = [words.word(i) for i in example.tolist()]
            row = np.repeat(np.arange(to - at), words.counts)
            prefixes = [b":" if i is None else f"{i}:".encode() for i in ids[at:to]]
            crc = _checksums(prefixes, texts, row, word).astype(np.int64)
            cut = crc % noise == 0
            n = np.bincount(word[~cut], minlength=len(texts))
            strings = [t.decode() for t in texts]
            total = Counter({strings[i]: int(n[i]) for i in np.flatnonzero(n).tolist()})
            for w, h in zip(word[cut].tolist(), crc[cut].tolist()):
                run = strings[w]
                k = h % len(run)
                total[run[:k] + run[k + 1 :]] += 1
            kept = [(w, k) for w, k in total.items() if len(w) >= least]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in kept], pa.string()), pa.array([k for _, k in kept], pa.int64())],
                names=["word", "n"],
            )


def vocabulary(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, noise: int = NOISE,
) -> DataFrame:
    """``word, n`` of all words of ``least_chars`` characters and ``least_count`` occurrences.

    Words are the longest runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. Where
    ``noise`` divides the crc32 of ``<id>:<run>``, the run lacks the character at that number modulo
    its length (this plants misspellings at a known rate). A null id reads as an empty one; null
    texts have no words; repeated rows count each time.
    """
    rows = documents.select(
        F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text")
    )
    return (
        rows.mapInArrow(lambda batches: _counted(batches, noise, least_chars), "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least_count)
    )


# --- blocked Bloom filters ---------------------------------------------------------------------


def _value(chars: np.ndarray) -> np.ndarray:
    return mixed((chars.astype(np.uint64) + np.uint64(1)) * _PRIME)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _PRIME, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _bits(h: np.ndarray) -> np.ndarray:
    mask = np.zeros(len(h), np.uint64)
    for k in range(_SET):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return mask


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(h) % np.uint64(parts)).astype(np.int64)


@dataclass
class _Filter:
    """Blocks of 64 bits for the words of one length whose hash falls into one part."""

    part: int
    parts: int
    blocks: int
    words: np.ndarray | None = None

    def has(self, h: np.ndarray) -> np.ndarray:
        """Places in ``h`` that may be in the vocabulary."""
        place = np.arange(len(h))
        if self.parts > 1:
            place = np.flatnonzero(_part(h, self.parts) == self.part)
            h = h[place]
        bits = _bits(h)
        return place[(self.words[_block(h, self.blocks)] & bits) == bits]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(places, characters)`` of words of one length, a bounded number of edits at once."""
    size = np.array([len(w) for w in words], np.int64)
    for n in np.unique(size).tolist():
        places = np.flatnonzero(size == n)
        step = max(1, _AT_ONCE // (100 * n + 1))
        for at in range(0, len(places), step):
            some = places[at : at + step]
            joined = "".join([words[i] for i in some.tolist()]).encode("utf-32-le")
            yield some, np.frombuffer(bytearray(joined), np.uint32).reshape(len(some), n)


def _hashes(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of a word's terms before each place, with the whole sum at the end; and powers."""
    m, n = chars.shape
    up, down = _powers(n + 1)
    sums = np.zeros((m, n + 1), np.uint64)
    np.cumsum(_value(chars) * up[:n], axis=1, out=sums[:, 1:])
    return sums, up, down


def _final(total: np.ndarray, size: int) -> np.ndarray:
    return mixed(total + np.uint64(size) * _INVERSE)


def _plan(words: DataFrame, word_bits: int, limit: int) -> list[dict[int, list[_Filter]]]:
    """Filters by length, in rounds of bounded size."""
    sizes = (
        words.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("size"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("size")
        .collect()
    )
    rounds: list[dict[int, list[_Filter]]] = []
    room = 0
    for r in sizes:
        parts = -(-r["n"] * word_bits // (8 * limit))
        blocks = max(1, -(-r["n"] * word_bits // (64 * parts)))
        for part in range(parts):
            if not rounds or 8 * blocks > room:
                rounds.append({})
                room = limit
            rounds[-1].setdefault(r["size"], []).append(_Filter(part, parts, blocks))
            room -= 8 * blocks
    return rounds


def _fill(words: DataFrame, filters: dict[int, list[_Filter]]) -> None:
    """Set the bits of all words; what comes to the driver are the filters, of bounded size."""
    shape = {n: [(f.part, f.parts, f.blocks) for f in fs] for n, fs in filters.items()}

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, chars in _by_length(batch.column("word").to_pylist()):
                size = min(chars.shape[1], LONGEST)
                sums, _, _ = _hashes(chars)
                h = _final(sums[:, -1], chars.shape[1])
                for k, (part, parts, blocks) in enumerate(shape.get(size, ())):
                    mine = h[_part(h, parts) == part] if parts > 1 else h
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(mine), size, np.int32)),
                            pa.array(np.full(len(mine), k, np.int32)),
                            pa.array(_block(mine, blocks)),
                            pa.array(_bits(mine).view(np.int64)),
                        ],
                        names=["size", "k", "block", "bits"],
                    )

    found = (
        words.select("word")
        .mapInArrow(bits, "size int, k int, block long, bits long")
        .groupBy("size", "k", "block")
        .agg(F.bit_or("bits").alias("bits"))
        .toPandas()
    )
    for (size, k), rows in found.groupby(["size", "k"]):
        f = filters[int(size)][int(k)]
        f.words = np.zeros(f.blocks, np.uint64)
        f.words[rows["block"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)


def _edits(chars: np.ndarray, alphabet: np.ndarray, filters: dict[int, list[_Filter]]):
    """``(word, edited characters)`` of deletions and of replacements by a larger character that
    may be words."""
    m, n = chars.shape
    sums, up, down = _hashes(chars)
    whole = sums[:, -1:]
    shorter = filters.get(min(n - 1, LONGEST), [])
    if shorter:
        h = _final(sums[:, :-1] + (whole - sums[:, 1:]) * down[1], n - 1)
        first = np.ones((m, n), bool)  # of a run of equal characters; the others give the same
        first[:, 1:] = chars[:, 1:] != chars[:, :-1]
        word, place = np.nonzero(first)
        for f in shorter:
            hit = f.has(h[word, place])
            w, p = word[hit], place[hit]
            keep = np.arange(n)[None, :] != p[:, None]
            yield w, chars[w][keep].reshape(len(w), n - 1)
    same = filters.get(min(n, LONGEST), [])
    if same:
        rest = whole - _value(chars) * up[:n]
        # every place and every larger character
        for c, v in zip(alphabet.tolist(), _value(alphabet)):
            word, place = np.nonzero(chars < c)
            h = _final(rest[word, place] + v * up[place], n)
            for f in same:
                hit = f.has(h)
                w, p = word[hit], place[hit]
                edited = chars[w]
                edited[np.arange(len(w)), p] = c
                yield w, edited


def _probe(words: DataFrame, alphabet: np.ndarray, held: Broadcast) -> DataFrame:
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("word").to_pylist()
            for places, chars in _by_length(texts):
                for w, edited in _edits(chars, alphabet, held.value):
                    if not len(w):
                        continue
                    n = edited.shape[1]
                    joined = np.ascontiguousarray(edited, np.uint32).tobytes().decode("utf-32-le")
                    row = pa.array(places[w])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("word").take(row),
                            batch.column("n").take(row),
                            pa.array([joined[i * n : i * n + n] for i in range(len(w))], pa.string()),
                        ],
                        names=["word", "n", "near"],
                    )

    return words.mapInArrow(probe, "word string, n long, near string")


def near_pairs(
    words: DataFrame, word_bits: int = WORD_BITS, round_bytes: int = ROUND_BYTES
) -> DataFrame:
    """``word, n, near, near_n`` of all ordered pairs of words one edit apart.

    ``words`` (``word, n``) has each word once and is read several times. An edit is one inserted,
    deleted or replaced character. Filters of ``word_bits`` for each word are held by tasks,
    ``round_bytes`` of them at once; both change the work, never the result.
    """
    chars = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c"))
    # letters of the vocabulary: some ninety at most, where words are runs of Latin letters
    letters = [r["c"] for r in chars.where("c != ''").distinct().collect()]
    alphabet = np.array(sorted(ord(c) for c in letters), np.uint32)
    found = words.select("word", "n").withColumns({"near": F.col("word"), "near_n": F.col("n")}).limit(0)
    other = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    for filters in _plan(words, word_bits, round_bytes):
        _fill(words, filters)
        held = words.sparkSession.sparkContext.broadcast(filters)
        found = found.unionByName(_probe(words, alphabet, held).join(other, "near"))
    pairs = durable(found, "near-words")
    return pairs.unionByName(
        pairs.select(
            F.col("near").alias("word"),
            F.col("near_n").alias("n"),
            F.col("word").alias("near"),
            F.col("n").alias("near_n"),
        )
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form (``word, form``), by pointer doubling.

    A form is more frequent than its word, so chains end; their length is at most the logarithm of
    the largest count, and rounds are as many as that length's logarithm.
    """
    up = durable(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        next_ = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = up.join(next_, "root", "left")
        up = durable(
            joined.select(
                "word",
                F.coalesce("further", "root").alias("root"),
                F.col("further").isNotNull().alias("moved"),
            ),
            "roots",
        )
        if up.where("moved").isEmpty():
            return up.select("word", "root")
        up = up.drop("moved")


def spelling_variants(
    words: DataFrame, ratio: int = RATIO, word_bits: int = WORD_BITS, round_bytes: int = ROUND_BYTES
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``words`` (``word, n``; each word
    once).

    A word's form is the most frequent of its near words (of several the first in character order)
    if that is ``ratio`` times as frequent or more, else null; ``root`` follows forms to the last.
    A word without near words has ``n_near`` 0, no form and itself as root; an empty vocabulary
    gives no rows; other columns of ``words`` are not read.
    """
    if ratio < 2:
        raise ValueError("a form is at least twice as frequent")
    words = words.select("word", "n")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = (
        near_pairs(words, word_bits, round_bytes)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
        .select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    )
    has = F.col("form_n") >= ratio * F.col("n")
    judged = durable(
        words.join(near, "word", "left").select(
            "word",
            F.when(has, F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has, F.col("form_n")).alias("form_n"),
        ),
        "judged-words",
    )
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
