"""Token ids of whole texts, with each different word encoded once by the tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tablume.llm.common import WHITE_SPACE, Words, slices

#: Words whose ids a worker keeps, about 40 bytes each; beyond, those that were met once go.
WORDS_KEPT = 2_500_000
#: New words wait in a small table, so that the large one is rarely rebuilt.
_RECENT = 150_000
_AT_ONCE = 1000
_MARK = "\x01"


class _Table:
    """Ids of words by the words' hashes, as sorted arrays."""

    def __init__(self):
        self.hashes = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int32)
        self.again = np.zeros(0, bool)
        self.ids = np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == hashes[inside]
        return place, known

    def add(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray, again: np.ndarray) -> None:
        """Add words that it doesn't have, sorted by hash."""
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        place = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.starts = np.insert(self.starts, place, starts)
        self.lengths = np.insert(self.lengths, place, lengths)
        self.again = np.insert(self.again, place, again)
        self.ids = np.concatenate([self.ids, ids])

    def of(self, place: np.ndarray) -> np.ndarray:
        """The ids of the words at ``place``, one after the other."""
        lengths = self.lengths[place].astype(np.int64)
        total = np.cumsum(lengths)
        shift = np.repeat(self.starts[place] - total + lengths, lengths)
        return self.ids[shift + np.arange(total[-1] if len(total) else 0)]

    def forget(self) -> None:
        """Keep the words met again since the last time; all go if those are too many too."""
        kept = np.flatnonzero(self.again)
        if 4 * len(kept) > 3 * WORDS_KEPT:
            kept = kept[:0]
        hashes, lengths, ids = self.hashes[kept], self.lengths[kept], self.of(kept)
        self.__init__()
        self.add(hashes, lengths, ids, np.zeros(len(hashes), bool))


class WordTokenizer:
    """Encodes texts with a tokenizer whose pieces never hold white space.

    Such a tokenizer gives the same ids for a text as for its words one after the other, so words
    are looked up by a 64-bit hash and only new ones are encoded, many in one call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._encoded(_MARK)
        self.main, self.recent = _Table(), _Table()

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(
            self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32
        )

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        parts, lengths = [], []
        for at in range(0, len(words), _AT_ONCE):
            some = words[at : at + _AT_ONCE]
            if len(self.mark) == 1 and not any(_MARK in w for w in some):
                ids = self._encoded(f" {_MARK} ".join([*some, ""]))
                marks = np.flatnonzero(ids == self.mark[0])
                if len(marks) == len(some):
                    parts.append(np.delete(ids, marks))
                    lengths.append(np.diff(marks, prepend=-1) - 1)
                    continue
            each = [self._encoded(w) for w in some]
            parts += each
            lengths.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(parts), np.concatenate(lengths)

    def _words(self, words: Words) -> tuple[_Table, np.ndarray]:
        """A table that has all the words, and the place of each."""
        unique, example, which = np.unique(words.hash, return_index=True, return_inverse=True)
        place, known = self.main.find(unique)
        self.main.again[place[known]] = True
        rest = np.flatnonzero(~known)
        early, met = self.recent.find(unique[rest])
        self.recent.again[early[met]] = True
        new = rest[~met]
        here = _Table()
        ids, lengths = [self.main.of(place[known])], [self.main.lengths[place[known]]]
        ids.append(self.recent.of(early[met]))
        lengths.append(self.recent.lengths[early[met]])
        if len(new):
            texts = [words.word(i).decode("utf-8", "replace") for i in example[new].tolist()]
            found, counts = self._new(texts)
            ids.append(found)
            lengths.append(counts)
            self.recent.add(unique[new], counts, found, np.zeros(len(new), bool))
        # the words of this slice, as they were found
        order = np.concatenate([np.flatnonzero(known), rest[met], new])
        here.ids, here.lengths = np.concatenate(ids), np.concatenate(lengths).astype(np.int32)
        here.starts = np.cumsum(here.lengths, dtype=np.int64) - here.lengths
        at = np.empty(len(unique), np.int64)
        at[order] = np.arange(len(unique))
        if len(self.recent.hashes) > _RECENT:
            r = self.recent
            self.main.add(r.hashes, r.lengths, r.of(np.arange(len(r.hashes))), r.again)
            self.recent = _Table()
            if len(self.main.hashes) > WORDS_KEPT:
                self.main.forget()
        return here, at[which]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        out = np.zeros(len(texts), np.int64)
        for at, to, data, offsets in slices(texts):
            words = Words(data, offsets, WHITE_SPACE, lower=False)
            table, place = self._words(words)
            total = np.zeros(len(place) + 1, np.int64)
            np.cumsum(table.lengths[place], out=total[1:])
            out[at:to] = np.diff(total[words.first])
        return out

    def encoded(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(from, to, ids, first)`` of runs of texts; ``first`` is where each text's ids start."""
        for at, to, data, offsets in slices(texts):
            words = Words(data, offsets, WHITE_SPACE, lower=False)
            table, place = self._words(words)
            total = np.zeros(len(place) + 1, np.int64)
            np.cumsum(table.lengths[place], out=total[1:])
            yield at, to, table.of(place), total[words.first]


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, loaded once by each worker."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def with_end(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts with the id ``end`` after each text."""
    return np.insert(ids, first[1:], end), first + np.arange(len(first))


def pieces(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, piece, start, length)`` of cuts into ``size``; each text has an id at least."""
    counts = np.diff(first)
    number = -(-counts // size)
    text = np.repeat(np.arange(len(counts)), number)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    start = piece * size
    return text, piece, start, np.minimum(counts[text] - start, size)
