"""Collocations: phrases whose words meet much more often than chance.

Phrases are counted level by level. The frequent phrases of one level are broadcast as a
double-array trie; every task walks all its text positions through it at once, one word a level,
and only positions whose first and last words are frequent phrases themselves can start a longer
one (Apriori). Such positions' edges out of the trie are counted by tasks and summed by Spark, and
those that reach the least count are the next level. A trie has a bounded number of phrases; a
level with more is cut into several by the phrases' first word, each walked by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablume.llm.common import _PRIME, Words, durable, lower_ascii, mixed, slices

LONGEST = 5
LEAST_COUNT = 100
TOP = 2000
#: Phrases in one trie (about 100 bytes each, with the words that they use).
TRIE_PHRASES = 1_000_000
#: Edges that a task gathers before it sums them, and rows that it hands over at once.
_GATHERED = 1 << 20
_HANDED = 1 << 16
#: Places looked at when children of one state are placed, each child counted.
_TRIED = 1 << 18

_BREAKS = bytes([*b".,;:!?", *range(0x0A, 0x0E)])
_SEPARATORS = b" \t" + _BREAKS


class _Pieces:
    """The words of a slice, as hashes that also tell the language, and which of them follow each
    other in one piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray):
        self.words = words = Words(data, offsets, _SEPARATORS, lower=True)
        text = np.repeat(np.arange(len(lang)), words.counts)
        self.key = mixed(words.hash + lang.view(np.uint64)[text] * _PRIME)
        self.text = text
        is_break = np.zeros(256, bool)
        is_break[list(_BREAKS)] = True
        piece = np.cumsum(is_break[data])[words.start] if len(data) else words.start
        self.follows = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])


def _read(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        lang = batch.column("lang_key").to_numpy(zero_copy_only=False)
        for at, to, data, offsets in slices(batch.column("text")):
            yield batch, at, _Pieces(data, offsets, lang[at:to])


# --- double-array trie -------------------------------------------------------------------------


class Trie:
    """Phrases of one length as a double array: from a state ``s`` the word of code ``c`` leads to
    ``base[s] + c`` if ``check`` there is ``s``. The root is state 0."""

    def __init__(self, phrases: np.ndarray, ids: np.ndarray):
        """``phrases`` has a row of word keys for each phrase, ``ids`` what each is called."""
        self.depth = phrases.shape[1]
        self.keys, which, often = np.unique(phrases, return_inverse=True, return_counts=True)
        # frequent words have small codes, so that the children of a state lie close together
        code = np.empty(len(self.keys), np.int64)
        code[np.argsort(-often, kind="stable")] = np.arange(1, len(self.keys) + 1)
        self.code = code
        codes = code[which.reshape(phrases.shape)]
        self.base = np.zeros(1, np.int64)
        self.check = np.full(1, -1, np.int64)
        self._low, self._top = 1, 1  # places before the one are taken, from the other on free
        self._loose = 1
        state = np.zeros(len(phrases), np.int64)
        for level in range(self.depth):
            state = self._add(state, codes[:, level])
        self.base, self.check = self.base[: self._top], self.check[: self._top]
        self.id = np.zeros(len(self.check), np.int64)
        self.id[state] = ids
        self.accepts = np.zeros(len(self.check), bool)
        self.accepts[state] = True

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def _add(self, parent: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Give each parent its children; the child of every phrase."""
        width = int(self.code.max()) + 1
        edge, which = np.unique(parent * width + code, return_inverse=True)
        of, child = edge // width, edge % width
        parents, begin, number = np.unique(of, return_index=True, return_counts=True)
        for k in np.argsort(-number, kind="stable").tolist():
            codes = child[begin[k] : begin[k] + number[k]]
            base = self._room(codes)
            self._top = max(self._top, base + int(codes[-1]) + 1)
            self._grow(self._top)
            self.base[parents[k]] = base
            self.check[base + codes] = parents[k]
        return (self.base[of] + child)[which]

    def _room(self, codes: np.ndarray) -> int:
        """A base whose places for the codes (in order) are all free."""
        first, span = int(codes[0]), int(codes[-1]) - int(codes[0]) + 1
        while self._low < self._top and self.check[self._low] != -1:
            self._low += 1
        # the first free places are crowded; the last stretch opened behind everything is not
        for start in (self._low, self._loose):
            at = max(start, first + 1)
            for look in (64, 512, 4096):
                end = min(at + look, self._top)
                if at >= end:
                    break
                self._grow(end + span)
                free = np.flatnonzero(self.check[at:end] == -1) + at
                free = free[: max(1, _TRIED // len(codes))]
                fits = (self.check[(free - first)[:, None] + codes] == -1).all(axis=1)
                if len(free) and fits.any():
                    return int(free[np.argmax(fits)]) - first
                at = end
        self._loose = max(self._top, first + 1)  # behind everything
        return self._loose - first

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """The codes of words; 0 for those that no phrase has."""
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.code[place], 0)

    def walk(self, code: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """The state each position reaches after ``depth`` words, all positions at once; 0: none."""
        n = len(code)
        state = self._step(np.zeros(n, np.int64), code)
        for level in range(1, self.depth):
            ahead = np.zeros(n, np.int64)
            if level < n:
                # the word before the one a level ahead goes on in this piece
                ahead[: n - level] = np.where(follows[level - 1 :], code[level:], 0)
            state = np.where(state > 0, self._step(state, ahead), 0)
        return state

    def _step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        place = np.minimum(self.base[state] + code, len(self.check) - 1)
        return np.where((code > 0) & (self.check[place] == state), place, 0)


# --- levels ------------------------------------------------------------------------------------


def _texts(documents: DataFrame, lang_column: str, text_column: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_column).cast("string"), F.lit("und"))
    return documents.select(
        lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), F.col(text_column).alias("text")
    )


def _words(texts: DataFrame) -> DataFrame:
    """``lang, phrase, key, n`` of all words, and a row without a phrase for all of a language's
    together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, pieces in _read(batches):
            key, example, n = np.unique(pieces.key, return_index=True, return_counts=True)
            words = [pieces.words.word(i) for i in example.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").take(pa.array(at + pieces.text[example])),
                    pa.array(words, pa.binary()).cast(pa.string()),
                    pa.array(key.view(np.int64)),
                    pa.array(n),
                ],
                names=["lang", "phrase", "key", "n"],
            )
            there, row, which = np.unique(
                batch.column("lang_key").to_numpy(zero_copy_only=False)[at + pieces.text],
                return_index=True, return_inverse=True,
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").take(pa.array(at + pieces.text[row])),
                    pa.nulls(len(there), pa.string()),
                    pa.array(np.zeros(len(there), np.int64)),
                    pa.array(np.bincount(which, minlength=len(there))),
                ],
                names=["lang", "phrase", "key", "n"],
            )

    found = texts.mapInArrow(count, "lang string, phrase string, key long, n long")
    lowered = found.withColumn("phrase", lower_ascii(F.col("phrase")))
    return lowered.groupBy("lang", "phrase", "key").agg(F.sum("n").alias("n"))


def _tries(phrases: DataFrame, limit: int) -> Iterator[tuple[Trie, bool]]:
    """Tries of bounded size for the phrases of a level, and whether one holds all of them."""
    number = phrases.count()
    shards = -(-number // limit)
    for k in range(shards):
        # a first word with very many phrases is cut by the whole phrase
        some = phrases.where(F.pmod("id", F.lit(shards)) == k) if shards > 1 else phrases
        rows = some.select("id", "keys").toArrow()
        if rows.num_rows:
            keys = rows["keys"].combine_chunks().flatten().to_numpy().view(np.uint64)
            yield Trie(keys.reshape(rows.num_rows, -1), rows["id"].to_numpy()), shards == 1


def _edges(texts: DataFrame, held: Broadcast, whole: bool, least: int) -> DataFrame:
    """``id, key, n``: phrases of the trie and words that follow them ``least`` times or more.

    Where one trie holds all phrases of the level, the words that may follow have codes in it, and
    state and code are shuffled as one number.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: Trie = held.value
        gathered: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for _, _, pieces in _read(batches):
            state = trie.walk(trie.codes(pieces.key), pieces.follows)
            n = len(state)
            last = np.arange(n) + trie.depth
            start = np.flatnonzero(state)
            start = start[last[start] < n]
            start = start[pieces.follows[last[start] - 1]]
            if whole:
                # the phrase without its first word must be frequent too
                start = start[state[start + 1] > 0]
            after = trie.codes(pieces.key[last[start]]).view(np.uint64) if whole else pieces.key[last[start]]
            gathered.append((state[start], after))
            size += len(start)
            if size > _GATHERED:
                yield from _summed(trie, gathered)
                gathered, size = [], 0
        if size:
            yield from _summed(trie, gathered)

    names = ["state", "after"]
    counted = texts.mapInArrow(walk, "state int, after long, n long")
    if whole:
        names = ["edge"]
        counted = counted.select(
            F.expr("shiftleft(CAST(state AS LONG), 32) + after").alias("edge"), "n"
        )
    counted = counted.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    if whole:
        counted = counted.select(
            F.shiftright("edge", 32).cast("int").alias("state"),
            F.expr("edge & 4294967295").alias("after"),
            "n",
        )

    def called(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: Trie = held.value
        keys = np.zeros(len(trie.keys) + 1, np.uint64)
        keys[trie.code] = trie.keys
        for batch in batches:
            state, after, n = (batch.column(i) for i in range(3))
            key = pa.array(keys[after.to_numpy()].view(np.int64)) if whole else after
            yield pa.RecordBatch.from_arrays(
                [pa.array(trie.id[state.to_numpy()]), key, n], names=["id", "key", "n"]
            )

    return counted.mapInArrow(called, "id long, key long, n long")


def _summed(trie: Trie, gathered: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    state = np.concatenate([s for s, _ in gathered])
    after = np.concatenate([k for _, k in gathered])
    _, example, which = np.unique(
        mixed(after + state.astype(np.uint64) * _PRIME), return_index=True, return_inverse=True
    )
    n = np.bincount(which)
    for at in range(0, len(example), _HANDED):
        some = example[at : at + _HANDED]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(state[some].astype(np.int32)),
                pa.array(after[some].view(np.int64)),
                pa.array(n[at : at + _HANDED]),
            ],
            names=["state", "after", "n"],
        )


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.xxhash64("lang", "phrase"))


def phrase_counts(
    documents: DataFrame, lang_column: str = "lang", text_column: str = "text",
    longest: int = LONGEST, least: int = LEAST_COUNT, trie_phrases: int = TRIE_PHRASES,
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, n`` of all phrases of one to ``longest`` words that occur ``least``
    times or more, and ``lang, total``: all words of each language.

    Texts are lower-cased (A-Z) and cut at ``.,;:!?`` and line ends into pieces, these at spaces and
    tabs into words; phrases never leave a piece, and all their places count, overlapping ones too.
    A null language is ``und``, a null or empty text has no words, repeated rows count each time.
    """
    if longest < 1 or least < 1:
        raise ValueError("phrases have a word at least and occur at least once")
    texts = _texts(documents, lang_column, text_column)
    frequent = (F.col("n") >= least) | F.col("phrase").isNull()
    words = durable(_words(texts).where(frequent), "words")
    totals = words.where("phrase IS NULL").select("lang", F.col("n").alias("total"))
    level = _named(words.where("phrase IS NOT NULL"))
    level = durable(level.withColumn("keys", F.array("key")).drop("key"), "phrases-1")
    vocabulary = level.select(
        F.col("phrase").alias("word"), "lang", F.col("keys")[0].alias("key")
    )
    if vocabulary.groupBy("key").count().where("count > 1").limit(1).count():
        raise RuntimeError("two words of one 64-bit hash; use another hash")
    shape = [F.col("lang"), F.col("phrase"), F.size("keys").cast("long").alias("words"), F.col("n")]
    levels = level.select(*shape)
    for k in range(2, longest + 1):
        counted = None
        for trie, whole in _tries(level, trie_phrases):
            held = documents.sparkSession.sparkContext.broadcast(trie)
            some = _edges(texts, held, whole, least)
            counted = some if counted is None else counted.unionByName(some)
        if counted is None:
            break
        longer = (
            counted.join(level.select("id", "lang", "phrase", "keys"), "id")
            .join(vocabulary, ["lang", "key"])
            .select(
                "lang",
                F.concat_ws(" ", "phrase", "word").alias("phrase"),
                F.array_append("keys", F.col("key")).alias("keys"),
                "n",
            )
        )
        level = durable(_named(longer), f"phrases-{k}")
        levels = levels.unionByName(level.select(*shape))
    return levels, totals


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")


def collocations(
    documents: DataFrame, lang_column: str = "lang", text_column: str = "text",
    longest: int = LONGEST, least: int = LEAST_COUNT, top: int = TOP, trie_phrases: int = TRIE_PHRASES,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of two words or
    more.

    A phrase of count ``a`` is cut after each of its words; with ``l`` and ``r`` the counts of the
    two sides and ``n`` all words of the language, the cut's score is ``floor(1000 a n / (l r))``,
    and the lowest cut (of several the first) counts. A phrase that always occurs inside one longer
    phrase is left out. Ties in score go to the more frequent, then to the first in byte order.
    Texts are read as by :func:`phrase_counts`; a table without frequent phrases gives no rows.
    """
    counts, totals = phrase_counts(documents, lang_column, text_column, longest, least, trie_phrases)
    counts = durable(counts, "phrase-counts")
    words = F.split("phrase", " ")
    candidates = counts.where("words > 1").withColumnRenamed("n", "a")
    # one word more is enough: what is between a phrase and a longer one is as frequent as the latter
    inside = candidates.where("words > 2").withColumn("w", words).select(
        "lang",
        F.explode(
            F.array(
                F.array_join(F.expr("slice(w, 1, size(w) - 1)"), " "),
                F.array_join(F.expr("slice(w, 2, size(w) - 1)"), " "),
            )
        ).alias("phrase"),
        F.col("a").alias("longer"),
    ).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    cuts = (
        candidates.join(inside, ["lang", "phrase"], "left")
        .where("longer IS NULL OR longer < a")
        .withColumn("w", words)
        .withColumn("k", F.explode(F.expr("sequence(1, size(w) - 1)")))
        .select(
            "lang",
            "phrase",
            "a",
            "k",
            F.array_join(F.expr("slice(w, 1, k)"), " ").alias("head"),
            F.array_join(F.expr("slice(w, k + 1, size(w) - k)"), " ").alias("rest"),
        )
        .join(left, ["lang", "head"])
        .join(right, ["lang", "rest"])
        .join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
        .withColumnRenamed("total", "n")
        .withColumns({"a_": _exact("a"), "n_": _exact("n"), "l_": _exact("l"), "r_": _exact("r")})
        .withColumn("score", F.expr("(CAST(1000 AS DECIMAL(4,0)) * a_ * n_) div (l_ * r_)"))
    )
    lowest = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (
        lowest.select("lang", "phrase", "cut.*")
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
