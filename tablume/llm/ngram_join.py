"""N-gram Jaccard join by a pigeonhole over partitions of the universe.

Texts are sets of word shingles; two texts link when the Jaccard similarity of their sets is 0.8
or more. Sets are banded by size. In each band hashing deals the shingles over segments; sets
that link differ in few shingles, so they must agree in one segment that neither leaves empty
(or nearly agree, where a band is cheaper with one-deletion neighbourhoods), and signatures of
segments find the pairs, which are then compared exactly.

Equal sets are one node. Signatures that many sets share are not expanded: a set that has enough
rare ones needs no others, and the rest (large groups of near copies) are compared with one pivot
for each signature; by the triangle inequality what else may link shares shingles in which both
differ from the pivot, which a prefix filter finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablume.llm.common import WHITE_SPACE, Words, durable, fresh, mixed, slices, windows
from tablume.llm.components import components

SHINGLE = 5
#: Mean shingles of a segment in a band's largest set: for equal segments, and with deletions.
EXACT_FILL, DELETION_FILL = 3.6, 6.0
#: A signature of more sets is common: its pairs are found by other signatures or by pivots.
RARE = 8
#: Ids that tasks may hold to pick rows out of the texts (8 bytes each); beyond, rows are joined.
IDS_HELD = 1_000_000
#: Sets around one pivot are counted against each other in blocks of about so many.
BLOCK = 256
SIGNATURES_PER_PART = 1_500_000

EXACT, DELETION, TOKEN = 0, 1, 2

PROFILE = (
    "id long, n long, digest long, check long, band int, exact long, deletion long, "
    "deletion_cost long, low_exact long, low_deletion long, key long"
)


# --- sets --------------------------------------------------------------------------------------


class Sets:
    """The distinct shingles of the texts of a slice, text by text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, WHITE_SPACE, lower=True)
        h, first = windows(words, SHINGLE, True)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        _, index = np.unique(mixed(h + text.astype(np.uint64)), return_index=True)
        index.sort()
        self.shingle, self.text = h[index], text[index]
        self.first = np.searchsorted(self.text, np.arange(len(first)))
        self.size = np.diff(self.first)
        self.mixed = mixed(self.shingle)

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sums by text, modulo 2^64."""
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        return sums[self.first[1:]] - sums[self.first[:-1]]

    @property
    def digest(self) -> np.ndarray:
        """62 bits that name a set."""
        salted = mixed(self.total(self.mixed) + self.size.astype(np.uint64))
        return (salted >> np.uint64(2)).astype(np.int64)

    @property
    def check(self) -> np.ndarray:
        return self.total(mixed(self.mixed + np.uint64(1))).view(np.int64)


def band_of(size: np.ndarray) -> np.ndarray:
    """Band k has sizes from 2^k up to 2^(k+1) - 1."""
    return np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1


def in_next_band(size: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Whether a set may link with a larger one of the next band: 1.25 times its size reaches it."""
    return 5 * size >= 4 * (np.int64(2) << band.astype(np.int64))


def segments_of(band: np.ndarray, fill: float) -> np.ndarray:
    return np.maximum(1, np.ceil((2.0 ** (band + 1)) / fill)).astype(np.int64)


class Segments:
    """Segments of the sets of a slice: for each, how many shingles and the sum of their hashes."""

    def __init__(self, sets: Sets, chosen: np.ndarray, band: np.ndarray, fill: float):
        number = np.where(chosen, segments_of(band, fill), 0)
        self.first = np.concatenate([[0], np.cumsum(number)])
        mask = chosen[sets.text]
        self.text, values = sets.text[mask], sets.mixed[mask]
        draw = (mixed(values) >> np.uint64(33)).astype(np.int64)
        self.place = self.first[self.text] + draw % np.maximum(number[self.text], 1)
        self.values = values
        self.count = np.bincount(self.place, minlength=self.first[-1])
        self.sum = np.zeros(self.first[-1], np.uint64)
        np.add.at(self.sum, self.place, values)
        self.owner = np.repeat(np.arange(len(chosen)), number)
        self.number = np.arange(self.first[-1]) - np.repeat(self.first[:-1], number)

    def capacity(self, deletions: bool) -> np.ndarray:
        """Differences that the segments of each set absorb at least, and one more."""
        each = (self.count > 0).astype(np.int64)
        if deletions:
            each += self.count > 1
        return np.bincount(self.owner, weights=each, minlength=len(self.first) - 1).astype(np.int64)

    def signatures(self, band: np.ndarray, deletions: bool) -> tuple[np.ndarray, np.ndarray]:
        """``(text, signature)``; segments without shingles have none."""
        base = mixed((band[self.owner].astype(np.uint64) << np.uint64(40)) + self.number.astype(np.uint64))
        there = self.count > 0
        text, out = self.owner[there], mixed(base[there] + self.sum[there])
        if deletions:
            several = self.count[self.place] > 1
            place = self.place[several]
            text = np.concatenate([text, self.text[several]])
            out = np.concatenate([out, mixed(base[place] + self.sum[place] - self.values[several])])
        return text, out


def profiles(texts: DataFrame) -> DataFrame:
    """One narrow row for each text: its set's size and digest, and what each allocation gives."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in slices(batch.column(1)):
                sets = Sets(data, offsets)
                band = band_of(sets.size)
                some = sets.size > 0
                low = some & in_next_band(sets.size, band)
                columns = [sets.size.astype(np.int64), sets.digest, sets.check, band.astype(np.int32)]
                for fill, deletions in ((EXACT_FILL, False), (DELETION_FILL, True)):
                    own = Segments(sets, some, band, fill)
                    columns.append(own.capacity(deletions))
                    if deletions:
                        cost = np.bincount(
                            own.owner, weights=(own.count > 0) + own.count * (own.count > 1),
                            minlength=to - at,
                        )
                        columns.append(cost.astype(np.int64))
                for fill, deletions in ((EXACT_FILL, False), (DELETION_FILL, True)):
                    columns.append(Segments(sets, low, band + 1, fill).capacity(deletions))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        *map(pa.array, columns),
                        batch.column(2).slice(at, to - at),
                    ],
                    schema=pa.schema(
                        [(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in PROFILE.split(", ")]
                    ),
                )

    return texts.mapInArrow(profile, PROFILE)


def allocation(profiled: DataFrame) -> tuple[dict[int, int], int]:
    """The cheapest allocation for each band in which no set is short, and all signatures.

    A set of n shingles and one of at most as many differ in 2n/9 at most if they link, so its
    segments must absorb that many. Single shingles as segments always do.
    """
    need = F.floor(2 * F.col("n") / 9)
    found = (
        profiled.where("n > 0")
        .groupBy("band")
        .agg(
            F.min(F.col("exact") - need).alias("exact_spare"),
            F.min(F.col("deletion") - need).alias("deletion_spare"),
            F.sum("exact").alias("exact_cost"),
            F.sum("deletion_cost").alias("deletion_cost"),
            F.sum("n").alias("token_cost"),
        )
        .collect()  # a row for each power of two
    )
    chosen, total = {}, 0
    for r in found:
        costs = [(r["token_cost"], TOKEN)]
        if r["exact_spare"] > 0:
            costs.append((r["exact_cost"], EXACT))
        if r["deletion_spare"] > 0:
            costs.append((r["deletion_cost"], DELETION))
        cost, chosen[r["band"]] = min(costs)
        total += cost
    return chosen, total


def signatures(texts: DataFrame, chosen: dict[int, int]) -> DataFrame:
    """``signature, entry``: entry is twice the set's digest, and one more in the next band."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(1)):
                sets = Sets(data, offsets)
                own_band, digest = band_of(sets.size), sets.digest
                once = np.zeros(len(digest), bool)
                once[np.unique(digest, return_index=True)[1]] = True
                once &= sets.size > 0
                for low in (0, 1):
                    band = own_band + low
                    kind = np.array([chosen.get(b, -1) for b in band.tolist()], np.int64)
                    part = once & (in_next_band(sets.size, own_band) if low else True)
                    for fill, k in ((EXACT_FILL, EXACT), (DELETION_FILL, DELETION)):
                        some = part & (kind == k)
                        if some.any():
                            text, out = Segments(sets, some, band, fill).signatures(band, k == DELETION)
                            yield _signed(out, 2 * digest[text] + low)
                    some = (part & (kind == TOKEN))[sets.text]
                    if some.any():
                        text = sets.text[some]
                        salt = mixed((band[text].astype(np.uint64) << np.uint64(40)))
                        yield _signed(mixed(sets.mixed[some] + salt), 2 * digest[text] + low)

    return texts.mapInArrow(sign, "signature long, entry long")


def _signed(signature: np.ndarray, entry: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(signature.view(np.int64)), pa.array(entry)], names=["signature", "entry"]
    )


# --- groups of sets that share a signature ------------------------------------------------------


def shared(signed: DataFrame, parts: int) -> DataFrame:
    """``a, b, times, common``: pairs of digests and how many rare signatures they share (in all
    rows of a pair), and, where ``common``, entry and signature of common ones.

    Rows come sorted by signature; a task holds one batch and at most RARE rows more.
    """

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signature, entry = np.zeros(0, np.int64), np.zeros(0, np.int64)
        common = None  # the signature that a run of common rows goes on with
        pairs: list[np.ndarray] = []
        for batch in batches:
            signature = np.concatenate([signature, batch.column(0).to_numpy()])
            entry = np.concatenate([entry, batch.column(1).to_numpy()])
            new = np.ones(len(signature), bool)
            new[1:] = (signature[1:] != signature[:-1]) | (entry[1:] != entry[:-1])
            signature, entry = signature[new], entry[new]
            if not len(signature):
                continue
            last = np.searchsorted(signature, signature[-1])
            if common is not None and signature[0] != common:
                common = None
            if common is not None or len(signature) - last > RARE:
                stop, goes_on = len(signature), len(signature) - last > RARE or common == signature[-1]
            else:
                stop, goes_on = last, False
            if common is not None and common != signature[-1] and len(signature) - last <= RARE:
                stop = last
            yield from _grouped(signature[:stop], entry[:stop], common, pairs)
            common = signature[-1] if goes_on else None
            signature, entry = signature[stop:], entry[stop:]
        yield from _grouped(signature, entry, common, pairs)
        yield from _emit(pairs)

    return (
        signed.repartition(parts, "signature")
        .sortWithinPartitions("signature", "entry")
        .mapInArrow(group, "a long, b long, times long, common boolean")
    )


def _grouped(signature, entry, common, pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs of the rare runs are gathered; rows of common runs are given out."""
    if not len(signature):
        return
    begin = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]]))
    length = np.diff(np.concatenate([begin, [len(signature)]]))
    many = length > RARE
    if common is not None and signature[0] == common:
        many[0] = True
    size = np.repeat(np.where(many, 0, length), length)
    for step in range(1, RARE):
        a = np.flatnonzero(size[:-step] > step) if len(size) > step else np.zeros(0, np.int64)
        a = a[signature[a] == signature[a + step]]
        # two sets that are both here from the band below meet in their own band
        a = a[(entry[a] & entry[a + step] & 1) == 0]
        if len(a):
            x, y = entry[a] >> 1, entry[a + step] >> 1
            pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[x != y])
    if sum(map(len, pairs)) > 200_000:
        yield from _emit(pairs)
    held = np.repeat(many, length)
    if held.any():
        yield _found(entry[held], signature[held], True)


def _emit(pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if pairs:
        every = np.concatenate(pairs)
        pairs.clear()
        every = every[np.lexsort((every[:, 1], every[:, 0]))]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]).any(axis=1)
        begin = np.flatnonzero(new)
        times = np.diff(np.append(begin, len(every)))
        yield _found(every[begin, 0], every[begin, 1], False, times)


def _found(a: np.ndarray, b: np.ndarray, common: bool, times: np.ndarray | None = None) -> pa.RecordBatch:
    times = np.ones(len(a), np.int64) if times is None else times
    columns = [pa.array(a), pa.array(b), pa.array(times), pa.array(np.full(len(a), common))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "times", "common"])


def entries(profiled: DataFrame, chosen: dict[int, int], common: DataFrame) -> DataFrame:
    """``entry, digest, n, capacity, weight, times`` of each set in its own band and, where it has
    signatures there, in the next: what its segments absorb, how much of that one signature
    stands for at most, and how many of its signatures are common."""
    kinds = F.create_map(*[F.lit(x) for kv in (chosen or {-1: TOKEN}).items() for x in kv])
    each = profiled.where("n > 0").dropDuplicates(["digest"])
    parts = []
    for low, exact, deletion in ((0, "exact", "deletion"), (1, "low_exact", "low_deletion")):
        kind = F.try_element_at(kinds, F.col("band") + low)
        some = each.where(kind.isNotNull())
        if low:
            some = some.where(5 * F.col("n") >= 4 * F.expr("shiftleft(2L, band)"))
        capacity = F.when(kind == EXACT, F.col(exact)).when(kind == DELETION, F.col(deletion))
        parts.append(
            some.select(
                (2 * F.col("digest") + low).alias("entry"),
                "digest",
                "n",
                F.coalesce(capacity, "n").alias("capacity"),
                F.when(kind == DELETION, 2).otherwise(1).alias("weight"),
            )
        )
    counts = common.groupBy("entry").agg(F.count("*").alias("times"))
    both = parts[0].unionByName(parts[1])
    return both.join(counts, "entry", "left").withColumn("times", F.coalesce("times", F.lit(0)))


def candidates(pairs: DataFrame, entry: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that share as many signatures as sets that link must.

    If they link they differ in (a + b) / 9 shingles at most; the segments of the larger set that
    these leave alone are shared signatures, rare ones, counted here, or common ones.
    """
    own = entry.where("entry % 2 = 0")
    side = lambda c: own.select(
        F.col("digest").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("n", "capacity", "weight", "times"))
    )
    larger = lambda x: F.when(F.col("a_n") >= F.col("b_n"), F.col(f"a_{x}")).otherwise(F.col(f"b_{x}"))
    left_alone = larger("capacity") - F.floor((F.col("a_n") + F.col("b_n")) / 9)
    return (
        pairs.groupBy("a", "b")
        .agg(F.sum("times").alias("shared"))
        .join(side("a"), "a")
        .join(side("b"), "b")
        .where(5 * F.least("a_n", "b_n") >= 4 * F.greatest("a_n", "b_n"))
        .where((F.col("shared") + larger("times")) * larger("weight") >= left_alone)
        .select("a", "b")
    )


def pivots(common: DataFrame, entry: DataFrame) -> DataFrame:
    """``a, b``: a pivot's digest, and that of each set that must be compared with it.

    ``common`` has ``entry, signature``. An entry whose other signatures absorb all differences is
    found by those; pairs of the remaining entries share a common signature, whose pivot is the
    entry with most of them. All entries of a signature are compared with one pivot.

    A set of n shingles may be the smaller one of a pair, also in its own band: it then differs in
    n/4 at most from a larger one it links with, which is more than 2n/9.
    """
    need = F.floor(F.col("n") / 4)
    needy = entry.where((F.col("times") > 0) & (F.col("capacity") - F.col("times") * F.col("weight") <= need))
    rows = durable(common.join(needy.select("entry", "times"), "entry"), "common-signatures")
    centre = rows.groupBy("signature").agg(
        F.max(F.struct("times", "entry")).alias("centre"), F.count("*").alias("sets")
    )
    around = rows.join(centre.where("sets > 1"), "signature")
    # an entry's hub is the foremost of its signatures' pivots; a signature whose entries all have
    # one hub needs no pivot of its own
    hubs = around.groupBy("entry").agg(F.max("centre").alias("hub"))
    hubbed = durable(
        around.join(hubs, "entry").select(
            "signature", "entry", F.col("centre.entry").alias("centre"), F.col("hub.entry").alias("hub")
        ),
        "hubs",
    )
    of_one = hubbed.groupBy("signature").agg((F.min("hub") == F.max("hub")).alias("one"))
    return (
        hubbed.join(of_one, "signature")
        .select(F.when(F.col("one"), F.col("hub")).otherwise(F.col("centre")).alias("pivot"), "entry")
        .select(F.expr("pivot div 2").alias("a"), F.expr("entry div 2").alias("b"))
        .where("a != b")
        .distinct()
    )


# --- comparing sets -----------------------------------------------------------------------------


def sets_of(texts: DataFrame, wanted: DataFrame, ids_held: int) -> DataFrame:
    """``digest, shingles`` (sorted 64-bit numbers) of the texts whose ids are ``wanted``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(1)):
                sets = Sets(data, offsets)
                if not len(sets.first):
                    continue
                order = np.lexsort((sets.shingle, sets.text))
                content = sets.shingle[order].astype("<u8").tobytes()
                cut = [content[8 * a : 8 * b] for a, b in zip(sets.first[:-1].tolist(), sets.first[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sets.digest), pa.array(cut, pa.binary())], names=["digest", "shingles"]
                )

    few = wanted.count() <= ids_held
    ids = wanted.select(F.col("id").alias("wanted"))
    same = texts["id"].eqNullSafe(ids["wanted"])
    picked = texts.join(F.broadcast(ids) if few else ids, same, "left_semi")
    gathered = picked.select("id", "text").mapInArrow(gather, "digest long, shingles binary")
    return gathered.dropDuplicates(["digest"])


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("digest").alias("a"), F.col("shingles").alias("a_set"))
    right = sets.select(F.col("digest").alias("b"), F.col("shingles").alias("b_set"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set")


def _links(both: int, one: int, other: int) -> bool:
    return 100 * both >= 80 * (one + other - both)


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that link, by their whole sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                fits = 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b))
                both = len(np.intersect1d(a, b, assume_unique=True)) if fits else 0
                keep.append(both > 0 and _links(both, len(a), len(b)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return _with_sets(pairs, sets).mapInArrow(compare, "a long, b long")


def stars(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Each pair of pivot ``a`` and set ``b`` with the sizes, whether they link, and the shingles
    in only one of them: first those that the pivot lacks, which are the rarer."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a_id, b_id, x, y in zip(*(batch.column(i) for i in range(4))):
                a, b = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                more = np.setdiff1d(b, a, assume_unique=True)
                less = np.setdiff1d(a, b, assume_unique=True)
                linked = _links(len(b) - len(more), len(a), len(b))
                different = np.concatenate([more, less]).astype("<u8").tobytes()
                rows.append((a_id.as_py(), b_id.as_py(), len(a), len(b), linked, different))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), _STAR.types)] if rows
                else [pa.array([], t) for t in _STAR.types],
                schema=_STAR,
            )

    return _with_sets(pairs, sets).mapInArrow(
        compare, "a long, b long, a_size long, b_size long, linked boolean, different binary"
    )


_STAR = pa.schema(
    [("a", pa.int64()), ("b", pa.int64()), ("a_size", pa.int64()), ("b_size", pa.int64()),
     ("linked", pa.bool_()), ("different", pa.binary())]
)


def beside_pivots(star: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of sets of one pivot, one of them not linked with it, that may link with each other.

    Sets that links found so far hold together already (one component in ``labels``) are left out.

    With D the shingles in which a set differs from the pivot, sets u and s differ in
    |D(u)| + |D(s)| - 2 |D(u) & D(s)| shingles, which is (u + s) / 9 at most if they link. For an
    unlinked u this asks for more than half of D(s) (up to the difference of the sizes), so a
    prefix of D(s) and all of D(u) share a shingle, and the places of shared shingles bound how
    many more there can be.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d = np.frombuffer(row["different"], "<u8").view(np.int64)
                overlap = max(1, -(-(9 * len(d) + row["a_size"] - row["b_size"]) // 18))
                prefix = max(0, len(d) - overlap + 1)
                for probe, n in ((False, prefix), (True, 0 if row["linked"] else len(d))):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, row["a"])), pa.array(d[:n]),
                            pa.array(np.full(n, row["b"])), pa.array(np.full(n, row["b_size"])),
                            pa.array(np.full(n, len(d))), pa.array(np.arange(n)),
                            pa.array(np.full(n, probe)), pa.array(np.full(n, row["label"])),
                        ],
                        names=["pivot", "shingle", "node", "size", "differing", "place", "probe", "label"],
                    )

    known = labels.select(F.col("node").alias("b"), F.col("component").alias("label"))
    labelled = star.join(known, "b", "left").withColumn("label", F.coalesce("label", "b"))
    tokens = durable(
        labelled.mapInArrow(
            spread,
            "pivot long, shingle long, node long, size long, differing long, place long, "
            "probe boolean, label long",
        ),
        "differences",
    )
    u = tokens.where("probe").alias("u")
    s = tokens.where("NOT probe").alias("s")
    left = F.least(F.expr("u.differing - u.place"), F.expr("s.differing - s.place"))
    may = (
        F.expr("u.pivot = s.pivot AND u.shingle = s.shingle AND u.label != s.label")
        & (18 * left >= F.expr("9 * (u.differing + s.differing) - u.size - s.size"))
        & F.expr("5 * least(u.size, s.size) >= 4 * greatest(u.size, s.size)")
    )
    return (
        u.join(s, may)
        .select(F.expr("least(u.node, s.node)").alias("a"), F.expr("greatest(u.node, s.node)").alias("b"))
        .distinct()
    )


# --- counting links -----------------------------------------------------------------------------


class _Postings:
    """Which of some lists hold a number."""

    def __init__(self, lists: list[np.ndarray]):
        self.lists = len(lists)
        numbers = np.concatenate([*lists, np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(numbers, kind="stable")
        self.numbers, self.owner = numbers[order], owner[order]

    def shared(self, numbers: np.ndarray) -> np.ndarray:
        """How many of ``numbers`` each list has."""
        begin = np.searchsorted(self.numbers, numbers)
        length = np.searchsorted(self.numbers, numbers, "right") - begin
        before = np.cumsum(length) - length
        at = np.arange(length.sum()) + np.repeat(begin - before, length)
        return np.bincount(self.owner[at], minlength=self.lists)


def linking(u: tuple, v: tuple) -> np.ndarray:
    """For each set of ``u`` and each of ``v`` whether they link and have no earlier pivot in common.

    Both are ``(sizes, differences from one pivot, earlier pivots)``. Sets with the differences D
    and E differ from each other in |D| + |E| - 2 |D & E| shingles.
    """
    (u_size, u_lists, u_earlier), (v_size, v_lists, v_earlier) = u, v
    different, earlier = _Postings(v_lists), _Postings(v_earlier)
    length = np.array([len(x) for x in v_lists], np.int64)
    out = np.zeros((len(u_lists), len(v_lists)), bool)
    for i, numbers in enumerate(u_lists):
        apart = len(numbers) + length - 2 * different.shared(numbers)
        both = (u_size[i] + v_size - apart) // 2
        out[i] = (both > 0) & (100 * both >= 80 * (u_size[i] + v_size - both))
        if len(u_earlier[i]):
            out[i] &= earlier.shared(u_earlier[i]) == 0
    return out


def links_around_pivots(star: DataFrame, of_node: DataFrame) -> DataFrame:
    """``node, links``: rows to add up, how many sets of its pivots each set links with.

    All sets of a pivot, which is one of them, are counted against each other, in pairs of blocks,
    so that no task holds a large group and no row is made for a pair. Two sets of several pivots
    in common are counted with the smallest of them; ``of_node`` has the ``pivots`` of each node.
    """
    centres = star.groupBy("a").agg(F.min("a_size").alias("size"))
    members = star.select(
        F.col("a").alias("pivot"), F.col("b").alias("node"), F.col("b_size").alias("size"), "different"
    ).unionByName(
        centres.select(
            F.col("a").alias("pivot"), F.col("a").alias("node"), "size", F.lit(b"").alias("different")
        )
    )
    # one row at most for each BLOCK sets
    large = star.groupBy("a").count().where(F.col("count") >= BLOCK)
    blocks = large.select(F.col("a").alias("pivot"), F.expr(f"count div {BLOCK} + 1").alias("blocks"))
    several = of_node.where("size(pivots) > 1")
    dealt = (
        members.join(several, "node", "left")
        .join(F.broadcast(blocks), "pivot", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            "pivot",
            F.least("block", "other").alias("one"),
            F.greatest("block", "other").alias("two"),
            "block",
            "node",
            "size",
            "different",
            F.coalesce(F.filter("pivots", lambda p: p < F.col("pivot")), F.expr("array()")).alias("earlier"),
        )
    )

    def count(rows: pa.Table) -> pa.Table:
        node, size = rows["node"].to_numpy(), rows["size"].to_numpy()
        lists = [np.frombuffer(x.as_buffer(), "<i8") for x in rows["different"]]
        earlier = [np.array(x, np.int64) for x in rows["earlier"].to_pylist()]
        first = rows["block"].to_numpy() == rows["one"][0].as_py()
        side = lambda chosen: (
            size[chosen], [lists[i] for i in np.flatnonzero(chosen)], [earlier[i] for i in np.flatnonzero(chosen)],
        )
        if first.all() and rows["one"][0] == rows["two"][0]:
            found = linking(side(first), side(first))
            np.fill_diagonal(found, False)
            links = found.sum(axis=1)
        else:
            found = linking(side(first), side(~first))
            links = np.zeros(len(node), np.int64)
            links[first], links[~first] = found.sum(axis=1), found.sum(axis=0)
        return pa.table({"node": node, "links": links.astype(np.int64)})

    return dealt.groupBy("pivot", "one", "two").applyInArrow(count, "node long, links long")


def links_of_sets(rare: DataFrame, star: DataFrame) -> DataFrame:
    """``digest, links``: with how many other sets each set links, of all that link with any.

    Sets that link share a pivot or are a pair in ``rare`` (``a < b``, once each), or both; each
    link is counted once.
    """
    of_node = durable(
        star.select(F.col("b").alias("node"), F.col("a").alias("pivot"))
        .unionByName(star.select(F.col("a").alias("node"), F.col("a").alias("pivot")))
        .groupBy("node")
        .agg(F.collect_set("pivot").alias("pivots")),
        "pivots-of-sets",
    )
    pivots_of = lambda c: of_node.select(F.col("node").alias(c), F.col("pivots").alias(f"{c}_pivots"))
    apart = (
        rare.join(pivots_of("a"), "a", "left")
        .join(pivots_of("b"), "b", "left")
        .where(~F.coalesce(F.arrays_overlap("a_pivots", "b_pivots"), F.lit(False)))
    )
    each = F.explode(F.array("a", "b")).alias("node")
    return (
        links_around_pivots(star, of_node)
        .unionByName(apart.select(each, F.lit(1).cast("long").alias("links")))
        .groupBy(F.col("node").alias("digest"))
        .agg(F.sum("links").alias("links"))
    )


# --- the operator -------------------------------------------------------------------------------


def similar(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", ids_held: int = IDS_HELD,
    count_links: bool = True,
) -> DataFrame:
    """``id, n, component, links, node, key`` for every row of ``df``.

    ``n`` is the size of the row's set of 5-word shingles (A-Z in lower case; words between ASCII
    white space; a text of fewer words is one shingle). ``component`` is the smallest id that
    links of similarity 0.8 or more reach, the row's own included; ``links`` counts the other sets
    that its set links with directly (null without ``count_links``). A null or empty text, or one of white
    space only, has no shingles and is alone even beside equal ones. Equal sets are in one
    component, so repeated rows are. A null id counts only where a component has no other id.
    Other columns are not read; an empty table gives an empty result.

    Every text is read three times, by tasks that shuffle signatures (8 byte numbers), never texts
    or all sets; sets are gathered only for the candidates.
    """
    texts = df.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(text_column).alias("text"),
        _key(text_column).alias("key"),
    )
    profiled = durable(profiles(texts), "profiles")
    classes = durable(
        profiled.where("n > 0")
        .groupBy("digest")
        .agg(
            F.min("id").alias("id"),
            F.min("check").alias("check"),
            F.max("check").alias("other_check"),
        ),
        "equal-sets",
    )
    if classes.where("check != other_check").limit(1).count():
        raise RuntimeError("two sets of one digest; use another hash")
    chosen, total = allocation(profiled)
    parts = max(1, -(-total // SIGNATURES_PER_PART))
    found = durable(shared(signatures(texts, chosen), parts), "shared-signatures")
    common = found.where("common").select(F.col("a").alias("entry"), F.col("b").alias("signature"))
    entry = durable(entries(profiled, chosen, common), "entries")
    pairs = durable(candidates(found.where("NOT common"), entry), "pairs")
    around = durable(pivots(common, entry), "around-pivots")
    both = pairs.unionByName(around)
    nodes = both.select(F.col("a").alias("digest")).union(both.select("b")).distinct()
    wanted = classes.join(nodes, "digest", "left_semi").select("id").distinct()
    sets = durable(sets_of(texts, wanted, ids_held), "sets")
    star = durable(stars(around, sets), "stars")
    rare = durable(compared(pairs, sets), "rare-links")
    links = rare.unionByName(star.where("linked").select("a", "b"))
    first = durable(components(links), "first-components")
    beside = durable(compared(beside_pivots(star, first), sets), "links-beside-pivots")
    labels = _joined(first, beside)
    members = classes.join(labels.withColumnRenamed("node", "digest"), "digest")
    least = members.groupBy("component").agg(F.min("id").alias("least"))
    linked = members.join(least, "component").select("digest", "component", "least")
    of_set = classes.join(linked, "digest", "left")
    if count_links:
        of_set = of_set.join(links_of_sets(rare, star), "digest", "left").fillna(0, ["links"])
    else:
        of_set = of_set.withColumn("links", F.lit(None).cast("long"))
    of_set = of_set.select(
        "digest",
        F.coalesce("component", "digest").alias("node"),
        F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("least"),
        "links",
    )
    own = F.col("n") > 0
    return (
        profiled.select("id", "n", "key", F.when(own, F.col("digest")).alias("digest"))
        .join(of_set, "digest", "left")
        .select(
            "id",
            "n",
            F.when(own, F.col("least")).otherwise(F.col("id")).alias("component"),
            (F.when(own, F.col("links")).otherwise(0) if count_links else F.col("links")).alias("links"),
            "node",
            "key",
        )
    )


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` when ``links`` are added to the graph that ``labels`` describes."""
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    alone = nodes.distinct().join(labels, "node", "left_anti")
    every = durable(
        labels.unionByName(alone.select("node", F.col("node").alias("component"))), "labels"
    )
    label = lambda c: every.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
    between = (
        links.join(label("a"), "a")
        .join(label("b"), "b")
        .select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    )
    moved = components(between).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return every.join(moved, "component", "left").select(
        "node", F.coalesce("to", "component").alias("component")
    )


def _key(text_column: str):
    return F.xxhash64(text_column, F.length(text_column))


def near_dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, one of each component: that with the smallest id (nulls last,
    then by a hash of the text).

    Rows without shingles all stay. Of rows with the same id and text one stays.
    """
    row, key, gone = fresh(df, "row"), fresh(df, "key"), fresh(df, "gone")
    found = durable(similar(df, id_column, text_column, count_links=False).select("id", "key", "node"), "similar")
    first = (
        found.where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("first"))
    )
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))
    marked = durable(found.join(first, "node").select("id", "key", stays.alias("stays")), "marked")
    dropped = marked.where("NOT stays").select(F.col("id").alias(row), F.col("key").alias(gone))
    few = dropped.count() <= IDS_HELD
    same = F.col(id_column).eqNullSafe(F.col(row)) & (_key(text_column) == F.col(gone))
    kept = df.join(F.broadcast(dropped) if few else dropped, same, "left_anti")
    staying = marked.where("stays")
    if staying.count() == first.count():
        return kept
    # rows without shingles are told apart by a number, the others by id and text
    twin = F.when(F.length(F.regexp_replace(text_column, "[\\x20\\x09-\\x0D]+", "")) > 0, F.lit(0))
    keyed = kept.withColumn(key, _key(text_column)).withColumn(
        row, F.coalesce(twin, F.monotonically_increasing_id() + 1)
    )
    return keyed.dropDuplicates([id_column, key, row]).drop(key, row)
