"""Training-order materialisation: token sequences in a keyed random order, in binary shards.

Every sequence has an index in reading order. A keyed Feistel permutation with cycle-walking
turns the index into a global slot; runs of slots are shards, files of records of one length, so
that reading slots in order is reading files from front to back, and any slot can be sought.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablume.llm.common import durable, mixed
from tablume.llm.tokens import pieces, tokenizer, with_end

SEQUENCE = 512
SHARD_BYTES = 16 << 20
ROUNDS = 6
#: A record: the number of ids, the ids, zeros up to the stride.
LENGTH_BYTES = 4

PLACED = "id long, piece int, length int, ids_crc32 long, slot long, shard int, ids binary"
WRITTEN = "id long, piece int, length int, ids_crc32 long, slot long, shard int, place long"


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """The slots of indexes below ``size``: a permutation of 0..size-1 that ``key`` picks.

    A Feistel network permutes the next power of four; numbers that land at ``size`` or beyond go
    through it again until they are below.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) + mixed(np.array([key], np.uint64)))
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> bits, x & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        out[walking] = x = (left << bits) | right
        walking = walking[x >= np.uint64(size)]
    return out.astype(np.int64)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the folder of a path as Spark writes it (``file:/a``, ``hdfs://h/a``)."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    return fs.FileSystem.from_uri(path)


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def _sequences_by_part(texts: DataFrame, path: str, size: int) -> np.ndarray:
    """How many sequences each input part gives: one number for each part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, total = tokenizer(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            total += int((-(-(encoder.counts(batch.column(1)) + 1) // size)).sum())
        yield pa.RecordBatch.from_pydict({"part": [part], "n": [total]})

    found = texts.mapInArrow(count, "part long, n long").collect()
    out = np.zeros(max([0, *(r.part for r in found)]) + 1, np.int64)
    for r in found:
        out[r.part] = r.n
    return out


def materialise(
    df: DataFrame, path: str, tokenizer_path: str, key: int = 0, id_column: str = "doc_id",
    text_column: str = "text", sequence: int = SEQUENCE, shard_bytes: int = SHARD_BYTES,
    end: int = 0,
) -> DataFrame:
    """Write all texts of ``df`` as token sequences under ``path``; one row for each sequence.

    ``df`` must be a plain scan or a written table, whose parts are the same each time they are
    read. A text's ids, with ``end`` after them, are cut into sequences of ``sequence`` ids, the
    last may be shorter; a null or empty text is the id ``end`` alone, repeated rows give their
    sequences again, an empty table writes only the manifest. Returns ``id, piece, length,
    ids_crc32`` (little-endian unsigned 32-bit ids) ``, slot, shard, place``.

    The texts are encoded twice, first to count sequences in each part (one number a part goes to
    the driver), then to place them; this is cheaper than writing the ids between. Each task
    checks that it made as many sequences as were counted. A shard is one task's sorted run of
    slots, written aside and then moved, so a lost task is simply done again; a call with the same
    arguments on a folder that has some shards already writes only the missing ones.
    """
    spark = df.sparkSession
    from tokenizers import Tokenizer

    kind = id_type(Tokenizer.from_file(tokenizer_path).get_vocab_size())
    stride = LENGTH_BYTES + kind.itemsize * sequence
    texts = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    by_part = _sequences_by_part(texts, tokenizer_path, sequence)
    total = int(by_part.sum())
    per_shard = max(1, shard_bytes // stride)
    shards = -(-total // per_shard)
    store, folder = _store(path)
    store.create_dir(folder, recursive=True)
    manifest = {
        "sequences": total, "sequence": sequence, "stride": stride, "per_shard": per_shard,
        "shards": shards, "key": key, "ids": kind.str,
    }
    there = {f.base_name for f in store.get_file_info(fs.FileSelector(folder))}
    done = np.array([name(k) in there for k in range(shards)], bool)
    with store.open_output_stream(f"{folder}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    first_of = spark.sparkContext.broadcast(np.cumsum(by_part) - by_part)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        index = begin = int(first_of.value[part])
        for batch in batches:
            for at, to, ids, first in encoder.encoded(batch.column(1)):
                ids, first = with_end(ids, first, end)
                text, piece, start, length = pieces(first, sequence)
                slot = permuted(index + np.arange(len(text)), total, key)
                index += len(text)
                wide, short = ids.astype("<u4").tobytes(), ids.astype(kind).tobytes()
                spans = list(zip((first[text] + start).tolist(), length.tolist()))
                crc = [zlib.crc32(wide[4 * b : 4 * (b + n)]) for b, n in spans]
                w = kind.itemsize
                cut = [short[w * b : w * (b + n)] for b, n in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at).take(pa.array(text)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(length.astype(np.int32)),
                        pa.array(crc, pa.int64()),
                        pa.array(slot),
                        pa.array((slot // per_shard).astype(np.int32)),
                        pa.array(cut, pa.binary()),
                    ],
                    names=["id", "piece", "length", "ids_crc32", "slot", "shard", "ids"],
                )
        if index - begin != by_part[part]:
            raise RuntimeError("the input's parts changed between two reads; write it first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().taskAttemptId()
        target, out, current = None, None, None
        for batch in batches:
            slots, shard_of = batch.column("slot").to_numpy(), batch.column("shard").to_numpy()
            for shard, ids in zip(shard_of.tolist(), batch.column("ids").to_pylist()):
                if shard != current:
                    _finish(store, out, target, task)
                    current, target = shard, f"{folder}/{name(shard)}"
                    out = None if done[shard] else store.open_output_stream(f"{target}.{task}")
                if out is not None:
                    n = len(ids) // kind.itemsize
                    out.write(n.to_bytes(LENGTH_BYTES, "little") + ids.ljust(stride - LENGTH_BYTES, b"\0"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(6)), pa.array(slots % per_shard)],
                names=["id", "piece", "length", "ids_crc32", "slot", "shard", "place"],
            )
        _finish(store, out, target, task)

    placed = texts.mapInArrow(place, PLACED)
    # a shard is a range of slots; its number is its partition
    ranges = placed.repartitionById(max(1, shards), "shard").sortWithinPartitions("slot")
    return durable(ranges.mapInArrow(write, WRITTEN), "sequences")


def _finish(store: fs.FileSystem, out, target: str | None, task: int) -> None:
    if out is not None:
        out.close()
        store.move(f"{target}.{task}", target)


def name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def manifest_of(path: str) -> dict:
    store, folder = _store(path)
    with store.open_input_stream(f"{folder}/manifest.json") as f:
        return json.loads(f.read())


def sequences(path: str, slot: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
    """The sequences from ``slot`` on in training order, ``count`` of them or to the end."""
    about = manifest_of(path)
    store, folder = _store(path)
    stop = about["sequences"] if count is None else min(about["sequences"], slot + count)
    kind, stride = np.dtype(about["ids"]), about["stride"]
    while slot < stop:
        shard, place = divmod(slot, about["per_shard"])
        with store.open_input_file(f"{folder}/{name(shard)}") as f:
            f.seek(place * stride)
            last = min(stop, (shard + 1) * about["per_shard"])
            for _ in range(slot, last):
                record = f.read(stride)
                n = int.from_bytes(record[:LENGTH_BYTES], "little")
                yield np.frombuffer(record, kind, n, LENGTH_BYTES)
        slot = last


def stored(spark: SparkSession, path: str) -> DataFrame:
    """``slot, length, ids_crc32`` of every record, read from the files, one task a shard."""
    about = manifest_of(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                begin = shard * about["per_shard"]
                found = [
                    (len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for ids in sequences(path, begin, about["per_shard"])
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(begin + np.arange(len(found))),
                        pa.array([n for n, _ in found], pa.int32()),
                        pa.array([c for _, c in found], pa.int64()),
                    ],
                    names=["slot", "length", "ids_crc32"],
                )

    shards = spark.range(0, about["shards"], 1, max(1, about["shards"]))
    return shards.mapInArrow(read, "slot long, length int, ids_crc32 long")
