"""Substring deduplication against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tablume.llm import repeats
from tablume.llm.common import WHITE_SPACE, Words, slices

CLASHING = ["id", "mark", "row", "first", "number", "symbol", "windows", "kept"]


def prose(n: int, seed: int, vocabulary: int = 300) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def brute(rows, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def odd_rows():
    passage, other = prose(60, 1), prose(35, 2)
    period = " ".join(["a b c"] * 40)
    rows = [
        (1, f"{prose(50, 3)} {passage} {prose(20, 4)}"), (2, f"{passage} {prose(90, 5)}"),
        (3, f"{prose(10, 6)}\n{passage}"), (4, None), (5, ""), (6, " \t\r\n "), (7, prose(34, 7)),
        (8, prose(34, 7)), (9, prose(35, 8)), (10, prose(35, 8)), (10, prose(35, 8)), (None, passage),
        (None, f"{other} x {other}"), (11, other.upper()), (12, "x " * 34), (13, "x " * 35),
        (14, "x " * 36 + "y"), (15, "x " * 100), (16, period), (17, f"{period} b c a b"),
        (18, f"{'a ' * 30} {'b ' * 30}"), (19, f"q {'a ' * 30} {'b ' * 30} r"),
        (20, " ".join(f"{c} {c}" for c in "abcdefghij" * 5)), (21, "X" * 100_000),
        (22, prose(40_000, 9, 5000)), (23, f"{'x ' * 70} é ß {'x ' * 40}"),
    ]
    draw = random.Random(10)
    rows += [(100 + i, " ".join(draw.choice("ab") for _ in range(200))) for i in range(5)]
    long = prose(400, 11).split()
    for i in range(40):  # pieces of one text, some with an edit
        at = draw.randrange(300)
        some = long[at : at + draw.randrange(30, 100)]
        if i % 3 == 0:
            some[len(some) // 2] = f"new{i}"
        rows.append((200 + i, f"{prose(draw.randrange(8), 20 + i)} {' '.join(some)} {prose(5, 70 + i)}"))
    return rows


def found_of(spark, rows, parts=3, **options):
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(parts)
    return sorted((tuple(r) for r in repeats.substring_dedup(docs, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"rounds": 1}, {"rounds": 12, "map_bits": 8}, {"window": 5}, {"window": 2}])
def test_like_brute_force(spark, options):
    rows = odd_rows()
    assert found_of(spark, rows, **options) == brute(rows, options.get("window", 35))


def test_a_hot_passage_and_a_hot_text(spark):
    passage = prose(50, 30)
    rows = [(i, f"{prose(12, 100 + i)} {passage} {prose(12, 900 + i)}") for i in range(150)]
    rows += [(500 + i, prose(60, 31)) for i in range(100)]
    assert found_of(spark, rows) == brute(rows)


def test_empty_table_clashing_names_and_one_word_windows(spark):
    assert found_of(spark, []) == []
    docs = spark.createDataFrame([(1, prose(50, 1)), (2, prose(50, 1))], "doc_id long, text string")
    for name in CLASHING:
        docs = docs.withColumn(name, docs.doc_id)
    got = repeats.substring_dedup(docs)
    assert got.columns == ["id", "n_words", "n_removed", "kept"]
    assert {tuple(r) for r in got.collect()} == {(1, 50, 50, ""), (2, 50, 50, "")}
    with pytest.raises(ValueError):
        repeats.substring_dedup(docs, window=1)


def test_equal_windows_have_equal_anchors():
    passage, texts = prose(120, 40, 40), []
    for i in range(30):
        texts.append(f"{prose(20 + i, 41 + i, 40)} {passage} {prose(10, 80 + i, 40)}")
    seen = {}
    for _, _, data, offsets in slices(pa.array(texts)):
        words = Words(data, offsets, WHITE_SPACE, lower=False)
        _, _, start, begin, end = repeats._anchors(words, 35, repeats.ROUNDS)
        for s, b, e in zip(start.tolist(), begin.tolist(), end.tolist()):
            window = tuple(words.word(k) for k in range(s, s + 35))
            assert s <= b <= e <= s + 35
            assert seen.setdefault(window, (b - s, e - s)) == (b - s, e - s)
    assert len(seen) < 30 * 150 and np.mean([b < e for b, e in seen.values()]) > 0.99
