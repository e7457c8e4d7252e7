"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tablume.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, least_chars=5, least_count=3, noise=97):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % noise == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least_chars and n >= least_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(words, ratio=2):
    forms, out = {}, {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = len(others)
    rows = set()
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, n, out[w], words[forms[w]] if forms[w] else None))
    return rows


def odd_rows():
    draw = random.Random(3)
    base = ["".join(draw.choice("abcdé÷À") for _ in range(draw.randrange(3, 9))) for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " - 123"), (None, "hello Hello hellÖ hellö HELLO"), (4, "x" * 300)]
    rows += [(5, "y" * 70 + " " + "y" * 71), (6, "naïve—naïve “naïve” naïv́e Œuvre œuvre"), (7, "中abcdeÃfghij")]
    rows += [rows[3], rows[4], rows[4], rows[5], rows[5], rows[7], rows[7]]
    for i in range(250):
        words = []
        for _ in range(draw.randrange(1, 60)):
            w = base[int(len(base) * draw.random() ** 2)]
            if draw.random() < 0.4:
                k = draw.randrange(len(w))
                w = draw.choice([w[:k] + w[k + 1 :], w[:k] + draw.choice("abcxé") + w[k:], w[:k] + draw.choice("abÿ") + w[k + 1 :]])
            words.append(draw.choice([w, w.capitalize(), w.upper()]))
        rows.append((draw.choice([i, i, -i, 10**12 + i]), draw.choice([" ", ", ", "-", "’"]).join(words)))
    return rows


@pytest.fixture(scope="module")
def words(spark):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string").repartition(3)
    found = spelling.vocabulary(docs).cache()
    return found


def test_vocabulary(spark, words):
    assert {tuple(r) for r in words.collect()} == set(brute_words(odd_rows()).items())
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string")
    found = spelling.vocabulary(docs, least_chars=1, least_count=1, noise=2)
    assert {tuple(r) for r in found.collect()} == set(brute_words(odd_rows(), 1, 1, 2).items())


@pytest.mark.parametrize("options", [{}, {"word_bits": 2}, {"word_bits": 64, "round_bytes": 512}])
def test_variants(words, options):
    wanted = brute_variants({r.word: r.n for r in words.collect()})
    found = spelling.spelling_variants(words, **options)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(wanted) and set(rows) == wanted
    assert sum(r[1] is not None for r in rows) > 50


def test_chains_ties_and_short_words(spark):
    counts = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 32, "zzzzz": 5,
              "zzzzy": 10, "zzzzx": 10, "z": 1, "y": 9, "": 7, "q" * 100: 3, "q" * 101: 9}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("near", F.lit(1))
    rows = {tuple(r) for r in spelling.spelling_variants(words).collect()}
    assert rows == brute_variants(counts)
    assert ("aaaaa", "aaaab", "bbbbb", 1, 1, 2) in rows


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, word string, n int")
    assert spelling.vocabulary(docs).count() == 0
    assert spelling.spelling_variants(spelling.vocabulary(docs)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(spelling.vocabulary(docs), ratio=1)
