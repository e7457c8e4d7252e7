"""Collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tablume.llm import collocations
from tablume.llm.collocations import Trie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=5, least=100, top=2000):
    counts, total = {}, Counter()
    for lang, text in rows:
        f = counts.setdefault(lang or "und", Counter()) if lang != "" else counts.setdefault("", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n, rows_of = total[lang], []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if any(
                len(q) > len(p) and 100 * b >= 100 * a
                and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in candidates.items()
            ):
                continue
            cuts = [(1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows_of.append((" ".join(p), a, f[p[:k]], f[p[k:]], n, score))
        rows_of.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows_of[:top])]
    return sorted(out)


def odd_rows():
    draw = random.Random(4)
    vocabulary = [f"{c}{d}" for c in "abcdeé" for d in "xyzÀ"]
    rows = [("en", None), ("en", ""), (None, " \t, .; \n"), ("de", "a b" * 3), ("en", "x " * 500), (None, "x y " * 60)]
    for i in range(400):
        words = []
        while len(words) < draw.randrange(1, 60):
            if draw.random() < 0.3:
                words += draw.choice(["New York City", "of the", "on the other hand", "ax ay az aÀ bx by"]).split()
            else:
                words.append(draw.choice(vocabulary[: 4 + i % 20]))
            if draw.random() < 0.15:
                words[-1] += draw.choice([",", ".", "!", "\n", "\x0b", "\x00", "-"])
        text = draw.choice([" ", "  ", "\t"]).join(words)
        rows.append((draw.choice(["en", "en", "en", "de", None]), text if i % 3 else text.upper()))
    return rows + rows[-20:]


def found_of(spark, rows, **options):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for name in ("phrase", "n", "id", "key", "a", "lang_key"):
        docs = docs.withColumn(name, F.lit("clash"))
    return sorted(tuple(r) for r in collocations.collocations(docs, **options).collect())


@pytest.mark.parametrize(
    "options", [{}, {"least": 20}, {"least": 20, "trie_phrases": 7}, {"least": 5, "top": 9, "longest": 3}]
)
def test_like_brute_force(spark, options):
    wanted = dict(options)
    wanted.pop("trie_phrases", None)
    rows = odd_rows()
    got = found_of(spark, rows, **options)
    assert got == brute(rows, **wanted) and got


def test_nothing_frequent_and_empty_table(spark):
    assert found_of(spark, []) == []
    assert found_of(spark, [("en", "one two three"), (None, None)]) == []
    with pytest.raises(ValueError):
        collocations.collocations(spark.createDataFrame([], "lang string, text string"), least=0)


def test_exact_beyond_64_bits(spark):
    one = spark.createDataFrame([(9_000_000_000_000_000, 7_000_000_000_000_000)], "a long, n long")
    got = one.select(
        F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)))"
               " div (CAST(a AS DECIMAL(19,0)) * CAST(3 AS DECIMAL(19,0)))")
    ).first()[0]
    assert got == 1000 * 7_000_000_000_000_000 // 3


def test_trie_finds_its_phrases_and_no_others():
    draw = np.random.default_rng(5)
    keys = np.unique(draw.integers(1, 1 << 60, 300, dtype=np.int64)).astype(np.uint64)
    phrases = np.unique(keys[(draw.random((5000, 3)) ** 2 * len(keys)).astype(int)], axis=0)
    trie = Trie(phrases, np.arange(len(phrases)))
    known = {tuple(p): i for i, p in enumerate(phrases.tolist())}
    text = np.append(keys[(draw.random(20_000) ** 2 * len(keys)).astype(int)], np.uint64(7))
    follows = draw.random(len(text) - 1) < 0.9
    state = trie.walk(trie.codes(text), follows)
    hits = 0
    for i in range(len(text)):
        phrase = tuple(text[i : i + 3].tolist()) if follows[i : i + 2].all() else ()
        assert (known.get(phrase, -1)) == (trie.id[state[i]] if trie.accepts[state[i]] else -1)
        hits += phrase in known
    assert hits > 30 and (trie.check >= 0).mean() > 0.2
