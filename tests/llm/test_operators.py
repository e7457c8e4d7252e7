"""Every operator on odd tables, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablume.llm import (
    chat,
    decontamination,
    exact_dedup,
    html_text,
    licenses,
    ngram_join,
    packing,
    quality,
    sharding,
    tokens,
    training_order,
)
from tablume.llm.common import NON_ALNUM, WHITE_SPACE, Words, slices
from tablume.llm.components import components

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = ["id", "key", "row", "score", "digest", "length", "slot", "shard", "hits", "_row", "size", "group"]

_draw = random.Random(5)
VOCABULARY = ["".join(_draw.choice("abcdeé") for _ in range(_draw.randint(2, 6))) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(VOCABULARY) for _ in range(n))


def edited(text: str, changes: int, seed: int) -> str:
    words, draw = text.split(" "), random.Random(seed)
    for i in draw.sample(range(len(words)), changes):
        words[i] = f"new{draw.randint(0, 999)}"
    return " ".join(words)


def odd_texts() -> list[tuple[int | None, str | None]]:
    base, other = prose(300, 1), prose(120, 2)
    rows: list[tuple[int | None, str | None]] = [
        (1, base), (2, base), (2, base), (3, base.upper()), (4, None), (5, ""), (6, "  \t\n "), (7, "Word"),
        (8, "word"), (9, "one two three four"), (10, "ONE  two\tthree\nfour"), (None, other), (11, other),
        (12, other.replace(" ", "\r\n")), (13, "!!! ??? ***"), (14, prose(30_000, 3)),
        (15, "x" * 200_000), (16, "Licensed under the Apache License, Version 2.0."),
        (17, "cc by nc cc by nc"), (18, "Released under the MIT License. under the mit license"),
        (19, f"{prose(50, 4)} This work is licensed under the GNU General Public License, version 3."),
        (20, "a b c ́d e\x00f <|endoftext|> \x01 g\x01h don't it's été"),
    ]
    rows += [(100 + i, edited(base, 2 + i, i)) for i in range(40)]
    rows += [(200 + i, edited(edited(base, 6, 77), 2 + i, i)) for i in range(12)]
    rows += [(300 + i, f"{other} {prose(60 + 10 * i, i)}") for i in range(20)]
    rows += [(400 + i, prose(i, 50 + i)) for i in range(40)]
    rows += [(500 + i, edited(prose(40, 9), i % 3, i)) for i in range(30)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The odd texts, with columns of clashing names and nulls in every column."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.when(F.col("doc_id") % 2 == 0, F.lit(c)) for c in CLASHING})


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.where("false")


# --- words and tokens ---------------------------------------------------------------------------


@pytest.mark.parametrize("separators", [WHITE_SPACE, NON_ALNUM])
def test_words_as_arrays(rows, separators):
    texts = [t for _, t in rows]
    pattern = "[^" + "".join(f"\\x{b:02x}" for b in separators) + "]+"
    found = []
    for at, to, data, offsets in slices(pa.array(texts)):
        words = Words(data, offsets, separators, lower=True)
        for k in range(to - at):
            found.append([words.word(i).decode() for i in range(words.first[k], words.first[k + 1])])
    assert found == [re.findall(pattern, t or "") for t in texts]


def test_tokens_are_the_tokenizer_s(rows):
    texts = [t or "" for _, t in rows]
    encoder, whole = tokens.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    wanted = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert encoder.counts(pa.array(texts)).tolist() == [len(x) for x in wanted]
    for _ in range(2):
        got = []
        for at, to, ids, first in encoder.encoded(pa.array(texts)):
            got += [ids[first[k] : first[k + 1]].tolist() for k in range(to - at)]
        assert got == wanted


def test_tokens_with_a_small_table(rows, monkeypatch):
    monkeypatch.setattr(tokens, "WORDS_KEPT", 50)
    monkeypatch.setattr(tokens, "_RECENT", 20)
    test_tokens_are_the_tokenizer_s(rows)


# --- 1: training order --------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 63, 64, 65, 1000, 4097])
def test_permutation(size):
    for key in (0, 7):
        slots = training_order.permuted(np.arange(size), size, key)
        assert sorted(slots.tolist()) == list(range(size))
    if size > 60:
        other = training_order.permuted(np.arange(size), size, 8)
        assert (slots != other).any() and (slots != np.arange(size)).any()


def test_training_order_round_trip(spark, docs, rows, tmp_path):
    path = str(tmp_path / "order")
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    made = training_order.materialise(df, path, PATH, key=3, sequence=64, shard_bytes=5_000)
    found = {r.slot: r for r in made.collect()}
    whole = Tokenizer.from_file(PATH)
    stored = list(training_order.sequences(path))
    assert sorted(found) == list(range(len(stored)))
    wanted = Counter()
    for doc_id, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        for piece in range(-(-len(ids) // 64)):
            wanted[doc_id, piece, tuple(ids[64 * piece : 64 * piece + 64])] += 1
    got = Counter((found[s].id, found[s].piece, tuple(ids.tolist())) for s, ids in enumerate(stored))
    assert got == wanted
    middle = [x.tolist() for x in training_order.sequences(path, 100, 30)]
    assert middle == [x.tolist() for x in stored[100:130]]
    back = {r.slot: (r.length, r.ids_crc32) for r in training_order.stored(spark, path).collect()}
    assert back == {s: (r.length, r.ids_crc32) for s, r in found.items()}
    # a second call writes only what is missing, the same as before
    about = training_order.manifest_of(path)
    lost = tmp_path / "order" / training_order.name(about["shards"] // 2)
    content = lost.read_bytes()
    lost.unlink()
    kept = (tmp_path / "order" / training_order.name(0)).stat().st_mtime_ns
    training_order.materialise(df, path, PATH, key=3, sequence=64, shard_bytes=5_000)
    assert lost.read_bytes() == content
    assert (tmp_path / "order" / training_order.name(0)).stat().st_mtime_ns == kept


def test_training_order_of_nothing(spark, no_docs, tmp_path):
    made = training_order.materialise(no_docs, str(tmp_path), PATH)
    assert made.count() == 0 and training_order.stored(spark, str(tmp_path)).count() == 0


# --- 2: n-gram join -----------------------------------------------------------------------------


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return Counter(
        (d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))
    )


@pytest.mark.parametrize("rare", [8, 2])
def test_similar_is_exact(spark, docs, rows, rare, monkeypatch):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    found = ngram_join.similar(docs).collect()
    assert Counter((r.id, r.n, r.component) for r in found) == brute_components(rows)


def test_similar_without_broadcast(docs, rows):
    found = ngram_join.similar(docs, ids_held=0).collect()
    assert Counter((r.id, r.n, r.component) for r in found) == brute_components(rows)


def test_many_near_copies(spark):
    base = prose(150, 11)
    rows = [(i, edited(base, i % 17, i)) for i in range(150)]
    rows += [(1000 + i, f"{prose(30, 12)} {prose(25 + i % 40, i)}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.similar(df).collect()
    assert Counter((r.id, r.n, r.component) for r in found) == brute_components(rows)


def test_short_sets_use_other_allocations(spark, monkeypatch):
    rows = [(i, edited(prose(12 + i % 30, i // 3), i % 3, i)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute_components(rows)
    for kind in (ngram_join.TOKEN, ngram_join.DELETION, ngram_join.EXACT):
        real = ngram_join.allocation

        def only(profiled, kind=kind, real=real):
            chosen, total = real(profiled)
            r = profiled.agg(F.min(F.col("exact") - F.floor(2 * F.col("n") / 9)),
                             F.min(F.col("deletion") - F.floor(2 * F.col("n") / 9))).first()
            fits = {ngram_join.TOKEN: 1, ngram_join.EXACT: r[0], ngram_join.DELETION: r[1]}[kind] > 0
            return ({b: kind for b in chosen} if fits else chosen), total

        with monkeypatch.context() as m:
            m.setattr(ngram_join, "allocation", only)
            found = ngram_join.similar(df).collect()
        assert Counter((r.id, r.n, r.component) for r in found) == wanted


def cut_copies():
    """Hot groups: a text, copies edited in its front part, and one that lacks the tail (J = 0.8 to 0.82)."""
    rows, draw = [], random.Random(31)
    for group in range(48):
        n, cut = [(80, 64), (40, 32), (21, 17)][group % 3]
        words = [f"g{group}w{i}" for i in range(n + 4)]
        rows += [(100 * group, " ".join(words)), (100 * group + 1, " ".join(words[: cut + 4]))]
        for i in range(2, 26):
            copy = list(words)
            copy[draw.randrange(cut // 2)] = f"c{group}e{i}"
            rows.append((100 * group + i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("kind", [ngram_join.TOKEN, ngram_join.DELETION, ngram_join.EXACT])
def test_tail_cut_copies_in_hot_groups(spark, kind, monkeypatch):
    rows = cut_copies()
    real = ngram_join.allocation

    def only(profiled):
        spare = {ngram_join.EXACT: F.col("exact"), ngram_join.DELETION: F.col("deletion")}.get(kind)
        if spare is None:
            return {b: kind for b in real(profiled)[0]}, real(profiled)[1]
        fits = profiled.groupBy("band").agg(F.min(spare - F.floor(2 * F.col("n") / 9)).alias("spare"))
        return {r.band: kind if r.spare > 0 else ngram_join.TOKEN for r in fits.collect()}, 100_000

    monkeypatch.setattr(ngram_join, "allocation", only)
    found = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.id, r.n, r.component) for r in found) == brute_components(rows)


def brute_links(rows):
    """How many other sets each row's set links with."""
    sets = {shingles(t) for _, t in rows} - {frozenset()}
    links = {a: sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in sets) for a in sets}
    return Counter((d, links.get(shingles(t), 0)) for d, t in rows)


@pytest.mark.parametrize("block", [256, 5])
def test_links_are_counted(spark, rows, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    base = prose(150, 11)
    texts = [*rows, *((2000 + i, edited(base, i % 17, i)) for i in range(100))]
    texts += [(10_000 + i, t) for i, t in cut_copies()[:78]]
    found = ngram_join.similar(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert Counter((r.id, r.links) for r in found) == brute_links(texts)


def test_pivots_take_smaller_sets_of_a_pair(spark):
    entry = spark.createDataFrame(
        [(2 * d, d, n, capacity, 1, times) for d, n, capacity, times in [(1, 80, 30, 30), (2, 64, 30, 14)]],
        "entry long, digest long, n long, capacity long, weight int, times long",
    )
    common = spark.createDataFrame([(2, 7), (4, 7)], "entry long, signature long")
    assert [(r.a, r.b) for r in ngram_join.pivots(common, entry).collect()] == [(1, 2)]


def test_near_dedup_keeps_one_of_each(docs, no_docs, rows):
    kept = ngram_join.near_dedup(docs)
    assert kept.columns == docs.columns
    wanted = Counter({c for (_, n, c) in brute_components(rows) if n})
    wanted += Counter(d for d, t in rows if not shingles(t))
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == wanted
    assert ngram_join.near_dedup(no_docs).count() == 0
    assert ngram_join.similar(no_docs).count() == 0


def test_components(spark):
    draw = random.Random(1)
    links = [(i, i + 1) for i in range(300) if i % 100 != 99]  # chains
    links += [(1000, 1000 + i) for i in range(1, 200)]  # a star
    links += [(draw.randint(2000, 2300), draw.randint(2000, 2300)) for _ in range(200)]
    nodes = {x for a, b in links for x in (a, b) if a != b}
    label = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 3: exact dedup -----------------------------------------------------------------------------


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def brute_copies(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[normal(t)].append(d)
    out = Counter()
    for text, ids in groups.items():
        keep = min((d for d in ids if d is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        stays = Counter()
        for d in ids:
            stays[d] += 1
            out[d, keep, len(ids), d == keep and stays[d] == 1, digest] += 1
    return out


@pytest.mark.parametrize("held", [0, 10_000])
def test_exact_groups(docs, rows, held):
    found = exact_dedup.exact_groups(docs, hash_all=True, keys_held=held).collect()
    assert Counter((r.id, r.keep_id, r.group_size, r.kept, r.sha256) for r in found) == brute_copies(rows)


def test_full_hash_only_where_it_decides(docs, rows):
    sizes = Counter((len(normal(t)), normal(t)[:256]) for _, t in rows)
    found = exact_dedup.exact_groups(docs).collect()
    assert sum(r.sha256 is not None for r in found) == sum(n for n in sizes.values() if n > 1)


@pytest.mark.parametrize("held", [500_000, 0])
def test_exact_dedup_keeps_rows(docs, no_docs, rows, held):
    kept = exact_dedup.exact_dedup(docs, dropped_held=held)
    assert kept.columns == docs.columns
    wanted = Counter((k[0], k[4]) for k, n in brute_copies(rows).items() if k[3])
    found = Counter(
        (r.doc_id, hashlib.sha256(normal(r.text).encode()).hexdigest()) for r in kept.collect()
    )
    assert found == wanted
    assert exact_dedup.exact_dedup(no_docs).count() == 0


# --- 4: licences --------------------------------------------------------------------------------


def test_license_scan(docs, no_docs, rows):
    found = Counter()
    by_id = {}
    for r in licenses.scan_licenses(docs).collect():
        found[r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels] += 1
        by_id[r.id] = r
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    wanted = Counter()
    for doc_id, text in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        places, labels = [], set()
        for label, phrase in licenses.BASE.items():
            p = phrase.split(" ")
            here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += here
            labels |= {label} if here else set()
        wanted[doc_id, len(words), len(places), min(places, default=None), max(places, default=None),
               ",".join(sorted(labels))] += 1
    assert found == wanted
    assert by_id[19].labels == "gpl-3" and by_id[19].score == 1.0
    assert by_id[17].n_base == 2 and by_id[18].labels == "mit"
    assert licenses.scan_licenses(no_docs).count() == 0


def brute_licenses(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(LOWER))
    labels, best = set(), 0.0
    for label, template, keys in licenses.TEMPLATES:
        t = template.split(" ")
        for offset in range(-len(t) + 1, len(words)):
            covered = words[max(0, offset) : max(0, offset + len(t))]
            share = sum(a == b for a, b in zip(covered, t[max(0, -offset) :])) / len(t)
            best = max(best, share)
            if share >= licenses.LEAST_MATCH and all(f" {k} " in f" {' '.join(covered)} " for k in keys):
                labels.add(label)
    return labels, best


def test_every_alignment_that_matches_is_proposed(spark):
    draw, texts = random.Random(8), []
    mit = licenses.TEMPLATES[1][1]
    for word in ("obtaining", "associated", "documentation"):
        mit = mit.replace(word, f"x{word}")
    texts.append(mit)
    for _, template, _ in licenses.TEMPLATES:
        for _ in range(12):
            words = template.split(" ")
            for i in draw.sample(range(len(words)), min(len(words), draw.randint(0, len(words) // 5 + 1))):
                words[i] = f"other{i}"
            cut = draw.choice([0, 0, 1])
            texts.append(" ".join([*(prose(3, len(texts)).split(" ") if not cut else []), *words[cut:]]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan_licenses(df).collect():
        labels, best = brute_licenses(texts[r.id])
        assert set(filter(None, r.labels.split(","))) == labels | set(filter(None, r.base_labels.split(",")))
        if best >= licenses.LEAST_MATCH and not r.n_base:
            assert r.score == best
    assert brute_licenses(mit) == ({"mit"}, 26 / 29)


def test_key_phrase_is_mandatory(spark):
    texts = [
        (1, "this source code form is subject to the terms of the mozilla public license v 2 0"),
        (2, "this source code form is subject to the terms of the mozilla public license v 3 0"),
        (3, "source code form is subject to the terms of the mozilla public license v 2 0"),
    ]
    found = licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.id: r.labels for r in found} == {1: "mpl-2", 2: "", 3: "mpl-2"}


# --- 5: quality ---------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    rows, labels = [], []
    for i in range(900):
        good = i % 3 != 0
        text = prose(30 + i % 50, i)
        rows.append((i, text if good else " ".join(f"{w}###" for w in text.split(" "))))
        labels.append((i, int(good)))
    rows += [(5000, None), (5001, ""), (None, "text"), (5002, "x" * 100_000)]
    labels += [(None, 1), (7000, 0), (1, None), (2, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old"))
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(docs, known)
    found = quality.score(docs, model).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    truth = dict(labels[:900])
    checked = [r for r in found if r.doc_id in truth and r.held]
    assert len(checked) > 200
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in checked]) > 0.98


def test_quality_sums_hold_a_row_for_each_word(monkeypatch):
    """What a task gathers for its words doesn't grow with the texts, and is the same either way."""
    words = [f"{''.join(_draw.choice('abcdefgh') for _ in range(9))}{i}" for i in range(2000)]
    texts = pa.array([" ".join(_draw.sample(words, 1500)) for _ in range(400)])
    told = np.sort(np.concatenate([quality.Tokens(d, o).word for _, _, d, o in slices(pa.array([" ".join(words)]))]))

    def found():
        rows = Counter()
        tracemalloc.start()
        for part in quality._sums_of(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), told[::2]):
            for shape, word, *sums in zip(*(c.to_pylist() for c in part.columns)):
                for k, x in enumerate(sums):
                    rows[shape, word, k] += x
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return rows, peak

    monkeypatch.setattr(quality, "_TOKENS", 2000)
    rows, peak = found()
    assert peak < 60e6
    monkeypatch.setattr(quality, "_GATHERED", 900)
    assert found()[0] == rows


def test_quality_without_rows_or_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.score(no_docs, quality.train(no_docs, none)).count() == 0
    one = spark.createDataFrame([(i, 1) for i in range(100, 140)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in quality.score(docs, quality.train(docs, one)).collect())


def brute_vectors(texts, least):
    """Word vectors and pooled texts with plain dictionaries, token by token."""
    read = []
    for text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        t = quality.Tokens(data, np.array([0, len(data)]))
        read.append((t.word.tolist(), t.shape.tolist()))
    index = lambda h: quality.random_vectors(np.array([h], np.uint64))[0].astype(float)
    look = quality.shape_vectors().astype(float)
    n, sums, shape_n, shape_sums = Counter(), {}, Counter(), {}
    for words, shapes in read:
        for i, (w, s) in enumerate(zip(words, shapes)):
            near = [j for j in range(i - 2, i + 3) if j != i and 0 <= j < len(words)]
            x = look[s] + sum((index(words[j]) + look[shapes[j]] for j in near), np.zeros(48))
            n[w] += 1
            shape_n[s] += 1
            sums[w] = sums.get(w, 0) + x
            shape_sums[s] = shape_sums.get(s, 0) + x
    total = sum(n.values())

    def unit(x, count):
        return np.log1p(total / max(count, 1)) / 10 * x / max(np.linalg.norm(x), 1e-9)

    of = {w: unit(index(w) + sums[w], n[w]) if n[w] >= least else unit(index(w), least) for w in n}
    shape_of = {s: unit(look[s] + shape_sums[s], shape_n[s]) for s in shape_n}
    out = []
    for words, shapes in read:
        size = max(1, len(words))
        out.append(np.concatenate([
            sum((of[w] for w in words), np.zeros(48)) / size, sum((shape_of[s] for s in shapes), np.zeros(48)) / size
        ]))
    return np.array(out)


@pytest.mark.parametrize("words_held, told", [(100_000, 4_000_000), (40, 4_000_000), (1, 10)])
def test_word_vectors_and_pooling(spark, monkeypatch, words_held, told):
    monkeypatch.setattr(quality, "WORDS_TOLD", told)
    monkeypatch.setattr(quality, "_TOKENS", 700)  # runs end inside texts, on the driver's side
    texts = [t for _, t in odd_texts() if t is None or len(t) < 5000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    held, rest = quality.dictionary(docs, 5, words_held)
    wanted = {t or "": x for t, x in zip(texts, brute_vectors(texts, 5))}
    if rest is None:
        found = dict(zip(wanted, quality.pooled(pa.array(list(wanted)), held)))
    else:
        assert len(held.words) == words_held
        shared = spark.sparkContext.broadcast(held)
        keys = spark.createDataFrame([(t,) for t in wanted], "text string")
        k1, k2 = quality._text_key(F.col("text"))
        rows = keys.select("text", k1.alias("k1"), k2.alias("k2")).join(
            quality._with_others(docs, (shared, rest), 5), ["k1", "k2"]
        )
        found = {r.text: np.frombuffer(r.x, "<f4") for r in rows.collect()}
    assert found.keys() == wanted.keys()
    for text, x in wanted.items():
        assert np.allclose(found[text], x, atol=1e-5), text[:50]


def test_sums_of_runs_add_up(monkeypatch):
    data = np.frombuffer(prose(3000, 8).encode(), np.uint8)
    t = quality.Tokens(data, np.array([0, 5000, 5000, len(data)]))
    looks = quality.shape_vectors()

    def total():
        of = list(quality._around(t, looks))
        return *quality._combined([(ids, sums) for ids, sums, _ in of]), sum(x for _, _, x in of)

    whole = total()
    monkeypatch.setattr(quality, "_TOKENS", 7)
    assert all((a == b).all() for a, b in zip(whole, total()))


def test_sums_of_told_words_only():
    data = np.frombuffer(prose(3000, 8).encode(), np.uint8)
    t = quality.Tokens(data, np.array([0, 5000, 5000, len(data)]))
    (ids, sums, looks), = quality._around(t, quality.shape_vectors())
    (some, of_some, same_looks), = quality._around(t, quality.shape_vectors(), ids[::3])
    assert (some == ids[::3]).all() and (of_some == sums[::3]).all() and (looks == same_looks).all()


def test_frequent_words_depend_on_their_share_alone(spark):
    texts = [("aa " * 3 + f"b{i} cc",) for i in range(3)] + [("dd " * 4,)]
    of = [
        quality.dictionary(spark.createDataFrame(texts * times, "text string"), rarest=8)[0].words.tolist()
        for times in (1, 2, 40)
    ]
    assert len(of[0]) == 3 and of[0] == of[1] == of[2]  # 19 tokens: aa, cc and dd
    few = quality.dictionary(spark.createDataFrame(texts, "text string"))[0]
    assert len(few.words) == 6


def test_quality_with_words_that_are_joined(spark, docs):
    known = docs.select("doc_id", F.col("doc_id").between(100, 399).cast("int").alias("quality"))
    several = docs.withColumn("k1", F.lit("own"))
    model = quality.train(docs, known, least=5, words_held=40)
    assert model.rest is not None
    held, _ = quality.dictionary(docs, 5)
    sure = quality.score(several, quality.Model(held, None, model.network)).collect()
    joined = quality.score(several, model)
    found = joined.collect()
    assert joined.columns == [*several.drop("score").columns, "score"] and len(found) == len(sure)
    wanted = {(r.doc_id, r.text): r.score for r in sure}
    assert all(abs(wanted[r.doc_id, r.text] - r.score) < 1e-4 and r.k1 == "own" for r in found)


def test_temperature_calibrates():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(4000, 6))
    y = (draw.random(4000) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    net = quality.fit(x, y, np.arange(4000) % 5 == 0)
    p = net.probability(x)
    for low in (0.1, 0.3, 0.6):
        near = (p > low) & (p < low + 0.2)
        assert abs(p[near].mean() - y[near].mean()) < 0.12


# --- 6: decontamination -------------------------------------------------------------------------


def brute_hits(rows, items, size=13):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items:
        words = split(text)
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(str(item) if item is not None else "")
    lengths = {len(w) for w in windows}
    out = Counter()
    for doc_id, text in rows:
        words = split(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(words[i : i + n])]
        out[doc_id, len(words), tuple(sorted(hit)), tuple(sorted(found))] += 1
    return out


@pytest.fixture(scope="module")
def items():
    base = prose(300, 1).split(" ")
    return [
        (1, " ".join(base[20:60])), (2, " ".join(base[50:63]).upper()), (3, "word"), (4, None), (5, " "),
        (None, "one two, three FOUR"), (6, prose(40, 900)), (7, " ".join(base[100:112])), (7, "cc by"),
        (8, prose(30_000, 3)[:3000]), (8, prose(30_000, 3)[:3000]),
    ]


@pytest.mark.parametrize("block", [200_000, 40])
def test_contamination(spark, docs, rows, items, block):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(docs, bench, block_windows=block).collect()
    got = Counter((r.id, r.n_words, tuple(sorted(r.hits)), tuple(r.items)) for r in found)
    assert got == brute_hits(rows, items)


def test_decontaminate(spark, docs, no_docs, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontamination.decontaminate(docs, bench)
    wanted = Counter()
    for (d, n, hits, _), times in brute_hits(rows, items).items():
        if not (hits and 20 * len(hits) >= n):
            wanted[d] += times
    assert Counter(r.doc_id for r in kept.collect()) == wanted and kept.columns == docs.columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(docs, none).count() == len(rows)
    assert decontamination.contamination(no_docs, bench).count() == 0


# --- 7: packing ---------------------------------------------------------------------------------


def test_pieces_and_packing(docs, no_docs, rows):
    cut = packing.token_pieces(docs, PATH, capacity=256)
    found = packing.pack(cut, capacity=256, group_pieces=60).collect()
    whole = Tokenizer.from_file(PATH)
    wanted = Counter()
    for doc_id, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        for piece in range(-(-len(ids) // 256)):
            part = ids[256 * piece : 256 * piece + 256]
            crc = zlib.crc32(np.array(part, "<u4").tobytes())
            wanted[doc_id, piece, 256 * piece, len(part), crc] += 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(packing.token_pieces(no_docs, PATH)).count() == 0


def test_local_search_beats_its_start():
    # best fit by decreasing length needs three bins here, exchanges find two
    bins = packing.Bins(np.array([6, 5, 5, 4, 3, 3, 4]), 15)
    bins.best_fit()
    before = sum(bool(x) for x in bins.items)
    bins.improve()
    assert sum(bool(x) for x in bins.items) <= before
    draw = np.random.default_rng(3)
    better = 0
    for _ in range(60):
        lengths = draw.integers(15, 55, 60)
        bins = packing.Bins(lengths, 100)
        bins.best_fit()
        before = sum(bool(x) for x in bins.items)
        bins.improve()
        after = sum(bool(x) for x in bins.items)
        assert -(-lengths.sum() // 100) <= after <= before
        better += after < before
        assert sorted(i for x in bins.items for i in x) == list(range(60))
        assert all(bins.room[b] == 100 - lengths[x].sum() >= 0 for b, x in enumerate(bins.items) if x)
    assert better > 0


# --- 8: sharding --------------------------------------------------------------------------------


def test_sharding(docs, no_docs, rows):
    placed = sharding.placed(docs, shards=16, seed=1, bucket_bytes=1 << 16, bucket_rows=20)
    found = placed.collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(rows)
    assert all(r.size == len((r.text or "").encode()) + 1 for r in found)
    shards = defaultdict(list)
    for r in found:
        shards[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert set(shards) == set(range(16))
    sizes = [len(s) for s in shards.values()]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.placed(docs, shards=16, seed=2, bucket_bytes=1 << 16, bucket_rows=20).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} != {(r.doc_id, r.shard, r.slot) for r in found}
    assert sharding.placed(no_docs).count() == 0


def test_written_shards(spark, docs, tmp_path):
    placed = sharding.placed(docs, shards=4, seed=1)
    sharding.write_shards(placed, str(tmp_path / "shards"), parts=6)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count()
    for shard in range(4):
        files = sorted((tmp_path / "shards" / f"shard={shard}").glob("part-*"))
        slots = [x for f in files for x in pd.read_parquet(f)["slot"]]
        assert slots == list(range(len(slots)))


def test_shards_are_written_in_the_order_of_buckets(spark, docs, rows, tmp_path):
    placed = sharding.placed(docs, shards=4, seed=1, bucket_bytes=1 << 16, bucket_rows=20)
    sharding.write_shards(placed, str(tmp_path / "shards"))
    back = sharding.stored(spark, str(tmp_path / "shards"), "doc_id long, text string, slot long")
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows)
    for shard in range(4):
        files = sorted((tmp_path / "shards" / f"shard={shard}").glob("part-*"))
        slots = [x for f in files for x in pd.read_parquet(f)["slot"]]
        assert len(files) > 1 and slots == list(range(len(slots)))


def test_fewer_rows_than_shards(spark):
    few = spark.createDataFrame([(i, "t") for i in range(3)], "doc_id long, text string")
    found = sharding.placed(few, shards=16).collect()
    assert len({r.shard for r in found}) == 3 and {r.slot for r in found} == {0}


# --- 9: main text of pages ----------------------------------------------------------------------

PAGES = [
    ("<article><h1>T &amp; U</h1><p>a <b>b</b>c<br>d &lt;x&gt; &amp;am &amp</p></article>", "T & U a bc d <x> &am &"),
    ("<nav><li>m</nav><article><p>one<aside>x</aside><p>two <form>f</form></article><footer>f", "one two"),
    ("<article><p>kept</p><div class='comments'><article><p>reader</p></article></div></article>", "kept"),
    ("<body><nav><ul><li>open<article><p>text</p></article>", "text"),
    ('<main><div class="cookie-notice">c</div><p>main <a href="x>y">link</a>.</p></main>', "main link."),
    ("<article><script>var t='</p>';</script><style>p{}</style><!-- no --><p>\n a \t b\n</p></article>", "a b"),
    ('<article><div class="ad">buy</div><p>x</p><div id="sidebar">s</div><header>h</header></article>', "x"),
    ("", ""), (None, ""), ("no markup & nothing", "no markup & nothing"), ("<p>a < b</p>", "a < b"),
    ("<article></article>", ""), ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
    ('<body class="has-sidebar"><article><p>a</p></article>', "a"),
    ('<body class="search-open"><article><p>b</p></article>', "b"),
    ('<div class="content-sidebar-wrap"><article><p>c</p></article></div>', "c"),
    ('<main class="site-main has-sidebar"><p>d</p></main>', "d"),
    ('<article class="post share-enabled"><p>e</p></article>', "e"),
    ('<article><div class="social-history"><p>f</p></div><p class="notice-of-meeting">g</p></article>', "f g"),
    ("<article><p>as <math><mi>x</mi><mo>=</mo><mn>1</mn></math> is</p></article>", "as x=1 is"),
    ('<article><p>own</p></article><article class="teaser"><p>other</p></article>', "own"),
    ('<form id="aspnet"><div class="site-footer">f</div><article><p>in a form</p></article></form>', "in a form"),
    ('<article><p>x</p><div class="share-buttons">s</div><ul class="related-posts"><li>r</ul></article>', "x"),
    ("<article><p hidden>h</p><p role='note'>n</p><textarea>t</textarea></article>", "n"),
]


def test_main_text(spark):
    rows = [(i, f"http://h{i}.example/x", h) for i, (h, _) in enumerate(PAGES)]
    rows += [(None, None, "<p>odd</p>"), (90, "::", "<article>o</article>"), (90, "::", "<article>o</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit(c) for c in ("row", "host", "text", "blocks", "run")})
    found = html_text.extract(pages).collect()
    got = {r.page_id: r.text for r in found}
    assert [got[i] for i in range(len(PAGES))] == [t for _, t in PAGES]
    assert got[None] == "odd" and len(found) == len(rows)
    assert html_text.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("per_array", [2, 512])
def test_boilerplate_of_a_host(spark, per_array):
    common = "subscribe to our daily letter for more stories like this one today"
    rows = []
    for i in range(12):
        rows.append((i, "http://a.example/", f"<body><p>{common}</p><p>{prose(30, i)}</p><div>{common}</div>"))
    rows.append((50, "http://b.example/", f"<body><p>{common}</p>"))
    rows.append((51, "http://a.example/", f"<body><article><p>{common}</p></article>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages, pages_per_array=per_array).collect()}
    assert all(got[i] == prose(30, i) for i in range(12))
    assert got[50] == common and got[51] == common


def test_copied_texts_stay(spark):
    body, other = prose(40, 1), prose(40, 2)
    common = "subscribe to our daily letter for more stories like this one today"
    rows = [(i, "http://two.example/", f"<body><p>{body}</p><div>menu of page {i}</div>") for i in range(2)]
    # one text on every third page of a host, whose pages share a line
    rows += [(10 + i, "http://ten.example/", f"<body><p>{common}</p><p>{other}</p>") for i in range(3)]
    rows += [(20 + i, "http://ten.example/", f"<body><p>{common}</p><p>{prose(40, 30 + i)}</p>") for i in range(7)]
    # a passage inside a longer block is no boilerplate
    rows += [(30 + i, "http://part.example/", f"<body><p>{prose(9, i)} {common} {prose(9, 50 + i)}</p>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert all(got[i] == f"{body} menu of page {i}" for i in range(2))
    assert all(got[10 + i] == other for i in range(3))
    assert all(got[20 + i] == prose(40, 30 + i) for i in range(7))
    assert all(got[30 + i] == f"{prose(9, i)} {common} {prose(9, 50 + i)}" for i in range(5))


def test_repeated_runs_against_brute_force():
    draw = random.Random(4)
    streams = [[draw.choice("abc") for _ in range(draw.randint(0, 60))] for _ in range(30)]
    runs, pages = html_text.repeated_runs(streams)
    want = defaultdict(set)
    for k, s in enumerate(streams):
        for i, h in enumerate(html_text.run_hashes(s).tolist()):
            want[h].add(k)
    assert dict(zip(runs.tolist(), pages.tolist())) == {h: len(p) for h, p in want.items()}


def test_many_open_tags_are_fast():
    html_text.Page("<a '" * 50_000).main_text()
    html_text.Page("<p " + 'x="1" ' * 50_000).main_text()


# --- 10: chat -----------------------------------------------------------------------------------


def folded(spark, events):
    schema = "conversation long, seq long, message string, kind string, role string, text string"
    rows = chat.fold_events(spark.createDataFrame(events, schema)).collect()
    return [(r.role, r.text) for r in sorted(rows, key=lambda r: (r.conversation or -1, r.place))]


def test_fold_events(spark):
    log = [
        (1, 1, "u", "message", "user", "hello"), (1, 2, "a", "message", "assistant", None),
        (1, 3, "a", "delta", None, "Hi "), (1, 4, "a", "delta", None, "there"),
        (1, 5, "u", "edit", None, "hello!"), (1, 6, "a", "regenerate", None, ""),
        (1, 7, "a", "delta", None, "Good "), (1, 8, "a", "delta", None, "day"),
        (1, 9, "x", "message", "user", "gone"), (1, 10, "x", "delete", None, None),
        (1, 11, "d", "delta", "tool", "late"),
    ]
    draw = random.Random(1)
    for _ in range(2):
        draw.shuffle(log)
        assert folded(spark, log) == [("user", "hello!"), ("assistant", "Good day"), ("tool", "late")]
    assert folded(spark, [(1, 1, "m", "delete", None, None), (1, 2, "m", "message", "user", "back")]) == [
        ("user", "back")
    ]


NASTY = [
    "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nx", "\\<|", "<\\|", "<\\\\|", "\\", "<|nl|>",
    "", None, "é<|\n\\n<", "\\\\<\\|<|\\",
]


def test_streamed_events_fold_back(spark):
    """A log of deltas, edits, regenerations and deletions ends in the messages it was made from."""
    texts = ["", None, "ok", "<|im_end|> \\ </s>", "déjà \U0001f600\n" * 90, "long words " * 60_000]
    roles = ["user", "assistant", None, "assistant"]
    rows = [(c, p, roles[(c + p) % 4], texts[(c + p) % 6]) for c in range(30) for p in range(5)]
    schema = "conversation bigint, place int, role string, text string"
    messages = spark.createDataFrame(rows, schema).withColumn("kind", F.lit("clash"))
    events = chat.streamed_events(messages).cache()
    kinds = {r["kind"]: r["count"] for r in events.groupBy("kind").count().collect()}
    assert set(kinds) == set(chat.EVENTS) and sum(kinds.values()) > 4 * len(rows)
    assert events.agg(F.max(F.length("text"))).first()[0] >= 600_000  # a user's message comes whole
    assert events.where("kind = 'delta'").agg(F.max(F.length("text"))).first()[0] <= 207
    assert events.groupBy("conversation", "seq").count().where("count > 1").count() == 0
    found = {(r["conversation"], r["place"]): (r["role"], r["text"]) for r in chat.fold_events(events).collect()}
    assert found == {(c, p): (role or "", text or "") for c, p, role, text in rows}
    assert chat.streamed_events(messages.where("false")).count() == 0


def test_chat_round_trip(spark):
    rows = []
    for c in range(6):
        for t in range(9):
            role = ["user", "assistant", None, "a\nb<|nl|>", "system"][(c + t) % 5]
            rows.append((c if c else None, t // 2 if c == 3 else t, role, NASTY[(c * 5 + t) % len(NASTY)]))
    events = spark.createDataFrame(
        [(c, t, i, "message", r, x) for i, (c, t, r, x) in enumerate(rows)],
        "conversation long, seq long, message int, kind string, role string, text string",
    )
    rendered = chat.render(chat.fold_events(events))
    back = {r.conversation: r for r in chat.read_back(rendered).collect()}
    digest = {r.conv_id: r for r in chat.digests(chat.read_back(rendered)).collect()}
    whole = {r.conversation: r for r in rendered.collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t, i) for i, (k, t, _, _) in enumerate(rows) if k == c))
        roles = [rows[i][2] or "" for _, i in turns]
        texts = [rows[i][3] or "" for _, i in turns]
        assert back[c].roles == roles and back[c].texts == texts
        trained = "".join(x for r, x in zip(roles, texts) if r == "assistant")
        assert back[c].trained_text == trained
        d = digest[c]
        said = "".join(f"{r}\n{x}\n" for r, x in zip(roles, texts))
        assert d.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (d.n_turns, d.loss_chars) == (len(turns), len(trained))
        assert d.loss_sha256 == hashlib.sha256(trained.encode()).hexdigest()
        text = whole[c].formatted
        assert d.formatted_chars == len(text) == sum(t.length for t in whole[c].turns)
        for turn, role in zip(whole[c].turns, roles):
            under = text[turn.mask_start : turn.mask_start + turn.mask_length]
            assert bool(turn.mask_length == 0) or role == "assistant" and "<|" not in under
    assert chat.digests(chat.read_back(chat.render(chat.fold_events(events.where("false"))))).count() == 0


# --- licences in very long texts ----------------------------------------------------------------


def test_licences_in_very_long_texts(spark):
    mit = licenses.TEMPLATES[1][1]
    texts = {
        1: "gnu " * 300_000, 2: "license " * 500_000, 3: "zzz " * 300_000, 4: "licensed under the " * 50_000,
        5: f"{'gnu ' * 100_000}{mit} {'software ' * 100_000}",
        6: f"{prose(5000, 1)} {licenses._MIT} {prose(5000, 2)} {licenses._BSD_START} {licenses._BSD_THIRD} {licenses._BSD_END}",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {r.id: r for r in licenses.scan_licenses(df).collect()}
    assert {i: r.labels for i, r in found.items()} == {1: "", 2: "", 3: "", 4: "", 5: "mit", 6: "bsd,bsd-3,mit"}
    assert found[5].score == found[6].score == 1.0 and found[2].n_words == 500_000


def test_whole_notices(spark):
    wanted = {
        "MIT": "mit", "ISC": "isc", "BSD_END": "", "APACHE": "apache-2", "MPL": "mpl-2", "BSD_START": "bsd",
    }
    texts = [(name, getattr(licenses, f"_{name}").upper()) for name in wanted]
    texts += [("bsd-2", f"{licenses._BSD_START}; {licenses._BSD_END}"), ("agpl-3", f"x {licenses.TEMPLATES[-2][1]}")]
    texts += [("gpl-3", f"This program {licenses.TEMPLATES[-5][1]}"), ("gpl-2", licenses.TEMPLATES[-6][1])]
    df = spark.createDataFrame(texts, "doc_id string, text string")
    found = {r.id: set(r.labels.split(",")) for r in licenses.scan_licenses(df).collect()}
    for name, labels in found.items():
        assert wanted.get(name, name) in labels or not wanted.get(name, name), (name, labels)
    assert found["gpl-3"] == {"gpl-3"} and found["agpl-3"] == {"agpl-3"} and "bsd-3" not in found["bsd-2"]
