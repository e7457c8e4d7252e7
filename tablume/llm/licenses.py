"""Licence scans with a positional index of rare words, in DataFrame operations only.

Of each licence text the words that are rarest in the corpus are indexed with their places. A
file's occurrences of such words propose alignments (licence, place in the file); alignments that
two different rare words agree on are compared word by word, and stand if the licence's mandatory
phrases are there too. So many words are indexed that no alignment with LEAST_MATCH is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablume.llm.common import lower_ascii

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Phrases that name a licence wherever their words stand consecutively.
BASE = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

# Licence texts as words, each with the phrases that must be found in a match.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files the software to deal in the software "
        "without restriction",
        ["hereby granted free of charge", "without restriction"],
    ),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    (
        "lgpl-3",
        "licensed under the gnu lesser general public license version 3",
        ["gnu lesser general public license version 3"],
    ),
    (
        "agpl-3",
        "licensed under the gnu affero general public license version 3",
        ["gnu affero general public license version 3"],
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4"]),
    (
        "cc-by",
        "licensed under a creative commons attribution 4 0 international license",
        ["creative commons attribution 4"],
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ["mozilla public license v 2"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        ["source and binary forms", "following conditions are met"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or "
        "without fee is hereby granted",
        ["with or without fee is hereby granted"],
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ["unencumbered software"],
    ),
]

# Whole notices, as they stand in files.
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software
and associated documentation files the software to deal in the software without restriction including
without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
of the software and to permit persons to whom the software is furnished to do so subject to the
following conditions the above copyright notice and this permission notice shall be included in all
copies or substantial portions of the software the software is provided as is without warranty of any
kind express or implied including but not limited to the warranties of merchantability fitness for a
particular purpose and noninfringement in no event shall the authors or copyright holders be liable for
any claim damages or other liability whether in an action of contract tort or otherwise arising from
out of or in connection with the software or the use or other dealings in the software"""
_ISC = """permission to use copy modify and or distribute this software for any purpose with or without
fee is hereby granted provided that the above copyright notice and this permission notice appear in all
copies the software is provided as is and the author disclaims all warranties with regard to this
software including all implied warranties of merchantability and fitness in no event shall the author be
liable for any special direct indirect or consequential damages or any damages whatsoever resulting from
loss of use data or profits whether in an action of contract negligence or other tortious action arising
out of or in connection with the use or performance of this software"""
_BSD_START = """redistribution and use in source and binary forms with or without modification are
permitted provided that the following conditions are met 1 redistributions of source code must retain
the above copyright notice this list of conditions and the following disclaimer 2 redistributions in
binary form must reproduce the above copyright notice this list of conditions and the following
disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_THIRD = """3 neither the name of the copyright holder nor the names of its contributors may be used
to endorse or promote products derived from this software without specific prior written permission"""
_BSD_END = """this software is provided by the copyright holders and contributors as is and any express
or implied warranties including but not limited to the implied warranties of merchantability and fitness
for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable
for any direct indirect incidental special exemplary or consequential damages including but not limited
to procurement of substitute goods or services loss of use data or profits or business interruption
however caused and on any theory of liability whether in contract strict liability or tort including
negligence or otherwise arising in any way out of the use of this software even if advised of the
possibility of such damage"""
_APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in
compliance with the license you may obtain a copy of the license at http www apache org licenses license
2 0 unless required by applicable law or agreed to in writing software distributed under the license is
distributed on an as is basis without warranties or conditions of any kind either express or implied see
the license for the specific language governing permissions and limitations under the license"""
_GNU = """is free software you can redistribute it and or modify it under the terms of the gnu {name} as
published by the free software foundation either version {version} or at your option any
later version this {what} is distributed in the hope that it will be useful but without any warranty
without even the implied warranty of merchantability or fitness for a particular purpose see the gnu
{name} for more details"""
_MPL = """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of
the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"""


def _notice(label: str, *parts: str, keys: list[str]) -> tuple[str, str, list[str]]:
    return label, " ".join(" ".join(parts).split()), keys


def _gnu(label: str, name: str, version: str, what: str = "program") -> tuple[str, str, list[str]]:
    text = _GNU.format(name=name, version=version, what=what)
    return _notice(label, text, keys=[f"terms of the gnu {name}", f"either version {version}"])


TEMPLATES += [
    _notice("mit", _MIT, keys=["hereby granted free of charge", "without warranty of any kind"]),
    _notice("isc", _ISC, keys=["with or without fee is hereby granted"]),
    _notice(
        "bsd-2", _BSD_START, _BSD_END,
        keys=["source and binary forms", "following disclaimer in the documentation and or other "
              "materials provided with the distribution this software is provided by"],
    ),
    _notice(
        "bsd-3", _BSD_START, _BSD_THIRD, _BSD_END, keys=["source and binary forms", "endorse or promote products"]
    ),
    _notice("apache-2", _APACHE, keys=["apache license version 2"]),
    _gnu("gpl-2", "general public license", "2 of the license"),
    _gnu("gpl-3", "general public license", "3 of the license"),
    _gnu("lgpl-2", "lesser general public license", "2 1 of the license", "library"),
    _gnu("lgpl-3", "lesser general public license", "3 of the license"),
    _gnu("agpl-3", "affero general public license", "3 of the license"),
    _notice("mpl-2", _MPL, keys=["mozilla public license v 2"]),
]

#: Words of each licence text that are indexed at least.
RARE_WORDS = 4
LEAST_MATCH = 0.8


def words_to_index(size: int) -> int:
    """How many different words of a licence text of ``size`` words are indexed.

    A match may lack so many words that LEAST_MATCH still holds; each can take one indexed word
    away, and two must be left.
    """
    lacking = max(m for m in range(size + 1) if (size - m) / size >= LEAST_MATCH)
    return max(RARE_WORDS, lacking + 2)


def words_to_agree(words: list[str]) -> int:
    """How many different indexed words agree in every match: two, or one in a text of few words."""
    return 2 if len(set(words)) >= words_to_index(len(words)) else 1


def words_of(text: Column) -> Column:
    """The words of a text (null: empty), A-Z in lower case."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def rare_word_index(words: DataFrame, templates) -> dict[str, list[tuple[int, int, int]]]:
    """``word: (licence text, place, its length)`` for each licence text's rarest words.

    Document frequencies come from all rows of ``words`` (a column ``words``), counted in each
    task before the exchange; only those of the fixed licence texts' words come to the driver. A
    word that no document has is rarest of all.
    """
    texts = [text.split(" ") for _, text, _ in templates]
    vocabulary = sorted({w for text in texts for w in text})
    if not vocabulary:
        return {}
    counted = (
        words.select(
            F.explode(
                F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
            ).alias("word")
        )
        .groupBy("word")
        .count()
        .collect()
    )
    documents = {r["word"]: r["count"] for r in counted}
    index: dict[str, list[tuple[int, int, int]]] = {}
    for i, text in enumerate(texts):
        rarest = sorted(set(text), key=lambda w: (documents.get(w, 0), w))
        rarest = rarest[: words_to_index(len(text))]
        for place, word in enumerate(text):
            if word in rarest:
                index.setdefault(word, []).append((i, place, len(text)))
    return index


#: Places of a file whose alignments are held at once.
_BLOCK = 2048
#: An alignment as one number: the licence text, and where its first word would stand.
_SHIFT = 1 << 40


def _word_map(index: dict[str, list[tuple[int, int, int]]]) -> Column:
    """``word: numbers`` of its postings, each the alignment that a word at place 0 proposes."""
    parts = []
    for word, postings in sorted(index.items()):
        parts += [F.lit(word), F.array(*[F.lit(t * _SHIFT - place).cast("bigint") for t, place, _ in postings])]
    return F.create_map(*parts)


def _alignments(index: dict[str, list[tuple[int, int, int]]], templates) -> Column:
    """``share, label`` of a file's best alignments, from its ``words``; at most one for each label.

    Places are gone through in blocks, so what is held beside the words is bounded by the block and
    the licence texts, however long the file is and however often it repeats a word.
    """
    words = F.col("words")
    n = F.size(words)
    postings = _word_map(index)
    texts = [text.split(" ") for _, text, _ in templates]
    all_words = F.array(*[F.split(F.lit(text), " ") for _, text, _ in templates])
    sizes = F.array(*[F.lit(len(t)) for t in texts])
    to_agree = F.array(*[F.lit(words_to_agree(t)) for t in texts])
    labels = F.array(*[F.lit(label) for label, _, _ in templates])
    mandatory = F.array(*[F.split(F.lit("|".join(keys)), "\\|") for _, _, keys in templates])
    places: list[list[int]] = [[] for _ in texts]
    for word, found in index.items():
        for t, place, _ in found:
            places[t].append(place)
    # a licence text's indexed places, one list of numbers a text
    indexed = F.array(
        *[F.split(F.lit(",".join(map(str, sorted(p)))), ",").cast("array<int>") for p in places]
    )

    def agreeing(a: Column) -> Column:
        """Do so many different indexed words stand where the alignment has them?"""
        t, at = _text_of(a), _offset_of(a)
        standing = F.filter(
            F.get(indexed, t), lambda p: F.get(words, at + p) == F.get(F.get(all_words, t), p)
        )
        different = F.array_distinct(F.transform(standing, lambda p: F.get(words, at + p)))
        return F.size(different) >= F.get(to_agree, t)

    def judged(a: Column) -> Column:
        t, at = _text_of(a), _offset_of(a)
        # a match at the very start of a file may lack the licence text's first words
        covered = F.slice(words, F.greatest(at, F.lit(0)) + 1, F.greatest(F.get(sizes, t) + F.least(at, F.lit(0)), F.lit(0)))
        pairs = F.zip_with(
            covered,
            F.slice(F.get(all_words, t), F.greatest(-at, F.lit(0)) + 1, F.greatest(F.size(covered), F.lit(1))),
            lambda x, y: F.coalesce(x == y, F.lit(False)),
        )
        share = F.size(F.filter(pairs, lambda same: same)) / F.get(sizes, t)
        text = F.concat(F.lit(" "), F.array_join(covered, " "), F.lit(" "))
        keys = F.forall(
            F.get(mandatory, t), lambda k: F.contains(text, F.concat(F.lit(" "), k, F.lit(" ")))
        )
        stands = (share >= LEAST_MATCH) & keys
        return F.struct(share.alias("share"), F.when(stands, F.get(labels, t)).alias("label"))

    def block(start: Column) -> Column:
        inside = F.sequence(start, F.least(start + _BLOCK, n) - 1)
        hits = F.filter(inside, lambda i: F.get(words, i).isin(sorted(index)))
        proposed = F.array_distinct(
            F.flatten(F.transform(hits, lambda i: F.transform(F.element_at(postings, F.get(words, i)), lambda p: p + i)))
        )
        found = F.transform(F.filter(proposed, agreeing), judged)
        # the best share, and each label that stands
        best = F.struct(
            F.array_max(F.transform(found, lambda f: f["share"])).alias("share"),
            F.lit(None).cast("string").alias("label"),
        )
        standing = F.array_distinct(F.filter(found["label"], lambda label: label.isNotNull()))
        alone = F.transform(
            standing, lambda label: F.struct(F.lit(0.0).alias("share"), label.alias("label"))
        )
        return F.when(F.size(found) > 0, F.concat(F.array(best), alone)).otherwise(
            F.array().cast("array<struct<share:double,label:string>>")
        )

    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(_BLOCK))).otherwise(
        F.array().cast("array<int>")
    )
    return F.flatten(F.transform(starts, block))


def _text_of(a: Column) -> Column:
    """Offsets are negative at the start of a file, so the number is rounded to the nearest text."""
    return F.floor((a + F.lit(_SHIFT // 2)) / F.lit(_SHIFT)).cast("int")


def _offset_of(a: Column) -> Column:
    return (a - _text_of(a).cast("bigint") * F.lit(_SHIFT)).cast("int")


def _base_columns() -> dict[str, Column]:
    """Counts and places of the base phrases in ``spaced``, where each word stands between spaces."""
    spaced = F.col("spaced")
    found, firsts, lasts, labels = [], [], [], []
    for label, phrase in sorted(BASE.items()):
        text = " " + "  ".join(phrase.split(" ")) + " "
        size = len(phrase.split(" "))
        n = F.length(spaced) - F.length(F.replace(spaced, F.lit(text), F.lit("")))
        there = F.contains(spaced, F.lit(text))
        found.append(F.when(there, n / len(text)).otherwise(0).cast("bigint"))
        before = F.substring_index(spaced, text, 1)
        after = F.substring_index(spaced, text, -1)
        spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
        firsts.append(F.when(there, (spaces(before) / 2).cast("bigint")))
        lasts.append(
            F.when(there, F.col("n_words") - size - (spaces(after) / 2).cast("bigint"))
        )
        labels.append(F.when(there, F.lit(label)))
    return {
        "n_base": sum(found[1:], found[0]),
        "first_word": F.least(*firsts),
        "last_word": F.greatest(*lasts),
        "base": F.array_compact(F.array(*labels)),
    }


def scan_licenses(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates=None
) -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row.

    ``score`` is 1 where a base phrase stands, else the share of words that agree in the best
    alignment two rare words propose (0 without one). ``labels`` are the base labels and those of
    alignments of LEAST_MATCH or more that hold all mandatory phrases. Null and empty texts have
    no words, no places (null) and empty label strings; repeated rows are scanned each by itself;
    only the two named columns are read. A very long text is one row, as in the input; beside its
    words only alignments of a bounded block of places are held, also where it repeats a word of a
    licence all along.

    Nothing but the licence words' counts is shuffled: a row's alignments are proposed, checked and
    judged within the row.
    """
    templates = TEMPLATES if templates is None else templates
    words = df.select(
        F.col(id_column).alias("id"), words_of(F.col(text_column)).alias("words")
    )
    index = rare_word_index(words, templates)
    none = F.array().cast("array<struct<share:double,label:string>>")
    spaced = F.when(F.size("words") > 0, F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")))
    scanned = words.withColumns(
        {
            "found": _alignments(index, templates) if index else none,
            "n_words": F.size("words").cast("bigint"),
            "spaced": F.coalesce(spaced, F.lit("")),
        }
    ).withColumns(_base_columns())
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    found = F.array_compact(F.col("found")["label"])
    return scanned.select(
        "id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", found)).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0))
        .otherwise(F.coalesce(F.array_max(F.col("found")["share"]), F.lit(0.0)))
        .alias("score"),
    )
