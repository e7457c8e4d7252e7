"""One registered query for each operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import public_tokenizers

from tablume.llm import (
    chat,
    collocations,
    decontamination,
    exact_dedup,
    html_text,
    licenses,
    ngram_join,
    packing,
    quality,
    repeats,
    sharding,
    spelling,
    training_order,
)
from tablume.llm.common import durable, table
from tablume.sources.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


@query("op2_ngram_join")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        "links",
    )


@query(
    "op3_exact_dedup",
    r"""
    WITH t AS (
      SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
      FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id,
           count(*) OVER (PARTITION BY h) AS group_size,
           row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST) = 1 AS kept,
           h AS text_sha256
    FROM t""",
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, folder, "documents"), hash_all=True)
    return groups.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.col("sha256").alias("text_sha256"),
    )


@query("op8_sharding")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    sharding.write_shards(
        sharding.placed(table(spark, folder, "documents"), shards=16, seed=20, stable=True), path
    )
    # everything that is told comes from the written files
    return sharding.stored(spark, path, "doc_id long, text string, slot long").select(
        "doc_id",
        sharding.size_of(F.col("text")).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


CHAT_SQL = r"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    f AS (
      SELECT *, CASE WHEN r = 'assistant' THEN t ELSE '' END AS l,
             replace(replace(replace(r, '\', '\\'), '<|', '<\|'), chr(10), '<|nl|>') AS er,
             replace(replace(t, '\', '\\'), '<|', '<\|') AS et
      FROM c)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
           CAST(sum(length(l)) AS BIGINT) AS loss_chars,
           sha256(string_agg(l, '' ORDER BY turn, r, t)) AS loss_sha256,
           CAST(sum(length('<|im_start|>') + length(er) + 1 + length(et) + length('<|im_end|>') + 1)
                AS BIGINT) AS formatted_chars
    FROM f GROUP BY conv_id"""


@query("op10_chat", CHAT_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.element_at(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int") + 1).alias("role"),
        F.lit(text).alias("text"),
    )
    in_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    # every row of the table is a message of its own, also where a turn is repeated
    messages = rows.unionByName(added).select(
        F.col("conv_id").alias("conversation"),
        (F.row_number().over(in_turn) - 1).alias("place"),
        "role",
        "text",
    )
    events = chat.streamed_events(messages)
    return chat.digests(chat.read_back(chat.render(chat.fold_events(events))))


def tokenizer_path() -> str:
    return str(public_tokenizers.path("word_bpe_49k.json"))


@query("op1_training_order")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "training-order")
    docs = table(spark, folder, "documents")
    made = training_order.materialise(docs, path, tokenizer_path(), key=20)
    # written, so that the join knows its size
    back = durable(training_order.stored(spark, path), "stored").select(
        "slot",
        F.col("length").alias("stored_length"),
        F.col("ids_crc32").alias("stored_crc32"),
    )
    return made.join(back, "slot", "left").select(
        F.col("id").alias("doc_id"),
        "piece",
        "length",
        "ids_crc32",
        "slot",
        "shard",
        "place",
        "stored_length",
        "stored_crc32",
    )


@query("op4_licenses")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    return found.withColumnRenamed("id", "doc_id")


@query("op7_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    cut = packing.token_pieces(table(spark, folder, "documents"), tokenizer_path())
    return packing.pack(cut).withColumnRenamed("id", "doc_id")


WORDS_SQL = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query(
    "op6_decontamination",
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
    b AS (SELECT item_id, w, least(13, len(w)) AS n
          FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
           FROM b, unnest(range(1, len(w) - n + 2)) AS t(i)),
    sizes AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
           FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
    m AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, s)),
    h AS (SELECT r, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) AS t(p) GROUP BY r),
    k AS (SELECT r, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT CAST(item_id AS VARCHAR), ','
                            ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM m GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)""",
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return decontamination.contaminated(found).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op5_quality")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, folder, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op9_html_text")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages")).withColumn(
        "n_chars", F.length("text").cast("bigint")
    )


@query(
    "op11_repeats",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
    t AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s
          FROM d, unnest(range(1, len(w) - 33)) AS u(i)),
    again AS (SELECT s FROM t GROUP BY s HAVING count(*) > 1),
    gone AS (SELECT DISTINCT r, p FROM t JOIN again USING (s), unnest(range(i, i + 35)) AS v(p)),
    words AS (SELECT r, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
    kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
             FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
           sha256(coalesce(text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (r)""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.substring_dedup(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_removed",
        F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"),
    )


@query("op13_spelling")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    words = durable(spelling.vocabulary(table(spark, folder, "documents")), "vocabulary")
    return spelling.spelling_variants(words)


@query(
    "op12_collocations",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
             string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                          'abcdefghijklmnopqrstuvwxyz'),
                                '[.,;:!?\x0A-\x0D]') AS pieces
      FROM documents),
    p AS (SELECT r, lang, regexp_extract_all(pieces[j], '[^\x20\x09]+') AS w
          FROM d, unnest(range(1, len(pieces) + 1)) AS u(j)),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
    grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
              FROM p, unnest(range(1, 6)) AS u(k), unnest(range(1, len(w) - k + 2)) AS v(i)),
    f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
    c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
    parts AS (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
              FROM c, unnest(range(2, k)) AS u(m), unnest(range(1, k - m + 2)) AS v(i)),
    longer AS (SELECT lang, phrase, max(a) AS most FROM parts GROUP BY ALL),
    cuts AS (
      SELECT c.lang, c.phrase, c.a, x, l.a AS l, r.a AS r, n,
             (CAST(1000 AS HUGEINT) * c.a * n) // (CAST(l.a AS HUGEINT) * r.a) AS score
      FROM c LEFT JOIN longer USING (lang, phrase), unnest(range(1, k)) AS u(x), f AS l, f AS r, totals
      WHERE l.lang = c.lang AND l.phrase = array_to_string(w[1:x], ' ')
        AND r.lang = c.lang AND r.phrase = array_to_string(w[x + 1:], ' ')
        AND totals.lang = c.lang AND (most IS NULL OR 100 * most < 100 * c.a)),
    lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, x) AS o FROM cuts),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang
                                            ORDER BY score DESC, a DESC, encode(phrase)) AS rank
               FROM lowest WHERE o = 1)
    SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
    FROM ranked WHERE rank <= 2000""",
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))
