"""The registered queries on the small tables, and the pipeline against brute force."""

from __future__ import annotations

import zlib

import corpus_pipeline
import pyarrow as pa
from conftest import DATA
from pyspark.sql import functions as F
from tablume.llm import queries
from tablume.llm.common import table
from test_operators import brute_components, brute_copies, brute_hits, normal


def test_pipeline_stages(spark):
    docs = table(spark, DATA, "documents")
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        after = docs.collect()
        rows = [(r.doc_id, r.text) for r in before]
        kept = {r.doc_id for r in after}
        if name == "quality":
            known = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
            wrong = [d for d, _ in rows if d in known and (d in kept) != (known[d] == 1)]
            assert len(wrong) <= 0.03 * len(known)
        elif name == "exact_dedup":
            assert kept == {k[0] for k in brute_copies(rows) if k[3]}
        elif name == "ngram_join":
            assert kept == {c if n else d for d, n, c in brute_components(rows)}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
            assert kept == {
                d for d, n, hits, _ in brute_hits(rows, items) if not (hits and 20 * len(hits) >= n)
            }
        else:
            assert kept == {d for d, _ in rows}
        if name != "packing":
            assert docs.columns == table(spark, DATA, "documents").columns
            texts = dict(rows)
            assert all(r.text == texts[r.doc_id] for r in after)
        before = after


def test_run_gives_the_last_stage(spark):
    assert {"doc_id", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, DATA).columns)


def test_queries_give_a_row_for_each_input(spark):
    n = table(spark, DATA, "documents").count()
    for name in ("op2_ngram_join", "op4_licenses", "op5_quality", "op8_sharding"):
        assert queries.QUERIES[name](spark, DATA).count() == n
    pages = table(spark, DATA, "pages")
    assert queries.QUERIES["op9_html_text"](spark, DATA).count() == pages.count()


def test_ngram_query_is_exact(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    found = queries.QUERIES["op2_ngram_join"](spark, DATA).collect()
    wanted = brute_components(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == set(wanted)


def test_sharding_query_tells_what_the_files_hold(spark, monkeypatch):
    def lossy(placed, path, real=queries.sharding.write_shards):
        real(placed.withColumn("text", F.expr("substr(text, 2)")).where("slot > 0"), path)

    documents = table(spark, DATA, "documents")
    known = {r.doc_id: r.text or "" for r in documents.collect()}
    found = queries.QUERIES["op8_sharding"](spark, DATA).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in found} == {
        (d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in known.items()
    }
    monkeypatch.setattr(queries.sharding, "write_shards", lossy)
    lost = queries.QUERIES["op8_sharding"](spark, DATA).collect()
    assert len(lost) == len(found) - 16
    assert all(r.text_crc32 == zlib.crc32(known[r.doc_id][1:].encode()) for r in lost)


def test_added_conversation(spark):
    found = {r.conv_id: r for r in queries.QUERIES["op10_chat"](spark, DATA).collect()}
    assert found[-7].n_turns == 2 and found[-7].loss_chars == len("</s>[INST] ok [/INST]")
    assert normal("a \t b") == "a b"


def test_stages_bound_the_bytes_of_arrow_batches(spark, monkeypatch):
    """Ten thousand long texts are not one batch, neither inside a stage nor when its rows are read."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    texts = spark.range(2000, numPartitions=1).selectExpr("id AS doc_id", "repeat('some words ', 1000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(name, before)
            with monkeypatch.context() as patched:
                patched.setattr(corpus_pipeline.quality, "train", lambda *a: None)
                patched.setattr(corpus_pipeline.quality, "score", lambda docs, *a, **k: docs.withColumn(k["name"], F.lit(1.0)))
                patched.setattr(corpus_pipeline.exact_dedup, "exact_dedup", lambda docs: docs)
                patched.setattr(corpus_pipeline.ngram_join, "near_dedup", lambda docs: docs)
                patched.setattr(corpus_pipeline.decontamination, "decontaminate", lambda docs, _: docs)
                patched.setattr(corpus_pipeline.packing, "token_pieces", lambda docs, _: docs)
                patched.setattr(corpus_pipeline.packing, "pack", lambda docs: docs)
                out = stage(spark, texts, DATA)
            assert out.mapInArrow(sizes, "size long").agg(F.max("size")).first()[0] < 2 * corpus_pipeline.BATCH_BYTES
    finally:
        spark.conf.set(name, before)
