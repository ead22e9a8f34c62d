"""Memory of Python workers."""

import tracemalloc

import numpy as np
import pandas as pd

import corpus_pipeline
from wayloom.llm import near_dedup, packing, quality, workers
from wayloom.llm.queries import tokenizer_path

from .corpus import documents, frame

FOLDER = "/root/testdata/sf0.001"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
TOKENIZER = tokenizer_path("word_bpe_49k.json")


def test_a_worker_keeps_one_operators_cache(spark):
    """Whatever operators a worker has served, it never holds word hashes and token ids at once."""
    docs = frame(spark, documents(0)).repartition(8).localCheckpoint()

    def held(batches):
        from wayloom.llm import packing, wordhash

        for batch in batches:
            yield pd.DataFrame({"words": [len(wordhash._known)], "ids": [len(packing._ids)]})

    seen = []
    for _ in range(2):
        near_dedup.near_dedup(docs).count()
        packing.pack_documents(docs, TOKENIZER).count()
        seen += docs.select("doc_id").mapInPandas(held, "words long, ids long").collect()
    assert any(r["ids"] for r in seen)
    assert not [r for r in seen if r["words"] and r["ids"]]


def test_scoring_takes_a_few_times_the_features(spark):
    """Features of a batch are made row by row, as the same 32-bit numbers as all at once."""
    texts = pd.Series([f"Some words {i} of a text, {i * i}." for i in range(2000)])
    quality._matrix(texts[:1])
    tracemalloc.start()
    found = quality._matrix(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(found, np.array([quality.features(t) for t in texts], np.float32))
    assert peak < 2 * found.nbytes
    assert quality._matrix(pd.Series([], dtype=object)).shape == (0, found.shape[1])


def test_pipeline_sends_small_batches(spark, monkeypatch):
    """A stage's batches are bounded by bytes, however many rows; a bound that the session has stays, and so does its default."""
    rows = [(i, f"{i} " + "word " * 2000, "en", "web") for i in range(1500)]  # 15 MB
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"mb": [batch["text"].str.len().sum() / 1e6]})

    spark.conf.unset(BATCH)
    try:
        corpus_pipeline.pack(spark, docs.limit(1), "")
        assert max(r["mb"] for r in docs.mapInPandas(sizes, "mb double").collect()) <= 5
        spark.conf.unset(BATCH)
        monkeypatch.setattr(corpus_pipeline, "STAGES", [("probe", lambda spark, df, sf_dir: docs.mapInPandas(sizes, "mb double"))])
        assert max(r["mb"] for r in corpus_pipeline.run(spark, FOLDER).collect()) <= 5 and BATCH not in spark.conf.getAll
        spark.conf.set(BATCH, "1MB")
        assert not workers.small_batches(spark) and spark.conf.get(BATCH) == "1MB"
    finally:
        spark.conf.unset(BATCH)
