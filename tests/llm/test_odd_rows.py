"""Every operator and pipeline stage on null and repeated ids, null, empty and very long texts, ties, clashing columns and empty tables."""

import os

import pytest
from pyspark.sql import functions as F

from wayloom.llm import alignment, common, exact_dedup, fingerprints, mixing, near_dedup, packing, quality, sharding, substring_dedup, token_counts, toxicity, warc
from wayloom.llm.queries import tokenizer_path

from .corpus import COLUMNS, frame, words

FOLDER = "/root/testdata/sf0.001"
PIECES, TOKENIZER = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")
LONG = " ".join(f"long{i % 5000} text{i}" for i in range(60_000))  # 120,000 words
PLAIN = "the same plain text of some words that is here more often than once, and then some more"
ROWS = [
    (None, PLAIN, "en", "a", 1), (None, PLAIN, "en", "a", 1), (None, None, None, None, None), (7, None, None, None, None), (8, "", "en", "a", 0), (8, "", "en", "a", 0),
    (9, PLAIN, "en", "b", 1), (9, PLAIN, "en", "b", 1), (9, "another text under the same id", "en", None, 1), (10, PLAIN, None, None, None), (11, LONG, "en", "a", 1), (12, LONG + " end", "en", "c", 1), (13, " \t\n", "en", "c", 1),
    (14, "x" * 300_000, "en", "c", 1), (15, "é \U0001f600 \u0000  ", "en", "c", 1),
]
LABELS = "doc_id long, quality int, toxic int"


def labels(spark, rows=()):
    return spark.createDataFrame([(None, 1, 1), (7, None, None), (9, 1, 0), (9, 0, 1), (99, 1, 0), *rows], LABELS)


def as_pages(df):
    return df.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"), F.lit(1).alias("digest"), F.lit(2).alias("body"), F.lit(3).alias("capture"))


#: Operators that give one row per input row.
OPERATORS = {
    "op1": lambda df: token_counts.count_tokens(df, PIECES),
    "op2": lambda df: exact_dedup.exact_groups(df, digests=True),
    "op3": lambda df: near_dedup.near_groups(df),
    "op4": lambda df: fingerprints.compare_with_edits(df),
    "op5": lambda df: mixing.mix_counts(df),
    "op6": lambda df: packing.pack_documents(df, TOKENIZER).where("piece = 0"),
    "op7": lambda df: warc.roundtrip(as_pages(df)),
    "op8": lambda df: substring_dedup.repeated_passages(df, keep_text=True),
    "op9": lambda df: quality.score_quality(df, labels(df.sparkSession)),
    "op11": lambda df: alignment.link_counts(df, tokenizer_path("byte_bpe_50k.json"), PIECES, digests=True),
    "op13": lambda df: sharding.shard_documents(df),
    "op10": lambda df: toxicity.score_toxicity(df, labels(df.sparkSession)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    df = frame(spark, ROWS, clashing=True)
    got = OPERATORS[name](df).collect()
    key = "page_id" if name == "op7" else "doc_id"
    assert sorted((r[key] for r in got), key=str) == sorted((r[0] for r in ROWS), key=str)
    assert OPERATORS[name](df.limit(0)).count() == 0
    of = lambda i: [r for r in got if r[key] == i]
    if name == "op1":
        assert of(11)[0]["n_words"] == 120_000 and of(7)[0]["n_tokens"] == 0
    if name == "op2":
        assert {(r["keep_id"], r["group_size"]) for r in got if r["doc_id"] == 10} == {(10, 5)} and sorted(r["kept"] for r in of(9)) == [False, False, True]
    if name == "op3":
        assert of(12)[0]["component_id"] == 11 and [r["component_id"] for r in of(None)] == [None] * 3
    if name == "op4":
        assert of(11)[0]["near_next"] < 0.5 < of(12)[0]["near_next"] and len({r["fingerprint"] for r in got if r["n_chars"] == len(PLAIN)}) == 1
    if name == "op6":
        assert of(8)[0]["length"] == 1 and of(11)[0]["length"] == 4096
    if name == "op7":
        assert of(14)[0]["payload_bytes"] == 300_000 and of(7)[0]["payload_bytes"] == 0
    if name == "op8":
        assert of(12)[0]["n_removed"] == 120_000 and of(12)[0]["kept_text"] == "end"
    if name == "op11":
        assert of(7)[0]["n_links"] == 0 and of(11)[0]["n_links"] > 240_000 and {r["groups"] for r in of(8)} == {""} and of(14)[0]["n_a"] > 0
    if name == "op13":
        assert of(14)[0]["size"] == 300_001 and sorted(sum(r["shard"] == j for r in got) for j in range(8)) == [1] + [2] * 7
    if name in ("op9", "op10"):
        assert all(0 <= r["score"] <= 1 for r in got)


KEPT = {"exact": exact_dedup.exact_dedup, "near": near_dedup.near_dedup, "mix": mixing.mix_documents, "quality": lambda df: quality.keep_quality(df, labels(df.sparkSession))}


@pytest.mark.parametrize("name", KEPT)
def test_rows_that_stay(spark, name):
    df = frame(spark, ROWS, clashing=True)
    left = KEPT[name](df)
    assert left.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert set(got) <= {r[:2] for r in ROWS} and KEPT[name](df.limit(0)).count() == 0
    if name == "exact":
        assert sorted(got, key=str) == sorted([(8, ""), (10, PLAIN), *(r[:2] for r in ROWS if r[0] in (11, 12, 13, 14, 15)), (9, ROWS[8][1])], key=str)
    if name == "near":
        stay = [r[:2] for r in ROWS if r[0] in (None, 7, 11, 13, 14, 15)]
        assert sorted(got, key=str) == sorted([*stay, (8, ""), (9, PLAIN), (9, ROWS[8][1])], key=str)
    if name == "mix":
        assert all(words(text) for _, text in got)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_stages(spark):
    """All stages in turn, on odd rows and on none; stages leave only their results behind."""
    import corpus_pipeline

    for rows in (ROWS, []):
        docs = spark.createDataFrame(rows, COLUMNS).withColumn("id", F.lit("extra"))
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            with common.working_tables(spark):
                docs = common.materialize(stage(spark, docs, FOLDER), f"odd-{name}")
            assert name == "pack" or docs.columns == before.columns
            assert bool(docs.count()) == bool(rows)


def test_working_tables(spark):
    with common.working_tables(spark):
        first = common.materialize(spark.range(3).select("id"), "first")
        last = common.materialize(first.withColumn("x", F.col("id")), "last")
    assert last.count() == 3
    with pytest.raises(Exception, match="(?i)not.exist|FILE_NOT_EXIST"):
        spark.read.parquet(first.inputFiles()[0]).count()
