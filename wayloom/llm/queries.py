"""The registered corpus queries and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import link_counts
from .common import table
from .exact_dedup import exact_groups
from .fingerprints import compare_with_edits
from .hard_negatives import hard_negatives
from .mixing import mix_counts
from .near_dedup import near_groups
from .packing import pack_documents
from .quality import score_quality
from .sharding import shard_documents
from .substring_dedup import repeated_passages
from .token_counts import count_tokens
from .toxicity import score_toxicity
from .warc import roundtrip


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), digests=True)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), shingle=4)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_counts(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), digests=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_warc": op7_warc,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_sharding": op13_sharding,
}

ORACLES = {
    "op2_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op3_near_dedup": r"""
        WITH RECURSIVE docs AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), shingled AS MATERIALIZED (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN []
                                WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                                ELSE list_distinct([array_to_string(words[i : i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS shingles
            FROM docs
        ), sizes AS MATERIALIZED (
            SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM shingled
        ), single AS MATERIALIZED (
            SELECT doc_id, unnest(shingles) AS s FROM shingled
        ), pairs AS MATERIALIZED (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
            FROM single a JOIN single b ON a.s = b.s AND a.doc_id <> b.doc_id
            GROUP BY 1, 2
        ), links AS MATERIALIZED (
            SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
            WHERE 100 * common >= 80 * (p.n + q.n - common)
        ), reached AS (
            SELECT doc_id AS node, doc_id AS low FROM sizes
            UNION
            SELECT l.y, r.low FROM reached r JOIN links l ON l.x = r.node WHERE r.low < l.y
        )
        SELECT s.doc_id, s.n AS n_shingles, min(r.low) AS component_id, s.doc_id = min(r.low) AS kept
        FROM sizes s JOIN reached r ON r.node = s.doc_id
        GROUP BY s.doc_id, s.n
    """,
    "op5_mixing": r"""
        WITH docs AS (
            SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents
        ), sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   row_number() OVER (ORDER BY source NULLS LAST) AS rank
            FROM docs GROUP BY source
        ), weighed AS (
            SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap,
                   CAST(sum(source_size) OVER () AS BIGINT) AS budget
            FROM sources
        ), tried AS (
            SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
                   CAST(budget - coalesce(sum(cap) OVER earlier, 0) AS DOUBLE)
                   / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS DOUBLE) AS try
            FROM weighed
            WINDOW earlier AS (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), plan AS (
            SELECT source, rank, weight, source_size, budget,
                   least(CAST(cap AS DOUBLE), (SELECT arg_min(try, (ratio, rank)) FROM tried WHERE try <= ratio) * weight) AS target
            FROM tried
        ), queue AS (
            SELECT d.doc_id, d.h, d.size, p.rank, p.weight, p.source_size, p.target, p.budget,
                   CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
            FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
        ), copies AS (
            SELECT doc_id, size, budget,
                   sum(size) OVER (ORDER BY CAST(copy * source_size + upto AS DOUBLE) / weight, rank, h, doc_id, copy ROWS UNBOUNDED PRECEDING) AS spent
            FROM queue, (SELECT unnest([0, 1, 2]) AS copy)
            WHERE size > 0
        ), taken AS (
            SELECT doc_id, count(*) AS n FROM copies WHERE spent <= budget GROUP BY doc_id
        )
        SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(t.n, 0) * q.size AS BIGINT) AS taken
        FROM queue q LEFT JOIN taken t ON q.doc_id = t.doc_id
    """,
    "op7_warc": """
        SELECT page_id,
               strlen(coalesce(html, '')) AS payload_bytes,
               sha1(coalesce(html, '')) AS payload_digest,
               CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id < max(page_id) OVER same
                    THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id < max(page_id) OVER same
                    THEN max(page_id) OVER same END AS refers_to
        FROM pages
        WINDOW same AS (PARTITION BY coalesce(html, ''))
    """,
    "op8_substring_dedup": r"""
        WITH docs AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), windows AS MATERIALIZED (
            SELECT doc_id, unnest(range(1, len(words) - 48)) AS place,
                   unnest([md5(array_to_string(words[i : i + 49], ' ')) FOR i IN range(1, len(words) - 48)]) AS w
            FROM docs WHERE len(words) >= 50
        ), firsts AS (
            SELECT w, min(doc_id) AS first FROM windows GROUP BY w
        ), repeats AS (
            SELECT doc_id, place FROM windows JOIN firsts USING (w) WHERE first < doc_id
        ), removed AS (
            SELECT doc_id, list(DISTINCT word) AS gone
            FROM (SELECT doc_id, unnest(range(place, place + 50)) AS word FROM repeats)
            GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(CASE WHEN gone IS NULL THEN array_to_string(words, ' ')
                           ELSE array_to_string([words[i] FOR i IN range(1, len(words) + 1) IF NOT list_contains(gone, i)], ' ') END) AS kept_sha256
        FROM docs d LEFT JOIN removed r ON d.doc_id = r.doc_id
    """,
    "op12_hard_negatives": """
        WITH vectors AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS MATERIALIZED (
            SELECT a.row AS anchor, a.vec_id AS anchor_id, r.row, r.vec_id, a.label = r.label AS same,
                   CAST(list_sum(list_transform(range(1, least(len(a.v), len(r.v)) + 1), lambda i: a.v[i] * r.v[i])) AS BIGINT) AS score
            FROM vectors a JOIN vectors r ON a.vec_id % 100 = 0 AND a.row <> r.row
        ), positives AS (
            SELECT anchor, anchor_id, row AS positive, vec_id AS positive_id, score AS positive_score
            FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5
        )
        SELECT p.anchor_id, p.positive_id,
               CAST(row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.vec_id NULLS LAST) AS INTEGER) AS rank,
               s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
        FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.same
         AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
        QUALIFY row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.vec_id NULLS LAST) <= 5
    """,
}
