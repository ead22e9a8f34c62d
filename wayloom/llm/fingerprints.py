"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash
range. Which hashes are kept does not depend on the document's length, so the
sketch of a union is the union of sketches (``merge``), and containment of a
short text in a very long one can be estimated. Apart from the sketch, a
fingerprint has the smallest hash of all, the least, for texts so short that
none is kept; the least of a union is the smaller one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, range_bucket, words

SHINGLE_WORDS = 5
#: One hash in this many is kept.
SCALE = 8
#: Bytes of text per range of ids; at most so many ranges, which bounds the table of their first rows.
RANGE_BYTES, MOST_RANGES = 32_000_000, 65_536


def fingerprint(text: Column, shingle: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """Struct of ``sketch``, the sorted array of the kept shingle hashes, and ``least``, the smallest hash.

    A shingle is ``shingle`` consecutive words as written; a text with fewer
    words is one shingle; one without words (or null) has an empty sketch and
    no least.
    """
    limit = -(2**63) + 2**64 // scale

    def of_hashes(hashes: Column) -> Column:
        n = F.size(hashes)
        rolled = F.transform(
            F.slice(hashes, 1, F.greatest(n - (shingle - 1), F.lit(1))),
            lambda first, i: F.xxhash64(first, *[F.get(hashes, i + k) for k in range(1, shingle)]),
        )
        kept = lambda all_: F.sort_array(F.array_distinct(F.filter(all_, lambda h: h < F.lit(limit))))
        return let(rolled, lambda all_: F.struct(kept(all_).alias("sketch"), F.array_min(all_).alias("least")))

    def of_words(tokens: Column) -> Column:
        none = F.struct(F.array().cast("array<bigint>").alias("sketch"), F.lit(None).cast("bigint").alias("least"))
        return F.when(F.size(tokens) > 0, let(F.transform(tokens, lambda w: F.xxhash64(w)), of_hashes)).otherwise(none)

    return let(words(text), of_words)


def as_text(found: Column) -> Column:
    """A fingerprint as a string: 16 hexadecimal digits of the least, then the last 8 of each hash of the sketch. Empty without words."""
    digits = F.array_join(F.transform(found["sketch"], lambda h: F.substring(F.lpad(F.hex(h), 16, "0"), 9, 8)), "")
    return F.coalesce(F.concat(F.lpad(F.hex(found["least"]), 16, "0"), digits), F.lit(""))


def merge(a: Column, b: Column) -> Column:
    """Fingerprint of the union of two shingle sets."""
    return F.struct(F.sort_array(F.array_union(a["sketch"], b["sketch"])).alias("sketch"), F.least(a["least"], b["least"]).alias("least"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness; where neither has a kept hash, 1 if the least ones are equal (or both missing), else 0."""
    shared = F.size(F.array_intersect(a["sketch"], b["sketch"]))
    union = F.size(a["sketch"]) + F.size(b["sketch"]) - shared
    return F.when(union > 0, shared / union).otherwise(a["least"].eqNullSafe(b["least"]).cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; null if a's sketch is empty."""
    return F.try_divide(F.size(F.array_intersect(a["sketch"], b["sketch"])), F.size(a["sketch"]))


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_chars, sketch (array), least, fingerprint (string) of every row of ``df``. A null text counts as empty."""
    found = df.select(F.col(id_col), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"), fingerprint(F.col(text_col), **options).alias("found"))
    return found.select(id_col, "n_chars", "found.sketch", "found.least", as_text(F.col("found")).alias("fingerprint"))


def compare_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, range_bytes: int = RANGE_BYTES, **options) -> DataFrame:
    """Fingerprints of each text and of an edited one, and their likeness.

    The edited text has its last floor(n/2) code points replaced by the first
    as many (or all) of the next document in descending id order; after the
    last one comes the first. Rows with equal ids follow each other by text,
    null ids come last. A table of one row is its own next document, an empty
    one gives an empty result. A null text counts as empty; other columns of
    ``df`` are not read. Ids are numbers.

    Ids are dealt into ranges of about ``range_bytes`` of text, one to a task.
    The first row of a range also goes to the range before it, so one shuffle
    brings all neighbours together.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, math.ceil(total / range_bytes)))
    rows = rows.withColumn("range", range_bucket(rows, "id", ranges))
    # One row a range: the row that it starts with, and the range that comes before it (the last one before the first).
    head = F.max(F.struct(F.col("id").isNotNull().alias("some"), "id", F.hash("body").alias("tie"), F.crc32(F.col("body").cast("binary")).alias("tie2")))
    heads = materialize(rows.groupBy("range").agg(head.alias("head")), "ranges")
    down, last = Window.orderBy(F.desc("range")), F.min("range").over(Window.partitionBy(F.lit(0)))
    number = F.row_number().over(down) - 1
    follows = heads.select(
        F.col("range").alias("h_range"), F.coalesce(F.lag("range").over(down), last).alias("h_to"), F.col("head.id").alias("h_id"), F.col("head.tie").alias("h_tie"), F.col("head.tie2").alias("h_tie2"), number.alias("h_number")
    )
    follows = materialize(follows, "range-heads")
    n_ranges = max(1, follows.count())
    tie, tie2 = F.hash("body"), F.crc32(F.col("body").cast("binary"))
    is_head = (
        (F.col("range") == F.col("h_range")) & F.col("id").eqNullSafe(F.col("h_id")) & (tie == F.col("h_tie")) & (tie2 == F.col("h_tie2"))
    )
    home = rows.withColumn("guest", F.lit(False))
    visiting = (
        rows.join(F.broadcast(follows), is_head)
        .dropDuplicates(["h_range"])
        .select("id", "body", F.col("h_to").alias("range"), F.lit(True).alias("guest"))
    )
    numbers = follows.select(F.col("h_range").alias("range"), F.col("h_number").alias("number"))
    dealt = home.unionByName(visiting).join(F.broadcast(numbers), "range").repartitionById(n_ranges, F.col("number").cast("int"))
    dealt = dealt.withColumn("sk", fingerprint(F.col("body"), **options))
    down = Window.partitionBy("number").orderBy("guest", F.col("id").desc_nulls_last(), F.hash("body").desc(), F.crc32(F.col("body").cast("binary")).desc())
    n = F.length("body")
    half = F.floor(n / 2).cast("int")
    paired = (
        dealt.withColumn("n_chars", n.cast("long"))
        .withColumn("next", F.lead(F.struct("body", "sk")).over(down))
        .where(~F.col("guest"))
        .withColumn("edited", F.concat(F.substring(F.col("body"), F.lit(1), n - half), F.substring(F.col("next.body"), F.lit(1), half)))
        .select("id", "n_chars", "sk", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited"), **options).alias("edited_sk"), F.col("next.sk").alias("next_sk"))
    )
    return paired.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_text(F.col("sk")).alias("fingerprint"),
        as_text(F.col("edited_sk")).alias("edited_fingerprint"),
        likeness(F.col("sk"), F.col("edited_sk")).alias("near_edited"),
        likeness(F.col("sk"), F.col("next_sk")).alias("near_next"),
    )
