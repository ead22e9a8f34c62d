"""Exact duplicates by progressive refinement, in DataFrame functions only.

Rows are grouped by byte length, then by the hash of a short prefix, then by
SHA-256. The first two steps work on a narrow table that one scan yields; the
second scan hashes full texts only where length and prefix are shared, and so
does the third, which takes the duplicates out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, hot_keys, materialize, salted_join

PREFIX_CHARS = 96
#: Bounds of the bit set that tells the second scan which texts to hash.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def _place(size: int) -> Column:
    return F.pmod(F.xxhash64("len", "pre"), F.lit(size)) + 1


def _bitmaps(keys: DataFrame) -> tuple[DataFrame, int]:
    """The keys as a bit set of some 16 bits a key, in pieces of 4 KB, and its size in bits: 16 MB at most, whatever the table."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    places = keys.select(_place(size).alias("place")).select(F.bitmap_bucket_number("place").alias("piece"), F.bitmap_bit_position("place").alias("bit"))
    return materialize(places.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits")), "exact-bits"), size


def _likely(rows: DataFrame, bitmaps: DataFrame, size: int) -> DataFrame:
    """Rows (len, pre, ...) with ``likely``: true where the key is in the set, and for a few others.

    Those others are only hashed in vain: groups are made of full hashes. So
    a set that is too small for its keys costs time, never a result, and no
    text is ever sent to another task.
    """
    found = rows.withColumn("place", _place(size)).withColumn("piece", F.bitmap_bucket_number("place")).join(F.broadcast(bitmaps), "piece", "left")
    bit = F.bitmap_bit_position("place")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    likely = F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)).cast("int") % 2 == 1, F.lit(False))
    return found.withColumn("likely", likely).drop("place", "piece", "bits")


def _marked(df: DataFrame, id_col: str, text_col: str, prefix_chars: int, *carried: Column) -> DataFrame:
    """id, body, len, pre of each row, and what is carried."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), body.alias("body"), *carried)
    return rows.withColumns({"len": F.octet_length("body"), "pre": F.xxhash64(F.substring("body", 1, prefix_chars))})


def _survivors(rows: DataFrame) -> tuple[DataFrame, int]:
    """The set of (length, prefix) pairs that rows share: bit set and size. Reads each text's length and prefix, no more."""
    narrow = materialize(rows.select("len", "pre"), "exact-rows")
    total = narrow.count()
    lengths = materialize(narrow.groupBy("len").agg(F.count("*").alias("n")).where("n > 1"), "exact-lengths")
    of_length = salted_join(narrow, lengths.select("len"), ["len"], hot_keys(lengths, ["len"], "n", total), "left_semi", ["pre"])
    return _bitmaps(materialize(of_length.groupBy("len", "pre").agg(F.count("*").alias("n")).where("n > 1"), "exact-keys"))


def _digest() -> Column:
    """SHA-256 of the full text, of survivors only."""
    return F.when(F.col("likely"), F.sha2(F.col("body").cast("binary"), 256)).alias("sha")


def hashed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """(id, sha) of the rows whose full text is hashed: those that share length and prefix with another, and a few that the bit set adds."""
    rows = _marked(df, id_col, text_col, prefix_chars)
    return _likely(rows, *_survivors(rows)).where("likely").select("id", _digest())


def _groups(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sha, keep_id, group_size), and the digests of large groups (see ``hot_keys``)."""
    groups = materialize(shared.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "exact-groups")
    return groups, hot_keys(groups, ["sha"], "group_size", shared.count())


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix_chars: int = PREFIX_CHARS, digests: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and, with
    ``digests``, text_sha256.

    Texts are equal when their UTF-8 bytes are; a null text counts as empty.
    The largest id of a group stays. Rows that share an id are judged by
    their own texts, and ``kept`` holds for all rows of a group that have its
    largest id; a null id stays only in a group that has no other id. An
    empty table gives an empty result. Other columns of ``df`` are not read,
    and ids may be of any type that has an order. Without ``digests`` full
    texts are hashed only where length and prefix are shared; the digests of
    the others are no step of the method but a column that was asked for.
    """
    rows = _marked(df, id_col, text_col, prefix_chars)
    digest = [F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256")] if digests else []
    rows = materialize(_likely(rows, *_survivors(rows)).select("id", _digest(), *digest), "exact-digests")
    shared = rows.where("sha IS NOT NULL")
    groups, hot = _groups(shared)
    found = salted_join(shared, groups, ["sha"], hot, "inner", ["id"])
    alone = rows.where("sha IS NULL").withColumn("keep_id", F.col("id")).withColumn("group_size", F.lit(1).cast("long"))
    return found.unionByName(alone).select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("keep_id").eqNullSafe(F.col("id")).alias("kept"), *(["text_sha256"] if digests else [])
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Of each group of equal texts one row with all its columns (see ``exact_groups``): of the largest id.

    Rows with equal ids and different texts don't share their fate. Of rows
    that repeat both id and text one stays; where they differ in other
    columns, any of them. Null texts are equal to empty ones; an empty table
    gives an empty one.
    """
    whole = F.struct(*[df[c] for c in df.columns]).alias("row")
    rows = _marked(df, id_col, text_col, prefix_chars, whole)
    bits, size = _survivors(rows)
    shared = materialize(_likely(rows, bits, size).where("likely").select("id", _digest()), "exact-shared")
    groups, hot = _groups(shared)
    found = salted_join(shared, groups.where("group_size > 1"), ["sha"], hot, "inner", ["id"])
    # What goes or repeats is one pair of id and digest, however many rows have it.
    kept = F.col("keep_id").eqNullSafe(F.col("id"))
    found = materialize(found.groupBy("id", "sha").agg(F.first(kept).alias("kept"), F.count("*").alias("n")), "exact-found")
    rows = _likely(rows, bits, size).select("row", "id", _digest())
    return _without_repeats(_without(rows, found.where("NOT kept")), found.where("kept AND n > 1")).select("row.*")


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows but for those whose (id, sha) is listed; a row without a digest is never."""
    dropped = dropped.select(F.col("id").alias("gone"), F.col("sha").alias("gone_sha"))
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return rows.join(dropped, F.col("id").eqNullSafe(F.col("gone")) & (F.col("sha") == F.col("gone_sha")), "left_anti")


def _without_repeats(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """One row of each (id, sha) that is listed, all others as they are. Mostly none is, which costs nothing."""
    if repeats.isEmpty():
        return rows
    pairs = repeats.select(F.col("id").alias("again"), F.col("sha").alias("again_sha"))
    same = F.col("id").eqNullSafe(F.col("again")) & (F.col("sha") == F.col("again_sha"))
    once = rows.join(pairs, same, "left_semi").dropDuplicates(["id", "sha"])
    return rows.join(pairs, same, "left_anti").unionByName(once)
