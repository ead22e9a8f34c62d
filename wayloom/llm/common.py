"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import fresh, shared_dir

#: ASCII white space separates words; every other code point belongs to one.
BLANKS = "\t\n\x0b\x0c\r"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the reread table.

    This cuts the lineage: a lost executor costs a reread, never a second
    run of what led here.
    """
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.parquet(path)
    if (written := _written.get()) is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def _delete(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``materialize`` writes in its body, but for the last one, which is the body's result."""
    token = _written.set([])
    try:
        yield
        for path in _written.get()[:-1]:
            _delete(spark, path)
    finally:
        _written.reset(token)


def release(spark: SparkSession) -> None:
    """Delete what ``materialize`` has written in this application; results that were not read yet are lost."""
    _delete(spark, shared_dir(spark))


#: A key is hot when it has more rows than this, or than this fraction of all rows.
HOT_ROWS, HOT_FRACTION = 256, 20_000


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str, rows: int) -> DataFrame:
    """(keys, parts) of the keys with too many rows for one task.

    ``counts`` has one row per key and its number of rows ``n``; ``rows`` is
    the sum of ``n``, or more. At most 20,000 keys can be hot, which is what
    bounds the broadcast of this table.
    """
    most = max(HOT_ROWS, rows // HOT_FRACTION)
    return counts.where(F.col(n) > most).select(*keys, F.ceil(F.col(n) / F.lit(most)).cast("int").alias("__parts"))


#: Up to this many rows of a few numbers or digests (some 30 MB as a hash table) are sent to the scan by a broadcast; beyond it rows are joined by a shuffle.
BROADCAST_ROWS = 300_000


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame, how: str = "inner", spread: Sequence[str] = (), *, few: int | None = None) -> DataFrame:
    """``left.join(right, keys, how)`` with the rows of hot keys dealt over several tasks.

    ``hot`` comes from ``hot_keys`` over the left side. A hot key's left rows
    are dealt by the hash of ``spread`` (all columns if none are named), its
    right rows are repeated once per part. ``how``: inner, left, left_semi or
    left_anti. A right side of at most ``few`` (``BROADCAST_ROWS``) rows, which
    are counted, is broadcast instead; 0 is for sides that are wide or were not
    written yet.
    """
    few = BROADCAST_ROWS if few is None else few
    if few and right.count() <= few:
        return left.join(F.broadcast(right), list(keys), how)
    hot = F.broadcast(hot)
    part = F.pmod(F.xxhash64(*(spread or left.columns)), F.col("__parts"))
    dealt = left.join(hot, list(keys), "left").withColumn("__salt", F.coalesce(part, F.lit(0)).cast("int")).drop("__parts")
    parts = F.when(F.col("__parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("__parts") - 1))
    repeated = right.join(hot, list(keys), "left").withColumn("__salt", F.explode(parts)).drop("__parts")
    return dealt.join(repeated, [*keys, "__salt"], how).drop("__salt")


#: Bounds of a bit set of keys.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def _place(keys: Sequence[str], size: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(size)) + 1


def bit_set(rows: DataFrame, keys: Sequence[str], label: str) -> tuple[DataFrame, int]:
    """The rows' keys as a bit set of some 16 bits a key, in pieces of 4 KB, and its size in bits: 16 MB at most, whatever the table."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * rows.count()).bit_length()))
    places = rows.select(_place(keys, size).alias("place")).select(F.bitmap_bucket_number("place").alias("piece"), F.bitmap_bit_position("place").alias("bit"))
    return materialize(places.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits")), label), size


def marked_likely(rows: DataFrame, keys: Sequence[str], bitmaps: DataFrame, size: int) -> DataFrame:
    """Rows with ``likely``: true where the key is in the set, and for a few others."""
    found = rows.withColumn("place", _place(keys, size)).withColumn("piece", F.bitmap_bucket_number("place")).join(F.broadcast(bitmaps), "piece", "left")
    bit = F.bitmap_bit_position("place")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    likely = F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)).cast("int") % 2 == 1, F.lit(False))
    return found.withColumn("likely", likely).drop("place", "piece", "bits")


def found_by(rows: DataFrame, right: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """``rows.join(right, keys)``, where no key has many rows: ``right`` is broadcast if it has few rows, else rows pass a bit set of its keys first."""
    if right.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(right), list(keys))
    return marked_likely(rows, keys, *bit_set(right, keys, label)).where("likely").drop("likely").join(right, list(keys))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to be none of the table's columns, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without_rows(df: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` but for the rows whose (id, text hash) is in ``dropped`` (id, h)."""
    key, digest = free_names(df, "id", "h")
    pairs = materialize(dropped.select(F.col("id").alias(key), F.col("h").alias(digest)).distinct(), "dropped")
    if pairs.count() <= BROADCAST_ROWS:
        pairs = F.broadcast(pairs)
    return df.join(pairs, df[id_col].eqNullSafe(pairs[key]) & (text_hash(df[text_col]) == pairs[digest]), "left_anti")


def without_repeats(df: DataFrame, repeats: DataFrame, id_col: str, text_hash: Column) -> DataFrame:
    """``df`` with one row of each (id, text) pair that ``repeats`` (id, h) lists.

    Rows that repeat both id and text are one document. Where they differ in
    other columns, any of them stays, after a lost executor maybe another one.
    There are none in most tables, which costs nothing.
    """
    if repeats.isEmpty():
        return df
    own, key, digest = free_names(df, "h", "id", "h2")
    marked = df.withColumn(own, text_hash)
    pairs = repeats.select(F.col("id").alias(key), F.col("h").alias(digest))
    same = marked[id_col].eqNullSafe(pairs[key]) & (marked[own] == pairs[digest])
    once = marked.join(pairs, same, "left_semi").dropDuplicates([id_col, own])
    return marked.join(pairs, same, "left_anti").unionByName(once).drop(own)


def text_hash(text: Column) -> Column:
    """64-bit hash that tells the texts of one id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the maximal runs of anything but ASCII white space."""
    flat = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(flat, " "), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def range_bucket(df: DataFrame, column: str, buckets: int) -> Column:
    """Monotone bucket number of a numeric column, about equally filled.

    At most 256 approximate quantiles reach the driver; each of their
    intervals is cut evenly when more buckets are asked for. Nulls get -1.
    """
    leaves = min(buckets, 256)
    cuts = sorted(set(df.approxQuantile(column, [i / leaves for i in range(leaves + 1)], 0.2 / leaves))) if leaves > 1 else []
    cuts = [c for c in cuts if c is not None and not math.isnan(c)]
    value = F.col(column).cast("double")
    if len(cuts) < 2:
        return F.when(value.isNull(), -1).otherwise(0).cast("long")
    fine = max(1, math.ceil(buckets / (len(cuts) - 1)))

    def search(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            part = F.floor((value - F.lit(cuts[lo])) * F.lit(fine / (cuts[hi] - cuts[lo])))
            return F.lit(lo * fine) + F.least(F.greatest(part, F.lit(0)), F.lit(fine - 1))
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid, hi))

    return F.when(value.isNull(), F.lit(-1)).otherwise(search(0, len(cuts) - 1)).cast("long")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
