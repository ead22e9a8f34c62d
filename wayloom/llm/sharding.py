"""A uniform shuffle of rows into shards of exact sizes, in DataFrame functions only.

The rows lie in parts. How many rows of which part go to which shard is drawn
first, exactly as a uniform shuffle would have it: a matrix from the
multivariate hypergeometric distribution whose rows add up to the parts and
whose columns add up to the shards. Then each part is permuted and cut by its
row of the matrix, the pieces are exchanged, and each shard is permuted. The
matrix is all that the driver sees; ranks within a part or shard are counted
in small groups, so no task ever holds either.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, HOT_ROWS, materialize

SHARDS = 8
#: Parts of about so many rows, at most so many parts: the matrix has no more rows, whatever the table.
PART_ROWS, MOST_PARTS = 4096, 1024
#: Numbers in the matrix (8 bytes each) that the driver draws and sends to the executors.
MOST_CELLS = 1 << 21
#: Rows that one group of a ranking holds, about; at most so many groups in all.
GROUP_ROWS, MOST_GROUPS = 512, 1 << 22


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from an urn of good and bad balls are good; for any size, by inversion around the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(max((good + 1) * (draws + 1) // (total + 2), low), high)
    spread = math.sqrt(draws * (good / total) * (bad / total) * max(0.0, (total - draws) / max(1, total - 1)))
    low, high = max(low, mode - int(14 * spread) - 40), min(high, mode + int(14 * spread) + 40)  # beyond lies less than 1e-30
    k = np.arange(low, high, dtype=np.float64)
    up = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)  # log of p(k + 1) / p(k)
    weight = np.concatenate([[0.0], np.cumsum(up)])
    chance = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(chance, rng.random() * chance[-1], side="right").clip(0, len(chance) - 1))


def communication_matrix(parts: Sequence[int], shards: Sequence[int], seed: int) -> list[list[int]]:
    """Rows of each part for each shard, as a uniform shuffle would deal them: rows add up to ``parts``, columns to ``shards``."""
    rng, left, out = np.random.default_rng(seed), list(shards), []
    for n in parts:
        row, rest = [], sum(left)
        for j, room in enumerate(left):
            rest -= room
            row.append(draw_hypergeometric(rng, room, rest, n))
            n -= row[-1]
            left[j] -= row[-1]
        out.append(row)
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _ranked(df: DataFrame, outer: str, order: str, ties: Sequence[str]) -> DataFrame:
    """``df`` with ``rank``: places from 0 of a random order within each ``outer``, by the hash ``order``.

    Hashes fall into groups of some hundred rows; only groups are sorted, and
    what lies before a group comes from their counts.
    """
    groups = max(1, min(MOST_GROUPS, df.count() // GROUP_ROWS))
    df = df.withColumn("group", F.floor((F.col(order) / F.lit(2.0**64) + 0.5) * F.lit(groups)))
    ahead = Window.partitionBy(outer).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(outer, "group").agg(F.count("*").alias("n"))
    counts = counts.select(outer, "group", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy(outer, "group").orderBy(order, *ties)
    placed = df.withColumn("at", F.row_number().over(within))
    return placed.join(counts, [outer, "group"]).withColumn("rank", F.col("before") + F.col("at") - 1).drop("group", "before", "at")


def shuffle_to_shards(df: DataFrame, keys: Sequence[str], shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """Rows of ``df`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 within the shard).

    Every way of dealing the rows to all slots is equally likely, over seeds;
    shard sizes are at most one apart, the first ones being larger. ``keys``
    are the columns that tell rows apart: equal keys and seed give an equal
    shuffle, however the input is split. Rows with equal keys (null equals
    null) are separate rows; where more than 256 share them, places in the
    input tell them apart, so that a third of all rows being copies still
    spreads over all parts. Columns named shard or slot are replaced; any
    other name is allowed, as columns travel in a struct. An empty table
    gives an empty result; with more shards than rows some stay empty.
    """
    if shards < 1 or shards * MOST_PARTS > MOST_CELLS:
        raise ValueError(f"the number of shards must be from 1 to {MOST_CELLS // MOST_PARTS}")
    carried = [c for c in df.columns if c not in ("shard", "slot")]
    mixed = F.xxhash64(F.lit(seed), *[F.xxhash64(_named(c), _named(c).isNull()) for c in keys])
    rows = materialize(df.select(F.struct(*[_named(c) for c in carried]).alias("row"), mixed.alias("h"), F.monotonically_increasing_id().alias("place")), "shard-rows")
    repeated = materialize(rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select("h", F.lit(True).alias("again")), "shard-repeats")
    if not repeated.isEmpty():
        repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
        rows = rows.join(repeated, "h", "left").withColumn("h", F.when(F.col("again"), F.xxhash64("h", "place")).otherwise(F.col("h"))).drop("again")
    total = rows.count()
    n_parts = max(1, min(MOST_PARTS, total // PART_ROWS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("h", F.lit("part")), F.lit(n_parts)).cast("int")).withColumn("order", F.xxhash64("h", F.lit("local")))

    sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # MOST_PARTS rows at most
    parts = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in parts], shard_sizes(total, shards), seed)
    ends = [(p, [int(x) for x in np.cumsum(row)]) for p, row in zip(parts, matrix)]
    plan = F.broadcast(df.sparkSession.createDataFrame(ends, "part int, ends array<long>"))  # MOST_CELLS numbers at most

    dealt = _ranked(rows, "part", "order", ["h", "place"]).join(plan, "part")
    shard = F.size(F.filter("ends", lambda end: end <= F.col("rank"))).cast("int")
    dealt = materialize(dealt.select("row", "h", "place", shard.alias("shard"), F.xxhash64("h", F.lit("shard")).alias("order")), "shard-dealt")
    placed = _ranked(dealt, "shard", "order", ["h", "place"])
    return placed.select(*[F.col("row").getField(c).alias(c) for c in carried], "shard", F.col("rank").cast("long").alias("slot"))


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """id, size (UTF-8 bytes of the text and 1), text_crc32, law, shard, slot, grown_shard of every document.

    The law is ``rows``: counts at most one apart, so groups of equal texts
    are dealt like other rows and ``grown_shard`` is null. A null text has no
    bytes, a null id is an id like others. Only ids, sizes and checksums are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = df.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("__size"), F.crc32(text.cast("binary")).alias("__crc"))
    dealt = shuffle_to_shards(narrow, [id_col, "__crc", "__size"], shards, seed)
    return dealt.select(id_col, F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(dealt: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write dealt rows as ``shard=j/`` folders of files that hold consecutive slots, each sorted by slot."""
    ranged = dealt.withColumn("file", F.floor(F.col("slot") / rows_per_file))
    ranged = ranged.repartition(F.col("shard"), F.col("file")).sortWithinPartitions("shard", "file", "slot")
    ranged.write.partitionBy("shard", "file").parquet(path)
