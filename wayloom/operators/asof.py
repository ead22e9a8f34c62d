"""As-of and nearest joins within groups, without pairs of rows.

Where groups have few right rows each, those are one sorted array a group and
a left row searches it by bisection, so left rows don't move. Where a group has more, both sides
are range-sorted together and the last right row seen is carried along, from
partition to partition too, so that one large group spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..folders import written
from .ordering import range_sorted

#: Right rows of a group, at most, for arrays, and right rows in all for sending those to every task.
ARRAY_ROWS, SENT_ROWS = 4096, 300_000


def _count_upto(array: Column, size: Column, holds, most: int) -> Column:
    """How many elements at the front of a sorted array satisfy ``holds``, by bisection: steps of falling powers of two."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, most.bit_length())))])
    ahead = lambda at, step: F.when((at + step <= size) & holds(F.get(array, at + step - 1)), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), ahead)


def lookup(array: Column, key: Column, most: int, forward: bool = False) -> Column:
    """Of structs sorted by their field ``key``: the last with a key at most ``key``, or the first with one of at least ``key``; null if there is none."""
    holds = (lambda x: x["key"] < key) if forward else (lambda x: x["key"] <= key)
    at = _count_upto(array, F.size(array), lambda x: F.coalesce(holds(x), F.lit(False)), most)
    return F.when(key.isNotNull(), F.get(array, at if forward else at - 1))


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], left_key: Column, right_key: str, values: Sequence[str], name: str = "hit", *, forward: bool = False, else_first: bool = False, array_rows: int = ARRAY_ROWS, sent_rows: int = SENT_ROWS) -> DataFrame:
    """``left`` with a struct ``name`` (key and ``values``) of the closest right row of its group that isn't above ``left_key``; null if there is none.

    ``forward`` takes the closest that isn't below; ``else_first`` the first of
    the group where there is none. Of right rows with equal
    keys the one with the largest values counts backward, with the smallest
    forward, so that it is the neighbour in their order either way. Null keys
    match nothing, nor do null groups.
    """
    rows = right.where(F.col(right_key).isNotNull()).select(*by, F.struct(F.col(right_key).alias("key"), *values).alias("r"))
    sizes = written(rows.groupBy(*by).agg(F.count("*").alias("n")), "asof-sizes")
    known = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if (known["most"] or 0) <= array_rows:
        arrays = rows.groupBy(*by).agg(F.sort_array(F.collect_list("r")).alias("__sorted"))
        arrays = F.broadcast(arrays) if (known["all"] or 0) <= sent_rows else arrays
        found = lookup(F.col("__sorted"), left_key, known["most"] or 1, forward)
        found = F.coalesce(found, F.get("__sorted", F.lit(0))) if else_first else found
        return left.join(arrays, list(by), "left").withColumn(name, found).drop("__sorted")
    found = _asof_by_ranges(left, rows, by, left_key, name, forward)
    if else_first:
        firsts = written(rows.groupBy(*by).agg(F.min("r").alias("__first")), "asof-firsts")
        firsts = F.broadcast(firsts) if firsts.count() <= sent_rows else firsts
        found = found.join(firsts, list(by), "left").withColumn(name, F.coalesce(name, "__first")).drop("__first")
    return found


def _asof_by_ranges(left: DataFrame, rows: DataFrame, by: Sequence[str], left_key: Column, name: str, forward: bool) -> DataFrame:
    """Both sides in one order, right rows before left ones of equal keys; the last right row is carried along."""
    keys = [F.col(c).alias(f"by{i}") for i, c in enumerate(by)]
    own = left.select(*keys, left_key.alias("key"), F.lit(1).alias("side"), F.lit(None).cast(rows.schema["r"].dataType).alias("r"), F.struct(*[left[c] for c in left.columns]).alias("l"))
    other = rows.select(*keys, F.col("r.key").cast(own.schema["key"].dataType).alias("key"), F.lit(0).alias("side"), "r", F.lit(None).cast(own.schema["l"].dataType).alias("l"))
    group = [f"by{i}" for i in range(len(by))]
    order = [*group, F.col("key").desc() if forward else F.col("key"), "side", F.col("r").desc() if forward else F.col("r")]
    placed = range_sorted(written(own.unionByName(other), "asof-rows"), order, "asof-sorted")
    seen = F.last("r", ignorenulls=True).over(Window.partitionBy("__part", *group).orderBy("__at"))
    ends = placed.where("side = 0").groupBy("__part", *group).agg(F.max_by("r", "__at").alias("end"))
    # A partition takes over what the last one before it, with right rows of the group, has seen.
    starts = placed.select("__part", *group).distinct().join(ends, ["__part", *group], "left")
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("__part", *group, F.last("end", ignorenulls=True).over(before).alias("carried"))
    carried = placed.withColumn("seen", seen).where("side = 1").join(starts, ["__part", *group], "left")
    hit = F.when(F.col("key").isNotNull(), F.coalesce("seen", "carried"))
    alone = placed.where("side = 1").where(" OR ".join(f"{g} IS NULL" for g in group)).select("l.*", F.lit(None).cast(rows.schema["r"].dataType).alias(name))
    return carried.where(" AND ".join(f"{g} IS NOT NULL" for g in group)).select("l.*", hit.alias(name)).unionByName(alone)


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], left_key: Column, right_key: str, values: Sequence[str], name: str = "hit", **limits: int) -> DataFrame:
    """``left`` with a struct ``name`` of the right row of its group whose key is closest; of equal distances the smallest values."""
    firsts = right.groupBy(*by, right_key).agg(F.min(F.struct(*values)).alias("v")).select(*by, right_key, "v.*")  # one row a key
    found = asof(left.withColumn("__key", left_key), firsts, by, F.col("__key"), right_key, values, "__below", **limits)
    found = asof(found, firsts, by, F.col("__key"), right_key, values, "__above", forward=True, **limits)
    far = lambda c: F.struct(F.abs(F.col(f"{c}.key") - F.col("__key")).alias("d"), *[F.col(f"{c}.{v}") for v in values])
    below = F.col("__above").isNull() | (F.col("__below").isNotNull() & (far("__below") <= far("__above")))
    return found.withColumn(name, F.when(below, F.col("__below")).otherwise(F.col("__above"))).drop("__key", "__below", "__above")
