"""Numbers, running sums and cuts in a global order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..folders import written

#: So many rows may meet in one task: a top-n of a bounded n, the last step of a cut.
FEW_ROWS = 10_000


def range_sorted(df: DataFrame, order: Sequence[str | Column], label: str) -> DataFrame:
    """Range-sorted rows with __part and __at, their partition and place, written once so that both stay what they are."""
    return written(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), label)


def _number(placed: DataFrame, column: str, start: int) -> DataFrame:
    """Consecutive numbers by (__part, __at); only a count per partition meets in one place."""
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = counts.select("__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + start).alias("__shift"))
    numbered = placed.join(F.broadcast(starts), "__part").withColumn(column, F.col("__at") + F.col("__shift"))
    return numbered.drop("__part", "__at", "__shift")


def dense_ordinals(df: DataFrame, order: Sequence[str], column: str = "ordinal", start: int = 0, *, settled: bool = False) -> DataFrame:
    """Consecutive numbers in a global order.

    Rows are range-sorted into partitions and numbered within; only a count per
    partition meets in one place, so no task sees all rows. The range sort
    samples its input first, so the input is written before, unless it is
    ``settled``: a table that is cheaper to read twice. The sorted rows are
    written once, so their numbers don't depend on what runs again.
    """
    rows = df if settled else written(df, "ordinal-rows")
    return _number(range_sorted(rows, order, "ordinals"), column, start)


def running_sums(df: DataFrame, order: Sequence[str], value: str, column: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each, in a global order."""
    placed = range_sorted(written(df, "sum-rows"), order, "sums")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = placed.groupBy("__part").agg(F.sum(value).alias("__sum"))
    parts = parts.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__ahead"))
    within = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(F.broadcast(parts), "__part")
    return summed.withColumn(column, F.col("__ahead") + F.col("__within")).drop("__part", "__at", "__ahead", "__within")


def _of_equals(df: DataFrame, n: int) -> DataFrame:
    """n rows, whichever."""
    placed = written(df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "equals")
    return _number(placed, "__number", 0).where(F.col("__number") < n).drop("__number")


def _take(df: DataFrame, before: Column, equal: Column, n: int) -> DataFrame:
    """The rows before a boundary, fewer than n, and as many of those on it as make up n."""
    counts = df.agg(F.count_if(before).alias("before"), F.count_if(equal).alias("equal")).first()
    if counts["before"] + counts["equal"] <= n:
        return df.where(before | equal)
    return df.where(before).unionByName(_of_equals(df.where(equal), n - counts["before"]))


def take_first(df: DataFrame, order: Sequence[str], n: int, descending: bool = False, *, few: int = FEW_ROWS) -> DataFrame:
    """The first n rows in an order (nulls first; last if descending), in no order themselves; of rows that tie at the end, any.

    A small n is a top-n. For a larger one the columns of the order alone are
    range-sorted, the n-th of them is looked up and rows are compared with
    it, so no task gathers the n rows and no row moves.
    """
    if n <= 0:
        return df.limit(0)
    turned = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    if n <= few:
        return df.orderBy(*turned).limit(n)
    keys = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    placed = range_sorted(written(keys, "order-keys"), [F.col(c).desc() if descending else F.col(c).asc() for c in keys.columns], "order-places")
    sizes = sorted((r["__part"], r["n"], r["first"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first")).collect())  # one row a partition
    left = n
    for part, size, first in sizes:
        if left <= size:
            break
        left -= size
    else:
        return df
    last = placed.where((F.col("__part") == part) & (F.col("__at") == first + left - 1)).select(*keys.columns).first()
    before, equal = F.lit(False), F.lit(True)
    for name, value, kind in zip(order, last, (f.dataType for f in keys.schema)):
        column, limit = F.col(name), F.lit(value).cast(kind)
        if descending:
            here = F.lit(False) if value is None else column > limit
            here = F.coalesce(here, F.lit(False)) if value is not None else column.isNotNull()
        else:
            here = F.lit(False) if value is None else F.coalesce(column < limit, F.lit(True))
        before, equal = before | (equal & here), equal & column.eqNullSafe(limit)
    return _take(df, before, equal, n)


#: Hex digits of a hash that one step of a cut counts by, and the digits there are.
STEP_DIGITS, DIGITS = 4, 32


def take_by_hash(df: DataFrame, digest: Column, n: int, *, few: int = FEW_ROWS) -> DataFrame:
    """The n rows of the smallest digests (hex of 32 digits; null before all others); of equal digests any.

    Rows are counted by the first digits, the range that holds the n-th by
    the next ones, and so on until it holds few rows; those are sorted to
    find the n-th. Rows are then compared with it: one scan a step, no
    shuffle of rows.
    """
    if n <= 0:
        return df.limit(0)
    digest = F.coalesce(digest, F.lit(""))
    if n <= few:
        return df.orderBy(digest).limit(n)
    hashes, prefix, left = df.select(digest.alias("h")), "", n
    while True:
        inside = hashes.where(F.startswith("h", F.lit(prefix)))
        digits = F.substring("h", len(prefix) + 1, STEP_DIGITS).alias("digits")
        for r in sorted(inside.groupBy(digits).count().collect()):  # 65,537 rows at most
            if left <= r["count"]:
                break
            left -= r["count"]
        else:
            return df
        prefix += r["digits"]
        if r["count"] <= few or len(prefix) >= DIGITS or not r["digits"]:
            break
    if len(prefix) < DIGITS and prefix:
        last = hashes.where(F.startswith("h", F.lit(prefix))).orderBy("h").limit(left).agg(F.max("h")).first()[0]
    else:
        last = prefix
    return _take(df, digest < F.lit(last), digest == F.lit(last), n)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
