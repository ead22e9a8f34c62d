"""Reproducible sampling, mixing and batch order.

Order comes from md5 of the row's key and a seed, so it doesn't depend on
partitions. It gives samples of the asked size, not those of any other
random generator.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..folders import written
from ..shipping import ship
from .ordering import FEW_ROWS, dense_ordinals, running_sums, take_by_hash, take_first, union_all


def hash_key(identifier: Column, seed: int) -> Column:
    return F.md5(F.concat(identifier.cast("string"), F.lit(f"|{seed}")).cast("binary"))


def uniform(identifier: Column, seed: int) -> Column:
    """Number in [0, 1) from the first 32 bits of the hash."""
    return F.conv(F.substring(hash_key(identifier, seed), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def hash_sample(df: DataFrame, identifier: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the first in hash order; of rows with equal identifiers any. Large samples are cut at a hash, not gathered."""
    return take_by_hash(df, hash_key(F.col(identifier), seed), n)


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return take_first(df, order, n)


def sample_size(spec: str, total: int) -> tuple[str, int]:
    """``first:N``, ``end:N``, ``random:N`` or with ``P%`` (rounded up) as a mode and a number of rows. ``all`` takes everything."""
    if spec == "all":
        return "first", total
    mode, _, amount = spec.partition(":")
    if mode not in ("first", "end", "random"):
        raise ValueError(f"unknown sampling mode {mode}")
    if amount.endswith("%"):
        return mode, math.ceil(total * int(amount[:-1]) / 100)
    if not amount.isdigit():
        raise ValueError(f"a sample needs a whole number or a percentage, not {amount}")
    return mode, int(amount)


def sample_rows(df: DataFrame, spec: str, identifier: str, order: Sequence[str], seed: int = 42) -> DataFrame:
    """Sample by a spec; ``all`` is the table itself, ``end:0`` is empty."""
    if spec == "all":
        return df
    mode, n = sample_size(spec, df.count() if spec.endswith("%") else 0)
    return hash_sample(df, identifier, n, seed) if mode == "random" else take_first(df, order, n, descending=mode == "end")


def mix_union(parts: Sequence[tuple[DataFrame, str]], identifier: str, order: Sequence[str], seed: int = 42) -> DataFrame:
    """UNION ALL of sampled datasets; a dataset listed twice counts twice."""
    return union_all([sample_rows(df, spec, identifier, order, seed) for df, spec in parts])


def ratio_count(n: int, ratio: float, least: int = 0) -> int:
    """How many rows make up ``ratio`` of the whole beside n others."""
    if not 0 <= ratio < 1:
        raise ValueError("the ratio must be at least 0 and below 1")
    return max(least, int(n * ratio / (1 - ratio)))


def repeat_to_length(df: DataFrame, identifier: str, n: int, seed: int = 42) -> DataFrame:
    """n rows: whole repeats, then the first in hash order of one more."""
    size = df.count()
    if not size:
        return df
    whole, rest = divmod(n, size)
    repeated = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(whole))).alias("__copy")).drop("__copy") if whole else df.limit(0)
    return repeated.unionByName(hash_sample(df, identifier, rest, seed))


def ratio_mix(main: DataFrame, other: DataFrame, identifier: str, ratio: float, seed: int = 42) -> DataFrame:
    """All of ``main`` and as many of ``other`` (repeated if short) as make up ``ratio`` of the whole, at least one."""
    n = ratio_count(main.count(), ratio, 1)
    return main.unionByName(repeat_to_length(other, identifier, n, seed), allowMissingColumns=True)


def weighted_choice(identifier: Column, weights: dict[str, float], seed: int) -> Column:
    """Name drawn with the given weights by the row's hash."""
    total, upto, u = sum(weights.values()), 0.0, uniform(identifier, seed)
    out = None
    names = list(weights)
    for name in names[:-1]:
        upto += weights[name] / total
        condition = u < F.lit(upto)
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def uniform_choice(identifier: Column, options: Column, seed: int) -> Column:
    """Element of an array by the row's hash; null for an empty one."""
    return F.get(options, F.floor(uniform(identifier, seed) * F.size(options)).cast("int"))


def eligible_styles(styles: Sequence[str], start: Column, end: Column, total: Column) -> Column:
    """Styles that fit an episode: fuzzy only where a floor is the lowest or the top one; never none."""
    every = F.array(*map(F.lit, styles))
    at_end = (start == 1) | (start == total) | (end == 1) | (end == total)
    usable = F.when(at_end, every).otherwise(F.array_remove(every, "fuzzy"))
    return F.when(F.size(usable) > 0, usable).otherwise(F.array(F.lit("absolute")))


#: Up to so many rows of a group are picked by a window, which passes on no more of them from any task.
WINDOW_ROWS = 1000


def group_quota(df: DataFrame, group: str, order: Sequence[str], each: int, total: int | None = None, group_order: str | None = None, *, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """The first ``each`` rows of every group, and of those the first ``total`` by group and order.

    ``order`` has to tell the rows of a group apart, ``group_order`` (the
    group itself if not given) is one value a group. With a total each group
    gets its own share: what the groups before it leave, from their sizes. So
    the cut needs no order of all rows. Shares beyond ``window_rows`` are cut
    by places in the range-sorted table, where a large group lies in many
    partitions.
    """
    share = F.lit(each).cast("long")
    if total is not None:
        by = group_order or group
        sizes = df.groupBy(group).agg(F.min(by).alias("__by"), F.least(F.count("*"), share).alias("__n"))
        sizes = running_sums(sizes, ["__by", group], "__n", "__before")
        shares = written(sizes.select(F.col(group).alias("__group"), F.least(F.col("__n"), F.lit(total) - F.col("__before")).alias("__share")).where("__share > 0"), "shares")
        shares = F.broadcast(shares) if shares.count() <= FEW_ROWS else shares
        df = df.join(shares, df[group].eqNullSafe(shares["__group"])).drop("__group")
        share = F.col("__share")
    if each <= window_rows:
        ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= each)
    else:
        placed = written(dense_ordinals(df, [group, *order], "__place"), "group-places")
        starts = placed.groupBy(F.col(group).alias("__group")).agg(F.min("__place").alias("__start"))
        ranked = placed.join(starts, placed[group].eqNullSafe(starts["__group"])).withColumn("__n", F.col("__place") - F.col("__start") + 1).drop("__group", "__place", "__start")
    return ranked.where(F.col("__n") <= share).drop("__n", "__share")


def validation_rows(df: DataFrame, order: Sequence[str], n: int, head: int = 80, tail: int = 80, most: int = 1500) -> DataFrame:
    """First and last rows and every k-th between; n is the number of rows, which have consecutive ``ordinal``s."""
    step = max(1, n // most)
    return df.where((F.col("ordinal") < head) | (F.col("ordinal") >= n - tail) | (F.col("ordinal") % step == 0)).orderBy(*order)


#: Rows that a task deals at a time, about: megabatches are dealt together, a larger one alone.
DEALT_ROWS = 1 << 15


def deal_chunks(megabatch: np.ndarray, length: np.ndarray, n_chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunk and place of every row, for rows in order of their megabatches: each as ``even_chunks``.

    Each step deals the next row of all megabatches.
    """
    first = np.flatnonzero(np.r_[True, megabatch[1:] != megabatch[:-1]])
    size = np.diff(np.r_[first, len(megabatch)])
    room, even = size // n_chunks, size % n_chunks == 0
    totals, sizes = np.zeros((len(first), n_chunks), np.int64), np.zeros((len(first), n_chunks), np.int64)
    chunk, place = np.zeros(len(megabatch), np.int32), np.zeros(len(megabatch), np.int32)
    for at in range(size.max(initial=0)):
        m = np.flatnonzero(size > at)
        shortest = np.where(sizes[m] < room[m, None], totals[m], np.iinfo(np.int64).max).argmin(axis=1)  # the first of equals
        target, row = np.where(even[m], shortest, at % n_chunks), first[m] + at
        chunk[row], place[row] = target, sizes[m, target]
        sizes[m, target] += 1
        totals[m, target] += length[row]
    return chunk, place


def even_chunks(lengths: Sequence[int], n_chunks: int) -> list[list[int]]:
    """Places dealt into chunks of equal size and about equal total length, greedily; dealt in turn if sizes can't be equal."""
    chunk, _ = deal_chunks(np.zeros(len(lengths), np.int64), np.array(lengths, np.int64), n_chunks)
    return [np.flatnonzero(chunk == c).tolist() for c in range(n_chunks)]


def length_batches(df: DataFrame, identifier: str, length: str, batch: int, workers: int, seed: int = 42, modality: Column | None = None) -> DataFrame:
    """Batch order: identifier, megabatch, chunk, place.

    Rows in hash order are cut into megabatches of ``batch * workers``, sorted
    by length in each (nulls last, as length 0) and dealt into one even chunk
    a worker. With a modality the megabatches hold one modality each (null is
    one). A group that a task sees is one megabatch, or as many small ones as
    make up some ten thousand rows.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(identifier).alias("id"), F.col(length).cast("long").alias("length"), (F.lit("") if modality is None else modality.cast("string")).alias("modality"))
    rows = rows.withColumn("h", hash_key(F.col("id"), seed))
    placed = dense_ordinals(rows, ["modality", "h", "id"]).drop("h")
    start = F.lit(0)
    if modality is not None:
        starts = written(placed.groupBy(F.col("modality").alias("__modality")).agg(F.min("ordinal").alias("start")), "modality-starts")
        starts = F.broadcast(starts) if starts.count() <= FEW_ROWS else starts
        placed, start = placed.join(starts, placed["modality"].eqNullSafe(starts["__modality"])), F.col("start")
    placed = placed.withColumn("megabatch", F.floor((F.col("ordinal") - start) / (batch * workers)))
    placed = placed.withColumn("block", F.floor(F.col("megabatch") / max(1, DEALT_ROWS // (batch * workers))))
    kind = dict(df.dtypes)[identifier]

    def deal(group: pa.Table) -> pa.Table:
        lengths, megabatch = group["length"].fill_null(0).to_numpy(), group["megabatch"].to_numpy()
        order = np.lexsort((group["ordinal"].to_numpy(), -lengths, group["length"].is_null().to_numpy(), megabatch))
        chunk, place = deal_chunks(megabatch[order], lengths[order], workers)
        return group.select(["id", "modality", "megabatch", "length"]).take(order).append_column("chunk", pa.array(chunk)).append_column("place", pa.array(place))

    blocks = placed.select("id", "modality", "megabatch", "length", "ordinal", "block").groupBy("modality", "block")
    return blocks.applyInArrow(deal, f"id {kind}, modality string, megabatch long, length long, chunk int, place int").withColumnRenamed("id", identifier)


def map_rows(df: DataFrame, call, schema: str) -> DataFrame:
    """Rows through a callable on batches: the place for model calls. The default of callers is a deterministic stub."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield call(batch)

    return df.mapInPandas(run, schema)
