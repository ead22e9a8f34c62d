"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow. Its documents are shuffled by a hash and queued up to
``passes`` times over; the virtual finish time of a copy is the flow's words up
to and including it, divided by the flow's weight. All copies are ranged by
virtual time and the queue is cut where the total budget is spent: the range
that holds the cut is ranged again, finer, until one task can sort what it
holds. Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, BROADCAST_ROWS, free_names, materialize, words

WEIGHTS = (1, 2, 3)
PASSES = 3
#: Hex digits of the shuffling hash that split each source's running total.
SPLIT_DIGITS = 3
#: Ranges of virtual time between nothing and the whole budget, and of each finer step (a power of two, so that steps are exact).
RANGES = 4096
#: A range with more copies than this is ranged again, up to so many steps, which is as fine as virtual times are.
CUT_ROWS, CUT_STEPS = 1_000_000, 4


def _plan(sources: DataFrame, weights: tuple[int, ...], passes: int, share: float) -> DataFrame:
    """Weight, target and fluid level of each source: one row per source.

    The level is the virtual time at which the budget would be spent if words
    were fluid: sources whose limit (``passes`` times their words) lies below
    it are full, the others share what is left by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("ratio", "rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    return (
        sources.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(cycle, (F.col("rank") - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * passes)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.floor(F.sum("source_size").over(whole) * F.lit(share)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("try", (F.col("budget") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("level", F.min(F.when(F.col("try") <= F.col("ratio"), F.struct("ratio", "rank", "try"))).over(whole)["try"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .select("key", "rank", "weight", "source_size", "target", "level", "budget")
    )


def _counted(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: tuple[int, ...] = WEIGHTS,
    passes: int = PASSES,
    share: float = 1.0,
    cut_rows: int = CUT_ROWS,
) -> DataFrame:
    """id, size, h, key (of its source), source_size, target, copies and first_finish of each document."""
    if not 0 < share <= passes:
        raise ValueError("share must be above 0 and at most the number of passes")
    docs = materialize(
        df.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.size(words(F.col(text_col))).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    docs = docs.select(
        "id",
        _key(F.col("source")).alias("key"),
        "source",
        "size",
        _digest(F.col("id")).alias("h"),
    ).withColumn("part", F.substring("h", 1, SPLIT_DIGITS))

    parts = docs.groupBy("key", "source", "part").agg(F.sum("size").alias("part_size"))
    plan = _plan(parts.groupBy("key", "source").agg(F.sum("part_size").alias("source_size")), weights, passes, share)
    ahead = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("key", "part", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("ahead")).join(plan, "key")
    within = Window.partitionBy("key", "part").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queue = materialize(
        docs.select("id", "key", "size", "h", "part")
        .join(offsets, ["key", "part"])
        .withColumn("upto", F.col("ahead") + F.sum("size").over(within))
        .select("id", "key", "size", "h", "upto", "rank", "weight", "source_size", "target", "level", "budget"),
        "mix-queue",
    )

    def finish(copy) -> Column:
        return (copy * F.col("source_size") + F.col("upto")) / F.col("weight")

    def at(time: Column, steps: int) -> list[Column]:
        """Ranges of virtual time, each RANGES times finer than the one before; the last one of a step holds all that lies far beyond the level."""
        rest, places = F.when(F.col("level") > 0, time / F.col("level")).otherwise(0.0), []
        for _ in range(steps):
            rest = rest * RANGES
            places.append(F.least(F.floor(rest), F.lit(2 * RANGES)).cast("long"))
            rest = rest - places[-1]
        return places

    copies = (
        queue.where("size > 0")
        .select("*", F.explode(F.array(*[F.lit(p) for p in range(passes)])).alias("copy"))
        .withColumn("time", finish(F.col("copy")))
    )
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    found, before = [], 0  # the range of the cut, step by step, and the words before it
    while len(found) < CUT_STEPS:
        *coarse, fine = at(F.col("time"), len(found) + 1)
        if found:
            copies = copies.where(coarse[-1] == found[-1])
        last = (
            copies.groupBy(fine.alias("range"))
            .agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.max("budget").alias("budget"))
            .withColumn("spent", F.lit(before).cast("long") + F.sum("words").over(order))
            .where("spent > budget")
            .orderBy("range")
            .select("range", "n", (F.col("spent") - F.col("words")).alias("before"))
            .first()
        )
        if last is None:
            break
        found.append(last["range"])
        before = last["before"]
        if last["n"] <= cut_rows:
            break
    if not found:  # nothing to cut: every copy fits
        taken_copies = F.when(F.col("size") > 0, F.lit(passes)).otherwise(0)
    else:
        place = ["time", "rank", "h", "id", "copy"]
        sequence = Window.partitionBy("budget").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
        cut = (
            copies.where(at(F.col("time"), len(found))[-1] == found[-1])
            .withColumn("spent", F.lit(before).cast("long") + F.sum("size").over(sequence))
            .where("spent <= budget")
            .agg(F.max(F.struct(*place)).alias("cut"))
            .first()["cut"]
        )

        def is_taken(copy: int) -> Column:
            time = finish(F.lit(copy))
            steps = at(time, len(found))
            inside, same = F.lit(False), F.lit(True)
            for value, step in zip(found, steps):
                inside, same = inside | (same & (step < value)), same & (step == value)
            if cut is None:
                return inside
            here = F.struct(time.alias("time"), "rank", "h", "id", F.lit(copy).alias("copy"))
            limit = F.struct(*[F.lit(cut[c]).cast(copies.schema[c].dataType).alias(c) for c in place])
            return inside | (same & (here <= limit))

        fits = [F.coalesce(is_taken(p), F.lit(False)).cast("int") for p in range(passes)]
        taken_copies = F.when(F.col("size") > 0, sum(fits[1:], fits[0])).otherwise(0)
    return queue.withColumn("copies", taken_copies.cast("int")).select("id", "size", "h", "key", "source_size", "target", "copies", finish(F.lit(0)).alias("first_finish"))


def mix_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, copies, first_finish.

    Size counts words (null text: 0). Sources in code-point order, null last,
    get ``weights`` in turn; a source may give each document ``passes`` times.
    Documents without words are never queued: they take nothing. Rows that
    repeat an id are separate documents at neighbouring places of the queue.
    The order comes from md5 of the id, so reruns agree. An empty table gives
    an empty result. ``share`` of all words is the budget; it must not exceed
    ``passes``.
    """
    counted = _counted(df, id_col, text_col, source_col, **options)
    return counted.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "first_finish")


def mix_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, passes: int = PASSES, ordered: bool = False, **options) -> DataFrame:
    """The mix itself: rows of ``df``, each as often as the mix takes it.

    A source's documents are queued in the order of their hashes, so of each
    pass the mix takes those up to some hash. These hashes, a few per source,
    are all that the rows are compared with: no text is shuffled. Where the cut falls
    among rows of one id and source, all of them are taken. With ``ordered``
    the rows are range-sorted by the finish time of their first copy, which
    joins them to the queue by id.
    """
    counted = _counted(df, id_col, text_col, source_col, passes=passes, **options)
    last = [F.max(F.when(F.col("copies") > p, F.struct("h", "id"))).alias(f"last{p}") for p in range(passes)]
    limits = materialize(counted.where("copies > 0").groupBy("key").agg(*last), "mix-limits")
    of_source, copy, finish, key = free_names(df, "source", "copy", "finish", "id")
    lasts = free_names(df, *[f"last{p}" for p in range(passes)])
    limits = limits.select(F.col("key").alias(of_source), *[F.col(f"last{p}").alias(name) for p, name in enumerate(lasts)])
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_ROWS else limits
    place = F.struct(_digest(df[id_col]).alias("h"), df[id_col].alias("id"))
    has_words = F.trim(F.translate(F.coalesce(df[text_col], F.lit("")), BLANKS, " " * len(BLANKS))) != ""
    copies = sum((F.coalesce(place <= limits[name], F.lit(False)).cast("int") for name in lasts), F.lit(0))
    mixed = df.join(limits, _key(df[source_col].cast("string")) == limits[of_source]).where(has_words & (copies > 0))
    mixed = mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), copies)))
    if ordered:
        times = counted.groupBy(F.col("id").alias(key)).agg(F.min("first_finish").alias(finish))
        mixed = mixed.join(times, df[id_col].eqNullSafe(times[key])).orderBy(finish, key, copy)
    return mixed.select(*[df[c] for c in df.columns])


def _key(source: Column) -> Column:
    """The source as text that is not null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _digest(identifier: Column) -> Column:
    """The hash that shuffles a source's documents."""
    return F.md5(F.coalesce(identifier.cast("string"), F.lit("")).cast("binary"))
