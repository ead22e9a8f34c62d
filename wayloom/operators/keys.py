"""Operators on keyed rows: dedupe, resume, lookups, merges, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import dense_ordinals


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key. Picked by a partial aggregate, so a hot key costs one row per task."""
    return _pick(df, keys, order, F.min_by)


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each key: later writes win."""
    return _pick(df, keys, order, F.max_by)


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], by) -> DataFrame:
    picked = df.groupBy(*keys).agg(by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order)).alias("__row"))
    return picked.select("__row.*")


def resume_anti(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't done yet. A null key is never done."""
    return df.join(done.select(*keys), list(keys), "left_anti")


def keep_semi(df: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(allowed.select(*keys), list(keys), "left_semi")


def ordered_inner(left: DataFrame, right: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Inner join that keeps the left side's order."""
    return left.join(right, list(keys), "inner").orderBy(position)


def override_inner(df: DataFrame, overrides: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """Only rows with an override, their value replaced; the last override of a key wins."""
    last = dedupe_last(overrides, [key], order).select(key, F.col(value).alias("__new"))
    return df.drop(value).join(last, key).withColumnRenamed("__new", value)


def left_fallback(df: DataFrame, overrides: DataFrame, key: str, value: str, fallback: Column) -> DataFrame:
    """Value of the override, else the fallback."""
    new = overrides.select(key, F.col(value).alias("__new"))
    return df.join(new, key, "left").withColumn(value, F.coalesce("__new", fallback)).drop("__new")


def chained_lookup(df: DataFrame, first: DataFrame, second: DataFrame, key: str, first_value: str, second_value: str) -> DataFrame:
    """Two lookups in turn and which of them succeeded."""
    out = df.join(first.select(key, first_value), key, "left").join(second.select(key, second_value), key, "left")
    return out.withColumn("status", F.when(F.col(first_value).isNull(), "no_" + first_value).when(F.col(second_value).isNull(), "no_" + second_value).otherwise("patched"))


def full_compare(left: DataFrame, right: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """key, status (missing, extra, common) and the names of fields that differ.

    ``fields`` maps a name to an equality over columns of aliases l and r.
    """
    joined = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer")
    names = F.array(*[F.when(~F.coalesce(equal, F.lit(False)), F.lit(name)) for name, equal in fields.items()])
    status = F.when(F.col(f"r.{key}").isNull(), "missing").when(F.col(f"l.{key}").isNull(), "extra").otherwise("common")
    differ = F.when(status == "common", F.filter(names, lambda n: n.isNotNull())).otherwise(F.array().cast("array<string>"))
    return joined.select(F.coalesce(F.col(f"l.{key}"), F.col(f"r.{key}")).alias(key), status.alias("status"), differ.alias("differences"))


def count_mismatches(reference: DataFrame, counted: DataFrame, key: str, want: str, got: str, skip: Column | None = None) -> DataFrame:
    """Rows whose count isn't the wanted one; a missing count is -1."""
    rows = reference if skip is None else reference.where(~skip)
    return rows.join(counted.select(key, got), key, "left").withColumn(got, F.coalesce(got, F.lit(-1))).where(F.col(got) != F.col(want))


def priority_merge(df: DataFrame, key: str, source: str, values: str, priority: Sequence[str]) -> DataFrame:
    """The best source's values per key. Sources that aren't listed don't count."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(source))
    ranked = df.withColumn("__rank", rank).where("__rank > 0")
    return ranked.groupBy(key).agg(F.min_by(values, "__rank").alias(values), F.min_by(source, "__rank").alias(source))


def priority_concat(df: DataFrame, key: str, source: str, values: str, priority: Sequence[str]) -> DataFrame:
    """Distinct values of all sources in order of priority, and the sources that had the key."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(source))
    parts = F.sort_array(F.collect_list(F.struct(rank.alias("rank"), F.col(source).alias("source"), F.col(values).alias("values"))))
    return df.where(rank > 0).groupBy(key).agg(parts.alias("__parts")).select(
        key, F.array_distinct(F.flatten(F.col("__parts.values"))).alias(values), F.array_distinct(F.col("__parts.source")).alias("sources")
    )


def first_existing(df: DataFrame, key: str, candidates: Sequence[Column], listing: DataFrame, path: str = "path") -> DataFrame:
    """First candidate path of each key that is listed; null if none is."""
    tried = df.select(key, F.posexplode(F.array(*candidates)).alias("rank", path))
    found = tried.join(listing.select(path).distinct(), path, "left_semi").groupBy(key).agg(F.min_by(path, "rank").alias(path))
    return df.select(key).distinct().join(found, key, "left")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows themselves; the job fails if a key repeats."""
    repeats = df.groupBy(*keys).count().where("count > 1")
    checked = repeats.agg(F.assert_true(F.count("*") == 0, F.lit(f"repeated key: {', '.join(keys)}")).alias("__ok"))
    return df.join(F.broadcast(checked), F.lit(True), "left").where(F.col("__ok").isNull()).drop("__ok")  # one row


def allocate_ids(df: DataFrame, taken: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Numbers after the largest one taken, in order (from 1 if none is)."""
    start = taken.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
    return dense_ordinals(df, order, column, start + 1)
