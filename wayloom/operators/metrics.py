"""Evaluation metrics and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from .filters import finite_rows


def spl_summary(results: DataFrame) -> DataFrame:
    """One row: n and means of success, nav_error, os and spl over results (success, nav_error, os, shortest, actual).

    Nulls count as 0; rows with a value that isn't finite don't count; without
    rows all figures are 0.
    """
    fields = ["success", "nav_error", "os", "shortest", "actual"]
    rows = finite_rows(results.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in fields]), fields)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return rows.agg(
        F.count("*").alias("n"),
        mean("success").alias("sr"),
        mean("nav_error").alias("ne"),
        mean("os").alias("os"),
        mean(geometry.spl(F.col("success"), F.col("shortest"), F.col("actual"))).alias("spl"),
    )


def result_rows(lines: DataFrame, column: str = "entry") -> DataFrame:
    """Results from JSON text maps of one instruction each; a payload is an object or a list (success, error, oracle, …)."""
    entries = lines.select(F.explode(F.from_json(column, "map<string,string>")).alias("instruction", "payload"))
    listed = F.startswith(F.ltrim("payload"), F.lit("["))
    field = lambda name: F.get_json_object("payload", f"$.{name}").try_cast("double")
    item = lambda i: F.get_json_object("payload", f"$[{i}]").try_cast("double")
    pick = lambda name, i: F.coalesce(F.when(listed, item(i)).otherwise(field(name)), F.lit(0.0))
    return entries.select(
        "instruction",
        pick("success", 0).alias("success"),
        pick("nav_error", 1).alias("nav_error"),
        pick("os", 2).alias("os"),
        F.when(listed, 0.0).otherwise(F.coalesce(field("shortest_path_length"), F.lit(0.0))).alias("shortest"),
        F.when(listed, 0.0).otherwise(F.coalesce(field("actual_path_length"), F.lit(0.0))).alias("actual"),
    )


def merge_results(episodes: DataFrame, results: DataFrame, keys: Sequence[str], position: str, order: Sequence[str]) -> DataFrame:
    """Results in episode order; later writes win; repeated episode keys fan out."""
    from .keys import dedupe_last, ordered_inner

    return ordered_inner(episodes, dedupe_last(results, keys, order), keys, position)


def trace_metrics(steps: DataFrame, key: str, order: Sequence[str], distance: str, moves: Column, radius: float, step_length: float = 0.25, include_start: bool = True) -> DataFrame:
    """Per trajectory: oracle success, path length, last distance, success.

    ``include_start`` also tests the first row's distance for oracle success.
    """
    place = F.struct(*order)
    rows = steps
    if not include_start:
        first = Window.partitionBy(key).orderBy(*order)
        rows = rows.withColumn("__inside", (F.row_number().over(first) > 1) & (F.col(distance) < radius))
    else:
        rows = rows.withColumn("__inside", F.col(distance) < radius)
    last = F.max_by(distance, place)
    return rows.groupBy(key).agg(
        F.max(F.col("__inside").cast("int")).alias("os"),
        (F.count_if(moves) * F.lit(step_length)).alias("path_length"),
        last.alias("nav_error"),
        (last < radius).cast("int").alias("success"),
    )


def running_totals(steps: DataFrame, key: str, order: Sequence[str], distance: str, moves: Column, radius: float, step_length: float = 0.25) -> DataFrame:
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("path_so_far", F.sum(F.when(moves, step_length).otherwise(0.0)).over(so_far)).withColumn(
        "os_so_far", F.max((F.col(distance) < radius).cast("int")).over(so_far)
    )


def deviation_streaks(steps: DataFrame, key: str, order: Sequence[str], distance: str) -> DataFrame:
    """Rows with how many steps in a row the distance has grown."""
    ordered = Window.partitionBy(key).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    grew = F.coalesce(F.col(distance) > F.lag(distance).over(ordered), F.lit(False))
    marked = steps.withColumn("__grew", grew).withColumn("__reset", F.sum((~F.col("__grew")).cast("int")).over(upto))
    streak = Window.partitionBy(key, "__reset").orderBy(*order)
    return marked.withColumn("streak", F.row_number().over(streak) - 1).drop("__grew", "__reset")


def first_deviation(steps: DataFrame, key: str, order: Sequence[str], distance: str, patience: int = 12) -> DataFrame:
    """First row per trajectory at which the streak reaches ``patience``."""
    reached = deviation_streaks(steps, key, order, distance).where(F.col("streak") >= patience)
    row = F.struct(*[F.col(c) for c in reached.columns])
    return reached.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("__row")).select("__row.*")


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("c")).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(key).alias("n_distinct"), F.coalesce(F.max("c"), F.lit(0)).alias("most"), F.count_if(F.col("c") > 1).alias("repeated")
    )


def histogram(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def consistency(compared: DataFrame) -> DataFrame:
    """Report on ``full_compare``: rows by status, share of common rows without differences, whether all agree."""
    common = F.col("status") == "common"
    ok = common & (F.size("differences") == 0)
    return compared.agg(
        F.count_if(common).alias("common"),
        F.count_if(F.col("status") == "missing").alias("missing"),
        F.count_if(F.col("status") == "extra").alias("extra"),
        F.coalesce(F.try_divide(F.count_if(ok) * F.lit(100.0), F.count_if(common)), F.lit(0.0)).alias("rate"),
        F.coalesce(F.every(ok), F.lit(True)).alias("all_agree"),
    )


def throughput(n: Column, seconds: Column) -> Column:
    return F.coalesce(F.try_divide(n, seconds), F.lit(0.0))


def build_report(rows: DataFrame, skipped: DataFrame, id_column: str, image_column: str, examples: int = 50) -> DataFrame:
    """One row: counts, image-list lengths, first and last sample, a bounded list of skipped ids.

    The list of examples is a report's excerpt; counts cover all rows.
    """
    sizes = rows.groupBy(F.size(image_column).alias("length")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("length", "n")))).alias("image_lengths"))
    ends = rows.agg(F.count("*").alias("n_rows"), F.min(id_column).alias("first_id"), F.max(id_column).alias("last_id"))
    listed = skipped.orderBy(id_column).limit(examples).agg(F.sort_array(F.collect_list(F.col(id_column))).alias("skipped_examples"))
    n_skipped = skipped.agg(F.count("*").alias("n_skipped"))
    out = ends
    for one_row in (n_skipped, sizes, listed):  # single rows each
        out = out.join(F.broadcast(one_row), F.lit(True))
    return out


def flatten_metrics(results: DataFrame, column: str = "results") -> DataFrame:
    """task, metric, value of a map of maps, without aliases and standard errors."""
    tasks = results.select(F.explode(column).alias("task", "metrics"))
    flat = tasks.select("task", F.explode("metrics").alias("metric", "value"))
    return flat.where(~F.contains("metric", F.lit("alias")) & ~F.contains("metric", F.lit("stderr"))).select(F.concat_ws("_", "task", "metric").alias("name"), "value")


def stair_frames(details: Column) -> Column:
    """How many frames of a details list show stairs."""
    return F.size(F.filter(details, lambda d: F.coalesce(d["has_stairs"], F.lit(False))))


def resume_state(samples: DataFrame, id_column: str = "id") -> DataFrame:
    """One row: the largest sample number and the number of finished trajectories, from ids ``sample_<n>_<traj>_<step>``.

    A malformed id fails the job. The trajectories themselves are ``finished_trajectories``.
    """
    number = F.regexp_extract(id_column, r"^sample_(\d+)_(.+)_(\d+)$", 1).try_cast("long")
    checked = samples.select(F.assert_true(number.isNotNull(), F.concat(F.lit("malformed id "), F.col(id_column))).alias("ok"), number.alias("n"), F.col(id_column))
    rows = checked.where("ok IS NULL").agg(F.coalesce(F.max("n"), F.lit(-1)).alias("last_sample"))
    return rows.join(F.broadcast(finished_trajectories(samples, id_column).agg(F.count("*").alias("n_finished"))), F.lit(True))  # single rows


def finished_trajectories(samples: DataFrame, id_column: str = "id") -> DataFrame:
    return samples.select(F.regexp_extract(id_column, r"^sample_(\d+)_(.+)_(\d+)$", 2).alias("traj_name")).distinct()
