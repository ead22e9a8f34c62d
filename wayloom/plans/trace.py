"""Metrics and trajectory windows as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..functions import text
from ..operators import metrics, trajectories as tr
from ..operators.keys import dedupe_last, dense_ordinals
from .base import STEPS_SQL, TRAJECTORIES_SQL, joined, steps, table, trajectories

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(
    """WITH lines AS (SELECT l_orderkey, CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS os,
            CAST(sum(CAST(round(l_extendedprice * 100) AS DECIMAL(18, 0)) * CAST(round((1 - l_discount) * 100) AS DECIMAL(18, 0))) AS DOUBLE) / 10000 AS actual
        FROM lineitem GROUP BY l_orderkey),
    results AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS success, os, o_totalprice AS shortest, actual, abs(actual - o_totalprice) AS nav_error
        FROM orders JOIN lines ON o_orderkey = l_orderkey)
    SELECT count(*) AS n, round(avg(success), 6) AS sr, round(avg(nav_error), 4) AS ne, round(avg(os), 6) AS os,
           round(avg(CASE WHEN success > 0 THEN success * shortest / greatest(actual, shortest) ELSE 0 END), 6) AS spl
    FROM results WHERE isfinite(shortest) AND isfinite(actual)"""
)
def spl_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Results joined in order to their episodes, the last of each key, and summarised. Prices are summed exactly, in ten-thousandths."""
    cents = lambda c: F.round(c * 100, 0).cast("long")
    lines = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.max((F.col("l_returnflag") == "R").cast("double")).alias("os"),
            (F.sum(cents(F.col("l_extendedprice")) * cents(1 - F.col("l_discount"))).cast("double") / 10000).alias("actual"),
        )
    )
    orders = dedupe_last(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"), ["o_orderkey"], ["o_orderdate"])
    results = orders.join(lines, "o_orderkey").select(
        (F.col("o_orderstatus") == "F").cast("double").alias("success"),
        F.abs(F.col("actual") - F.col("o_totalprice")).alias("nav_error"),
        "os",
        F.col("o_totalprice").alias("shortest"),
        "actual",
    )
    out = metrics.spl_summary(results)
    return out.select("n", F.round("sr", 6).alias("sr"), F.round("ne", 4).alias("ne"), F.round("os", 6).alias("os"), F.round("spl", 6).alias("spl"))


@query(
    f"""WITH {STEPS_SQL} SELECT user_id, max(CASE WHEN value < 5 THEN 1 ELSE 0 END) AS os, 0.25::DOUBLE * count(*) FILTER (WHERE action = 1) AS path_length,
        arg_max(value, step) AS nav_error, CASE WHEN arg_max(value, step) < 5 THEN 1 ELSE 0 END AS success FROM steps GROUP BY user_id"""
)
def trace_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.trace_metrics(steps(spark, sf), "user_id", ["step"], "value", F.col("action") == 1, 5.0)


@query(
    f"""WITH {STEPS_SQL} SELECT event_id, sum(CASE WHEN action = 1 THEN 0.25::DOUBLE ELSE 0 END) OVER w AS path_so_far, max(CASE WHEN value < 5 THEN 1 ELSE 0 END) OVER w AS os_so_far
        FROM steps WINDOW w AS (PARTITION BY user_id ORDER BY step)"""
)
def running_totals(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.running_totals(steps(spark, sf), "user_id", ["step"], "value", F.col("action") == 1, 5.0).select("event_id", "path_so_far", "os_so_far")


@query(
    f"""WITH {STEPS_SQL}, grown AS (SELECT *, coalesce(value > lag(value) OVER (PARTITION BY user_id ORDER BY step), false) AS grew FROM steps),
    islands AS (SELECT *, sum(CASE WHEN grew THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY step) AS island FROM grown),
    streaks AS (SELECT user_id, event_id, step, row_number() OVER (PARTITION BY user_id, island ORDER BY step) - 1 AS streak FROM islands)
    SELECT user_id, arg_min(event_id, step) AS event_id, min(step) AS step, arg_min(streak, step) AS streak FROM streaks WHERE streak >= 3 GROUP BY user_id"""
)
def deviation_streak(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.first_deviation(steps(spark, sf), "user_id", ["step"], "value", 3).select("user_id", "event_id", "step", "streak")


@query("SELECT sum(c)::BIGINT AS n, count(*) AS n_distinct, max(c) AS most, count(*) FILTER (WHERE c > 1) AS repeated FROM (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1)")
def uniqueness_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.uniqueness(table(spark, sf, "lineitem"), "l_orderkey")


@query("SELECT n AS length, count(*) AS n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) GROUP BY 1")
def len_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.histogram(trajectories(spark, sf), F.col("n").cast("long"), "length")


_RUNS_SQL = """runs AS (
    SELECT user_id, action, segment, count(*) AS n FROM (
        SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY step) AS segment FROM (
            SELECT *, CASE WHEN lag(action) OVER (PARTITION BY user_id ORDER BY step) <> action THEN 1 ELSE 0 END AS changed FROM {})) GROUP BY 1, 2, 3)"""


@query(f"WITH {STEPS_SQL}, {_RUNS_SQL.format('steps')} SELECT user_id, CAST(segment AS BIGINT) AS segment, action, n FROM runs")
def rle_segments(spark: SparkSession, sf: str) -> DataFrame:
    return tr.rle_segments(steps(spark, sf), "user_id", ["step"], "action")


@query(
    f"""WITH {STEPS_SQL}, {_RUNS_SQL.format('(SELECT * FROM steps WHERE action > 0)')}
    SELECT user_id, count(*) AS n_segments, coalesce(sum(CASE WHEN action = 1 THEN n * 0.25::DOUBLE END), 0) AS meters, coalesce(sum(CASE WHEN action > 1 THEN n * 30 END), 0)::BIGINT AS degrees
    FROM runs GROUP BY user_id"""
)
def motion_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = trajectories(spark, sf).select("user_id", F.explode(tr.segments_of(F.col("actions"))).alias("s"))
    return rows.groupBy("user_id").agg(
        F.count("*").alias("n_segments"), F.coalesce(F.sum("s.meters"), F.lit(0.0)).alias("meters"), F.coalesce(F.sum("s.degrees"), F.lit(0)).alias("degrees")
    )


@query(f"WITH {STEPS_SQL} SELECT user_id, count(*) FILTER (WHERE action IN (2, 3)) AS turns FROM steps GROUP BY user_id")
def turn_count(spark: SparkSession, sf: str) -> DataFrame:
    return trajectories(spark, sf).select("user_id", sq.turn_count(F.col("actions")).alias("turns"))


def _per_step(spark: SparkSession, sf: str) -> DataFrame:
    return trajectories(spark, sf).select("user_id", "actions", "n", F.posexplode("actions").alias("step", "action"))


@query(
    f"""WITH {TRAJECTORIES_SQL} SELECT s.user_id, s.step,
        array_to_string([CASE WHEN i <= s.step + 1 THEN i ELSE s.step + 1 END FOR i IN range(greatest(1, s.step - 6), greatest(1, s.step - 6) + 8)], ',') AS frames
    FROM steps s"""
)
def hist_window(spark: SparkSession, sf: str) -> DataFrame:
    return _per_step(spark, sf).select("user_id", "step", joined(sq.history(F.col("step"), F.col("n"))).alias("frames"))


@query(
    f"""WITH {TRAJECTORIES_SQL} SELECT user_id, s.step,
        array_to_string([CASE coalesce(actions[s.step + 1 + j], 0) WHEN 1 THEN '↑' WHEN 2 THEN '←' WHEN 3 THEN '→' ELSE 'STOP' END FOR j IN range(1, 7)], '') AS answer
    FROM steps s JOIN trajectories USING (user_id)"""
)
def future_window(spark: SparkSession, sf: str) -> DataFrame:
    return _per_step(spark, sf).select("user_id", "step", text.ids_to_glyphs(sq.future(F.col("actions"), F.col("step"))).alias("answer"))


@query(
    f"""WITH {TRAJECTORIES_SQL}, based AS (SELECT user_id, list_append(actions[2:], 0) AS a FROM trajectories),
    starts AS (SELECT user_id, a, unnest(range(0, len(a), 4)) AS start FROM based)
    SELECT user_id, start, array_to_string([coalesce(a[start + k], 0) FOR k IN range(1, 5)], ',') AS chunk FROM starts"""
)
def tumbling_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = trajectories(spark, sf).select("user_id", F.explode(sq.chunks(sq.rebase(F.col("actions")), 4)).alias("c"))
    return rows.select("user_id", F.col("c.start").cast("long").alias("start"), joined(F.col("c.actions")).alias("chunk"))


@query(
    f"""WITH {STEPS_SQL}, places AS (SELECT user_id, step,
        CASE WHEN step + 1 <= 8 THEN range(0, step + 1) ELSE list_sort(list_distinct([CAST(round_even(i * step / 7.0::DOUBLE, 0) AS BIGINT) FOR i IN range(0, 8)])) END AS p FROM steps)
    SELECT user_id, step, array_to_string(p, ',') AS places FROM places"""
)
def uniform_history(spark: SparkSession, sf: str) -> DataFrame:
    return steps(spark, sf).select("user_id", "step", joined(sq.spread_rounded(F.col("step"), 8)).alias("places"))


@query(
    f"""WITH {TRAJECTORIES_SQL} SELECT user_id, array_to_string(CASE WHEN n <= 12 THEN range(0, n)
        ELSE [CASE WHEN i = 11 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 11.0::DOUBLE)) AS BIGINT) END FOR i IN range(0, 12)] END, ',') AS places FROM trajectories"""
)
def linspace_history(spark: SparkSession, sf: str) -> DataFrame:
    return trajectories(spark, sf).select("user_id", joined(sq.spread_cut(F.col("n"), 12)).alias("places"))


@query(
    f"""WITH {TRAJECTORIES_SQL}, lasts AS (SELECT s.user_id, s.step, least(s.step, n - 1) AS l FROM steps s JOIN trajectories USING (user_id)),
    mids AS (SELECT *, CASE WHEN l - 1 <= 6 THEN range(1, greatest(l, 1))
        ELSE [CASE WHEN i = 5 THEN l - 1 ELSE CAST(floor(1 + i * ((l - 2) / 5.0::DOUBLE)) AS BIGINT) END FOR i IN range(0, 6)] END AS m FROM lasts)
    SELECT user_id, step, array_to_string(CASE WHEN l = 0 THEN [0, 0, 0, 0, 0, 0, 0, 0]
        ELSE list_concat(list_concat([0], list_concat(m, [l FOR i IN range(0, 6 - len(m))])), [l]) END, ',') AS places FROM mids"""
)
def first_cur_mid(spark: SparkSession, sf: str) -> DataFrame:
    return _per_step(spark, sf).select("user_id", "step", joined(sq.first_current_middle(F.col("step"), F.col("n"))).alias("places"))


@query(
    f"""WITH {TRAJECTORIES_SQL} SELECT user_id, array_to_string(CASE WHEN n <= 10 THEN range(0, n)
        ELSE list_sort(list_distinct([CAST(round_even(i * (n - 1) / 9.0::DOUBLE, 0) AS BIGINT) FOR i IN range(0, 10)])) END, ',') AS places FROM trajectories"""
)
def even_frames(spark: SparkSession, sf: str) -> DataFrame:
    return trajectories(spark, sf).select("user_id", joined(sq.even_frames(F.col("n"), 10)).alias("places"))


@query(
    f"""WITH {TRAJECTORIES_SQL}, rated AS (SELECT user_id, n, 1 + user_id % 4 AS fps FROM trajectories),
    placed AS (SELECT user_id, n, fps, CASE WHEN len(range(0, n, fps)) > 24 THEN
        [CASE WHEN i = 23 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 23.0::DOUBLE)) AS BIGINT) END FOR i IN range(0, 24)] ELSE range(0, n, fps) END AS p FROM rated)
    SELECT user_id, array_to_string(p, ',') AS places, n / CAST(fps AS DOUBLE) AS duration FROM placed"""
)
def fixed_rate_frames(spark: SparkSession, sf: str) -> DataFrame:
    fps = (1 + F.col("user_id") % 4).cast("double")
    rows = trajectories(spark, sf).select("user_id", sq.fixed_rate(F.col("n"), fps, 1.0, 24).alias("f"))
    return rows.select("user_id", joined(F.col("f.places")).alias("places"), F.col("f.duration").alias("duration"))


@query(f"WITH {STEPS_SQL} SELECT user_id, step, event_id FROM steps WHERE step % 5 = 0 AND step / 5 < 12")
def stride_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth step, at most twelve a trajectory: the twelfth is step 55."""
    return tr.strided(steps(spark, sf)).select("user_id", "step", "event_id")


@query(f"WITH {TRAJECTORIES_SQL} SELECT user_id, array_to_string(actions[:-2], ',') AS actions FROM trajectories")
def regroup_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Steps as samples with future answers, and episodes rebuilt from the answers' first actions."""
    rows = _per_step(spark, sf).select(
        F.format_string("scan_%06d_step_%d", F.col("user_id"), F.col("step")).alias("id"),
        sq.two_turns(F.lit("?"), F.transform(F.array("action"), lambda a: text.lookup({0: "stop", 1: "move_forward", 2: "turn_left", 3: "turn_right"}, a))[0]).alias("conversations"),
    )
    return tr.answers_to_actions(rows).select(F.col("episode").alias("user_id"), joined(F.col("actions")).alias("actions"))


@query(
    f"""WITH {STEPS_SQL} SELECT event_id, row_number() OVER (ORDER BY user_id % 7, user_id, step) - 1 AS sample_no,
        printf('sample_%07d_%d_%04d', row_number() OVER (ORDER BY user_id % 7, user_id, step) - 1, user_id, step) AS sample_id FROM steps"""
)
def kway_merge_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = steps(spark, sf).select("event_id", (F.col("user_id") % 7).alias("shard"), "user_id", "step")
    out = dense_ordinals(rows, ["shard", "user_id", "step"], "sample_no")
    return out.select("event_id", "sample_no", F.format_string("sample_%07d_%d_%04d", "sample_no", "user_id", "step").alias("sample_id"))


@query(
    f"""WITH {TRAJECTORIES_SQL}, rows AS (SELECT user_id, s.step, n, actions FROM steps s JOIN trajectories USING (user_id) WHERE s.step < n - 1 AND user_id % 10 <> 0)
    SELECT printf('traj%d_step_%d', user_id, step) AS id,
        array_to_string([CASE coalesce(actions[step + 1 + j], 0) WHEN 1 THEN '↑' WHEN 2 THEN '←' WHEN 3 THEN '→' ELSE 'STOP' END FOR j IN range(1, 7)], '') AS answer,
        array_to_string([printf('v%d/rgb/%03d.jpg', user_id, least(i, step + 1)) FOR i IN range(greatest(1, step - 6), greatest(1, step - 6) + 8)], ' ') AS image FROM rows"""
)
def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Training samples of annotated trajectories; every tenth has no instruction and gives none."""
    k = F.col("user_id")
    said = F.when(k % 10 == 0, F.array(F.lit("none"))).otherwise(F.array(F.lit(" walk on ")))
    rows = trajectories(spark, sf).select(F.format_string("traj%d", k).alias("id"), F.format_string("v%d", k).alias("video"), said.alias("instructions"), "actions")
    out = tr.training_rows(rows)
    return out.select("id", F.get("conversations", F.lit(1))["value"].alias("answer"), F.array_join("image", " ").alias("image"))


@query(
    f"""WITH {TRAJECTORIES_SQL}, bundles AS (SELECT user_id, s.step, actions FROM steps s JOIN trajectories USING (user_id) WHERE s.step < n - user_id % 5)
    SELECT user_id, step, 'Final Answer: ' || array_to_string([CASE coalesce(actions[step + j], 0) WHEN 1 THEN 'Move Forward' WHEN 2 THEN 'Turn Left' WHEN 3 THEN 'Turn Right' ELSE 'Stop' END FOR j IN range(1, 7)], ', ') AS answer,
        len(CASE WHEN step + 1 <= 8 THEN range(0, step + 1) ELSE list_distinct([CAST(round_even(i * step / 7.0::DOUBLE, 0) AS BIGINT) FOR i IN range(0, 8)]) END) AS n_images FROM bundles"""
)
def step_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Step samples; trajectories lack up to four of their images."""
    images = F.transform(sq.indices(F.col("n") - (F.col("user_id") % 5).cast("int")), lambda i: F.format_string("%d.jpg", i))
    out = tr.step_bundles(trajectories(spark, sf).withColumn("images", images), "user_id")
    return out.select("user_id", F.col("step").cast("long").alias("step"), "answer", F.size("image").cast("long").alias("n_images"))
