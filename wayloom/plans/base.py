"""Driver tables and shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

#: Event types as actions; anything else is a stop.
EVENT_ACTIONS = {"click": 1, "view": 2, "purchase": 3}

STEPS_SQL = """
    steps AS (
        SELECT user_id, event_id, ts, value,
               CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS action,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step
        FROM events
    )"""
TRAJECTORIES_SQL = (
    STEPS_SQL
    + """,
    trajectories AS (
        SELECT user_id, list(action ORDER BY step) AS actions, count(*) AS n FROM steps GROUP BY user_id
    )"""
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trajectory steps: a user is a trajectory."""
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    action = F.coalesce(text.lookup(EVENT_ACTIONS, F.col("event_type")), F.lit(0))
    return events.select("user_id", "event_id", "ts", "value", action.alias("action"), (F.row_number().over(order) - 1).alias("step"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.trajectories import regroup

    return regroup(steps(spark, sf_dir), ["user_id"], "step", "action").withColumn("n", F.size("actions"))


def joined(values, separator: str = ","):
    """Array as text, for results that every engine hashes alike."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), separator)
