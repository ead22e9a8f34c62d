"""Functions and filters on single rows as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, sequences, text
from ..operators import filters, metrics, sampling
from ..sources import records
from ..streaming import sessions
from .base import table

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
    """SELECT p_partkey, p_size BETWEEN 4 AND 40 AND p_partkey % 3 > 0 AS usable,
        CASE WHEN p_size % 5 = 0 THEN 'no_level' WHEN p_size % 4 <= 1 THEN 'single_level' WHEN p_size % 5 = p_partkey % 5 THEN 'same_level' END AS reason FROM part"""
)
def level_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths that fit and reasons of levels, with levels that are null."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("int")
    actions = F.array_repeat(F.lit(1), size)
    usable = filters.length_ok(actions, F.when(k % 3 > 0, size).otherwise(size + 1), 4, 40)
    return table(spark, sf, "part").select("p_partkey", usable.alias("usable"), filters.level_reason(F.when(size % 5 > 0, size % 5), k % 5, size % 4).alias("reason"))


_CHATS = "chats AS (SELECT conv_id, list(text ORDER BY turn) AS said FROM conversations GROUP BY conv_id)"


@query(f"WITH {_CHATS} SELECT conv_id, trim(said[1]) AS question FROM chats WHERE len(said) >= 2 AND trim(said[2]) <> ''")
def question_answers(spark: SparkSession, sf: str) -> DataFrame:
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("from"), F.concat(F.when(m["turn"] == 0, "<image>").otherwise(""), m["text"]).alias("value")))
    chats = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("conversations"))
    return filters.usable_qa(chats).select("conv_id", "question")


@query("SELECT page_id AS id, trim(url) AS said FROM pages")
def plain_instructions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", F.concat(F.lit(" "), F.col("url"), F.lit("  ")).alias("said"), F.lit(1).alias("_inner"))
    return filters.drop_internal(filters.passthrough(rows, "page_id", "said").withColumn("_more", F.lit(2))).select("id", F.get("instructions", F.lit(0)).alias("said"))


@query(
    """WITH v AS (SELECT o_orderkey, o_orderkey % 4 AS n, o_custkey % 2 AS off FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'unknown_verb' WHEN o_orderkey % 7 = 0 THEN 'blank_instruction' WHEN n = 0 THEN 'too_short' WHEN off = 1 THEN 'frames' END AS reason,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE array_to_string([-1] || [2 FOR i IN range(0, n)], ',') END AS actions FROM v"""
)
def manual_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Left turns and a stop, after which nothing counts; some verbs are unknown."""
    k = F.col("o_orderkey")
    n = (k % 4).cast("int")
    verbs = F.concat(F.when(k % 11 == 0, F.array(F.lit("fly"))).otherwise(F.filter(F.array(F.lit("")), lambda x: F.lit(False))), F.array_repeat(F.lit("turn_left"), n), F.array(F.lit("stop"), F.lit("move_forward")))
    reason = filters.manual_reason(verbs, n + 1 + (F.col("o_custkey") % 2).cast("int"), F.when(k % 7 > 0, "walk"))
    actions = F.array_join(F.transform(filters.manual_actions(verbs), lambda a: a.cast("string")), ",")
    return table(spark, sf, "orders").select("o_orderkey", reason.alias("reason"), F.when(k % 11 > 0, actions).alias("actions"))


@query(
    """SELECT p_partkey, round(p_size / 50.0::DOUBLE, 9) AS yaw, round((200 + p_size) / (2 * tan(radians(60 + p_partkey % 40) / 2)), 6) AS focal, 1000.0::DOUBLE * p_size / (200 + p_size) AS rescaled FROM part"""
)
def camera_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Yaw through both orders of stored rotations, focal lengths, and intrinsics of a resized image."""
    size, width = F.col("p_size"), 200 + F.col("p_size")
    q = geometry.of_yaw(size / 50.0)
    stored = F.when(F.col("p_partkey") % 2 == 0, geometry.yaw_of(geometry.rotation(F.array(q["w"], q["x"], q["y"], q["z"]), "wxyz"))).otherwise(geometry.yaw_of(geometry.rotation(F.array(q["x"], q["y"], q["z"], q["w"]), "xyzw")))
    focal = geometry.focal_length(width, (60 + F.col("p_partkey") % 40).cast("double"))
    return table(spark, sf, "part").select("p_partkey", F.round(stored, 9).alias("yaw"), F.round(focal, 6).alias("focal"), geometry.rescale_intrinsics(F.lit(1000.0), width, size).alias("rescaled"))


@query(
    """SELECT event_id, array_to_string([printf('%.2fs', i / 4.0::DOUBLE) FOR i IN range(0, event_id % 6)], ',') AS times, event_id // 32 AS epoch, coalesce(event_id / nullif(event_id % 5, 0)::DOUBLE, 0) AS rate,
        len([i FOR i IN range(0, event_id % 7) IF i % 2 = 1])::INT AS stairs, printf('[%d] Eval Results: Success:%.3f, NE:%.3f, OS:%.3f, SPL:%.3f', event_id, 0.5::DOUBLE, event_id / 8.0::DOUBLE, 1.0::DOUBLE, 0.25::DOUBLE) AS line,
        strftime(to_timestamp(event_id * 977) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS at, repeat('<image>' || chr(10), (event_id % 3)::INT) || 'look at it' AS anchored,
        CASE WHEN event_id % 2 = 0 THEN '{"a": ' || event_id || '}' END AS found FROM events"""
)
def small_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Frame times, epochs, rates, stairs, report lines, times in UTC, image marks and JSON in replies."""
    k = F.col("event_id")
    details = F.transform(sequences.indices((k % 7).cast("int")), lambda i: F.struct(F.when(i % 3 < 3, i % 2 == 1).alias("has_stairs")))
    reply = F.when(k % 2 == 0, F.concat(F.lit('Here: ```json\n{"a": '), k.cast("string"), F.lit("}\n``` so"))).otherwise("nothing")
    return table(spark, sf, "events").select(
        "event_id",
        sequences.frame_times((k % 6).cast("int"), 4.0).alias("times"),
        sessions.observation_epoch(k).alias("epoch"),
        metrics.throughput(k, k % 5).alias("rate"),
        metrics.stair_frames(details).alias("stairs"),
        text.metric_line(k, F.lit(0.5), k / 8.0, F.lit(1.0), F.lit(0.25)).alias("line"),
        text.utc_text(k * 977).alias("at"),
        text.anchor_image_tokens(F.lit("look <image>at <image>it"), (k % 3).cast("int")).alias("anchored"),
        text.json_object(reply).alias("found"),
    )


@query(
    """SELECT instruction, success, nav_error, os, shortest, actual FROM (SELECT 'i' || o_orderkey AS instruction, (o_orderkey % 2)::DOUBLE AS success, o_totalprice::DOUBLE AS nav_error, 1.0::DOUBLE AS os,
        CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE o_totalprice END::DOUBLE AS shortest, CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 2 END::DOUBLE AS actual FROM orders)"""
)
def result_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Results as lists and as objects."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    name = F.concat(F.lit("i"), k.cast("string"))
    listed = F.to_json(F.create_map(name, F.array((k % 2).cast("double"), price, F.lit(1.0))))
    fields = F.struct((k % 2).alias("success"), price.alias("nav_error"), F.lit(1).alias("os"), price.alias("shortest_path_length"), F.lit(2).alias("actual_path_length"))
    return metrics.result_rows(table(spark, sf, "orders").select(F.when(F.col("o_custkey") % 2 == 0, listed).otherwise(F.to_json(F.create_map(name, fields))).alias("entry")))


@query("SELECT conv_id, turn, text AS said, CASE WHEN turn % 2 = 0 THEN role || '|' || text ELSE text END AS listed FROM conversations")
def union_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Raw JSON of all turns: instructions as objects, strings and plain text, lists of two and single strings."""
    one = F.to_json(F.array("text"))
    string = F.substring(one, F.lit(2), F.length(one) - 2)
    said = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.col("role").alias("by"), F.col("text").alias("instruction_text")))).when(F.col("turn") % 3 == 1, string).otherwise(F.col("text"))
    listed = F.when(F.col("turn") % 2 == 0, F.to_json(F.array("role", "text"))).otherwise(string)
    return table(spark, sf, "conversations").select("conv_id", "turn", records.union_instruction(said).alias("said"), F.array_join(records.union_list(listed), "|").alias("listed"))


@query("SELECT c_custkey, length(c_name) AS n, right(c_name, 3) AS tail FROM customer")
def mapped_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All customers through a callable on batches."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_name")
    call = lambda b: b.assign(n=b["c_name"].str.len(), tail=b["c_name"].str[-3:])[["c_custkey", "n", "tail"]]
    return sampling.map_rows(rows, call, f"c_custkey {dict(rows.dtypes)['c_custkey']}, n long, tail string")
