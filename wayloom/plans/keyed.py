"""Scans, filters, keyed joins and merges as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import filters, keys, tolerance, trajectories as tr
from .base import STEPS_SQL, table, trajectories

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE coalesce(o_totalprice, 0) BETWEEN 50000 AND 250000")
def geodesic_band(spark: SparkSession, sf: str) -> DataFrame:
    return filters.within_band(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice"), 50000.0, 250000.0)


@query("SELECT p_partkey, p_retailprice - 20.0 * p_size AS height_diff FROM part WHERE abs(p_retailprice - 20.0 * p_size) >= 300")
def height_filter(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return filters.with_height_diff(part, F.lit(20.0) * F.col("p_size"), F.col("p_retailprice"), 300.0).select("p_partkey", "height_diff")


_PHRASES = ("go past the {} and stop at the Second Door", "wait next to the {}", "take the {} across from you", "walk to the {} at the very end", "enter the {} room")


def _instructions(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    phrase = F.get(F.array(*map(F.lit, _PHRASES)), (F.col("p_partkey") % 5).cast("int"))
    return part.select("p_partkey", F.replace(phrase, F.lit("{}"), F.col("p_name")).alias("said"))


_INSTRUCTIONS_SQL = f"said AS (SELECT p_partkey, replace(list_extract([{', '.join(repr(p) for p in _PHRASES)}], CAST(p_partkey % 5 AS INT) + 1), '{{}}', p_name) AS said FROM part)"


@query(f"WITH {_INSTRUCTIONS_SQL} SELECT * FROM (SELECT p_partkey, regexp_extract(said, '{text.SPATIAL_PATTERN}', 0) AS keyword FROM said) WHERE keyword <> ''")
def keyword_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.with_spatial_phrase(_instructions(spark, sf), "said").select("p_partkey", "keyword")


@query("SELECT doc_id, lang FROM documents WHERE lang LIKE 'en%' OR lang LIKE 'd%'")
def language_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(filters.language_matches(F.col("lang"), ["en", "d"])).select("doc_id", "lang")


@query(
    f"""WITH {STEPS_SQL}, runs AS (
        SELECT user_id, count(*) FILTER (WHERE before IS NULL OR before <> action) AS segments FROM
            (SELECT user_id, action, lag(action) OVER (PARTITION BY user_id ORDER BY step) AS before FROM steps WHERE action <> 0) GROUP BY user_id
    ), sized AS (
        SELECT user_id, count(*) AS n, count(*) FILTER (WHERE action IN (2, 3)) AS turns FROM steps GROUP BY user_id
    )
    SELECT CASE WHEN NOT n BETWEEN 55 AND 75 THEN 'steps' WHEN turns < 25 THEN 'turns' WHEN coalesce(segments, 0) < 2 THEN 'segments'
                WHEN sized.user_id % 2 = 1 THEN 'instruction' ELSE 'kept' END AS reason, count(*) AS n
    FROM sized LEFT JOIN runs USING (user_id) GROUP BY 1"""
)
def reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Every even trajectory gets an instruction with its own numbers, every odd one an instruction without any."""
    rows = trajectories(spark, sf).withColumn("segments", tr.segments_of(F.col("actions")))
    amounts = F.transform("segments", lambda s: F.coalesce(text.format_meters(s["meters"]), s["degrees"].cast("string")))
    rows = rows.withColumn("said", F.when(F.col("user_id") % 2 == 0, F.array_join(amounts, " and then ")).otherwise("go on"))
    reason = filters.precise_reason(F.col("actions"), F.col("segments"), F.col("said"), least_steps=55, most_steps=75, least_turns=25)
    return rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def _picked_sql(direction: str) -> str:
    return f"SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts {direction}, event_id {direction}) AS r FROM events) WHERE r = 1"


@query(_picked_sql(""))
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    return keys.dedupe_first(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(_picked_sql("DESC"))
def dedupe_last(spark: SparkSession, sf: str) -> DataFrame:
    return keys.dedupe_last(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def resume_anti(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return keys.resume_anti(table(spark, sf, "customer").select("c_custkey", "c_name"), done, ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def rendered_semi(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return keys.keep_semi(table(spark, sf, "customer").select("c_custkey"), urgent, ["c_custkey"])


@query(
    """SELECT l_returnflag, count(*) AS n, sum(l_linenumber) AS lines FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND abs(o_totalprice - l_extendedprice) < 50000) GROUP BY l_returnflag"""
)
def tolerance_anti(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("v"), "l_returnflag", "l_linenumber")
    existing = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return tolerance.tolerance_anti(lines, existing, "k", "v", 50000.0).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


@query(
    """WITH RECURSIVE fresh AS MATERIALIZED (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events e
        WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = e.user_id AND abs(o.o_totalprice / 1000 - e.value) < 1)),
    appended AS (SELECT user_id, 0::BIGINT AS i, []::DOUBLE[] AS kept FROM (SELECT DISTINCT user_id FROM fresh)
        UNION ALL SELECT f.user_id, f.i, CASE WHEN len(list_filter(kept, lambda x: abs(x - f.value) < 1)) > 0 THEN kept ELSE list_append(kept, f.value) END
        FROM appended a JOIN fresh f ON f.user_id = a.user_id AND f.i = a.i + 1)
    SELECT user_id, unnest(kept) AS value FROM (SELECT user_id, arg_max(kept, i) AS kept FROM appended GROUP BY user_id)
    UNION ALL SELECT o_custkey, o_totalprice / 1000 FROM orders"""
)
def upsert_append(spark: SparkSession, sf: str) -> DataFrame:
    existing = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_totalprice") / 1000).alias("value"), F.lit(0).cast("long").alias("event_id"))
    new = table(spark, sf, "events").select("user_id", "value", "event_id")
    return tolerance.upsert_append(existing, new, "user_id", "value", ["event_id"], 1.0).select("user_id", "value")


@query(
    """SELECT c_custkey, o_orderpriority AS said FROM customer JOIN
        (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) ON o_custkey = c_custkey AND r = 1"""
)
def custom_override(spark: SparkSession, sf: str) -> DataFrame:
    overrides = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("said"), "o_orderdate", "o_orderkey")
    base = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("said"))
    return keys.override_inner(base, overrides, "c_custkey", "said", ["o_orderdate", "o_orderkey"])


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), d.lang) AS said FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_fallback(spark: SparkSession, sf: str) -> DataFrame:
    overrides = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("said"))
    return keys.left_fallback(table(spark, sf, "documents").select("doc_id", "lang"), overrides, "doc_id", "said", F.col("lang")).select("doc_id", "said")


@query(
    """SELECT CASE WHEN quality IS NULL THEN 'no_quality' WHEN page_url IS NULL THEN 'no_page_url' ELSE 'patched' END AS status, count(*) AS n
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN (SELECT page_id, url AS page_url FROM pages) p ON p.page_id = d.doc_id GROUP BY 1"""
)
def chained_patch(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("page_url"))
    out = keys.chained_lookup(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), pages, "doc_id", "quality", "page_url")
    return out.groupBy("status").agg(F.count("*").alias("n"))


_COMPARE_SQL = """compared AS (
    SELECT coalesce(d.doc_id, l.doc_id) AS doc_id,
           CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' ELSE 'common' END AS status,
           CASE WHEN d.doc_id IS NULL OR l.doc_id IS NULL THEN '' ELSE concat_ws(',',
                CASE WHEN NOT (d.n_chars % 2 = l.quality) THEN 'parity' END,
                CASE WHEN NOT (d.doc_id % 2 = l.toxic AND d.n_chars > 1000) THEN 'position' END) END AS differences
    FROM documents d FULL JOIN (SELECT * FROM labels UNION ALL SELECT -1 - doc_id, quality, toxic FROM labels WHERE toxic = 1) l
        ON d.doc_id = l.doc_id)"""


def compared(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    other = labels.union(labels.where("toxic = 1").select(-1 - F.col("doc_id"), "quality", "toxic"))
    as_position = lambda *parts: F.array(*[p.cast("double") for p in parts])
    fields = {
        "parity": F.col("l.n_chars") % 2 == F.col("r.quality"),
        "position": geometry.positions_equal(as_position(F.col("l.doc_id") % 2, (F.col("l.n_chars") > 1000).cast("int")), as_position(F.col("r.toxic"), F.lit(1))),
    }
    return keys.full_compare(table(spark, sf, "documents").select("doc_id", "n_chars"), other, "doc_id", fields)


@query(f"WITH {_COMPARE_SQL} SELECT * FROM compared")
def integrity_compare(spark: SparkSession, sf: str) -> DataFrame:
    return compared(spark, sf).withColumn("differences", F.array_join("differences", ","))


@query(
    f"""WITH {_COMPARE_SQL} SELECT count(*) FILTER (WHERE status = 'common') AS common, count(*) FILTER (WHERE status = 'missing') AS missing,
        count(*) FILTER (WHERE status = 'extra') AS extra,
        count(*) FILTER (WHERE status = 'common' AND differences = '') * 100.0::DOUBLE / count(*) FILTER (WHERE status = 'common') AS rate,
        bool_and(status = 'common' AND differences = '') AS all_agree FROM compared"""
)
def consistency_rate(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.metrics import consistency

    return consistency(compared(spark, sf))


@query(
    """SELECT o_custkey, want, coalesce(got, -1) AS got FROM (SELECT o_custkey, count(*) AS want, max(o_orderpriority) AS highest FROM orders GROUP BY 1)
    LEFT JOIN (SELECT o_custkey AS k, count(*) AS got FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) ON k = o_custkey
    WHERE highest <> '4-NOT SPECIFIED' AND coalesce(got, -1) <> want"""
)
def reference_counts(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    want = orders.groupBy("o_custkey").agg(F.count("*").alias("want"), F.max("o_orderpriority").alias("highest"))
    got = orders.where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.count("*").alias("got"))
    return keys.count_mismatches(want, got, "o_custkey", "want", "got", F.col("highest") == "4-NOT SPECIFIED").select("o_custkey", "want", "got")


_PRIORITY = ["MACHINERY", "BUILDING", "HOUSEHOLD"]


def _by_nation(spark: SparkSession, sf: str) -> DataFrame:
    """Values of all customers; a source is missing in a nation where its number of customers is a multiple of three."""
    values = F.array(F.min("c_name"), F.max("c_name"), F.first(F.lit("shared")))
    parts = table(spark, sf, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("source")).agg(values.alias("said"), F.count("*").alias("n"))
    return parts.where("n % 3 > 0").drop("n")


_NATION_SQL = """parts AS (SELECT c_nationkey, c_mktsegment AS source, [min(c_name), max(c_name), 'shared'] AS said,
    list_position(['MACHINERY', 'BUILDING', 'HOUSEHOLD'], c_mktsegment) AS rank
    FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING', 'HOUSEHOLD') GROUP BY 1, 2 HAVING count(*) % 3 > 0)"""


@query(f"WITH {_NATION_SQL} SELECT c_nationkey, array_to_string(arg_min(said, rank), ',') AS said, arg_min(source, rank) AS source FROM parts GROUP BY 1")
def priority_merge(spark: SparkSession, sf: str) -> DataFrame:
    return keys.priority_merge(_by_nation(spark, sf), "c_nationkey", "source", "said", _PRIORITY).withColumn("said", F.array_join("said", ","))


@query(
    f"""WITH {_NATION_SQL}, flat AS (SELECT c_nationkey, rank, unnest(said) AS s, unnest([1, 2, 3]) AS i FROM parts),
    firsts AS (SELECT c_nationkey, s, min(rank * 10 + i) AS place FROM flat GROUP BY 1, 2)
    SELECT f.c_nationkey, string_agg(s, ',' ORDER BY place) AS said,
           (SELECT string_agg(source, ',' ORDER BY rank) FROM parts p WHERE p.c_nationkey = f.c_nationkey) AS sources FROM firsts f GROUP BY 1"""
)
def priority_concat(spark: SparkSession, sf: str) -> DataFrame:
    out = keys.priority_concat(_by_nation(spark, sf), "c_nationkey", "source", "said", _PRIORITY)
    return out.select("c_nationkey", F.array_join("said", ",").alias("said"), F.array_join("sources", ",").alias("sources"))


@query(
    """WITH tried AS (SELECT c_custkey, unnest([c_nationkey % 7 || '/' || c_custkey, c_mktsegment, 'default']) AS path, unnest([0, 1, 2]) AS rank FROM customer),
    listing AS (SELECT DISTINCT o_custkey % 7 || '/' || o_custkey AS path FROM orders UNION SELECT 'BUILDING' UNION SELECT 'default')
    SELECT c_custkey, arg_min(path, rank) AS path FROM tried WHERE path IN (SELECT path FROM listing) GROUP BY 1"""
)
def first_existing_path(spark: SparkSession, sf: str) -> DataFrame:
    listing = table(spark, sf, "orders").select(F.concat_ws("/", F.col("o_custkey") % 7, "o_custkey").alias("path"))
    listing = listing.union(spark.createDataFrame([("BUILDING",), ("default",)], "path string"))
    tried = [F.concat_ws("/", F.col("c_nationkey") % 7, "c_custkey"), F.col("c_mktsegment"), F.lit("default")]
    return keys.first_existing(table(spark, sf, "customer"), "c_custkey", tried, listing)


@query("SELECT o_orderkey, (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus <> 'P') + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS new_id FROM orders WHERE o_orderstatus = 'P'")
def max_plus_one_ids(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    taken = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("new_id"))
    return keys.allocate_ids(orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate"), taken, "new_id", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "new_id")
