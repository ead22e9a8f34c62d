"""Levels, sampling, mixing, draws and streaming windows as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import fresh
from ..functions import draws, geometry
from ..operators import levels, sampling
from ..operators import trajectories as tr
from ..streaming import sessions, windows
from .base import table, trajectories

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """A box for every supplier, in ten scenes."""
    s = table(spark, sf, "supplier")
    d = lambda c: c.cast("double")
    low = F.array(d(F.col("s_nationkey")), d(F.col("s_suppkey") % 4), F.lit(0.0))
    side = d(1 + F.col("s_suppkey") % 9)
    high = F.transform(low, lambda x: x + side)
    return s.select((F.col("s_suppkey") % 10).alias("scene"), F.col("s_suppkey").alias("region"), (F.col("s_suppkey") % 4).alias("level"), low.alias("low"), high.alias("high"))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", (F.col("p_partkey") % 10).alias("scene"), (F.col("p_size") / 2).alias("x"), (F.col("p_size") % 11).cast("double").alias("y"), (F.col("p_retailprice") - 900).alias("z")
    )


_PLACES_SQL = """boxes AS (SELECT s_suppkey % 10 AS scene, s_suppkey AS region, s_suppkey % 4 AS level, s_nationkey::DOUBLE AS lx, (s_suppkey % 4)::DOUBLE AS ly, 0.0::DOUBLE AS lz,
        (1 + s_suppkey % 9)::DOUBLE AS side FROM supplier),
    points AS (SELECT p_partkey, p_partkey % 10 AS scene, p_size / 2.0::DOUBLE AS x, (p_size % 11)::DOUBLE AS y, p_retailprice - 900 AS z FROM part)"""


@query(
    f"""WITH {_PLACES_SQL} SELECT p_partkey, arg_min(level, (side * side * side, region)) AS level, arg_min(region, (side * side * side, region)) AS region
    FROM points p JOIN boxes b ON p.scene = b.scene AND x BETWEEN lx - 0.2::DOUBLE AND lx + side + 0.2::DOUBLE AND y BETWEEN ly - 0.5::DOUBLE AND ly + side + 0.5::DOUBLE AND z BETWEEN lz - 0.2::DOUBLE AND lz + side + 0.2::DOUBLE GROUP BY 1"""
)
def aabb_smallest(spark: SparkSession, sf: str) -> DataFrame:
    return levels.smallest_box(_points(spark, sf), _boxes(spark, sf), "scene", "p_partkey")


@query(
    f"""WITH {_PLACES_SQL}, floors AS (SELECT scene, level, min(ly) * 3 AS floor_y FROM boxes GROUP BY 1, 2)
    SELECT p_partkey, coalesce(arg_max(level, floor_y) FILTER (WHERE floor_y <= y + 0.5), arg_min(level, floor_y)) AS level FROM points p JOIN floors f ON p.scene = f.scene GROUP BY 1"""
)
def asof_level(spark: SparkSession, sf: str) -> DataFrame:
    floors = levels.level_floors(_boxes(spark, sf), "scene").withColumn("floor_y", F.col("floor_y") * 3)
    return levels.asof_level(_points(spark, sf), floors, "scene", "p_partkey")


@query(
    f"""WITH {_PLACES_SQL}, floors AS (SELECT scene, level + 1 AS floor, min(ly) * 3 AS height FROM boxes GROUP BY 1, 2)
    SELECT p_partkey, arg_min(floor, (abs(height - y), floor)) AS floor FROM points p JOIN floors f ON p.scene = f.scene GROUP BY 1"""
)
def nearest_floor(spark: SparkSession, sf: str) -> DataFrame:
    floors = levels.level_floors(_boxes(spark, sf), "scene").select("scene", (F.col("level") + 1).alias("floor"), (F.col("floor_y") * 3).alias("height"))
    return levels.nearest_floor(_points(spark, sf), floors, "scene", "p_partkey")


_MANY_LEVELS_SQL = """scenes AS (SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN 0 ELSE c_nationkey END AS scene, c_acctbal::DOUBLE AS height FROM customer),
    points AS (SELECT o_orderkey, scene, o_totalprice::DOUBLE / 40 - 1200 AS y FROM orders JOIN scenes ON c_custkey = o_custkey)"""


def _many_levels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as points and their customers' balances as heights, by nation; half of the nations are one scene."""
    nation = F.when(F.col("c_nationkey") < 12, 0).otherwise(F.col("c_nationkey")).cast("long")
    heights = table(spark, sf, "customer").select("c_custkey", nation.alias("scene"), F.col("c_acctbal").cast("double").alias("height"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_totalprice").cast("double") / 40 - 1200).alias("y"))
    return orders.join(heights.select("c_custkey", "scene"), "c_custkey").select("o_orderkey", "scene", "y"), heights


@query(
    f"""WITH {_MANY_LEVELS_SQL}, ranked AS (SELECT scene, height, max(c_custkey) AS level FROM scenes GROUP BY 1, 2), low AS (SELECT scene, arg_min(c_custkey, (height, c_custkey)) AS level FROM scenes GROUP BY 1)
    SELECT o_orderkey, coalesce(r.level, low.level) AS level FROM points p JOIN low USING (scene) ASOF LEFT JOIN ranked r ON p.scene = r.scene AND p.y + 0.5 >= r.height"""
)
def asof_many_levels(spark: SparkSession, sf: str) -> DataFrame:
    points, heights = _many_levels(spark, sf)
    return levels.asof_level(points, heights.select("scene", F.col("c_custkey").alias("level"), F.col("height").alias("floor_y")), "scene", "o_orderkey")


@query(
    f"""WITH {_MANY_LEVELS_SQL}, ranked AS (SELECT scene, height, min(c_custkey) AS floor FROM scenes GROUP BY 1, 2)
    SELECT o_orderkey, CASE WHEN a.floor IS NULL OR (b.floor IS NOT NULL AND (abs(b.height - y), b.floor) <= (abs(a.height - y), a.floor)) THEN b.floor ELSE a.floor END AS floor
    FROM points p ASOF LEFT JOIN ranked b ON p.scene = b.scene AND p.y >= b.height ASOF LEFT JOIN ranked a ON p.scene = a.scene AND p.y <= a.height"""
)
def nearest_many_floors(spark: SparkSession, sf: str) -> DataFrame:
    points, heights = _many_levels(spark, sf)
    return levels.nearest_floor(points, heights.select("scene", F.col("c_custkey").alias("floor"), "height"), "scene", "o_orderkey")


@query(
    f"""WITH {_PLACES_SQL}, boxed AS (SELECT p_partkey, arg_min(level, (side * side * side, region)) AS level
        FROM points p JOIN boxes b ON p.scene = b.scene AND x BETWEEN lx - 0.2::DOUBLE AND lx + side + 0.2::DOUBLE AND y BETWEEN ly - 0.5::DOUBLE AND ly + side + 0.5::DOUBLE AND z BETWEEN lz - 0.2::DOUBLE AND lz + side + 0.2::DOUBLE GROUP BY 1),
    floors AS (SELECT scene, level, min(ly) AS floor_y FROM boxes GROUP BY 1, 2),
    tall AS (SELECT p_partkey, coalesce(arg_max(level, floor_y) FILTER (WHERE floor_y <= y + 0.5), arg_min(level, floor_y)) AS level FROM points p JOIN floors f ON p.scene = f.scene GROUP BY 1)
    SELECT p.p_partkey, coalesce(b.level, t.level) AS level, CASE WHEN b.level IS NOT NULL THEN 'box' WHEN t.level IS NOT NULL THEN 'height' END AS found
    FROM points p LEFT JOIN boxed b ON p.p_partkey = b.p_partkey LEFT JOIN tall t ON p.p_partkey = t.p_partkey"""
)
def level_fallback(spark: SparkSession, sf: str) -> DataFrame:
    boxes = _boxes(spark, sf)
    return levels.level_of_points(_points(spark, sf), boxes, levels.level_floors(boxes, "scene"), "scene", "p_partkey").select("p_partkey", "level", "found")


@query(
    """WITH heights AS (SELECT DISTINCT s_nationkey % 5 AS scene, round(s_acctbal)::BIGINT AS h FROM supplier),
    marked AS (SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY scene ORDER BY h) > 150 THEN 1 ELSE 0 END AS new FROM heights),
    numbered AS (SELECT *, 1 + sum(new) OVER (PARTITION BY scene ORDER BY h) AS floor FROM marked)
    SELECT scene, floor::BIGINT AS floor, round(avg(h), 6) AS height, count(*) AS n_heights FROM numbered GROUP BY 1, 2"""
)
def gap_clusters(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select((F.col("s_nationkey") % 5).alias("scene"), F.round("s_acctbal", 0).alias("y"))
    return levels.gap_clusters(s, "scene", "y", 150.0, 0).withColumn("height", F.round("height", 6))


@query(
    """SELECT vec_id, sqrt(list_sum([power(embedding[i]::DOUBLE - embedding[i + 1]::DOUBLE, 2) FOR i IN range(1, 4)])) > 0.3 AS far,
        (embedding[1] > embedding[2]) AS falls FROM embeddings"""
)
def vector_steps(spark: SparkSession, sf: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    d = geometry.distance(F.slice(e, 1, 3), F.slice(e, 2, 3))
    return table(spark, sf, "embeddings").select("vec_id", (d > 0.3).alias("far"), (geometry.height_diff(F.reverse(F.slice(e, 1, 2)), F.slice(e, 1, 2)) < 0).alias("falls"))


@query(
    """WITH facts AS (SELECT c_custkey, 1 + c_nationkey % 3 AS a, 1 + c_custkey % 3 AS b, 1 + c_custkey % 4 AS total, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal / 1000 ELSE 0.5 END AS climb FROM customer),
    split AS (SELECT *, total <= 1 AND abs(climb) >= 1 AS pretend FROM facts)
    SELECT c_custkey, CASE WHEN pretend THEN CASE WHEN climb > 0 THEN 1 ELSE 2 END ELSE a END AS start_floor, CASE WHEN pretend THEN CASE WHEN climb > 0 THEN 2 ELSE 1 END ELSE b END AS end_floor,
        CASE WHEN pretend THEN 2 ELSE total END AS total_floors, CASE WHEN climb > 0 THEN 'up' ELSE 'down' END AS direction FROM split"""
)
def floor_annotations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    climb = F.when(k % 4 == 0, F.col("c_acctbal") / 1000).otherwise(0.5)
    floors = levels.floor_annotation((1 + F.col("c_nationkey") % 3).cast("long"), 1 + k % 3, 1 + k % 4, climb)
    return table(spark, sf, "customer").select("c_custkey", floors.alias("f")).select("c_custkey", "f.*")


_GRID = [(336, 672), (672, 336), (672, 672), (1008, 336), (336, 1008)]


@query(
    f"""WITH sizes AS (SELECT p_partkey, 200 + p_size * 17 AS w, 200 + (p_partkey % 37) * 23 AS h FROM part),
    rated AS (SELECT p_partkey, w, h, unnest({[g[0] for g in _GRID]}) AS gw, unnest({[g[1] for g in _GRID]}) AS gh, unnest(range(0, {len(_GRID)})) AS place FROM sizes),
    used AS (SELECT *, least(CAST(floor(w * least(gw / CAST(w AS DOUBLE), gh / CAST(h AS DOUBLE))) AS BIGINT) * CAST(floor(h * least(gw / CAST(w AS DOUBLE), gh / CAST(h AS DOUBLE))) AS BIGINT), w * h) AS used FROM rated)
    SELECT p_partkey, arg_max(gw, (used, used - gw * gh, -place)) AS width, arg_max(gh, (used, used - gw * gh, -place)) AS height FROM used GROUP BY 1"""
)
def best_resolution(spark: SparkSession, sf: str) -> DataFrame:
    w, h = 200 + F.col("p_size") * 17, 200 + (F.col("p_partkey") % 37) * 23
    return table(spark, sf, "part").select("p_partkey", geometry.best_resolution(w, h, _GRID).alias("r")).select("p_partkey", "r.*")


_HASH = "md5({0} || '|42'), {0}"


@query(f"SELECT doc_id FROM documents ORDER BY {_HASH.format('doc_id')} LIMIT 50")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.hash_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 50)


@query(
    """WITH d AS (SELECT doc_id FROM documents), n AS (SELECT count(*) AS n FROM d)
    (SELECT doc_id, 'first' AS part FROM d ORDER BY doc_id LIMIT 30) UNION ALL (SELECT doc_id, 'end' FROM d ORDER BY doc_id DESC LIMIT 20)
    UNION ALL (SELECT doc_id, 'random' FROM d ORDER BY md5(doc_id || '|42'), doc_id LIMIT (SELECT CAST(ceil(n * 7 / 100.0) AS BIGINT) FROM n))"""
)
def first_end_pct(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    specs = (("first", "first:30"), ("end", "end:20"), ("random", "random:7%"))
    return sampling.mix_union([(docs.withColumn("part", F.lit(name)), spec) for name, spec in specs], "doc_id", ["doc_id"])


@query("SELECT doc_id AS id, lang AS kind FROM documents UNION ALL SELECT doc_id, lang FROM documents WHERE lang = 'en' UNION ALL SELECT item_id, NULL FROM benchmark")
def mix_union(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"))
    extra = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"))
    return sampling.mix_union([(docs, "all"), (docs.where("kind = 'en'"), "all"), (extra, "all")], "id", ["id"])


@query(
    """WITH m AS (SELECT count(*) AS n FROM labels), o AS (SELECT count(*) AS n FROM benchmark), want AS (SELECT greatest(1, CAST(floor(m.n * 0.3::DOUBLE / (1 - 0.3::DOUBLE)) AS BIGINT)) AS k, o.n AS size FROM m, o)
    SELECT doc_id AS id, 'main' AS part FROM labels UNION ALL SELECT item_id, 'other' FROM benchmark, want, range(0, CAST(floor(k / size) AS BIGINT))
    UNION ALL SELECT item_id, 'other' FROM (SELECT item_id, row_number() OVER (ORDER BY md5(item_id || '|42'), item_id) AS r FROM benchmark), want WHERE r <= k % size"""
)
def ratio_mix(spark: SparkSession, sf: str) -> DataFrame:
    main = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit("main").alias("part"))
    other = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("other").alias("part"))
    return sampling.ratio_mix(main, other, "id", 0.3)


_WEIGHTS = {"A_starting_if": 3.0, "B_if_then": 2.0, "D_if_stay": 2.0, "E_from_here": 1.0}


@query(
    """WITH u AS (SELECT event_id, ('0x' || substr(md5(event_id || '|42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM events)
    SELECT event_id, CASE WHEN u < 0.375 THEN 'A_starting_if' WHEN u < 0.625 THEN 'B_if_then' WHEN u < 0.875 THEN 'D_if_stay' ELSE 'E_from_here' END AS template,
        list_extract(['x', 'y', 'z'], CAST(floor(u * 3) AS INT) + 1) AS option FROM u"""
)
def weighted_choice(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id", sampling.weighted_choice(k, _WEIGHTS, 42).alias("template"), sampling.uniform_choice(k, F.array(*map(F.lit, "xyz")), 42).alias("option")
    )


@query(
    """SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS t FROM
        (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r <= 4) WHERE t <= 50"""
)
def per_group_quota(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.group_quota(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", ["c_custkey"], 4, 50)


@query(
    """WITH RECURSIVE dealt AS (SELECT doc_id, n_chars::BIGINT AS length, md5(doc_id || '|42') AS h FROM documents),
    placed AS (SELECT *, (row_number() OVER (ORDER BY h, doc_id) - 1) // 8 AS megabatch FROM dealt),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY megabatch ORDER BY length DESC, h) - 1 AS r, count(*) OVER (PARTITION BY megabatch) AS size FROM placed),
    walk AS (SELECT megabatch, size, -1::BIGINT AS r, 0::HUGEINT AS t0, 0::HUGEINT AS t1, 0 AS n0, 0 AS n1, -1 AS chunk FROM (SELECT DISTINCT megabatch, size FROM ranked)
        UNION ALL SELECT megabatch, size, r, t0 + CASE WHEN c = 0 THEN length ELSE 0 END, t1 + CASE WHEN c = 1 THEN length ELSE 0 END, n0 + CASE WHEN c = 0 THEN 1 ELSE 0 END, n1 + CASE WHEN c = 1 THEN 1 ELSE 0 END, c
        FROM (SELECT w.*EXCLUDE (r), d.r, d.length, CASE WHEN w.size % 2 = 1 THEN d.r % 2 WHEN w.n1 * 2 >= w.size THEN 0 WHEN w.n0 * 2 >= w.size THEN 1 WHEN w.t0 <= w.t1 THEN 0 ELSE 1 END::INT AS c FROM walk w JOIN ranked d ON d.megabatch = w.megabatch AND d.r = w.r + 1))
    SELECT d.doc_id, '' AS modality, d.megabatch, d.length, w.chunk, CASE WHEN w.chunk = 0 THEN n0 ELSE n1 END - 1 AS place FROM walk w JOIN ranked d ON d.megabatch = w.megabatch AND d.r = w.r"""
)
def length_batches(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.length_batches(table(spark, sf, "documents"), "doc_id", "n_chars", 4, 2)


@query()
def render_params(spark: SparkSession, sf: str) -> DataFrame:
    """Three variants of every supplier's episode: the cross join is an explode."""
    rows = tr.with_variants(table(spark, sf, "supplier").select("s_suppkey"), 3)
    drawn = rows.select("s_suppkey", "variant", draws.render_params(F.col("s_suppkey"), F.col("variant"), height_jitter=0.3, hfov_jitter=20.0, resolutions=(224, 336, 448)).alias("p"))
    return drawn.select("s_suppkey", "variant", "p.*", draws.render_signature(F.col("p")).alias("signature"))


@query()
def precise_sentences(spark: SparkSession, sf: str) -> DataFrame:
    rows = trajectories(spark, sf).select("user_id", tr.segments_of(F.col("actions")).alias("segments"))
    return rows.select("user_id", draws.precise_instruction(F.col("user_id"), F.col("segments")).alias("said"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return windows.with_event_time(table(spark, sf, "events"))


_AT = "epoch({})::BIGINT"


@query(f"SELECT event_type, {_AT.format('time_bucket(INTERVAL 1 HOUR, ts)')} AS start, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    return windows.tumbling_counts(_events(spark, sf), ["event_type"], "1 hour").select("event_type", F.unix_seconds("start").alias("start"), "n")


@query(
    """SELECT event_type, start, count(*) AS n FROM (SELECT event_type, epoch(time_bucket(INTERVAL 30 MINUTE, ts))::BIGINT - 1800 * unnest([0, 1]) AS start FROM events) GROUP BY 1, 2"""
)
def sliding_counts(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sliding_counts(_events(spark, sf), ["event_type"], "1 hour", "30 minutes").select("event_type", F.unix_seconds("start").alias("start"), "n")


@query(
    """SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
        (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""
)
def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    return windows.session_counts(_events(spark, sf), ["user_id"], "6 hours").select("user_id", F.unix_seconds("start").alias("start"), "n")


def session_commands(events: DataFrame) -> DataFrame:
    """Events as session commands: sign-ups start, purchases stop and submit, errors disconnect, the rest moves."""
    kinds = F.create_map(*[F.lit(x) for p in {"signup": "start", "purchase": "stop", "error": "disconnect"}.items() for x in p])
    kind = F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("move"))
    base = events.select(
        F.col("user_id").cast("string").alias("sid"), (F.col("event_id") * 2).alias("seq"), kind.alias("type"), F.when(F.col("event_type") == "view", "turn_left").otherwise("move_forward").alias("action_key"),
        F.lit(None).cast("string").alias("instruction_text"), F.col("value").alias("x"), F.lit(0.0).alias("y"), (F.col("value") / 2).alias("z"),
    )
    submits = base.where("type = 'stop'").withColumn("seq", F.col("seq") + 1).withColumn("type", F.lit("submit")).withColumn("instruction_text", F.concat(F.lit("walk "), F.col("seq").cast("string")))
    return base.unionByName(submits)


#: One row per command and session in turn: what the session is after it, and the episode that it finishes.
_SESSIONS_SQL = """
    WITH RECURSIVE sent AS (
        SELECT CAST(user_id AS VARCHAR) AS sid, event_id * 2 AS seq,
               CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'stop' WHEN 'error' THEN 'disconnect' ELSE 'move' END AS type,
               CASE WHEN event_type = 'view' THEN 'turn_left' ELSE 'move_forward' END AS action, value AS x FROM events
        UNION ALL SELECT CAST(user_id AS VARCHAR), event_id * 2 + 1, 'submit', NULL, NULL FROM events WHERE event_type = 'purchase'
    ), commands AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY sid ORDER BY seq) AS i FROM sent
    ), machine AS (
        SELECT sid, 0::BIGINT AS i, 'idle' AS phase, 0 AS steps, 0 AS local_no, []::VARCHAR[] AS actions, 0.0::DOUBLE AS here, 0.0::DOUBLE AS start, 0.0::DOUBLE AS goal,
               NULL::VARCHAR AS kind, NULL::VARCHAR AS instruction, []::VARCHAR[] AS done, 0.0::DOUBLE AS way
        FROM (SELECT DISTINCT sid FROM commands)
        UNION ALL
        SELECT sid, i,
               CASE WHEN begins THEN 'recording' WHEN type = 'stop' AND phase = 'recording' THEN 'pending' WHEN saves OR submits THEN 'idle' ELSE phase END,
               CASE WHEN type = 'move' AND phase = 'idle' THEN steps + 1 WHEN begins AND saves THEN 0 ELSE steps END,
               local_no + CAST(saves OR submits AS INTEGER),
               CASE WHEN records THEN list_append(actions, action) WHEN begins THEN [] ELSE actions END,
               now, CASE WHEN begins THEN now ELSE start END, CASE WHEN records OR begins THEN now ELSE goal END,
               CASE WHEN saves THEN 'auto' WHEN submits THEN 'submitted' END, CASE WHEN saves THEN '(auto-saved)' WHEN submits THEN 'walk ' || seq END, list_append(actions, 'stop'), abs(goal - start)
        FROM (SELECT m.*  EXCLUDE (i, kind, instruction, done, way), c.i, c.seq, c.type, c.action, CASE WHEN type = 'move' THEN coalesce(c.x, here) ELSE here END AS now,
                     type = 'move' AND phase = 'recording' AS records,
                     type = 'start' AND phase <> 'pending' AND steps >= 3 AS begins,
                     (type = 'start' AND phase = 'recording' AND steps >= 3) OR (type = 'disconnect' AND phase <> 'idle') AS saves,
                     type = 'submit' AND phase = 'pending' AND steps >= 3 AS submits
              FROM machine m JOIN commands c ON c.sid = m.sid AND c.i = m.i + 1)
    )
    SELECT row_number() OVER (ORDER BY sid, local_no) AS episode_id, sid, local_no, kind, instruction, array_to_string(done, ',') AS actions, CAST(len(done) AS INTEGER) AS n_positions,
           round(way * sqrt(1.25), 6) AS distance
    FROM machine WHERE kind IS NOT NULL"""


def _shown(episodes: DataFrame) -> DataFrame:
    return episodes.select("episode_id", "sid", "local_no", "kind", "instruction", F.array_join("actions", ",").alias("actions"), "n_positions", F.round("distance", 6).alias("distance"))


@query(_SESSIONS_SQL)
def session_machine(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(sessions.number_episodes(sessions.replay_sessions(session_commands(table(spark, sf, "events")), unlock=3)))


@query(_SESSIONS_SQL)
def numbered_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The same episodes from a stream over the table's files, numbered by the sink; all files are one batch."""
    events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet")
    provider, path = "spark.sql.streaming.stateStore.providerClass", fresh(spark, "numbered-sessions")
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        sink = sessions.NumberingSink(f"{path}/sink")
        episodes = sessions.session_episodes(session_commands(events), unlock=3)
        episodes.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return _shown(sink.episodes(spark))