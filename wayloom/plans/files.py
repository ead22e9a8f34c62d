"""Readers and writers as queries: tables go to files in the shared folder and come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..folders import fresh
from ..operators import filters, keys, metrics, sampling
from ..sources import listings, manifest, records, sinks
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


def _lists(df: DataFrame, group: str, record, label: str, envelopes: tuple[str | None, ...], order) -> str:
    """One gzip JSON file per group: a list of records in order, plain or under an envelope key, and one file that breaks off."""
    body = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("at"), record.alias("r")))), lambda x: x["r"]))
    files = df.groupBy(F.col(group).cast("long").alias("part")).agg(body.alias("body"))
    wrapped = F.lit(None).cast("string")
    for i, key in enumerate(envelopes):
        text = F.col("body") if key is None else F.concat(F.lit(f'{{"about": [1, "a]}}"], "{key}": '), F.col("body"), F.lit(', "end": {}}'))
        wrapped = F.when(F.col("part") % len(envelopes) == i, text).otherwise(wrapped)
    broken = df.sparkSession.createDataFrame([(-1, '{"records": [{"id": 1')], "part long, value string")
    path = fresh(df.sparkSession, label)
    files.select("part", wrapped.alias("value")).unionByName(broken).repartition("part").write.partitionBy("part").option("compression", "gzip").text(path)
    return path


def _customer_lists(spark: SparkSession, sf: str, label: str) -> str:
    """Customers as instruction records, a file per nation."""
    record = F.struct(F.col("c_custkey").alias("id"), F.array("c_name").alias("instructions"))
    return _lists(table(spark, sf, "customer"), "c_nationkey", record, label, (None, "records", "episodes"), F.col("c_custkey"))


@query("SELECT c_custkey AS id, c_name AS said FROM customer")
def record_files(spark: SparkSession, sf: str) -> DataFrame:
    """Lists and envelopes of all customers; the file that breaks off has no rows."""
    return records.read_records(spark, _customer_lists(spark, sf, "lists"), schemas.CUSTOM_INSTRUCTION).select("id", F.get("instructions", F.lit(0)).alias("said"))


@query(SQL["record_files"])
def array_files(spark: SparkSession, sf: str) -> DataFrame:
    """The same files, streamed."""
    return records.read_array(spark, _customer_lists(spark, sf, "lists"), schemas.CUSTOM_INSTRUCTION).select("id", F.get("instructions", F.lit(0)).alias("said"))


@query("SELECT -1 AS part")
def unreadable_files(spark: SparkSession, sf: str) -> DataFrame:
    found = records.unreadable(spark, _customer_lists(spark, sf, "lists"))
    return found.select(F.regexp_extract("path", r"part=(-?\d+)", 1).cast("int").alias("part"))


@query("SELECT c_custkey AS id, c_nationkey AS part FROM customer")
def tagged_files(spark: SparkSession, sf: str) -> DataFrame:
    """All nations' folders, and one that isn't there."""
    path = _customer_lists(spark, sf, "lists")
    nations = [r[0] for r in table(spark, sf, "nation").select("n_nationkey").collect()]
    rows = records.read_tagged(spark, [f"{path}/part={n}/*" for n in [*nations, 1000]], schemas.CUSTOM_INSTRUCTION)
    return rows.select("id", F.regexp_extract("folder", r"part=(\d+)", 1).cast("long").alias("part"))


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey IN (1, 3, 12)")
def brace_files(spark: SparkSession, sf: str) -> DataFrame:
    """Three folders by a glob with braces."""
    return records.read_records(spark, _customer_lists(spark, sf, "lists") + "/part={1,3,12}", schemas.CUSTOM_INSTRUCTION).select("id")


@query("SELECT c_custkey::VARCHAR AS id, c_name AS instruction FROM customer")
def override_files(spark: SparkSession, sf: str) -> DataFrame:
    """Instructions to be trimmed, under either name of the id and either form."""
    k = F.col("c_custkey")
    said = F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))
    record = F.struct(
        F.when(k % 2 == 0, k.cast("string")).alias("episode_id"), k.cast("string").alias("id"), F.when(k % 3 == 0, F.array(said, F.lit("other"))).alias("instructions"), F.when(k % 3 > 0, said).alias("instruction")
    )
    return records.instruction_overrides(spark, _lists(table(spark, sf, "customer"), "c_nationkey", record, "overrides", ("records",), k))


_EPISODES_SQL = """episodes AS (SELECT c_custkey, c_nationkey, c_acctbal::DOUBLE AS bal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS dataset_index,
    CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'go  to ' || c_mktsegment END AS said, CASE c_custkey % 3 WHEN 0 THEN 'en-US' WHEN 1 THEN 'de' END AS language FROM customer)"""


def _episode_files(spark: SparkSession, sf: str) -> str:
    """Customers as episodes: some without instruction, language or goals, some with rotations of three numbers."""
    k, zero = F.col("c_custkey"), F.lit(0.0)
    said = F.when(k % 5 == 1, " ").when(k % 5 > 1, F.concat(F.lit("go  to "), F.col("c_mktsegment")))
    language = F.when(k % 3 == 0, "en-US").when(k % 3 == 1, "de")
    position = F.array(F.col("c_acctbal").cast("double"), zero, F.col("c_nationkey").cast("double"))
    goal = F.struct(position.alias("position"), F.lit(3.0).alias("radius"))
    record = F.struct(
        k.alias("episode_id"),
        F.struct(said.alias("instruction_text"), language.alias("language"), F.concat(F.lit("i/"), k.cast("string")).alias("instruction_id")).alias("instruction"),
        F.when(k % 7 > 0, F.array(goal)).otherwise(F.filter(F.array(goal), lambda g: F.lit(False))).alias("goals"),
        F.array(F.array(zero, zero, zero), F.array(F.lit(1.0), zero, F.lit(-1.5))).alias("reference_path"),
        F.when(k % 2 == 0, F.array(zero, zero, zero, F.lit(1.0))).otherwise(F.array(zero, zero, F.lit(1.0))).alias("start_rotation"),
    )
    return _lists(table(spark, sf, "customer"), "c_nationkey", record, "episodes", ("episodes",), k)


@query(f"WITH {_EPISODES_SQL} SELECT c_custkey AS episode_id, bal AS x FROM episodes WHERE trim(said) <> '' AND c_custkey % 7 > 0")
def episode_files(spark: SparkSession, sf: str) -> DataFrame:
    return records.read_episodes(spark, _episode_files(spark, sf)).select("episode_id", F.get("goal_position", F.lit(0)).alias("x"))


@query(
    f"""WITH {_EPISODES_SQL} SELECT c_custkey AS episode_id, CASE WHEN c_custkey % 7 > 0 THEN c_nationkey::DOUBLE ELSE -1.5::DOUBLE END AS z, c_custkey % 2 = 0 AS rotated
    FROM episodes WHERE language = 'en-US'"""
)
def language_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = records.read_language_episodes(spark, _episode_files(spark, sf), "EN")
    return rows.select("episode_id", F.get("goal_position", F.lit(2)).alias("z"), F.col("start_rotation").isNotNull().alias("rotated"))


@query(f"WITH {_EPISODES_SQL} SELECT c_custkey AS episode_id, dataset_index, CASE WHEN said IS NULL THEN 0 WHEN said = ' ' THEN 0 ELSE 3 END AS n_words FROM episodes")
def indexed_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = records.with_dataset_index(spark, _episode_files(spark, sf))
    return rows.select("episode_id", "dataset_index", F.when(F.col("words").isNull(), 0).otherwise(F.size("words")).alias("n_words"))


@query("SELECT 'go' AS word UNION ALL SELECT 'to' UNION ALL SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey % 5 > 1")
def vocabulary_files(spark: SparkSession, sf: str) -> DataFrame:
    return records.vocabulary(records.with_dataset_index(spark, _episode_files(spark, sf)))


@query(f"WITH {_EPISODES_SQL} SELECT dataset_index AS traj_idx, 'traj_' || dataset_index || '_i-' || c_custkey AS traj_name, language FROM episodes WHERE language LIKE 'en%'")
def manifest_files(spark: SparkSession, sf: str) -> DataFrame:
    return listings.trajectory_manifest(records.with_dataset_index(spark, _episode_files(spark, sf)), ["en"])


@query("SELECT event_id, event_type, value, (SELECT count(*) FROM events) AS written FROM events")
def line_files(spark: SparkSession, sf: str) -> DataFrame:
    """Lines written in two goes, and some that are no JSON, which are skipped."""
    path = fresh(spark, "lines.jsonl")
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    buys = F.col("event_type") == "purchase"
    n = sinks.write_counted(events.where(buys), path)
    sinks.write_lines(events.where(~F.coalesce(buys, F.lit(False))), path, append=True)
    spark.createDataFrame([("no json",), ('{"event_id": ',), ("",)], "value string").coalesce(1).write.mode("append").text(path)
    rest = spark.read.text(path).where(F.contains("value", F.lit('"event_id":')) & ~F.contains("value", F.lit('"purchase"')) & F.endswith("value", F.lit("}"))).count()
    return records.read_by_suffix(spark, path, "event_id long, event_type string, value double").withColumn("written", F.lit(n + rest).cast("long"))


@query(
    """SELECT 'part=' || page_id % 7 AS folder, CAST(row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS BIGINT) AS number, page_id FROM pages
    QUALIFY length(html) % 3 = 1"""
)
def numbered_malformed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Files of pages as lines in order of their ids; a third breaks off. Where the broken ones are, file by file."""
    k = F.col("page_id")
    line = F.to_json(F.struct("page_id", "url"))
    line = F.when(F.length("html") % 3 == 1, F.concat(F.lit("{"), k.cast("string"), F.lit(': "'))).otherwise(line)
    path = fresh(spark, "numbered-lines")
    lines = table(spark, sf, "pages").select((k % 7).alias("part"), "page_id", line.alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "page_id").select("part", "value").write.partitionBy("part").text(path)
    bad = records.malformed_lines(spark, path, "page_id long, url string", numbers=True)
    return bad.select(F.regexp_extract("path", r"(part=\d+)", 1).alias("folder"), "number", F.regexp_extract("line", r"(\d+)", 1).cast("long").alias("page_id"))


@query("SELECT 'broken ' || page_id || ' {' AS line FROM pages")
def malformed_files(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh(spark, "lines.jsonl")
    pages = table(spark, sf, "pages")
    sinks.write_lines(pages.select("page_id", "url"), path)
    pages.select(F.concat(F.lit("broken "), F.col("page_id").cast("string"), F.lit(" {"))).write.mode("append").text(path)
    return records.malformed_lines(spark, path, "page_id long, url string")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_custkey = o.o_custkey AND d.o_orderstatus = 'F')")
def checkpoint_files(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of customers that a checkpoint file of lines doesn't list yet."""
    path = fresh(spark, "done.jsonl")
    orders = table(spark, sf, "orders")
    sinks.write_lines(orders.where("o_orderstatus = 'F'").select("o_custkey"), path)
    return keys.resume_anti(orders, records.checkpoint_ids(spark, path, "o_custkey", "long"), ["o_custkey"]).select("o_orderkey")


@query("SELECT event_id % 8 AS shard, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def shard_files(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh(spark, "shards")
    sinks.write_shards(table(spark, sf, "events").select("event_id", "event_type"), path, "event_id", 8)
    rows = spark.read.schema("event_id long, event_type string, shard long").json(path)
    return rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT CAST(event_id % 8 AS INTEGER) AS shard, count(*) AS counted, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def shard_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """What the manifest says of each shard, and what its files hold."""
    path = fresh(spark, "counted-shards")
    manifest.write_counted_shards(table(spark, sf, "events").select("event_id", "event_type"), path, "event_id", 8)
    said = manifest.read_manifest(spark, path).groupBy("shard").agg(F.sum("count").alias("counted"))
    rows = manifest.read_counted_shards(spark, path, "event_id long, event_type string")
    return said.join(rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")), "shard")


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS said FROM customer")
def scene_files(spark: SparkSession, sf: str) -> DataFrame:
    """A rerun over the even scenes replaces those and leaves the rest."""
    path = fresh(spark, "scenes")
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").alias("scene_id"))
    sinks.write_by_scene(rows.select("c_custkey", F.col("c_name").alias("said"), "scene_id"), path)
    sinks.write_by_scene(rows.where("scene_id % 2 = 0").select("c_custkey", F.col("c_mktsegment").alias("said"), "scene_id"), path)
    return spark.read.parquet(path).select("c_custkey", "said")


@query("SELECT s_suppkey, s_name, 'demo' AS pipeline, (SELECT count(*) FROM supplier) AS count FROM supplier")
def envelope_files(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh(spark, "envelope")
    sinks.write_envelope(table(spark, sf, "supplier").select("s_suppkey", "s_name"), path, "demo")
    head = records.read_lines(spark, f"{path}/header", "pipeline string, count long")
    return records.read_lines(spark, f"{path}/records", "s_suppkey long, s_name string").join(F.broadcast(head))  # one row


@query("SELECT s_suppkey, s_name, '_new' AS suffix FROM supplier")
def beside_files(spark: SparkSession, sf: str) -> DataFrame:
    """The input stays as it is; the result lies next to it."""
    path = fresh(spark, "base")
    table(spark, sf, "supplier").select("s_suppkey").write.parquet(path)
    target = sinks.write_beside(spark.read.parquet(path).join(table(spark, sf, "supplier"), "s_suppkey").select("s_suppkey", "s_name"), path)
    return spark.read.parquet(target).join(spark.read.parquet(path), "s_suppkey").withColumn("suffix", F.lit(target.removeprefix(path)))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25")
def first_customers(spark: SparkSession, sf: str) -> DataFrame:
    return records.first_n(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 25)


@query("SELECT s_nationkey AS scene, s_suppkey * 0.5::DOUBLE AS y FROM supplier")
def house_files(spark: SparkSession, sf: str) -> DataFrame:
    """House files of even nations have rooms, those of odd ones only viewpoints; both state heights, and viewpoints beside rooms don't count."""
    path = fresh(spark, "houses")
    k, n, y = F.col("s_suppkey"), F.col("s_nationkey"), (F.col("s_suppkey") * 0.5).cast("string")
    rooms = F.concat_ws(" ", F.lit("R"), k, n, F.lit("0 0 x"), y, F.lit("-1"))
    views = F.concat_ws(" ", F.lit("V"), k, n, F.lit("0 0"), y)
    lines = F.when(n % 2 == 0, F.array(rooms, F.lit("V 0 0 0 0 99999"), F.lit("R short"))).otherwise(F.array(views, F.lit("H x"), F.lit("V 0 0 0 0 none")))
    table(spark, sf, "supplier").select(n.alias("part"), F.explode(lines).alias("value")).repartition("part").write.partitionBy("part").text(path)
    parts = [r[0] for r in table(spark, sf, "supplier").select("s_nationkey").distinct().collect()]  # nations
    found = [listings.house_heights(spark, f"{path}/part={p}").select(F.lit(p).cast("long").alias("scene"), "y") for p in parts]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


@query(
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'told ' || page_id ELSE NULL END AS instruction, 's' || page_id || '.glb' AS scene, page_id * 0.25::DOUBLE AS geodesic_distance FROM pages"""
)
def flat_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Instructions as a string, as an object, or missing."""
    k = F.col("page_id")
    raw = F.when(k % 3 == 0, F.concat(F.lit('"'), F.col("url"), F.lit('"'))).when(k % 3 == 1, F.concat(F.lit('{"instruction_text": "told '), k.cast("string"), F.lit('", "x": 1}')))
    rows = table(spark, sf, "pages").select(
        "page_id", k.alias("episode_id"), F.concat(F.lit("/data/s"), k.cast("string"), F.lit(".glb")).alias("scene_id"), raw.alias("instruction"), F.lit(None).alias("start_position"), F.lit(None).alias("start_rotation"),
        F.lit(None).alias("goals"), F.struct((k * 0.25).cast("double").alias("geodesic_distance")).alias("info"),
    )
    return records.flat_episode(rows).select(F.col("episode_id").alias("page_id"), "instruction", "scene", "geodesic_distance")


def _scene_paths(spark: SparkSession, sf: str, folder: str, ending: str, keep) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").where(keep).select(F.concat(F.lit(f"/{folder}/s"), k.cast("string"), F.lit(ending)).alias("path"))


@query(
    """SELECT 's' || s_suppkey AS scene, CASE WHEN s_nationkey % 2 = 0 THEN 'meshes' ELSE 'backup' END AS source,
        CASE WHEN s_nationkey % 2 = 0 THEN '/a/s' || s_suppkey || '.glb' ELSE '/b/s' || s_suppkey || '.basis.glb' END AS path FROM supplier"""
)
def scene_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The first listing has the scenes of even nations, the second has all."""
    return listings.scene_catalogue([("meshes", _scene_paths(spark, sf, "a", ".glb", "s_nationkey % 2 = 0")), ("backup", _scene_paths(spark, sf, "b", ".basis.glb", "true"))])


@query("SELECT 's' || s_suppkey AS scene FROM supplier WHERE s_nationkey % 3 > 0")
def scene_meshes(spark: SparkSession, sf: str) -> DataFrame:
    listing = _scene_paths(spark, sf, "a", ".glb", "true").union(_scene_paths(spark, sf, "a", ".navmesh", "s_nationkey % 3 > 0"))
    return listings.complete_scenes(listing).select("scene")


@query(
    """SELECT 'traj_' || o_custkey || '_x' AS traj_name, o_orderkey AS step FROM orders"""
)
def image_listing(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    paths = table(spark, sf, "orders").select(F.concat(F.lit("/d/traj_"), F.col("o_custkey").cast("string"), F.lit("_x/rgb"), k, F.lit(".jpg")).alias("path"))
    return listings.ordered_images(paths).select("traj_name", "step")


@query("SELECT 'clip' || p_size AS stem, min('/v' || p_partkey || '/clip' || p_size || '.mp4') AS path FROM part GROUP BY 1")
def video_listing(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "part").select(F.concat(F.lit("/v"), F.col("p_partkey").cast("string"), F.lit("/clip"), F.col("p_size").cast("string"), F.lit(".mp4")).alias("path"))
    return listings.first_video_frames(paths)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def files_missing(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("/f/"), F.col(c).cast("string"))
    listing = table(spark, sf, "orders").where("o_totalprice > 400000").select(name("o_custkey").alias("path"))
    return filters.missing_files(table(spark, sf, "customer").select("c_custkey", name("c_custkey").alias("file")), "file", listing).select("c_custkey")


@query(
    """WITH ids AS (SELECT 'sample_' || lpad(event_id::VARCHAR, 9, '0') || '_user_' || user_id || '_' || (event_id % 10) AS id, event_id, user_id FROM events)
    SELECT max(event_id) AS last_sample, count(DISTINCT user_id) AS n_finished FROM ids"""
)
def sample_state(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    ids = F.concat(F.lit("sample_"), F.lpad(k.cast("string"), 9, "0"), F.lit("_user_"), F.col("user_id").cast("string"), F.lit("_"), (k % 10).cast("string"))
    return metrics.resume_state(table(spark, sf, "events").select(ids.alias("id")))


@query(
    """SELECT (SELECT count(*) FROM events WHERE event_type <> 'error') AS n_rows, (SELECT min(event_id) FROM events WHERE event_type <> 'error') AS first_id, (SELECT max(event_id) FROM events WHERE event_type <> 'error') AS last_id,
        (SELECT count(*) FROM events WHERE event_type = 'error') AS n_skipped, (SELECT string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FROM (SELECT event_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 5)) AS skipped,
        (SELECT string_agg(length || ':' || n, ',' ORDER BY length) FROM (SELECT event_id % 4 AS length, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1)) AS lengths"""
)
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    events = table(spark, sf, "events").select("event_id", "event_type", F.array_repeat(F.lit("f"), (k % 4).cast("int")).alias("image"))
    report = metrics.build_report(events.where("event_type <> 'error'"), events.where("event_type = 'error'"), "event_id", "image", 5)
    lengths = F.array_join(F.transform(F.map_entries("image_lengths"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return report.select("n_rows", "first_id", "last_id", "n_skipped", F.array_join(F.transform("skipped_examples", lambda x: x.cast("string")), ",").alias("skipped"), lengths.alias("lengths"))


@query(
    """WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS ordinal FROM part), n AS (SELECT count(*) AS n, greatest(1, count(*) // 100) AS step FROM part)
    SELECT p_partkey FROM r, n WHERE ordinal < 10 OR ordinal >= n - 10 OR ordinal % step = 0"""
)
def validation_sample(spark: SparkSession, sf: str) -> DataFrame:
    parts = keys.dense_ordinals(table(spark, sf, "part").select("p_partkey"), ["p_partkey"], settled=True)
    return sampling.validation_rows(parts, ["ordinal"], table(spark, sf, "part").count(), 10, 10, 100).select("p_partkey")
