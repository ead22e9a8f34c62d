"""Keyed operators, levels, metrics, sampling, sources, sinks and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from wayloom import schemas
from wayloom.operators import keys, levels, metrics, sampling, tolerance
from wayloom.operators import trajectories as tr
from wayloom.sources import listings, records, sinks
from wayloom.streaming import sessions, windows


def test_golden_metrics(spark):
    rows = [(1.0, 0.4, 1.0, 5.0, 5.0), (0.0, 3.2, 1.0, 4.0, 6.0), (1.0, 0.1, 1.0, 3.0, 6.0), (1.0, float("nan"), 1.0, 3.0, 6.0), (1.0, 1.0, 1.0, float("inf"), 6.0)]
    df = spark.createDataFrame(rows, "success double, nav_error double, os double, shortest double, actual double")
    r = metrics.spl_summary(df).first()
    assert (r["n"], r["os"], r["spl"]) == (3, 1.0, 0.5) and r["sr"] == pytest.approx(2 / 3) and r["ne"] == pytest.approx(3.7 / 3)
    assert list(metrics.spl_summary(df.limit(0)).first()) == [0, 0.0, 0.0, 0.0, 0.0]


def test_result_payloads(spark):
    lines = [(json.dumps({"a": {"success": 1, "nav_error": 0.5, "os": 1, "shortest_path_length": 2, "actual_path_length": 4}}),), (json.dumps({"b": [1, 0.2, 1]}),)]
    rows = {r["instruction"]: r for r in metrics.result_rows(spark.createDataFrame(lines, "entry string")).collect()}
    assert (rows["a"]["shortest"], rows["a"]["actual"]) == (2.0, 4.0) and (rows["b"]["success"], rows["b"]["nav_error"], rows["b"]["shortest"]) == (1.0, 0.2, 0.0)


def test_upsert_keeps_the_first(spark):
    old = spark.createDataFrame([("a", 1.0, 0)], "k string, v double, pos int")
    new = spark.createDataFrame([("a", 1.0 + 1e-7, 1), ("a", 2.0, 2), ("a", 2.0, 3)], "k string, v double, pos int")
    assert sorted(r["pos"] for r in tolerance.upsert_append(old, new, "k", "v", ["pos"]).collect()) == [0, 2]


def test_unique_or_fail(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    assert keys.assert_unique(df, ["k"]).count() == 2
    with pytest.raises(Exception, match="repeated key"):
        keys.assert_unique(df.union(df), ["k"]).collect()


def test_ordinals(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"))
    rows = keys.dense_ordinals(df, ["k"]).collect()
    assert sorted((r["k"], r["ordinal"]) for r in rows) == [(i, i) for i in range(1000)]
    assert keys.dense_ordinals(df.limit(0), ["k"]).count() == 0


def test_floor_gaps(spark):
    rows = [("s", y) for y in (0.0, 1.5, 3.1, 3.1, None)]
    got = {r["floor"]: r["height"] for r in levels.gap_clusters(spark.createDataFrame(rows, "scene string, y double"), "scene", "y").collect()}
    assert got == {1: pytest.approx(0.75), 2: pytest.approx(3.1)}


def test_containment_edges(spark):
    boxes = spark.createDataFrame([("s", 0, 1, [0.0, 0.0, 0.0], [4.0, 4.0, 4.0]), ("s", 1, 2, [0.0, 0.0, 0.0], [1.0, 1.0, 1.0])], "scene string, region int, level int, low array<double>, high array<double>")
    points = spark.createDataFrame([(1, "s", 0.5, 0.5, 0.5), (2, "s", 1.25, 0.5, 0.5), (3, "s", 4.2, 4.5, 4.0), (4, "s", 9.0, 0.0, 0.0)], "p int, scene string, x double, y double, z double")
    got = {r["p"]: r["level"] for r in levels.smallest_box(points, boxes, "scene", "p").collect()}
    assert got == {1: 2, 2: 1, 3: 1}


def test_sampling_specs():
    assert sampling.sample_size("end:0", 10) == ("end", 0) and sampling.sample_size("random:15%", 10) == ("random", 2) and sampling.sample_size("all", 3) == ("first", 3)
    with pytest.raises(ValueError):
        sampling.sample_size("random:0.5", 10)
    assert sampling.ratio_count(500, 0.45) == 409


def test_even_chunks():
    assert sampling.even_chunks([9, 7, 3, 1], 2) == [[0, 3], [1, 2]] and sampling.even_chunks([1, 2, 3], 2) == [[0, 2], [1]]


def test_training_rows(spark):
    rows = [("e", "v", ["walk"], [-1, 1, 2, 0]), ("n", "v", ["none"], [-1, 1]), ("m", "v", [], [-1, 1])]
    df = spark.createDataFrame(rows, "id string, video string, instructions array<string>, actions array<int>")
    out = tr.training_rows(df).orderBy("id").collect()
    assert [r["id"] for r in out] == ["e_step_0", "e_step_1", "e_step_2"] and out[0]["conversations"][1]["value"] == "↑←STOPSTOPSTOPSTOP"
    assert out[1]["image"][:2] == ["v/rgb/001.jpg", "v/rgb/002.jpg"] and len(out[1]["image"]) == 8


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"records": [{"id": 1, "instructions": ["x"]}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": 2, "instructions": ["y"]}]))
    (tmp_path / "c.json").write_text("{broken")
    got = records.read_records(spark, str(tmp_path), schemas.CUSTOM_INSTRUCTION)
    assert sorted(r["id"] for r in got.collect()) == [1, 2]
    assert records.unreadable(spark, str(tmp_path)).count() == 1
    (tmp_path / "d.jsonl").write_text('{"episode_id": "7"}\nnot json\n{"episode_id": "7"}\n')
    assert [r[0] for r in records.checkpoint_ids(spark, str(tmp_path / "d.jsonl")).collect()] == ["7"]
    assert records.malformed_lines(spark, str(tmp_path / "d.jsonl"), "episode_id string").count() == 1
    episodes = {"episodes": [{"episode_id": 1, "instruction": {"instruction_text": "go", "language": "en-US"}, "goals": [{"position": [1, 2, 3]}], "reference_path": [[0, 0, 0]]}, {"episode_id": 2, "instruction": {"instruction_text": " ", "language": "hi"}, "goals": []}]}
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "e.json").write_text(json.dumps(episodes))
    assert [r["goal_position"] for r in records.read_episodes(spark, str(tmp_path / "e")).collect()] == [[1.0, 2.0, 3.0]]
    assert records.read_language_episodes(spark, str(tmp_path / "e"), "EN").count() == 1


def test_house_files(spark, tmp_path):
    (tmp_path / "one.house").write_text("R 0 0 0 0 0 1.0 x\nR 1 0 0 0 0 4.0 x\nV 0 0 0 0 9.0\n")
    (tmp_path / "two.house").write_text("V 0 0 0 0 2.5\n")
    got = sorted((r["scene"], r["y"]) for r in listings.house_heights(spark, str(tmp_path)).collect())
    assert got == [("one", 1.0), ("one", 4.0), ("two", 2.5)]


def test_sinks(spark, tmp_path):
    df = spark.range(10)
    assert sinks.write_counted(df, str(tmp_path / "lines")) == 10
    sinks.write_shards(df, str(tmp_path / "shards"), "id", 3)
    assert spark.read.json(str(tmp_path / "shards")).where("shard = id % 3").count() == 10


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"a": ["${ROOT}/x", {"b": "$MISSING"}], "n": 1}')
    assert records.load_config(str(tmp_path / "c.json"), {"ROOT": "/r"}) == {"a": ["/r/x", {"b": "$MISSING"}], "n": 1}


def commands(spark, rows):
    return spark.createDataFrame([(s, i, t, None, x, None, None, None) for i, (s, t, x) in enumerate(rows)], "sid string, seq long, type string, action_key string, instruction_text string, x double, y double, z double")


SCRIPT = (
    [("a", "move", None)] * 2 + [("a", "start", None)] + [("a", "move", None)] + [("a", "start", None)] + [("a", "move", None)] * 2 + [("a", "stop", None), ("a", "submit", "walk"), ("a", "submit", "again")]
    + [("b", "move", None)] * 3 + [("b", "start", None), ("b", "move", None), ("b", "disconnect", None), ("b", "disconnect", None)]
)


def test_session_script(spark):
    got = sorted((r["sid"], r["kind"], r["instruction"], len(r["actions"])) for r in sessions.replay_sessions(commands(spark, SCRIPT), unlock=3).collect())
    assert got == [("a", "rejected", "locked", 0), ("a", "rejected", "nothing to submit", 0), ("a", "submitted", "walk", 3), ("b", "auto", "(auto-saved)", 2)]


def test_streaming_agrees_with_replay(spark, tmp_path):
    df = commands(spark, SCRIPT)
    df.where("seq < 6").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("seq >= 6").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = sessions.session_episodes(stream, unlock=3)
    query = out.writeStream.format("memory").queryName("episodes").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    columns = ["sid", "local_no", "kind", "instruction", "n_positions", "distance"]
    got = sorted(map(str, spark.table("episodes").select(*columns).collect()))
    assert got == sorted(map(str, sessions.replay_sessions(df, unlock=3).select(*columns).collect()))


def test_window_stream_matches_table(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-01 00:{i % 60:02d}:00") for i in range(300)], "event_id int, t string").select("event_id", F.to_timestamp_ntz("t").alias("ts"), F.lit("k").alias("kind"))
    events.write.parquet(str(tmp_path / "ev"))
    stream = windows.tumbling_counts(windows.with_event_time(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), delay="1 hour"), ["kind"], "10 minutes")
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    want = windows.tumbling_counts(windows.with_event_time(events), ["kind"], "10 minutes")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))


def test_resume_state(spark):
    df = spark.createDataFrame([("sample_0000007_a_b_0001",), ("sample_0000009_a_b_0002",), ("sample_0000003_c_0001",)], "id string")
    assert list(metrics.resume_state(df).first()) == [9, 2]
    with pytest.raises(Exception, match="malformed"):
        metrics.resume_state(df.union(spark.createDataFrame([("odd",)], "id string"))).collect()


def test_variants_and_instructions(spark):
    df = spark.createDataFrame([("a", ["x", "y"], [1, 2, 3])], "id string, instructions array<string>, actions array<int>")
    assert tr.per_instruction(df).count() == 6 and sorted(r["variant"] for r in tr.with_variants(df, 3).collect()) == [0, 1, 2]


def test_reconstruction(spark):
    stop = "Final Answer: " + ", ".join(["Stop"] * 6)
    rows = [("s", [("human", "<image>\nInstruction: go on\nnow"), ("gpt", stop)], ["a.jpg"]), ("t", [("human", "Instruction: x\n"), ("gpt", "Final Answer: Stop")], [])]
    out = tr.reconstruction(spark.createDataFrame(rows, "id string, conversations array<struct<from:string,value:string>>, image array<string>")).collect()
    assert [r["id"] for r in out] == ["s_reconstruct"] and out[0]["conversations"][1]["value"] == "go on"


def test_reports(spark):
    rows = spark.createDataFrame([("a", ["1", "2"]), ("b", ["1"])], "id string, image array<string>")
    report = metrics.build_report(rows, spark.createDataFrame([("z",)], "id string"), "id", "image").first()
    assert (report["n_rows"], report["first_id"], report["last_id"], report["n_skipped"], report["skipped_examples"]) == (2, "a", "b", 1, ["z"]) and report["image_lengths"] == {1: 1, 2: 1}
    nested = spark.createDataFrame([({"t": {"acc": 0.5, "acc_stderr": 0.1}},)], "results map<string,map<string,double>>")
    assert [tuple(r) for r in metrics.flatten_metrics(nested).collect()] == [("t_acc", 0.5)]


def test_listings(spark):
    files = spark.createDataFrame([("/s/traj_10_x/2.jpg",), ("/s/traj_2_x/10.jpg",), ("/s/odd/1.jpg",), ("/s/traj_2_x/9.jpg",)], "path string")
    assert [r["traj_name"] for r in listings.ordered_trajectories(files).collect()] == ["traj_2_x", "traj_10_x", "odd"]
    assert [r["step"] for r in listings.ordered_images(files).where("traj_name = 'traj_2_x'").collect()] == [9, 10]
    scenes = spark.createDataFrame([("/a/one.glb",), ("/a/one.navmesh",), ("/a/two.glb",)], "path string")
    assert [r["scene"] for r in listings.complete_scenes(scenes).collect()] == ["one"]
    other = spark.createDataFrame([("/b/one.basis.glb",), ("/b/three.basis.glb",)], "path string")
    got = {r["scene"]: r["source"] for r in listings.scene_catalogue([("a", scenes.where("path LIKE '%glb'")), ("b", other)]).collect()}
    assert got == {"one": "a", "two": "a", "three": "b"}
