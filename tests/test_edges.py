"""Smaller functions and readers, each on rows chosen by hand."""

import json

import pytest
from pyspark.sql import functions as F

from wayloom.functions import geometry, sequences, text
from wayloom.operators import filters, metrics, sampling
from wayloom.sources import listings, records, sinks
from wayloom.streaming import sessions


@pytest.fixture(scope="module")
def one(spark):
    def run(*columns):
        return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())

    return run


def turns(*pairs):
    return F.array(*[F.struct(F.lit(w).alias("from"), F.lit(v).alias("value")) for w, v in pairs])


def test_filters(one):
    three = F.array(*map(F.lit, (1, 2, 3)))
    four = F.array(*map(F.lit, (1, 2, 3, 0)))
    assert one(filters.length_ok(three, F.lit(3)), filters.length_ok(four, F.lit(4)), filters.length_ok(four, F.lit(5))) == [False, True, False]
    null = F.lit(None).cast("int")
    assert one(filters.level_reason(null, F.lit(1), F.lit(3)), filters.level_reason(F.lit(1), F.lit(1), F.lit(1)), filters.level_reason(F.lit(1), F.lit(1), F.lit(2)), filters.level_reason(F.lit(1), F.lit(2), F.lit(2))) == [
        "no_level", "single_level", "same_level", None,
    ]
    assert one(filters.annotation_reason(F.lit(""), F.array(F.lit("x")), three), filters.annotation_reason(F.lit("a"), F.array(F.lit("N/A")), three), filters.annotation_reason(F.lit("a"), F.array(F.lit("go")), F.array(F.lit(1)))) == [
        "missing_id", "bad_instruction", "too_short",
    ]
    assert one(filters.language_matches(F.lit(None), []), filters.language_matches(F.lit(None), ["en"]), filters.language_matches(F.lit("EN-us"), ["en"]), filters.language_matches(F.lit("EN-us"), ["en"], False)) == [True, False, False, True]


def test_qa_and_projections(spark):
    qa = spark.createDataFrame([(1, [("human", "<image>why?"), ("gpt", "so")]), (2, [("human", "x"), ("gpt", " ")]), (3, [("human", "x")])], "id int, conversations array<struct<from:string,value:string>>")
    assert [(r["id"], r["question"]) for r in filters.usable_qa(qa).collect()] == [(1, "why?")]
    assert [tuple(r) for r in filters.passthrough(spark.createDataFrame([(7, " go ")], "k int, t string"), "k", "t").collect()] == [(7, ["go"])]
    assert filters.drop_internal(spark.createDataFrame([(1, 2)], "_a int, b int")).columns == ["b"]
    listing = spark.createDataFrame([("a",)], "path string")
    assert [r[0] for r in filters.missing_files(spark.createDataFrame([("a",), ("b",)], "f string"), "f", listing).collect()] == ["b"]


def test_text_details(one):
    messages = F.array(F.struct(F.lit("human").alias("role"), F.lit("hi").alias("text")))
    assert one(text.speaker_lines(messages, "H\n"), text.anchor_image_tokens(F.lit("a <image> b"), F.lit(2)), text.json_object(F.lit('```json\n{"a": {"b": 1}}\n``` end')), text.json_object(F.lit("none"))) == [
        "H\n### human: hi\n### ", "<image>\n<image>\na  b", '{"a": {"b": 1}}', None,
    ]
    assert one(text.metric_line(F.lit(3), F.lit(2 / 3), F.lit(1.0), F.lit(1.0), F.lit(0.5))) == ["[3] Eval Results: Success:0.667, NE:1.000, OS:1.000, SPL:0.500"]
    assert one(text.clean_output(F.lit(' "\'x\'" ')), text.clean_output(F.lit("```y```")), text.ensure_period(F.lit("a ")), text.ensure_period(F.lit("a!")), text.decapitalize(F.lit(" Go On"))) == ["x", "y", "a.", "a!", "go On"]
    assert one(text.rewrite_accepted(F.lit("go to the kitchen door"), F.lit("walk to kitchen door")), text.rewrite_accepted(F.lit("from the kitchen door"), F.lit("kitchen door")), text.rewrite_accepted(F.lit(""), F.lit("x"))) == [True, False, False]
    assert one(text.normalize_object(F.lit("the glass")), text.normalize_object(F.lit("two chairs")), text.normalize_object(F.lit("owl.")), text.normalize_object(F.lit(None))) == ["a glass", "two chairs", "an owl", "a pool table"]
    assert one(text.scene_stem(F.lit("/x/one.basis.glb")), text.model_name(F.lit("/m/base/checkpoint-5/")), text.action_id(F.lit("turn_left")), text.action_id(F.lit("3")), text.action_id(F.lit("fly"))) == ["one", "base_checkpoint-5", 2, 3, 0]
    assert one(text.substitute_stairs(F.lit("Rest. Go upstairs now"), F.lit("go to the top floor")), text.substitute_stairs(F.lit("no such thing"), F.lit("x"))) == ["Rest. Go to the top floor now", "no such thing"]


def test_geometry_details(one):
    goal = lambda r: F.array(F.struct(F.array(F.lit(1.0)).alias("position"), F.lit(r).cast("double").alias("radius")))
    assert one(geometry.goals_equal(goal(None), goal(0.0)), geometry.goals_equal(goal(0.5), goal(0.0))) == [True, False]
    path = F.array(*[F.array(*map(F.lit, p)) for p in ((0.0, 0.0), (3.0, 4.0), (3.0, 5.0))])
    assert one(geometry.path_length(path), geometry.focal_length(F.lit(640), F.lit(90.0)), geometry.clamp(F.lit(0.1), 0.2, 1.0), geometry.direction(F.lit(1), F.lit(1)), geometry.direction(F.lit(1), F.lit(1), False)) == [6.0, pytest.approx(320.0), 0.2, "same", "down"]
    box = one(geometry.box(F.array(*map(F.lit, (0.0, 1.0, 0.0))), F.array(*map(F.lit, (2.0, -4.0, 6.0)))))[0]
    assert box["low"] == [-1.0, -1.0, -3.0] and box["high"] == [1.0, 3.0, 3.0]
    assert [tuple(x) for x in one(geometry.patch_grid(F.lit(30), F.lit(50), 14), geometry.padded_square(F.lit(30), F.lit(50)))] == [(2, 3), (50, 10, 0)]


def test_sequence_details(one):
    assert one(sequences.frame_times(F.lit(3), 2.0), sequences.even_frames(F.lit(10), 1), sequences.spread_cut(F.lit(3), 8), sequences.last_of(F.array(F.lit(1), F.lit(9)))) == ["0.00s,0.50s,1.00s", [0], [0, 1, 2], 9]
    assert one(sequences.first_current_middle(F.lit(0), F.lit(5)), sequences.first_current_middle(F.lit(9), F.lit(4), 4), sequences.first_current_middle(F.lit(3), F.lit(4), 1)) == [[0] * 8, [0, 1, 2, 3], [3]]
    assert one(sessions.observation_epoch(F.lit(63)), metrics.throughput(F.lit(5), F.lit(0)), metrics.throughput(F.lit(5), F.lit(2))) == [1, 0.0, 2.5]
    frames = F.array(*[F.struct(F.lit(x).cast("boolean").alias("has_stairs")) for x in (True, None, False, True)])
    assert one(metrics.stair_frames(frames)) == [2]


def test_sampling_details(spark):
    rows = spark.range(1000).select(F.col("id").alias("ordinal"))
    kept = [r[0] for r in sampling.validation_rows(rows, ["ordinal"], 1000, 5, 5, 100).collect()]
    assert kept[:5] == [0, 1, 2, 3, 4] and kept[-5:] == [995, 996, 997, 998, 999] and all(x % 10 == 0 for x in kept[5:-5])
    assert sampling.repeat_to_length(spark.range(3), "id", 8).count() == 8 and sampling.repeat_to_length(spark.range(0), "id", 8).count() == 0
    styles = spark.range(1).select(sampling.eligible_styles(["fuzzy"], F.lit(2), F.lit(2), F.lit(3)), sampling.eligible_styles(["fuzzy", "updown"], F.lit(1), F.lit(2), F.lit(3))).first()
    assert list(styles) == [["absolute"], ["fuzzy", "updown"]]
    doubled = sampling.map_rows(spark.range(4), lambda b: b * 2, "id long")
    assert sorted(r[0] for r in doubled.collect()) == [0, 2, 4, 6]


def test_overrides_and_manifest(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"records": [{"episode_id": "1", "instructions": [" a "]}, {"id": "2", "instruction": "b"}, {"id": "3", "instructions": []}]}))
    assert sorted(tuple(r) for r in records.instruction_overrides(spark, str(tmp_path / "o.json")).collect()) == [("1", "a"), ("2", "b")]
    episodes = {"episodes": [{"instruction": {"instruction_text": "go  now", "language": "en-US", "instruction_id": "i/1"}}, {"instruction": {"instruction_text": "los", "language": "de"}}]}
    (tmp_path / "e.json").write_text(json.dumps(episodes))
    indexed = records.with_dataset_index(spark, str(tmp_path / "e.json"))
    assert [r["word"] for r in records.vocabulary(indexed).collect()] == ["go", "los", "now"]
    assert [tuple(r) for r in listings.trajectory_manifest(indexed, ["en"]).collect()] == [(0, "traj_0_i-1", "en-US")]
    raw = spark.createDataFrame([(i, r) for i, r in enumerate(('"text"', '{"instruction_text": "inner"}', '["a", "b"]', '"say \\"go\\" \\u00e9"', 'say "go"', '"a" or "b"', "[beep] go", None))], "i int, raw string")
    got = raw.orderBy("i").select(records.union_instruction(F.col("raw")), records.union_list(F.col("raw"))).collect()
    assert got[0][0] == "text" and got[1][0] == "inner" and got[2][1] == ["a", "b"]
    assert [r[0] for r in got[3:]] == ['say "go" é', 'say "go"', '"a" or "b"', "[beep] go", None]
    assert [r[1] for r in got[3:]] == [['say "go" é'], ['say "go"'], ['"a" or "b"'], ["[beep] go"], None]
    assert records.read_tagged(spark, [str(tmp_path / "nowhere" / "x.json")], "id string").count() == 0


def test_more_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1), ("s2", 2)], "scene_id string, x int")
    sinks.write_envelope(df, str(tmp_path / "env"), "demo")
    assert spark.read.json(str(tmp_path / "env" / "header")).first()["count"] == 2
    sinks.write_by_scene(df, str(tmp_path / "scenes"))
    sinks.write_by_scene(spark.createDataFrame([("s2", 5)], df.schema), str(tmp_path / "scenes"))
    assert sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "scenes")).collect()) == [1, 5]
    files = listings.list_files(spark, str(tmp_path / "scenes"), "*.parquet")
    assert files.count() == 2 and listings.first_video_frames(files).count() == 2
