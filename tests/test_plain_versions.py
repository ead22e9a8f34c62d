"""Draws, batches, sessions and readers against plain versions of their rules."""

import hashlib
import json
import os
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayloom import plans
from wayloom.functions import draws
from wayloom.operators import levels, sampling
from wayloom.plans import spaces
from wayloom.sources import records
from wayloom.streaming import sessions, windows

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


@tables
def test_render_params(spark):
    """Every drawn parameter, from the generator that seed, episode and variant name."""
    got = plans.QUERIES["render_params"](spark, FOLDER).collect()
    assert len(got) == 3 * spark.read.parquet(f"{FOLDER}/supplier.parquet").count()
    for r in got:
        seed = hashlib.blake2b(f"42|{r['s_suppkey']}|{r['variant']}".encode(), digest_size=8).digest()
        rng = random.Random(int.from_bytes(seed, "big"))
        height = max(0.2, 1.25 + rng.uniform(-0.3, 0.3))
        hfov = max(30.0, min(160.0, 90.0 + rng.uniform(-20.0, 20.0)))
        side = rng.choice((224, 336, 448))
        assert (r["camera_height"], r["hfov"], r["width"], r["height"]) == (height, hfov, side, side)
        assert r["signature"] == f"h{height:.4f}_f{hfov:.4f}_{side}x{side}"


def test_sentences_follow_the_segments():
    """Read back, a sentence has the segments' movements in their order."""
    rng = random.Random(1)
    for i in range(300):
        segments = []
        for _ in range(rng.randrange(1, 12)):
            kind = rng.choice(("forward", "turn_left", "turn_right"))
            segments.append((kind, rng.choice((0.25, 1.5, 2.0, 3.75)) if kind == "forward" else rng.choice((30, 60, 90, 180))))
        said = draws.precise_sentence(segments, draws.episode_random(i, 0, 42))
        assert any(said.startswith(o) for o in draws.OPENINGS) and any(said.endswith(c) for c in draws.CLOSINGS)
        found = []
        for m in re.finditer(r"half a circle|full|[\d.]*\d", said):
            found.append(180.0 if m.group() in ("half a circle", "full") else float(m.group()))
        assert found == [float(n) for _, n in segments]
        turns = [k for k, _ in segments if k != "forward"]
        sides = re.findall(r"counter-clockwise|clockwise|left|right", re.sub(r"turn (left|right) (\d+)", r"turn \1 \2", said))
        assert ["turn_left" if s in ("left", "counter-clockwise") else "turn_right" for s in sides] == turns


def plain_batches(rows, batch, workers, seed=42):
    """Megabatches in hash order; in each, the longest goes to the lightest worker that has room."""
    key = lambda i: hashlib.md5(f"{i}|{seed}".encode()).hexdigest()
    ordered, out = sorted(rows, key=lambda r: (key(r[0]), r[0])), {}
    for m in range(0, len(ordered), batch * workers):
        mega = sorted(ordered[m : m + batch * workers], key=lambda r: (-r[1], key(r[0])))
        loads = [[] for _ in range(workers)]
        for at, (i, n) in enumerate(mega):
            if len(mega) % workers:
                worker = at % workers
            else:
                free = [w for w in range(workers) if len(loads[w]) < len(mega) // workers]
                worker = min(free, key=lambda w: (sum(loads[w]), w))
            out[i] = (m // (batch * workers), n, worker, len(loads[worker]))
            loads[worker].append(n)
    return out


@pytest.mark.parametrize(("n", "batch", "workers"), [(50, 4, 2), (37, 3, 3), (48, 2, 4), (5, 4, 4)])
def test_length_batches(spark, n, batch, workers):
    rng = random.Random(n)
    rows = [(i, rng.randrange(1, 40)) for i in range(n)]
    got = sampling.length_batches(spark.createDataFrame(rows, "k long, size int"), "k", "size", batch, workers).collect()
    assert {r["k"]: (r["megabatch"], r["length"], r["chunk"], r["place"]) for r in got} == plain_batches(rows, batch, workers)


def test_length_batches_are_dealt_many_at_a_time(spark):
    """A task deals many small megabatches at once, one of a call each before; rows of a null modality are kept."""
    rng = random.Random(3)
    rows = [(i, rng.randrange(1, 40), "ab"[i % 2] if i % 3 else None) for i in range(3001)]
    df = spark.createDataFrame(rows, "k long, size int, m string")
    dealt = sampling.length_batches(df, "k", "size", 4, 2)
    assert "FlatMapGroupsInArrow" in dealt._jdf.queryExecution().toString() and sampling.DEALT_ROWS > len(rows)
    assert {r["k"]: (r["megabatch"], r["length"], r["chunk"], r["place"]) for r in dealt.collect()} == plain_batches([r[:2] for r in rows], 4, 2)
    want = {}
    for m in ("a", "b", None):
        want |= {k: (m, *at) for k, at in plain_batches([r[:2] for r in rows if r[2] == m], 4, 2).items()}
    got = sampling.length_batches(df, "k", "size", 4, 2, modality=F.col("m")).collect()
    assert {r["k"]: (r["modality"], r["megabatch"], r["length"], r["chunk"], r["place"]) for r in got} == want


def test_deal_chunks():
    rng = random.Random(5)
    for workers in (1, 2, 3):
        sizes = [rng.randrange(1, 13) for _ in range(40)]
        lengths = [sorted((rng.randrange(9) for _ in range(n)), reverse=True) for n in sizes]
        chunk, place = sampling.deal_chunks(np.repeat(np.arange(40), sizes), np.concatenate(lengths), workers)
        at = 0
        for one in lengths:
            loads, want = [[] for _ in range(workers)], []
            for k, n in enumerate(one):
                free = [w for w in range(workers) if len(loads[w]) < len(one) // workers]
                w = k % workers if len(one) % workers else min(free, key=lambda w: (sum(loads[w]), w))
                want.append((w, len(loads[w])))
                loads[w].append(n)
            assert list(zip(chunk[at : at + len(one)].tolist(), place[at : at + len(one)].tolist())) == want
            at += len(one)


COMMANDS = "sid string, seq long, type string, action_key string, instruction_text string, x double, y double, z double"


def plain_session(sid, commands, unlock):
    """Episodes and refusals of one session: an open episode is a record with its own flags, each command looks at those."""
    out, made, explored = [], 0, 0
    episode = None  # {"actions", "path", "stopped"} of an unfinished one
    here = (0.0, 0.0, 0.0)

    def save(kind, said):
        nonlocal made, episode
        made += 1
        out.append((sid, made, kind, said, len(episode["actions"]), len(episode["path"])))
        episode = None

    def refuse(why):
        out.append((sid, made, "rejected", why, -1, 0))

    for kind, action, said, at in commands:
        if kind == "move":
            here = at or here
            if episode is None:
                explored += 1
            elif not episode["stopped"]:
                episode["actions"].append(action)
                episode["path"].append(here)
        if kind == "start":
            if episode and episode["stopped"]:
                refuse("pending")
                continue
            if explored < unlock:
                refuse("locked")
                continue
            if episode:  # saved as it is, and the scene is set up anew
                save("auto", "(auto-saved)")
                explored = 0
            episode = {"actions": [], "path": [here], "stopped": False}
        if kind == "stop":
            if episode is None or episode["stopped"]:
                refuse("not recording")
            else:
                episode["stopped"] = True
        if kind == "submit":
            if episode is None or not episode["stopped"]:
                refuse("nothing to submit")
            elif explored < unlock:
                refuse("locked")
            elif not (said or "").strip():
                refuse("blank")
            else:
                save("submitted", said.strip())
        if kind in ("disconnect", "timeout", "init", "switch"):
            if episode:
                save("auto", "(auto-saved)")
            explored = 0 if kind in ("init", "switch") else explored
    return out


def test_sessions(spark):
    rng, rows, want = random.Random(8), [], []
    for s in range(120):
        commands = []
        for _ in range(rng.randrange(1, 60)):
            kind = rng.choice(("move", "move", "move", "move", "start", "stop", "submit", "disconnect", "init", "switch", "timeout", "unknown") if rng.random() < 0.4 else ("move", "start", "stop", "submit", "submit"))
            commands.append((kind, "turn_left", rng.choice((" go ", "", None)), (rng.random(), 0.0, 1.0)))
        want += plain_session(f"s{s}", [c for c in commands if c[0] != "unknown"], 4)
        rows += [(f"s{s}", at, kind, action, said, *place) for at, (kind, action, said, place) in enumerate(commands)]
    df = spark.createDataFrame(rows, "sid string, seq long, type string, action_key string, instruction_text string, x double, y double, z double")
    df = df.union(df.where("seq % 7 = 0"))  # commands that are sent twice count once
    got = [(r["sid"], r["local_no"], r["kind"], r["instruction"], len(r["actions"]) - 1, r["n_positions"]) for r in sessions.replay_sessions(df.orderBy(F.rand(1)), unlock=4).collect()]
    assert sorted(got) == sorted(want) and {g[2] for g in got} == {"auto", "rejected", "submitted"}
    assert {g[3] for g in got if g[2] == "rejected"} == {"pending", "locked", "not recording", "nothing to submit", "blank"}


def test_an_episode_in_waiting_is_kept(spark):
    """Starting while an episode is pending is refused; recording anew saves the old one, even without moves, and locks."""
    one = lambda *kinds: [(r["kind"], r["instruction"], len(r["path"] or [])) for r in sessions.replay_sessions(spark.createDataFrame([("a", i, k, "turn_left", "go", float(i), 0.0, None if i == 2 else 0.0) for i, k in enumerate(kinds)], COMMANDS), unlock=1).collect()]
    assert one("move", "start", "move", "stop", "start", "submit") == [("rejected", "pending", 0), ("submitted", "go", 2)]
    assert one("move", "start", "start", "stop", "submit", "start", "init", "move", "start", "disconnect") == [("auto", "(auto-saved)", 1), ("rejected", "locked", 0), ("rejected", "pending", 0), ("auto", "(auto-saved)", 1), ("auto", "(auto-saved)", 1)]


@tables
def test_session_machine(spark):
    """The query's episodes from the events themselves."""
    commands = spaces.session_commands(spark.read.parquet(f"{FOLDER}/events.parquet")).orderBy("seq").collect()
    by_session = {}
    for c in commands:
        by_session.setdefault(c["sid"], []).append((c["type"], c["action_key"], c["instruction_text"], (c["x"], c["y"], c["z"])))
    episodes = sorted((e for sid, cs in by_session.items() for e in plain_session(sid, cs, 3) if e[2] != "rejected"), key=lambda e: e[:2])
    want = [(i, *e) for i, e in enumerate(episodes, 1)]
    got = [(r["episode_id"], r["sid"], r["local_no"], r["kind"], r["instruction"], r["actions"].count(","), r["n_positions"]) for r in plans.QUERIES["session_machine"](spark, FOLDER).collect()]
    assert sorted(got) == want and want


class Handle:
    """State and timers of one key; counts what is written."""

    def __init__(self):
        self.timers, self.written = [], 0

    def getValueState(self, name, schema, ttl=None):  # noqa: N802
        return Value(self)

    def getListState(self, name, schema, ttl=None):  # noqa: N802
        return Listed(self)

    def getMapState(self, name, key, value):  # noqa: N802
        return Mapped(self)

    def listTimers(self):  # noqa: N802
        return list(self.timers)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


class Value:
    def __init__(self, handle):
        self.handle, self.body = handle, None

    def exists(self):
        return self.body is not None

    def get(self):
        return self.body

    def update(self, body):
        self.handle.written += len(repr(body))
        self.body = body


class Listed(Value):
    def get(self):
        return iter(self.body or [])

    def put(self, rows):
        self.update(list(rows))

    def appendList(self, rows):  # noqa: N802
        self.handle.written += len(repr(rows))
        self.body = [*(self.body or []), *rows]

    def clear(self):
        self.body = None


class Mapped:
    def __init__(self, handle):
        self.handle, self.rows = handle, {}

    def iterator(self):
        return iter(list(self.rows.items()))

    def keys(self):
        return iter(list(self.rows))

    def values(self):
        return iter(list(self.rows.values()))

    def containsKey(self, key):  # noqa: N802
        return key in self.rows

    def updateValue(self, key, value):  # noqa: N802
        self.handle.written += len(repr((key, value)))
        self.rows[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.rows[key]


class Now:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now


def batch(*commands, first=0, ms=None):
    rows = [{"sid": "a", "seq": first + i, "type": k, "action_key": None, "instruction_text": "go", "x": None, "y": None, "z": None, "ms": (ms or 0) + 10 * (first + i)} for i, k in enumerate(commands)]
    return iter([pd.DataFrame(rows)])


def test_idle_sessions_are_saved():
    """Each batch moves the timer; when it expires, what was recorded is saved once."""
    processor, handle = sessions.SessionProcessor(1, 500), Handle()
    processor.init(handle)
    assert all(f.empty for f in processor.handleInputRows(("a",), batch("move", "start", "move"), Now(1000))) and handle.timers == [1500]
    assert all(f.empty for f in processor.handleInputRows(("a",), batch("move"), Now(1400))) and handle.timers == [1900]
    saved = pd.concat(processor.handleExpiredTimer(("a",), Now(1900), None))
    assert saved[["kind", "local_no", "instruction"]].values.tolist() == [["auto", 1, "(auto-saved)"]] and list(saved["actions"][0]) == ["move_forward", "move_forward", "stop"]
    assert all(f.empty for f in processor.handleExpiredTimer(("a",), Now(2500), None))
    assert pd.concat(processor.handleInputRows(("a",), batch("submit"), Now(2600)))["kind"].tolist() == ["rejected"]


def test_state_grows_with_the_commands():
    """A long recording in many batches writes each move once and a few numbers a batch."""
    written = []
    for n in (100, 200, 400):
        processor, handle = sessions.SessionProcessor(0), Handle()
        processor.init(handle)
        for k in range(n):
            assert all(f.empty for f in processor.handleInputRows(("a",), batch("move" if k else "start", first=k), Now(0)))
        written.append(handle.written)
        done = pd.concat(processor.handleInputRows(("a",), batch("stop", "submit", first=n), Now(0)))
        assert done["n_positions"].tolist() == [n] and len(done["path"][0]) == n
    assert written[2] < 2.2 * written[1] < 4.8 * written[0]


def test_commands_wait_for_the_watermark():
    """By event time: released by seq as the watermark passes; timers for what waits, then for idle sessions; late ones are refused."""
    processor, handle = sessions.SessionProcessor(1, 500, by_event_time=True), Handle()
    processor.init(handle)
    run = lambda rows, now: [f for f in processor.handleInputRows(("a",), rows, Now(now)) if not f.empty]
    assert not run(batch("start", "move", first=2), 5) and handle.timers == [20]
    assert not run(batch("move", "move", first=0), 10) and handle.timers == [20]
    assert not run(batch("stop", first=4), 15) and handle.timers == [20] and len(processor.waiting.rows) == 3
    assert all(f.empty for f in processor.handleExpiredTimer(("a",), Now(31), None)) and handle.timers == [40]
    assert run(batch("submit", first=1), 31)[0]["instruction"].tolist() == ["late"]
    assert all(f.empty for f in processor.handleExpiredTimer(("a",), Now(45), None)) and handle.timers == [540]
    saved = pd.concat(processor.handleExpiredTimer(("a",), Now(541), None))
    assert saved[["kind", "n_positions"]].values.tolist() == [["auto", 2]] and handle.timers == []


def test_shuffled_stream_agrees_with_replay(spark, tmp_path):
    """Commands dealt over batches in any order within the delay give what a replay by seq gives."""
    rng, rows = random.Random(12), []
    for sid in range(6):
        kinds = ["move"] * 3 + [rng.choice(("move", "move", "move", "start", "stop", "submit", "init", "disconnect")) for _ in range(60)]
        rows += [(f"s{sid}", k, kind, "turn_left", "go", float(k), 0.0, 0.0, f"2024-01-01 00:{k // 6:02d}:{k % 6 * 10:02d}") for k, kind in enumerate(kinds)]
    df = spark.createDataFrame(rows, COMMANDS + ", t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    shuffled = sorted(df.collect(), key=lambda r: r["seq"] + rng.uniform(0, 20))  # up to 200 s late
    for at in range(0, len(shuffled), 90):
        spark.createDataFrame(shuffled[at : at + 90], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for hour in (2, 3):
        spark.createDataFrame([("end", hour, "move", None, None, None, None, None)], COMMANDS).withColumn("ts", F.to_timestamp(F.lit(f"2024-01-01 {hour:02d}:00:00"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = sessions.session_episodes(stream, unlock=3, event_time="ts", delay="5 minutes")
    query = out.writeStream.format("memory").queryName("shuffled").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got, want = ([tuple(map(str, r)) for r in x.collect()] for x in (spark.table("shuffled"), sessions.replay_sessions(df, unlock=3)))
    assert sorted(got) == sorted(want) and len(want) > 60 and "late" not in {g[3] for g in got}


def test_numbers_survive_a_stop(spark, tmp_path):
    """The stream dies after a batch's rows were written, and once after its ledger line; numbers stay gapless and equal."""
    rows = [(f"s{b}{k}", i, kind, None, "go", None, None, None) for b in range(4) for k in range(3) for i, kind in enumerate(("move", "start", "move", "stop", "submit"))]
    for b in range(4):
        spark.createDataFrame(rows[15 * b : 15 * (b + 1)], COMMANDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(name, fail=None):
        sink = sessions.NumberingSink(str(tmp_path / name), first=5)

        def numbered(df, batch_id):
            if fail == (batch_id, "line"):
                sink._line = lambda spark, b: None if b == batch_id else sessions.NumberingSink._line(sink, spark, b)
                df.sparkSession.createDataFrame([(5 + 3 * batch_id, 3)], "first long, rows long").write.json(f"{sink.path}/ledger/batch={batch_id}")
                raise RuntimeError("stopped")
            sink(df, batch_id)
            if fail == (batch_id, "rows"):
                raise RuntimeError("stopped")

        stream = spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = sessions.session_episodes(stream, unlock=1).writeStream.foreachBatch(numbered).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
        try:
            query.processAllAvailable()
        except Exception:
            assert fail
        query.stop()
        return sorted((r["episode_id"], r["sid"]) for r in sink.episodes(spark).collect()) if fail is None else None

    want = run("whole")
    assert [n for n, _ in want] == list(range(5, 17))
    for fail in ((1, "rows"), (1, "rows"), (2, "line"), (3, "rows")):
        run("stopped", fail)
    assert run("stopped") == want
    with pytest.raises(RuntimeError, match="no line for batch 8"):
        sessions.NumberingSink(str(tmp_path / "other"))(sessions.replay_sessions(spark.createDataFrame([], COMMANDS)), 9)


def test_late_rows_are_left_out(spark, tmp_path):
    """A row later than the watermark allows does not reopen its window."""
    schema = "event_id long, ts timestamp_ntz, kind string"

    def put(name, *times):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "event_id long, t string")
        rows.select("event_id", F.to_timestamp_ntz("t").alias("ts"), F.lit("k").alias("kind")).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    put("a", "2024-01-01 00:05:00", "2024-01-01 02:00:00")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    counts = windows.tumbling_counts(windows.with_event_time(stream, delay="10 minutes"), ["kind"], "10 minutes")
    query = counts.writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    put("b", "2024-01-01 00:06:00", "2024-01-01 01:55:00", "2024-01-01 04:00:00")
    query.processAllAvailable()
    put("c", "2024-01-01 04:01:00")
    query.processAllAvailable()
    query.stop()
    got = {r["start"].strftime("%H:%M"): r["n"] for r in spark.table("late").collect()}
    assert got == {"00:00": 1, "01:50": 1, "02:00": 1}


def test_streamed_lists(spark, tmp_path):
    """Any spacing, strings with braces and quotes, nested objects, other keys before the list, split anywhere."""
    rng = random.Random(4)
    rows = [{"id": i, "instructions": [rng.choice(('a } "b" {', "[x]", "back\\slash\\", "plain", "é }"))], "deep": {"a": [{"b": i}]}} for i in range(400)]
    forms = {"a": json.dumps(rows[:100]), "b": json.dumps({"x": [1, {"id": -1}], "y": {"records": [{"id": -2}]}, "records": rows[100:200], "z": [{"id": -3}]}, indent=3), "c": json.dumps({"episodes": rows[200:300]}, ensure_ascii=False)}
    forms |= {"d": json.dumps(rows[300:])[:-40], "e": "[]", "f": "", "g": "{}"}
    for name, body in forms.items():
        (tmp_path / f"{name}.json").write_text(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    got = sorted((r["id"], r["instructions"][0]) for r in records.read_array(spark, str(tmp_path), "id long, instructions array<string>").collect())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(r["id"], r["instructions"][0]) for r in rows[:399]]
    body = forms["b"]
    for size in (1, 7, 1000):
        parser, found = records.ArrayParser(), []
        for at in range(0, len(body), size):
            found += parser.feed(body[at : at + size])
        assert [json.loads(f) for f in found] == rows[100:200] and parser.text == ""


def test_many_boxes_of_one_scene(spark):
    """Boxes of very unlike sizes, on and beside cell borders."""
    rng = random.Random(6)
    boxes = []
    for i in range(150):
        low = [round(rng.uniform(-50, 50), 1) for _ in range(3)]
        side = rng.choice((0.1, 0.6, 1.0, 4.0, 30.0, 200.0))
        boxes.append(("s", i, i % 5, [float(x) for x in low], [x + side for x in low]))
    points = [(i, "s", float(rng.randrange(-60, 60)), float(rng.randrange(-60, 60)), float(rng.randrange(-60, 60))) for i in range(300)]
    b = spark.createDataFrame(boxes, "scene string, region int, level int, low array<double>, high array<double>")
    p = spark.createDataFrame(points, "p int, scene string, x double, y double, z double")
    want = {}
    for i, _, *at in points:
        held = [((h[0] - lo[0]) * (h[1] - lo[1]) * (h[2] - lo[2]), r, lv) for _, r, lv, lo, h in boxes if all(x >= a - m and x <= c + m for x, a, c, m in zip(at, lo, h, (0.2, 0.5, 0.2)))]
        if held:
            want[i] = min(held)[2]
    assert {r["p"]: r["level"] for r in levels.smallest_box(p, b, "scene", "p").collect()} == want and len(want) > 100
    assert levels.smallest_box(p, b.limit(0), "scene", "p").count() == 0


@pytest.mark.parametrize("sent", [levels.SENT_BOXES, 0])
def test_boxes_in_one_place(spark, monkeypatch, sent):
    """Copies of boxes are met once, and pairs of points and boxes are not sorted, whether boxes are sent or shuffled."""
    monkeypatch.setattr(levels, "SENT_BOXES", sent)
    places = [([0.0, 0.0, 0.0], [2.0, 2.0, 2.0]), ([1.0, 0.0, 0.0], [3.0, 2.0, 2.0]), ([0.0, 0.0, 0.0], [4.0, 4.0, 4.0])]
    boxes = [("s", 900 - i, i, *places[i % 3]) for i in range(900)]
    b = spark.createDataFrame(boxes, "scene string, region int, level int, low array<double>, high array<double>")
    p = spark.createDataFrame([(i, "s", i / 4, 1.0, 1.0) for i in range(20)], "p int, scene string, x double, y double, z double")
    found = levels.smallest_box(p, b, "scene", "p")
    want = {}
    for i in range(20):
        held = [((hi[0] - lo[0]) ** 3, r, lv) for _, r, lv, lo, hi in boxes if lo[0] - 0.2 <= i / 4 <= hi[0] + 0.2]
        if held:
            want[i] = min(held)[1:]
    assert {r["p"]: (r["region"], r["level"]) for r in found.collect()} == want and len(want) == 17
    assert "SortAggregate" not in found._jdf.queryExecution().toString()


def test_levels_of_points(spark):
    """By box, else by height, else neither; points move for the boxes alone and no pairs are sorted."""
    b = spark.createDataFrame([("s", i, i % 2, [0.0, 5.0 * (i % 2), 0.0], [2.0, 5.0 * (i % 2) + 2, 2.0]) for i in range(300)], "scene string, region int, level int, low array<double>, high array<double>")
    at = [(1, "s", 1.0, 1.0, 1.0), (2, "s", 1.0, 6.0, 1.0), (3, "s", 9.0, 4.6, 1.0), (4, "s", 9.0, -8.0, 1.0), (5, "t", 1.0, 1.0, 1.0), (6, None, 1.0, 1.0, 1.0)]
    p = spark.createDataFrame(at, "p int, scene string, x double, y double, z double")
    want = {1: (0, "box"), 2: (1, "box"), 3: (1, "height"), 4: (0, "height"), 5: (None, None), 6: (None, None)}
    for limits in ({}, {"array_rows": 1}):
        found = levels.level_of_points(p, b, levels.level_floors(b, "scene"), "scene", "p", **limits)
        assert found.columns == ["p", "scene", "x", "y", "z", "level", "found"]
        assert {r["p"]: (r["level"], r["found"]) for r in found.collect()} == want
        if not limits:
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("LeftOuter") == 2 and "SortAggregate" not in found._jdf.queryExecution().toString()
