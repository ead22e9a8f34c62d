"""Annotation sessions: a keyed state machine over a stream of commands.

idle -> recording -> pending -> idle. Moves are familiarisation until enough
of them unlock recording; while recording they make up the episode. Stopping
fixes the goal, submitting emits the episode. Disconnecting, switching the
scene, recording anew or a timeout emits what was recorded as auto-saved, even
if it has no move yet. Starting while an episode is pending is refused, and
recording anew begins a new familiarisation, so that the next episode can't be
submitted or restarted before the scene is initialised and explored again.

``apply`` drives the streaming operator (per key and micro-batch) and the
batch replay (per key), so both must agree. What an open episode has gathered
is a list that only grows; the state of a session but for that is a few
numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..folders import written
from ..shipping import ship

GOAL_RADIUS = 0.2
AUTO_SAVED = "(auto-saved)"
FIELDS = ("type", "action_key", "instruction_text", "x", "y", "z")
OUTPUT = (
    "sid string, local_no int, kind string, instruction string, actions array<string>, n_positions int, goal array<double>, "
    "radius double, distance double, distance_kind string, path array<array<double>>"
)
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
_HEAD = "phase string, steps int, local_no int, start array<double>, here array<double>, last_seq long, last_ms long"


@dataclass
class Session:
    phase: str = "idle"
    steps: int = 0
    local_no: int = 0
    start: tuple[float, ...] = (0.0, 0.0, 0.0)
    here: tuple[float, ...] = (0.0, 0.0, 0.0)
    last_seq: int | None = None
    last_ms: int | None = None


class Trail:
    """(action, x, y, z) of each move of the open episode. ``before`` reads what earlier batches have stored."""

    def __init__(self, before: Callable[[], Iterable[tuple]] = tuple):
        self.before, self.new, self.wiped = before, [], False

    def add(self, action: str, at: tuple[float, ...]) -> None:
        self.new.append((action, *at))

    def moves(self) -> list[tuple]:
        return ([] if self.wiped else [tuple(m) for m in self.before()]) + self.new

    def wipe(self) -> None:
        self.new, self.wiped = [], True


def _episode(s: Session, trail: Trail, sid: str, kind: str, instruction: str) -> tuple:
    """The finished episode; its distance is the straight line from start to goal."""
    moves = trail.moves()
    path = [list(s.start), *(list(m[1:]) for m in moves)]
    s.local_no += 1
    return (sid, s.local_no, kind, instruction, [*(m[0] for m in moves), "stop"], len(path), path[-1], GOAL_RADIUS, math.dist(path[0], path[-1]), "euclidean", path)


def apply(s: Session, trail: Trail, sid: str, unlock: int, kind: str | None, action: str | None, text: str | None, *at: float | None) -> Iterator[tuple]:
    """Apply one command; yields episodes and rejections."""
    refused = lambda why: (sid, s.local_no, "rejected", why, [], 0, None, None, None, None, None)
    if kind == "move":
        if not any(v is None or v != v for v in at):
            s.here = tuple(at)
        if s.phase == "idle":
            s.steps += 1
        elif s.phase == "recording":
            trail.add(action or "move_forward", s.here)
    elif kind == "start":
        if s.phase == "pending":
            yield refused("pending")
        elif s.steps < unlock:
            yield refused("locked")
        else:
            if s.phase == "recording":
                yield _episode(s, trail, sid, "auto", AUTO_SAVED)
                s.steps = 0
            trail.wipe()
            s.phase, s.start = "recording", s.here
    elif kind == "stop":
        if s.phase == "recording":
            s.phase = "pending"
        else:
            yield refused("not recording")
    elif kind == "submit":
        said = (text or "").strip()
        if s.phase != "pending":
            yield refused("nothing to submit")
        elif s.steps < unlock:
            yield refused("locked")
        elif not said:
            yield refused("blank")
        else:
            yield _episode(s, trail, sid, "submitted", said)
            trail.wipe()
            s.phase = "idle"
    elif kind in ("disconnect", "timeout", "init", "switch"):
        if s.phase != "idle":
            yield _episode(s, trail, sid, "auto", AUTO_SAVED)
            trail.wipe()
        s.phase = "idle"
        if kind in ("init", "switch"):
            s.steps = 0


def _frame(rows: Iterable[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(list(rows), columns=_NAMES)
    return out.astype({"local_no": "int32", "n_positions": "int32", "radius": "float64", "distance": "float64"})


def _plain(value):
    """A cell of a data frame, None if it is missing."""
    return None if value is None or value != value else value


class SessionProcessor(StatefulProcessor):
    """State of a session: a few numbers, the moves of the open episode and, with event times, commands that wait for their turn.

    Without event times a batch's commands are applied at once, by ``seq``.
    With event times a command waits until the watermark has passed it, so
    commands that come in later batches than their successors are still
    applied by ``seq``. One that comes after a successor was applied is
    rejected as late.
    """

    def __init__(self, unlock: int, idle_ms: int | None = None, by_event_time: bool = False, ttl_ms: int | None = None):
        self.unlock, self.idle_ms, self.by_event_time, self.ttl_ms = unlock, idle_ms, by_event_time, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD, self.ttl_ms)
        self.trail = handle.getListState("trail", "action string, x double, y double, z double", self.ttl_ms)
        if self.by_event_time:
            self.waiting = handle.getMapState("waiting", "seq long", "ms long, type string, action_key string, instruction_text string, x double, y double, z double")

    def _open(self) -> tuple[Session, Trail]:
        stored = self.head.get() if self.head.exists() else None
        s = Session(*stored[:3], tuple(stored[3]), tuple(stored[4]), *stored[5:]) if stored else Session()
        return s, Trail(self.trail.get)

    def _close(self, s: Session, trail: Trail) -> None:
        self.head.update((s.phase, s.steps, s.local_no, list(s.start), list(s.here), s.last_seq, s.last_ms))
        if trail.wiped:
            self.trail.clear()
        if trail.new:
            (self.trail.put if trail.wiped else self.trail.appendList)(trail.new)

    def _release(self, s: Session, trail: Trail, sid: str, watermark: int) -> Iterator[tuple]:
        """Apply the waiting commands that the watermark has passed, by ``seq``, up to the first that it hasn't."""
        for (seq,), (ms, *command) in sorted(((tuple(k), tuple(v)) for k, v in self.waiting.iterator()), key=lambda x: x[0]):
            if ms > watermark:
                break
            self.waiting.removeKey((seq,))
            yield from apply(s, trail, sid, self.unlock, *command)
            s.last_seq, s.last_ms = seq, max(ms, s.last_ms or ms)

    def _set_timers(self, s: Session, now: int) -> None:
        """Of waiting commands: when the first is due. Else when the session has been idle for too long."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = []
        if self.by_event_time:
            due = [v[0] for v in self.waiting.values()]
            now = s.last_ms or now
        if due:
            self.handle.registerTimer(min(due))
        elif self.idle_ms is not None and s.phase != "idle":
            self.handle.registerTimer(now + self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (s, trail), sid, out = self._open(), key[0], []
        commands = pd.concat(list(rows)).sort_values("seq", kind="stable").drop_duplicates("seq")
        columns = [[_plain(v) for v in commands[c].tolist()] for c in FIELDS]
        if self.by_event_time:
            for seq, ms, *command in zip(commands["seq"].tolist(), commands["ms"].tolist(), *columns):
                if s.last_seq is not None and seq <= s.last_seq:
                    out.append((sid, s.local_no, "rejected", "late", [], 0, None, None, None, None, None))
                elif not self.waiting.containsKey((seq,)):
                    self.waiting.updateValue((seq,), (ms, *command))
            out += self._release(s, trail, sid, timerValues.getCurrentWatermarkInMs())
        else:
            for command in zip(*columns):
                out += apply(s, trail, sid, self.unlock, *command)
        self._close(s, trail)
        if self.by_event_time or self.idle_ms is not None:
            self._set_timers(s, timerValues.getCurrentProcessingTimeInMs())
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (s, trail), sid, out = self._open(), key[0], []
        if self.by_event_time:
            watermark = timerValues.getCurrentWatermarkInMs()
            out += self._release(s, trail, sid, watermark)
            idle = self.idle_ms is not None and s.last_ms is not None and s.last_ms + self.idle_ms <= watermark and not list(self.waiting.keys())
        else:
            idle = True
        if idle:
            out += apply(s, trail, sid, self.unlock, "timeout", None, None)
        self._close(s, trail)
        if self.by_event_time:
            self._set_timers(s, 0)
        yield _frame(out)

    def close(self) -> None:
        pass


def session_episodes(commands: DataFrame, unlock: int = 200, idle_ms: int | None = None, *, event_time: str | None = None, delay: str = "10 minutes", ttl_ms: int | None = None) -> DataFrame:
    """Streaming operator; needs the RocksDB state store.

    Commands of a session are applied by ``seq`` within a batch; with
    ``event_time`` (a timestamp column) also across batches, once the
    watermark, ``delay`` behind the latest time, has passed them. Spark leaves
    out commands older than the watermark, and those without ``seq`` have no
    place in the order. ``idle_ms`` saves open episodes of idle sessions, by event
    time if there is one, else by the clock. ``ttl_ms``, for sessions by the
    clock alone, forgets a session that has had no command for so long.
    A repeated ``seq`` of a session is the same command.
    """
    ship(commands.sparkSession)
    if event_time is None:
        mode = "None" if idle_ms is None and ttl_ms is None else "ProcessingTime"
        rows = commands.select("sid", "seq", *FIELDS)
    elif ttl_ms is not None:
        raise ValueError("state expires by the clock, not by event time")
    else:
        mode = "EventTime"
        rows = commands.withWatermark(event_time, delay).where(F.col("seq").isNotNull()).select("sid", "seq", *FIELDS, event_time, F.unix_millis(event_time).alias("ms"))
    processor = SessionProcessor(unlock, idle_ms, event_time is not None, ttl_ms)
    return rows.groupBy("sid").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUTPUT, outputMode="Append", timeMode=mode)


def replay_sessions(commands: DataFrame, unlock: int = 200) -> DataFrame:
    """Batch replay by ``seq``; of commands that repeat a session's ``seq`` the first counts.

    Sessions lie sorted in their partitions and are read once; a task holds
    the open episode of one session, never a whole session.
    """
    ship(commands.sparkSession)
    rows = commands.select("sid", "seq", *FIELDS).repartition("sid").sortWithinPartitions("sid", "seq", *FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_sid, seen, s, trail, first = None, None, Session(), Trail(), True
        kinds = pa.schema([(n, _ARROW[n]) for n in _NAMES])
        for batch in batches:
            out = []
            for sid, seq, *command in zip(*(c.to_pylist() for c in batch.columns)):
                if first or sid != open_sid:
                    open_sid, seen, s, trail, first = sid, None, Session(), Trail(), False
                elif seq is not None and seq == seen:
                    continue
                seen = seq
                out += apply(s, trail, sid, unlock, *command)
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in out], schema=kinds)

    return rows.mapInArrow(run, OUTPUT)


_ARROW = {
    "sid": pa.string(), "local_no": pa.int32(), "kind": pa.string(), "instruction": pa.string(), "actions": pa.list_(pa.string()), "n_positions": pa.int32(), "goal": pa.list_(pa.float64()),
    "radius": pa.float64(), "distance": pa.float64(), "distance_kind": pa.string(), "path": pa.list_(pa.list_(pa.float64())),
}


def number_episodes(episodes: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Global episode numbers, given at the sink in order of session and local number."""
    from ..operators.keys import allocate_ids, dense_ordinals

    kept = episodes.where(F.col("kind") != "rejected")
    if taken is None:
        return dense_ordinals(kept, ["sid", "local_no"], "episode_id", 1)
    return allocate_ids(kept, taken, "episode_id", ["sid", "local_no"])


class NumberingSink:
    """``foreachBatch`` sink that numbers a stream's episodes without gaps and survives a stop at any moment.

    A ledger keeps the first number and the number of rows of each batch; a
    batch's line is written before its rows. A batch that is run again, since
    the stream was stopped before it was committed, finds its line, takes the
    same numbers and overwrites its own folder.

    Lines are a small JSON folder per batch below ``path``/ledger, rows are
    Parquet below ``path``/episodes. Both must lie where all executors write.
    """

    def __init__(self, path: str, first: int = 1):
        self.path, self.first = path.rstrip("/"), first

    def _line(self, spark, batch: int) -> tuple[int, int] | None:
        """(first number, rows) of a batch; None if its line isn't whole."""
        from pyspark.errors import AnalysisException

        try:
            found = spark.read.schema("first long, rows long").json(f"{self.path}/ledger/batch={batch}").first()
        except AnalysisException:  # no such folder
            return None
        return (found["first"], found["rows"]) if found is not None and found["rows"] is not None else None

    def __call__(self, episodes: DataFrame, batch: int) -> None:
        from ..operators.keys import dense_ordinals

        spark = episodes.sparkSession
        kept = written(episodes.where(F.col("kind") != "rejected"), "batch-episodes")
        line = self._line(spark, batch)
        if line is None:
            before = self._line(spark, batch - 1) if batch else None
            if batch and before is None:
                raise RuntimeError(f"the ledger has no line for batch {batch - 1}; was the stream started with another checkpoint?")
            line = (sum(before) if before else self.first, kept.count())
            spark.createDataFrame([line], "first long, rows long").coalesce(1).write.mode("overwrite").json(f"{self.path}/ledger/batch={batch}")
        numbered = dense_ordinals(kept, ["sid", "local_no"], "episode_id", line[0])
        numbered.write.mode("overwrite").parquet(f"{self.path}/episodes/batch={batch}")

    def episodes(self, spark) -> DataFrame:
        """All numbered episodes so far, with the batch of each."""
        return spark.read.parquet(f"{self.path}/episodes")


def observation_epoch(step_column: Column, every: int = 32) -> Column:
    """Epoch of a growing history that is reset every so many steps."""
    return F.floor(step_column / every)
