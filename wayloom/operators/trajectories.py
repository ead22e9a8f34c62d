"""Trajectories as tables: one row per step, or arrays of actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences, text

FORWARD_METERS, TURN_DEGREES = 0.25, 30


def rle_segments(steps: DataFrame, key: str, order: Sequence[str], action: str, known: Sequence[int] | None = None) -> DataFrame:
    """Runs of equal actions per trajectory: key, segment (from 0), action, n. Unknown actions leave before runs form."""
    rows = steps if known is None else steps.where(F.col(action).isin(*known))
    ordered = Window.partitionBy(key).orderBy(*order)
    changes = F.coalesce((F.col(action) != F.lag(action).over(ordered)).cast("int"), F.lit(0))
    marked = rows.withColumn("__changes", changes).withColumn("segment", F.sum("__changes").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "segment", action).agg(F.count("*").alias("n"))


def measured(action: Column, n: Column, forward: float = FORWARD_METERS, turn: float = TURN_DEGREES) -> Column:
    """A run as a motion segment: type with meters or degrees."""
    kind = text.lookup({1: "forward", 2: "turn_left", 3: "turn_right"}, action)
    return F.struct(
        kind.alias("type"),
        F.when(kind == "forward", F.round(n * F.lit(forward), 2)).alias("meters"),
        F.when(kind != "forward", (n * F.lit(turn)).cast("int")).alias("degrees"),
    )


def segments_of(actions: Column, forward: float = FORWARD_METERS, turn: float = TURN_DEGREES) -> Column:
    """Motion segments of an action array, in one pass without a shuffle."""
    run_type = "array<struct<action:int,n:int>>"

    def add(runs: Column, a: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        same = F.coalesce(last["action"] == a, F.lit(False))
        grown = F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.struct(a.alias("action"), (last["n"] + 1).alias("n"))))
        fresh = F.concat(runs, F.array(F.struct(a.alias("action"), F.lit(1).alias("n"))))
        return F.when(same, grown).otherwise(fresh).cast(run_type)

    known = F.filter(actions, lambda a: a.isin(1, 2, 3))
    return F.transform(F.aggregate(known, F.array().cast(run_type), add), lambda r: measured(r["action"], r["n"], forward, turn))


def expand_segments(segments: Column, forward: float = FORWARD_METERS, turn: float = TURN_DEGREES) -> Column:
    """The actions that motion segments stand for."""
    ids = {"forward": 1, "turn_left": 2, "turn_right": 3}
    return F.flatten(
        F.transform(
            segments,
            lambda s: F.array_repeat(text.lookup(ids, s["type"]), F.round(F.coalesce(s["meters"] / F.lit(forward), s["degrees"] / F.lit(float(turn))), 0).cast("int")),
        )
    )


def explode_steps(df: DataFrame, actions: str = "actions", step: str = "step", action: str = "action") -> DataFrame:
    return df.select("*", F.posexplode(actions).alias(step, action))


def strided(steps: DataFrame, step: str = "step", every: int = 5, most: int = 12) -> DataFrame:
    """Every so many steps, at most ``most`` a trajectory."""
    return steps.where((F.col(step) % every == 0) & (F.col(step) < every * most))


def per_instruction(df: DataFrame, instructions: str = "instructions", actions: str = "actions") -> DataFrame:
    """One row per step and instruction of each trajectory."""
    return explode_steps(df, actions).select("*", F.posexplode(instructions).alias("instruction_no", "instruction"))


def with_variants(df: DataFrame, n: int, column: str = "variant") -> DataFrame:
    """Every row n times, with a variant number from 0: a cross join with a small range, without a join."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(column))


def regroup(steps: DataFrame, keys: Sequence[str], step: str, action: str, drop_last: bool = False) -> DataFrame:
    """Action arrays rebuilt from steps. Keys hold episode, variant and instruction number, so that variants stay apart."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(step, action))), lambda s: s[action])
    out = steps.groupBy(*keys).agg(ordered.alias("actions"))
    return out.withColumn("actions", F.slice("actions", F.lit(1), F.greatest(F.size("actions") - 1, F.lit(0)))) if drop_last else out


def training_rows(df: DataFrame, history: int = 8, future: int = 6) -> DataFrame:
    """One row per step of annotations (id, video, instructions, actions): history frames, future glyphs, conversation.

    The number of frames is the number of actions, whose first is the sentinel.
    """
    steps = df.withColumn("instruction", text.instruction_of(F.col("instructions"))).where(F.col("instruction").isNotNull() & (F.size("actions") >= 2))
    steps = steps.select("*", F.posexplode("actions").alias("step", "__action")).where(F.col("step") < F.size("actions") - 1)
    frames = sequences.history(F.col("step"), F.size("actions"), history)
    answer = text.ids_to_glyphs(sequences.future(F.col("actions"), F.col("step"), future))
    return steps.select(
        F.format_string("%s_step_%d", F.col("id"), F.col("step")).alias("id"),
        sequences.two_turns(text.future_prompt(F.col("instruction"), future), answer).alias("conversations"),
        F.transform(frames, lambda f: F.format_string("%s/rgb/%03d.jpg", F.col("video"), f)).alias("image"),
        "video",
        F.lit(history).alias("video_nframes"),
    )


def answers_to_actions(samples: DataFrame, id_column: str = "id") -> DataFrame:
    """Episodes rebuilt from per-step samples: the first action of each answer but the last step's."""
    parsed = samples.select(text.parse_step_id(F.col(id_column)).alias("p"), text.first_action(F.get("conversations", F.lit(1))["value"]).alias("action"))
    return regroup(parsed.select("p.episode", "p.step", "action").where("episode IS NOT NULL"), ["episode"], "step", "action", drop_last=True)


def move_frames_to_rgb(path: Column) -> Column:
    """``…/NNN.jpg`` as ``…/rgb/NNN+1.jpg``."""
    number = F.regexp_extract(path, r"(\d+)\.jpg$", 1).try_cast("int")
    return F.concat(F.regexp_replace(path, r"\d+\.jpg$", "rgb/"), F.format_string("%03d.jpg", number + 1))


def step_bundles(df: DataFrame, key: str = "traj_name", images: str = "images", actions: str = "actions", most_images: int = 8, ahead: int = 6) -> DataFrame:
    """Step samples of trajectories: valid steps are those with an image and an action."""
    verbs = {0: "Stop", 1: "Move Forward", 2: "Turn Left", 3: "Turn Right"}
    valid = F.least(F.size(images), F.size(actions))
    steps = df.withColumn("step", F.explode(sequences.indices(valid)))
    places = sequences.spread_rounded(F.col("step"), most_images)
    answer = F.transform(sequences.future(F.col(actions), F.col("step") - 1, ahead), lambda a: F.coalesce(text.lookup(verbs, a), F.lit("Stop")))
    return steps.select(
        key,
        "step",
        F.transform(places, lambda i: F.get(F.col(images), i)).alias("image"),
        F.concat(F.lit(f"{text.FINAL_ANSWER} "), F.array_join(answer, ", ")).alias("answer"),
    )


def merged_samples(bundles: DataFrame, index: str = "traj_idx", name: str = "traj_name", step: str = "step", most: int | None = None) -> DataFrame:
    """All shards in one total order, with consecutive sample numbers and ids."""
    from .keys import dense_ordinals

    out = dense_ordinals(bundles, [index, name, step], "sample_no")
    out = out if most is None else out.where(F.col("sample_no") < most)
    return out.withColumn("sample_id", F.format_string("sample_%07d_%s_%04d", "sample_no", name, step))


def reconstruction(samples: DataFrame, prompt: str = "Describe the instruction that this trajectory follows.") -> DataFrame:
    """All-stop samples turned around: the trajectory asks, the instruction answers."""
    from .filters import all_stop, answer_of

    turns = F.col("conversations")
    instruction = text.prompt_instruction(F.get(turns, F.lit(0))["value"])
    rows = samples.where(all_stop(answer_of(turns)) & instruction.isNotNull())
    return rows.select(
        F.concat("id", F.lit("_reconstruct")).alias("id"),
        sequences.two_turns(F.concat(text.image_tokens(F.size("image")), F.lit(prompt)), instruction).alias("conversations"),
        "image",
    )
