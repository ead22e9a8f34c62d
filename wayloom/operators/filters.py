"""Filters with their derived columns, over episode-like rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, sequences, text


def within_band(df: DataFrame, value: Column, low: float, high: float, default: float = 0.0) -> DataFrame:
    """Rows whose value (``default`` if null) lies between the bounds, both included."""
    return df.where(F.coalesce(value, F.lit(default)).between(low, high))


def with_height_diff(df: DataFrame, start: Column, goal: Column, least: float, name: str = "height_diff") -> DataFrame:
    """Rows that climb or descend enough, with the signed difference."""
    return df.withColumn(name, goal - start).where(F.abs(F.col(name)) >= least)


def with_spatial_phrase(df: DataFrame, column: str, name: str = "keyword") -> DataFrame:
    return df.withColumn(name, text.spatial_phrase(F.col(column))).where(F.col(name).isNotNull())


def language_matches(language: Column, prefixes: Sequence[str], case_sensitive: bool = True) -> Column:
    """Starts with one of the prefixes; none listed lets all pass, null included. A null language fails otherwise."""
    wanted = [p.strip() for p in prefixes if p.strip()]
    if not wanted:
        return F.lit(True)
    shown = language if case_sensitive else F.lower(language)
    hits = [F.startswith(shown, F.lit(p if case_sensitive else p.lower())) for p in wanted]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return F.coalesce(out, F.lit(False))


def length_ok(actions: Column, frames: Column, least: int = 4, most: int = 498) -> Column:
    return F.size(actions).between(least, most) & (F.size(actions) == frames)


def first_reason(reasons: dict[str, Column]) -> Column:
    """Name of the first condition that holds; null if none does."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(list(reasons.items())):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def precise_reason(actions: Column, segments: Column, instruction: Column, *, least_steps: int = 16, most_steps: int = 45, least_turns: int = 1) -> Column:
    """Why a precise-movement trajectory is not used: steps, then turns, then segments, then its text."""
    wanted = F.transform(segments, lambda s: F.coalesce(s["meters"], s["degrees"].cast("double")))
    return first_reason(
        {
            "steps": ~F.size(actions).between(least_steps, most_steps),
            "turns": sequences.turn_count(actions) < least_turns,
            "segments": F.size(segments) < 2,
            "instruction": ~text.numbers_match(text.numbers_in(instruction), wanted),
        }
    )


def annotation_reason(identifier: Column, instructions: Column, actions: Column, least_actions: int = 2) -> Column:
    return first_reason(
        {
            "missing_id": F.coalesce(identifier, F.lit("")) == "",
            "bad_instruction": text.instruction_of(instructions).isNull(),
            "too_short": F.coalesce(F.size(actions), F.lit(0)) < least_actions,
        }
    )


def answer_of(conversations: Column) -> Column:
    """Text of the second turn, empty if there is none."""
    return F.coalesce(F.get(conversations, F.lit(1))["value"], F.lit(""))


def mentions_stop(conversations: Column) -> Column:
    return F.contains(answer_of(conversations), F.lit("Stop"))


def all_stop(answer: Column, stops: int = 6) -> Column:
    """Every listed action is a stop. The cheap test for ``stops`` stops in a row comes first, as for raw lines."""
    listed = text.final_answer_parts(answer)
    return F.contains(answer, F.lit(", ".join(["Stop"] * stops))) & (F.size(listed) > 0) & F.forall(listed, lambda a: a == "Stop")


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.where(geometry.is_finite(F.col(c)))
    return df


def level_reason(start_level: Column, end_level: Column, total_levels: Column) -> Column:
    return first_reason({"no_level": start_level.isNull() | end_level.isNull(), "single_level": total_levels <= 1, "same_level": start_level == end_level})


def usable_qa(df: DataFrame, conversations: str = "conversations") -> DataFrame:
    """Question-answer rows with two turns and an answer; image marks leave the question."""
    turns = F.col(conversations)
    return df.where((F.size(turns) >= 2) & (F.trim(answer_of(turns)) != "")).withColumn("question", F.trim(F.replace(F.get(turns, F.lit(0))["value"], F.lit("<image>"), F.lit(""))))


def passthrough(df: DataFrame, identifier: str, original: str) -> DataFrame:
    return df.select(F.col(identifier).alias("id"), F.array(F.trim(F.col(original))).alias("instructions"))


#: Verbs of a manual episode.
MANUAL_VERBS = ("move_forward", "turn_left", "turn_right", "stop")


def manual_actions(verbs: Column) -> Column:
    """Verbs up to the first stop, as numbers with the sentinel in front."""
    at = F.array_position(verbs, "stop").cast("int")
    until = F.when(at > 0, F.slice(verbs, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(verbs)
    return F.concat(F.array(F.lit(-1)), F.transform(until, text.action_id))


def manual_reason(verbs: Column, frames: Column, instruction: Column) -> Column:
    actions = manual_actions(verbs)
    return first_reason(
        {
            "unknown_verb": ~F.forall(verbs, lambda v: v.isin(*MANUAL_VERBS)),
            "blank_instruction": F.coalesce(F.trim(instruction), F.lit("")) == "",
            "too_short": F.size(actions) < 2,
            "frames": F.size(actions) != frames,
        }
    )


def drop_internal(df: DataFrame, prefix: str = "_") -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def missing_files(df: DataFrame, path: str, listing: DataFrame) -> DataFrame:
    """Rows whose file isn't listed."""
    return df.join(listing.select(F.col("path").alias(path)).distinct(), path, "left_anti")
