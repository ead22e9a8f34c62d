"""Draws that need the standard library's generator: pandas functions.

A draw depends on its seed, episode and variant alone.
"""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def episode_random(episode: int, variant: int, seed: int) -> random.Random:
    digest = hashlib.blake2b(f"{seed}|{episode}|{variant}".encode(), digest_size=8).digest()
    return random.Random(int.from_bytes(digest, "big"))


def render_params(episode: Column, variant: Column, *, seed: int = 42, height: float = 1.25, height_jitter: float = 0.0, hfov: float = 90.0, hfov_jitter: float = 0.0, width: int = 640, pixels: int = 480, resolutions: tuple[int, ...] = ()) -> Column:
    """camera_height (at least 0.2), hfov (30 to 160), width, height of a variant; the base values without jitter."""

    @F.pandas_udf("camera_height double, hfov double, width int, height int")
    def draw(episodes: pd.Series, variants: pd.Series) -> pd.DataFrame:
        rows = []
        for e, v in zip(episodes, variants):
            rng = episode_random(int(e), int(v), seed)
            h = max(0.2, height + rng.uniform(-height_jitter, height_jitter)) if height_jitter > 0 else height
            f = max(30.0, min(160.0, hfov + rng.uniform(-hfov_jitter, hfov_jitter))) if hfov_jitter > 0 else hfov
            side = rng.choice(resolutions) if resolutions else None
            rows.append((float(h), float(f), int(side or width), int(side or pixels)))
        return pd.DataFrame(rows, columns=["camera_height", "hfov", "width", "height"])

    return draw(episode, variant)


def render_signature(params: Column) -> Column:
    return F.format_string("h%.4f_f%.4f_%dx%d", params["camera_height"], params["hfov"], params["width"], params["height"])


# Wording of precise-movement instructions, with weights of openings.
OPENINGS = {
    "From your current position,": (71, True), "First,": (32, False), "Starting from your current position,": (24, True), "From your current location,": (10, True),
    "From this position,": (8, True), "From your current spot,": (5, True), "From here,": (5, True),
}
FORWARD = (
    "go straight for {} meters", "go straight {} meters", "go forward {} meters", "go forward for {} meters", "walk {} meters forward", "walk forward {} meters",
    "move forward {} meters", "continue straight for {} meters", "continue for {} meters", "go {} meters", "proceed straight for {} meters", "head forward {} meters",
)
FORWARD_TAILS = (
    "and walk {} meters forward", "and go forward {} meters", "and go straight for {} meters", "and continue for {} meters", "and move forward {} meters", "and proceed {} meters",
)
HALF_TURNS = (
    "turn 180 degrees {spin}", "turn half a circle {spin}", "make a 180-degree {side} turn", "complete a full {spin} rotation", "rotate {spin} by 180 degrees",
)
TURNS = ("turn {side} {n} degrees", "turn {n} degrees {spin}", "make a {n}-degree {side} turn", "rotate {spin} by {n} degrees")
CLOSINGS = (", and stop.", ", and stop", ", then stop.", " before stopping.", ", and come to a stop.")
LINKS = ("then", "next", "after that", "and then")
FUSED_SHARE = 0.35


def precise_sentence(segments: list[tuple[str, float]], rng: random.Random) -> str:
    """Instruction for segments (type, meters or degrees). Every number of the segments appears in it."""
    if not segments:
        return "From your current position, stop."
    opening = rng.choices(list(OPENINGS), [w for w, _ in OPENINGS.values()])[0]
    lead = "first " if OPENINGS[opening][1] else ""
    layout = rng.choice(("semicolon", "period", "comma"))

    def turn(kind: str, n: float) -> str:
        side = kind.removeprefix("turn_")
        spin = {"left": "counter-clockwise", "right": "clockwise"}[side]
        return rng.choice(HALF_TURNS if n == 180 else TURNS).format(side=side, spin=spin, n=int(n))

    clauses, rest = [], list(segments)
    while rest:
        kind, n = rest.pop(0)
        if kind == "forward":
            clauses.append(rng.choice(FORWARD).format(f"{n:g}"))
            continue
        clause = turn(kind, n)
        if rest and rest[0][0] == "forward" and rng.random() < FUSED_SHARE:
            clause += " " + rng.choice(FORWARD_TAILS).format(f"{rest.pop(0)[1]:g}")
        clauses.append(clause)
    closing = rng.choice(CLOSINGS)
    if len(clauses) == 1:
        return f"{opening} {clauses[0]}{closing}"
    first, *middle, last = clauses
    if layout == "period":
        sentences = [f"{opening} {lead}{first}", *(f"{rng.choice(('Then', 'Next', 'After that'))}, {c}" for c in middle), f"Finally, {last}{closing}"]
        return ". ".join(sentences).rstrip(".") + "."
    linked = [lead + first, *(f"{rng.choice(LINKS)} {c}" for c in middle), f"finally {last}"]
    return f"{opening} {'; '.join(linked) if layout == 'semicolon' else ', '.join(linked)}{closing}"


def precise_instruction(episode: Column, segments: Column, seed: int = 42) -> Column:
    """``precise_sentence`` of an array of (type, meters, degrees), drawn per episode."""

    @F.pandas_udf("string")
    def build(episodes: pd.Series, kinds: pd.Series, amounts: pd.Series) -> pd.Series:
        return pd.Series(
            [precise_sentence(list(zip(k, map(float, a))), episode_random(int(e), 0, seed)) for e, k, a in zip(episodes, kinds, amounts)], dtype=object
        )

    amounts = F.transform(segments, lambda s: F.coalesce(s["meters"], s["degrees"].cast("double")))
    return build(episode, F.transform(segments, lambda s: s["type"]), amounts)
