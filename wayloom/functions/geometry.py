"""Functions over positions (arrays x, y, z with y up), boxes, rotations and grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def positions_equal(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Both null, or of equal length and within a tolerance everywhere. NaN equals nothing."""
    near = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) < tolerance), lambda ok: F.coalesce(ok, F.lit(False)))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((F.size(a) == F.size(b)) & near)


def goals_equal(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Arrays of (position, radius); a missing radius is 0."""
    radius = lambda g: F.coalesce(g["radius"], F.lit(0.0))
    same = F.forall(
        F.zip_with(a, b, lambda x, y: positions_equal(x["position"], y["position"], tolerance) & (F.abs(radius(x) - radius(y)) < tolerance)),
        lambda ok: F.coalesce(ok, F.lit(False)),
    )
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((F.size(a) == F.size(b)) & same)


def distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def path_length(path: Column) -> Column:
    """Length of a polyline given as an array of positions."""
    steps = F.zip_with(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))), distance)
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def height_diff(start: Column, goal: Column) -> Column:
    return F.get(goal, F.lit(1)) - F.get(start, F.lit(1))


def spl(success: Column, shortest: Column, actual: Column) -> Column:
    """Success weighted by path length; 0 without success or without any length."""
    return F.when(success > 0, F.coalesce(success * F.try_divide(shortest, F.greatest(actual, shortest)), F.lit(0.0))).otherwise(0.0)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def box(center: Column, size: Column) -> Column:
    half = lambda sign: F.zip_with(center, size, lambda c, s: c + sign * F.abs(s) / 2)
    return F.struct(half(-1).alias("low"), half(1).alias("high"))


def box_volume(low: Column, high: Column) -> Column:
    return F.aggregate(F.zip_with(low, high, lambda a, b: F.greatest(b - a, F.lit(0.0))), F.lit(1.0), lambda v, x: v * x)


def in_box(x: Column, y: Column, z: Column, low: Column, high: Column, across: float = 0.2, upright: float = 0.5) -> Column:
    """Point in a box widened by a tolerance, its bounds included."""
    slack = (across, upright, across)
    return F.lit(True) & (
        x.between(F.get(low, F.lit(0)) - slack[0], F.get(high, F.lit(0)) + slack[0])
        & y.between(F.get(low, F.lit(1)) - slack[1], F.get(high, F.lit(1)) + slack[1])
        & z.between(F.get(low, F.lit(2)) - slack[2], F.get(high, F.lit(2)) + slack[2])
    )


def direction(start_level: Column, end_level: Column, with_same: bool = True) -> Column:
    up_down = F.when(end_level > start_level, "up").otherwise("down")
    return F.when(start_level == end_level, "same").otherwise(up_down) if with_same else up_down


def rotation(stored: Column, convention: str) -> Column:
    """Stored four numbers as a struct w, x, y, z; the order they are stored in must be named."""
    order = {"wxyz": (0, 1, 2, 3), "xyzw": (3, 0, 1, 2)}[convention]
    return F.struct(*[F.get(stored, F.lit(i)).alias(n) for i, n in zip(order, "wxyz")])


def yaw_of(q: Column) -> Column:
    """Turn about the upright axis, in radians."""
    return 2 * F.atan2(q["y"], q["w"])


def of_yaw(yaw: Column) -> Column:
    zero = F.lit(0.0)
    return F.struct(F.cos(yaw / 2).alias("w"), zero.alias("x"), F.sin(yaw / 2).alias("y"), zero.alias("z"))


def focal_length(width: Column, hfov_degrees: Column) -> Column:
    return width / (2 * F.tan(F.radians(hfov_degrees) / 2))


def rescale_intrinsics(focal: Column, width: Column, new_width: Column) -> Column:
    return focal * new_width / width


def clamp(value: Column, low: float | None = None, high: float | None = None) -> Column:
    out = value if low is None else F.greatest(value, F.lit(low))
    return out if high is None else F.least(out, F.lit(high))


def best_resolution(width: Column, height: Column, choices: list[tuple[int, int]]) -> Column:
    """Choice that keeps the most pixels of an image fitted into it, then wastes the fewest; the first of equals."""

    def rated(place: int, w: int, h: int) -> Column:
        scale = F.least(F.lit(w) / width, F.lit(h) / height)
        used = F.least(F.floor(width * scale) * F.floor(height * scale), width * height)
        return F.struct(used.alias("used"), (used - F.lit(w * h)).alias("spare"), F.lit(-place).alias("place"), F.lit(w).alias("width"), F.lit(h).alias("height"))

    best = F.array_max(F.array(*[rated(i, w, h) for i, (w, h) in enumerate(choices)]))
    return F.struct(best["width"].alias("width"), best["height"].alias("height"))


def patch_grid(width: Column, height: Column, patch: int) -> Column:
    return F.struct(F.floor(width / patch).alias("columns"), F.floor(height / patch).alias("rows"))


def padded_square(width: Column, height: Column) -> Column:
    """Side of the square an image is padded to, and its offsets in it."""
    side = F.greatest(width, height)
    return F.struct(side.alias("side"), F.floor((side - width) / 2).alias("left"), F.floor((side - height) / 2).alias("top"))
