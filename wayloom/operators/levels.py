"""Levels of buildings: containment, as-of and nearest joins, gap clustering.

Levels and boxes are tables per scene; the scene is always part of the join
key. Points look levels up in sorted arrays (see ``asof``) and boxes in a grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..folders import written
from ..functions import geometry
from .asof import asof, nearest
from .ordering import dense_ordinals

#: Boxes in different places, at most, that are sent to every task, in up to four cells each.
SENT_BOXES = 75_000


def smallest_box(points: DataFrame, boxes: DataFrame, scene: str, point_id: str, across: float = 0.2, upright: float = 0.5) -> DataFrame:
    """(point, level) of the smallest box that holds each point; of equal volumes the first region.

    Points have x, y, z; boxes have region, level, low, high. Points in no box are left out.

    Boxes lie in cells of a grid as wide as they are (rounded up to a power of
    two), at most two each way. Points look into their cell of each grid in
    use, so a point meets the boxes around it, not all of its scene. Boxes are
    numbered by volume and region first: of boxes in the same place only the
    lowest number can win and is kept, and a point keeps the lowest number it
    meets, so no task holds or sorts the pairs that meet.
    """
    b = boxes.select(scene, "region", "level", "low", "high", geometry.box_volume(F.col("low"), F.col("high")).alias("volume"))
    b = dense_ordinals(b, ["volume", "region"], "__rank").groupBy(scene, "low", "high")
    b = written(b.agg(F.min_by("level", "__rank").alias("level"), F.min_by("region", "__rank").alias("region"), F.min("__rank").alias("__rank")), "boxes")
    low, high = (lambda i: F.get("low", F.lit(i)) - across), (lambda i: F.get("high", F.lit(i)) + across)
    cells = b.select(scene, "low", "high", "__rank", F.ceil(F.log2(F.greatest(high(0) - low(0), high(2) - low(2), F.lit(1e-9)))).cast("int").alias("__grid"))
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("__grid"))).cast("long")
    both = lambda i: F.sequence(cell(low(i)), cell(high(i)))
    grids = boxes.sparkSession.createDataFrame([(g,) for g in cells.agg(F.collect_set("__grid")).first()[0]], "__grid int")  # exponents: some dozens at most
    send = F.broadcast if b.count() <= SENT_BOXES else (lambda df: df)
    cells = cells.select("*", F.explode(both(0)).alias("__cx")).select("*", F.explode(both(2)).alias("__cz"))
    p = points.join(F.broadcast(grids)).withColumn("__cx", cell(F.col("x"))).withColumn("__cz", cell(F.col("z")))
    inside = p.join(send(cells), [scene, "__grid", "__cx", "__cz"]).where(geometry.in_box(F.col("x"), F.col("y"), F.col("z"), F.col("low"), F.col("high"), across, upright))
    first = inside.groupBy(point_id).agg(F.min("__rank").alias("__rank"))
    return first.join(send(b.select("__rank", "level", "region")), "__rank").select(point_id, "level", "region")


def _with_level(points: DataFrame, levels: DataFrame, scene: str, slack: float = 0.5, **limits: int) -> DataFrame:
    """Points with ``__hit``: the highest level that starts at most ``slack`` above them, else the lowest; null in scenes without levels."""
    return asof(points, levels, [scene], F.col("y") + slack, "floor_y", ["level"], "__hit", else_first=True, **limits)


def asof_level(points: DataFrame, levels: DataFrame, scene: str, point_id: str, slack: float = 0.5, **limits: int) -> DataFrame:
    """(point, level): the highest level that starts at most ``slack`` above the point, else the lowest level. Scenes without levels are left out."""
    found = _with_level(points.select(point_id, scene, "y"), levels, scene, slack, **limits)
    return found.where("__hit IS NOT NULL").select(point_id, F.col("__hit.level").alias("level"))


def nearest_floor(points: DataFrame, floors: DataFrame, scene: str, point_id: str, **limits: int) -> DataFrame:
    """(point, floor) of the closest height; of equals the lowest number. Scenes without floors and points without a height are left out."""
    found = nearest(points.select(point_id, scene, "y"), floors, [scene], F.col("y"), "height", ["floor"], "__hit", **limits)
    return found.where("__hit IS NOT NULL").select(point_id, F.col("__hit.floor").alias("floor"))


def level_of_points(points: DataFrame, boxes: DataFrame, levels: DataFrame, scene: str, point_id: str, **limits: int) -> DataFrame:
    """Level by box, else by height; ``found`` says which."""
    by_box = smallest_box(points, boxes, scene, point_id).select(point_id, F.col("level").alias("box_level"))
    out = _with_level(points, levels, scene, **limits).join(by_box, point_id, "left").withColumn("height_level", F.col("__hit.level"))
    found = F.when(F.col("box_level").isNotNull(), "box").when(F.col("height_level").isNotNull(), "height")
    return out.select(point_id, *[c for c in points.columns if c != point_id], F.coalesce("box_level", "height_level").alias("level"), found.alias("found"))


def gap_clusters(df: DataFrame, scene: str, height: str, gap: float = 1.5, digits: int = 1) -> DataFrame:
    """Floors per scene: distinct rounded heights, a new floor where the gap is larger, mean height, numbered from 1.

    Rounding is half-even on the decimal value; heights that are null don't count.
    """
    heights = df.where(F.col(height).isNotNull()).select(scene, F.bround(F.col(height), digits).alias("h")).distinct()
    upward = Window.partitionBy(scene).orderBy("h")
    starts = heights.withColumn("__new", F.coalesce((F.round(F.col("h") - F.lag("h").over(upward), 6) > gap).cast("int"), F.lit(0)))
    numbered = starts.withColumn("floor", F.sum("__new").over(upward.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    return numbered.groupBy(scene, "floor").agg(F.avg("h").alias("height"), F.count("*").alias("n_heights"))


def level_floors(boxes: DataFrame, scene: str) -> DataFrame:
    """Lowest y of each level."""
    return boxes.groupBy(scene, "level").agg(F.min(F.get("low", F.lit(1))).alias("floor_y"))


def total_levels(boxes: DataFrame, scene: str) -> DataFrame:
    return boxes.groupBy(scene).agg(F.countDistinct("level").alias("total_levels"))


def floor_annotation(start_floor: Column, end_floor: Column, total_floors: Column, height_diff: Column) -> Column:
    """Floors of an episode; a one-floor house with a climb of 1 or more counts as two floors."""
    split = (total_floors <= 1) & (F.abs(height_diff) >= 1.0)
    up = height_diff > 0
    start = F.when(split, F.when(up, 1).otherwise(2)).otherwise(start_floor)
    end = F.when(split, F.when(up, 2).otherwise(1)).otherwise(end_floor)
    return F.struct(
        start.alias("start_floor"), end.alias("end_floor"), F.when(split, 2).otherwise(total_floors).alias("total_floors"), geometry.direction(F.lit(0.0), height_diff, with_same=False).alias("direction")
    )
