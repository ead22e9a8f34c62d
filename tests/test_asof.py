"""As-of and nearest joins against a look at every right row; as arrays and as ranges."""

import random

import pytest
from pyspark.sql import functions as F

from wayloom.operators import asof, levels

LIMITS = [{}, {"sent_rows": 0}, {"array_rows": 0}]


def tables(spark, seed):
    """One hot group, ties, nulls on both sides, groups without right rows."""
    rng = random.Random(seed)
    pick = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    right = [(pick(), rng.choice((None, *[x / 2 for x in range(-30, 30)])), rng.randrange(50)) for _ in range(160)] + [("only", 5.0, 1)]
    left = [(i, pick() if i % 9 else rng.choice(("only", "nothing")), rng.choice((None, *[x / 4 for x in range(-80, 80)])), "x") for i in range(400)]
    return left, right, spark.createDataFrame(left, "id long, scene string, y double, r string").repartition(5), spark.createDataFrame(right, "scene string, height double, floor long")


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("forward", [False, True])
def test_asof(spark, limits, forward):
    left, right, points, floors = tables(spark, 3)
    want = {}
    for i, scene, y, _ in left:
        near = [(h, f) for s, h, f in right if scene is not None and s == scene and h is not None and y is not None and (h >= y if forward else h <= y)]
        want[i] = (min(near) if forward else max(near)) if near else None
    got = asof.asof(points, floors, ["scene"], F.col("y"), "height", ["floor"], forward=forward, **limits)
    assert got.columns == ["scene", "id", "y", "r", "hit"] or set(got.columns) == {"id", "scene", "y", "r", "hit"}
    rows = got.collect()
    assert {r["id"]: r["hit"] and tuple(r["hit"]) for r in rows} == want and len(rows) == len(left)


@pytest.mark.parametrize("limits", LIMITS)
def test_levels(spark, limits):
    left, right, points, floors = tables(spark, 4)
    of = lambda scene: [(h, f) for s, h, f in right if scene is not None and s == scene and h is not None]
    want = {}
    for i, scene, y, _ in left:
        if of(scene):
            below = [x for x in of(scene) if y is not None and x[0] <= y + 0.5]
            want[i] = (max(below) if below else min(of(scene)))[1]
    got = levels.asof_level(points, floors.select("scene", F.col("floor").alias("level"), F.col("height").alias("floor_y")), "scene", "id", **limits).collect()
    assert {r["id"]: r["level"] for r in got} == want
    want = {i: min((abs(h - y), f) for h, f in of(scene))[1] for i, scene, y, _ in left if y is not None and of(scene)}
    got = levels.nearest_floor(points, floors, "scene", "id", **limits).collect()
    assert {r["id"]: r["floor"] for r in got} == want


def test_no_rows(spark):
    _, _, points, floors = tables(spark, 5)
    for limits in LIMITS:
        assert levels.nearest_floor(points.limit(0), floors, "scene", "id", **limits).count() == 0
        assert levels.asof_level(points, floors.limit(0).select("scene", F.col("floor").alias("level"), F.col("height").alias("floor_y")), "scene", "id", **limits).count() == 0


def test_points_stay_where_they_are(spark):
    """Groups of few rows are sent to the points: no exchange of points in the plan."""
    _, _, points, floors = tables(spark, 6)
    points = spark.createDataFrame(points.collect(), points.schema)
    plan = asof.asof(points, floors, ["scene"], F.col("y"), "height", ["floor"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan
