"""Queries over whole tables, held against brute force."""

import os

import pytest
from pyspark.sql import functions as F

from wayloom import plans
from wayloom.functions import text
from wayloom.operators import trajectories as tr
from wayloom.plans.base import trajectories

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


def rows(spark, table):
    return spark.read.parquet(f"{FOLDER}/{table}.parquet").collect()


def test_every_supplier_is_a_box(spark):
    boxes = []
    for s in rows(spark, "supplier"):
        k, side = s["s_suppkey"], 1.0 + s["s_suppkey"] % 9
        low = (float(s["s_nationkey"]), float(k % 4), 0.0)
        boxes.append((side**3, k, k % 10, k % 4, low, tuple(x + side for x in low)))
    want, floors = {}, {}
    for p in rows(spark, "part"):
        k, at = p["p_partkey"], (p["p_size"] / 2, float(p["p_size"] % 11), float(p["p_retailprice"]) - 900)
        held = [b for b in boxes if b[2] == k % 10 and all(lo - m <= x <= hi + m for x, lo, hi, m in zip(at, b[4], b[5], (0.2, 0.5, 0.2)))]
        if held:
            want[k] = min(held)[3], min(held)[1]
        heights = {b[3] + 1: min(c[4][1] for c in boxes if c[2:4] == b[2:4]) * 3 for b in boxes if b[2] == k % 10}
        floors[k] = min((abs(h - at[1]), floor) for floor, h in heights.items())[1]
    got = {r["p_partkey"]: (r["level"], r["region"]) for r in plans.QUERIES["aabb_smallest"](spark, FOLDER).collect()}
    assert got == want and any(region % 5 for _, region in want.values())
    assert {r["p_partkey"]: r["floor"] for r in plans.QUERIES["nearest_floor"](spark, FOLDER).collect()} == floors
    fallback = {r["p_partkey"]: (r["level"], r["found"]) for r in plans.QUERIES["level_fallback"](spark, FOLDER).collect()}
    assert {k: level for k, (level, found) in fallback.items() if found == "box"} == {k: level for k, (level, _) in want.items()}


def test_every_line_is_parsed(spark):
    want = []
    for r in rows(spark, "lineitem"):
        q, m = int(r["l_quantity"]), r["l_linenumber"] * 0.25
        want.append((r["l_orderkey"], r["l_partkey"], r["l_linenumber"], r["l_suppkey"] % 2 == 0 or q == 180, q + m + 180))
    got = plans.QUERIES["number_multiset"](spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r["ok"] for r in got} == {True, False}


def test_sources_are_merged_over_all_customers(spark):
    groups = {}
    for r in rows(spark, "customer"):
        groups.setdefault((r["c_nationkey"], r["c_mktsegment"]), []).append(r["c_name"])
    said = {k: [min(v), max(v), "shared"] for k, v in groups.items() if len(v) % 3}
    order = ("MACHINERY", "BUILDING", "HOUSEHOLD")
    first, joined = {}, {}
    for nation in {n for n, _ in said}:
        sources = [s for s in order if (nation, s) in said]
        if sources:
            first[nation] = (",".join(said[nation, sources[0]]), sources[0])
            joined[nation] = (",".join(dict.fromkeys(x for s in sources for x in said[nation, s])), ",".join(sources))
    got = plans.QUERIES["priority_merge"](spark, FOLDER).collect()
    assert {r["c_nationkey"]: (r["said"], r["source"]) for r in got} == first and len({s for _, s in first.values()}) > 1
    got = plans.QUERIES["priority_concat"](spark, FOLDER).collect()
    assert {r["c_nationkey"]: (r["said"], r["sources"]) for r in got} == joined


def test_sentences_have_every_segment(spark):
    actions = trajectories(spark, FOLDER)
    segments = tr.segments_of(F.col("actions"))
    numbers = F.transform(segments, lambda s: F.coalesce(s["meters"], s["degrees"].cast("double")))
    joined = plans.QUERIES["precise_sentences"](spark, FOLDER).join(actions, "user_id").select(F.size(segments).alias("n"), text.numbers_match(text.numbers_in(F.col("said")), numbers).alias("ok"))
    got = joined.collect()
    assert len(got) == actions.count() and all(r["ok"] for r in got) and max(r["n"] for r in got) > 6
