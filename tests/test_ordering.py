"""Cuts, numbers and shares against plain sorts, however large the sample."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayloom.operators import ordering, sampling


def table(spark, n=900, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice("abcdefgh") if rng.random() < 0.9 else None, rng.randrange(20) if rng.random() < 0.8 else None) for i in range(n)]
    rows += [(7, "hot", 3)] * 300 + [(None, "hot", None)] * 5
    return rows, spark.createDataFrame(rows, "id long, g string, v int").repartition(5, "v")


def md5(i):
    return "" if i is None else hashlib.md5(f"{i}|42".encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 4, 9, 300, 700, 1000, 1205, 5000])
def test_hash_samples(spark, n):
    rows, df = table(spark)
    got = Counter(r["id"] for r in ordering.take_by_hash(df, sampling.hash_key(F.col("id"), 42), n, few=8).collect())
    assert got == Counter(i for i, *_ in sorted(rows, key=lambda r: md5(r[0]))[:n])
    assert Counter(r["id"] for r in sampling.hash_sample(df, "id", n).collect()) == got


@pytest.mark.parametrize("descending", [False, True])
def test_first_rows(spark, descending):
    rows, df = table(spark)
    key = lambda r: ((r[2] is not None, r[2] or 0), (r[0] is not None, r[0] or 0))
    ranked = sorted(rows, key=key, reverse=descending)
    for n in (1, 9, 100, 480, 700, 1204, 2000):
        got = ordering.take_first(df, ["v", "id"], n, descending, few=8)
        assert sorted(((r["v"], r["id"]) for r in got.collect()), key=str) == sorted(((r[2], r[0]) for r in ranked[:n]), key=str)


def test_large_samples_gather_nothing(spark):
    """90 % of a table: no limit, no global sort of rows in the plan that gives them."""
    df = spark.range(30_000)
    for taken in (sampling.hash_sample(df, "id", 27_000), ordering.take_first(df, ["id"], 27_000), sampling.sample_rows(df, "end:90%", "id", ["id"]), sampling.sample_rows(df, "all", "id", ["id"])):
        plan = taken._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("TakeOrdered", "GlobalLimit", "CollectLimit", "Sort ", "Exchange"))
        assert taken.count() in (27_000, 30_000)


def test_running_sums(spark):
    rows, df = table(spark)
    got = {(r["id"], r["v"]): r["s"] for r in ordering.running_sums(df.where("id <> 7").withColumn("one", F.lit(2)), ["id"], "one", "s").collect()}
    assert sorted(got.values()) == [2 * k for k in range(899)] and got[0, rows[0][2]] == 0


@pytest.mark.parametrize("each,total,window", [(4, 30, 1000), (4, None, 1000), (50, 200, 10), (400, 900, 10), (400, None, 10), (400, 10_000, 10), (3, 0, 1000)])
def test_shares_of_groups(spark, each, total, window):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", "c", "hot", "hot", "hot", None])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, g string")
    want, groups = [], Counter()
    for i, g in sorted(rows, key=lambda r: ((r[1] is not None, r[1] or ""), r[0])):
        groups[g] += 1
        if groups[g] <= each:
            want.append((i, g))
    got = sampling.group_quota(df, "g", ["id"], each, total, window_rows=window)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want if total is None else want[:total], key=str)
