"""Hard negatives against a full sort of all scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayloom.llm import hard_negatives as hn
from wayloom.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, row string, score string"


def vectors(n=300, seed=1, dim=6, spread=0.6):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, spread), 3) for _ in range(dim)], rng.randrange(4)) for i in range(n)]
    rows += [(1000 + i, rows[10][1], i % 2) for i in range(40)]  # ties
    rows += [(10, rows[10][1], 2), (10, rows[10][1], 2), (None, rows[20][1], 1), (None, rows[20][1], 1)]
    rows += [(2000, None, 1), (2010, [1.0, None], 1), (2020, [math.nan] * dim, 1), (2030, [math.inf] * dim, 2), (2040, rows[0][1], None), (2050, [], 1), (2060, [0.5, 0.5], 3)]
    return [(*r, "extra", "extra", "extra") for r in rows]


def plain(rows, every=10, k=5, m=5):
    known = [(i, [math.floor(256 * x) for x in v], label) for i, v, label, *_ in rows if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    order = lambda i: (i is None, i or 0)
    for a, (i, v, label) in enumerate(known):
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, other, b) for b, (j, w, other) in enumerate(known) if b != a]
        for p in sorted((s for s in scored if s[2] == label), key=lambda s: (-s[0], order(s[1])))[:k]:
            near = [s for s in scored if s[2] != label and 80 * p[0] <= 100 * s[0] <= 100 * p[0]]
            out += [(i, p[1], r, s[1], p[0], s[0]) for r, s in enumerate(sorted(near, key=lambda s: (-s[0], order(s[1])))[:m], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("digit,anchors,block", [(11, 4096, 2048), (2, 7, 16)])
def test_against_a_full_sort(spark, monkeypatch, digit, anchors, block):
    monkeypatch.setattr(hn, "DIGIT_BITS", digit)
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    rows = vectors()
    import numpy as np

    exact = [(r[0], None if r[1] is None else [x if x is None else float(np.float32(x)) for x in r[1]], *r[2:]) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3, "label")
    got = hard_negatives(df, F.col("vec_id") % 10 == 0, round_anchors=anchors)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(exact)
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 200


def test_few_rows(spark):
    df = spark.createDataFrame(vectors(), SCHEMA)
    anchor = F.col("vec_id") % 10 == 0
    assert hard_negatives(df.limit(0), anchor).count() == 0
    assert hard_negatives(df, F.lit(False)).count() == 0
    assert hard_negatives(df.where("vec_id = 0"), anchor).count() == 0
    two = spark.createDataFrame([(0, [1.0], 1, "", "", ""), (1, [1.0], 1, "", "", ""), (2, [0.9], 2, "", "", "")], SCHEMA)
    assert [tuple(r) for r in hard_negatives(two, anchor).collect()] == [(0, 1, 1, 2, 65536, 58880)]


def test_large_numbers(spark):
    rows = [(0, [2e6, 1.0], 1, "", "", ""), (1, [2e6, 5.0], 1, "", "", ""), (2, [2e6, 4.0], 2, "", "", ""), (3, [1.9e6, 0.0], 2, "", "", "")]
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0)  # products beyond 2 ** 53
    assert sorted(map(tuple, got.collect())) == [r for r in plain([(r[0], r[1], r[2]) for r in rows])] and got.count() == 2
    rows[1] = (1, [1e30, 1.0], 1, "", "", "")
    with pytest.raises(Exception, match="too large"):
        hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()


def test_tasks_send_on_few_buckets():
    held = {5: 1, 2: 3, 9: 10, 3: 4}
    assert hn._trim(held, 5) == {2: 3, 3: 4}
