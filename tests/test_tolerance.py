"""Greedy upserts within a tolerance against the sequential loop."""

import math
import random

import pytest

from wayloom.operators import tolerance

SCHEMA = "k string, v double, pos int"


def loop(existing, new, eps):
    """The rows as one process would append them, one by one."""
    out = list(existing)
    for k, v, pos in sorted(new, key=lambda r: r[2]):
        if k is None or v is None or not any(k == j and w is not None and abs(v - w) < eps for j, w, _ in out):
            out.append((k, v, pos))
    return sorted(out, key=str)


@pytest.mark.parametrize("scan_rows", [100_000, 0, 40])
def test_chains(spark, scan_rows):
    """1.0, 1.0 + 0.6 t, 1.0 + 1.2 t: the second goes, the third stays; also in rounds."""
    t = 1e-6
    values = [1.0, 1.0 + 0.6 * t, 1.0 + 1.2 * t, 1.0 + 1.7 * t, 1.0 + 2.1 * t]
    rng = random.Random(2)
    new = [("a", v, i) for i, v in enumerate(values)] + [("b", v, 100 - i) for i, v in enumerate(values)]
    existing = [("i", 5.0, 0), ("b", 1.0 - 0.5 * t, 0)]
    new += [("j", 1.0, 1), ("j", 1.0 + 1e-7, 2), ("j", 1.0 + 2e-7, 3)]
    new += [("r", 7.0 + rng.randrange(400) * 0.13 * t, 200 + i) for i in range(150)]
    new += [("r", -3e9 + rng.randrange(40) * 1e-6, 400 + i) for i in range(50)] + [("r", rng.uniform(-2, 2) * t, 500 + i) for i in range(50)]
    new += [(None, 1.0, 900), (None, 1.0, 901), ("a", None, 902), ("a", None, 903), ("a", math.inf, 904), ("a", math.inf, 905), ("a", -0.0, 906), ("a", 0.0, 907)]
    rng.shuffle(new)
    got = tolerance.upsert_append(spark.createDataFrame(existing, SCHEMA), spark.createDataFrame(new, SCHEMA), "k", "v", ["pos"], t, scan_rows=scan_rows)
    assert sorted(map(tuple, got.collect()), key=str) == loop(existing, new, t)


def test_rising_values(spark):
    """Every row is close to the one before: one round a cell, the right rows all the same."""
    new = [("a", i * 0.4, i) for i in range(60)]
    got = tolerance.first_within(spark.createDataFrame(new, SCHEMA), "k", "v", ["pos"], 1.0, scan_rows=20)
    assert sorted(map(tuple, got.collect()), key=str) == loop([], new, 1.0)
    assert tolerance.first_within(spark.createDataFrame([], SCHEMA), "k", "v", ["pos"]).count() == 0


def test_cells_hold_all_that_is_close(spark):
    rng = random.Random(3)
    old, new = [], []
    for i in range(400):
        eps, base = 0.1, rng.choice((0.0, 0.35, 12345.6, -7.75, 4e15))
        v = base + rng.randrange(-8, 9) * 0.05
        old.append(("k", v, i))
        new.append(("k", v + rng.choice((-1, 1)) * rng.choice((0.0999999, 0.1, 0.1000001, 0.05, 5.0)), i))
    got = tolerance.tolerance_anti(spark.createDataFrame(new, SCHEMA), spark.createDataFrame(old, SCHEMA), "k", "v", eps).collect()
    assert sorted(map(tuple, got)) == sorted(r for r in new if not any(abs(r[1] - w) < eps for _, w, _ in old))
