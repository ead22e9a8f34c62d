"""Shards: exact sizes, gapless slots, and every way of dealing equally likely."""

import itertools
import zlib
from collections import Counter
from math import comb, prod

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.llm import sharding
from wayloom.llm.sharding import communication_matrix, draw_hypergeometric, shard_documents, shard_sizes, shuffle_to_shards, write_shards

from .corpus import documents, frame


def expect(counts, chances):
    """Chi-square of observed counts stays below its mean and six deviations."""
    n = sum(counts.values())
    assert set(counts) <= set(chances)
    square = sum((counts.get(x, 0) - n * p) ** 2 / (n * p) for x, p in chances.items())
    assert square < len(chances) + 6 * (2 * len(chances)) ** 0.5


def test_draws():
    rng = np.random.default_rng(4)
    for good, bad, draws in ((5, 7, 4), (2, 3, 5), (1, 30, 10)):
        counts = Counter(draw_hypergeometric(rng, good, bad, draws) for _ in range(5000))
        expect(counts, {k: comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) for k in range(max(0, draws - bad), min(good, draws) + 1)})
    assert draw_hypergeometric(rng, 0, 5, 3) == 0 and draw_hypergeometric(rng, 5, 0, 3) == 3 and draw_hypergeometric(rng, 4, 4, 0) == 0
    large = [draw_hypergeometric(rng, 10**11, 7 * 10**11, 10**9) for _ in range(300)]  # beyond the usual generators
    assert abs(np.mean(large) - 1.25e8) < 5 * 10440 / 300**0.5 and 0.8 < np.std(large) / 10453 < 1.2


def test_matrix():
    parts, shards = [3, 0, 2, 4], [4, 3, 2]
    many = Counter(tuple(map(tuple, communication_matrix(parts, shards, seed))) for seed in range(3000))
    for matrix in many:
        assert [sum(r) for r in matrix] == parts and [sum(c) for c in zip(*matrix)] == shards
    rows = [[r for r in itertools.product(range(5), repeat=3) if sum(r) == n] for n in parts]
    possible = [m for m in itertools.product(*rows) if [sum(c) for c in zip(*m)] == shards]
    ways = {m: prod(prod(comb(left, x) for left, x in zip([n - sum(r[:k]) for k in range(3)], r)) for n, r in zip(parts, m)) for m in possible}
    expect(many, {m: w / sum(ways.values()) for m, w in ways.items()})


@pytest.mark.parametrize("group,part", [(4, 8), (512, 4096)])
def test_shuffle(spark, monkeypatch, group, part):
    """Laws hold, an equal seed gives an equal shuffle however rows lie, and another seed another one."""
    monkeypatch.setattr(sharding, "GROUP_ROWS", group)
    monkeypatch.setattr(sharding, "PART_ROWS", part)
    rows = documents()
    got = shard_documents(frame(spark, rows, clashing=True)).collect()
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert [(r["size"], r["text_crc32"]) for r in got] == [(len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]])) for r in got]
    sizes = Counter(r["shard"] for r in got)
    assert [sizes[k] for k in range(8)] == shard_sizes(len(rows), 8) and max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r["shard"], r["slot"]) for r in got) == [(j, i) for j in range(8) for i in range(sizes[j])]
    again = shard_documents(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    other = shard_documents(frame(spark, rows), seed=1).collect()
    assert sorted(map(str, other)) != sorted(map(str, got))


def test_every_place_is_equally_likely(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP_ROWS", 2)
    monkeypatch.setattr(sharding, "PART_ROWS", 2)
    df = spark.range(7).withColumn("x", F.lit("a"))
    counts = Counter((r["id"], r["shard"], r["slot"]) for seed in range(40) for r in shuffle_to_shards(df, ["id"], 3, seed).collect())
    places = [(j, i) for j, n in enumerate(shard_sizes(7, 3)) for i in range(n)]
    expect(counts, {(k, *p): 1 / 49 for k in range(7) for p in places})


def test_odd_rows(spark, monkeypatch):
    """Copies beyond the limit of one group, null ids and texts, clashing names, more shards than rows."""
    monkeypatch.setattr(sharding, "PART_ROWS", 64)
    rows = [(None, "copy", None, None, None)] * 600 + [(None, None, None, None, None), (1, None, None, None, None), (1, "", None, None, None)]
    df = frame(spark, rows, clashing=True).withColumn("shard", F.lit("x")).withColumn("place", F.lit("y")).withColumn("a.b`c", F.lit(3)).withColumn("h", F.lit(4))
    dealt = shuffle_to_shards(df, ["doc_id", "text"], 5)
    assert dealt.columns == [*[c for c in df.columns if c != "shard"], "shard", "slot"]
    got = dealt.collect()
    sizes = Counter(r["shard"] for r in got)
    assert sorted(sizes.values()) == [120, 120, 121, 121, 121] and all(r["place"] == "y" and r["h"] == 4 and r["a.b`c"] == 3 for r in got)
    assert sorted((r["shard"], r["slot"]) for r in got) == [(j, i) for j in sorted(sizes) for i in range(sizes[j])]
    assert Counter(r["doc_id"] for r in got) == {None: 601, 1: 2}
    assert shuffle_to_shards(df.limit(0), ["doc_id"], 5).count() == 0
    assert sorted((r["shard"], r["slot"]) for r in shuffle_to_shards(df.limit(2), ["doc_id"], 5).collect()) == [(0, 0), (1, 0)]
    with pytest.raises(ValueError):
        shuffle_to_shards(df, ["doc_id"], 0)


def test_written_shards(spark, tmp_path):
    dealt = shuffle_to_shards(frame(spark), ["doc_id", "text"], 3)
    write_shards(dealt, str(tmp_path / "out"), rows_per_file=10)
    import pyarrow.parquet as pq

    for shard in range(3):
        files = sorted((tmp_path / "out" / f"shard={shard}").glob("file=*/*.parquet"), key=lambda f: int(f.parent.name.split("=")[1]))
        slots = [s for f in files for s in pq.ParquetFile(f).read(["slot"]).column(0).to_pylist()]
        assert slots == list(range(len(slots))) and len(files) > 1
