"""Counted shards: the manifest is the commit."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from wayloom.sources import manifest


def held(path):
    """Rows by the manifest, file by file, and all files there."""
    said = json.loads((path / manifest.MANIFEST).read_text())
    for shard in said["shards"]:
        assert shard["count"] == sum(f["count"] for f in shard["files"])
        for f in shard["files"]:
            lines = gzip.decompress((path / f["file"]).read_bytes()).decode().splitlines()
            assert len(lines) == f["count"] and all(json.loads(x)["id"] % len(said["shards"]) == shard["shard"] for x in lines)
    return said, {str(p.relative_to(path)) for p in path.glob("shard=*/*.gz")}


def test_counts_are_those_of_the_files(spark, tmp_path):
    path = tmp_path / "out"
    df = spark.range(0, 1000, 1, 7).withColumn("line", F.lit("a\nb é"))
    manifest.write_counted_shards(df, str(path), "id", 4)
    said, files = held(path)
    assert said["count"] == 1000 and [s["count"] for s in said["shards"]] == [250] * 4
    (path / "shard=1" / "left-over.json.gz").write_bytes(gzip.compress(b'{"id": 1}\n'))  # of an attempt that failed
    rows = manifest.read_counted_shards(spark, str(path), "id long, line string").collect()
    assert sorted((r["id"], r["line"], r["shard"]) for r in rows) == [(i, "a\nb é", i % 4) for i in range(1000)]
    with pytest.raises(Exception, match="has a manifest already"):
        manifest.write_counted_shards(df, str(path), "id", 4)
    manifest.write_counted_shards(df.limit(9), str(path), "id", 3, overwrite=True)
    said, after = held(path)
    assert said["count"] == 9 and not files & after


def test_failed_jobs_leave_no_manifest(spark, tmp_path):
    path = tmp_path / "out"
    bad = spark.range(0, 100, 1, 4).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise("x").alias("line"))
    with pytest.raises(Exception, match="stop"):
        manifest.write_counted_shards(bad, str(path), "id", 4)
    assert not (path / manifest.MANIFEST).exists()
    manifest.write_counted_shards(bad.where("id <> 77"), str(path), "id", 4)
    assert held(path)[0]["count"] == 99


def test_no_rows(spark, tmp_path):
    manifest.write_counted_shards(spark.range(0), str(tmp_path / "out"), "id", 4)
    assert held(tmp_path / "out")[0] == {"count": 0, "shards": []}
    assert manifest.read_counted_shards(spark, str(tmp_path / "out"), "id long").count() == 0
