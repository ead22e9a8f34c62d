"""Writers. Spark's committer makes each of them all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines."""
    df.write.mode("append" if append else "errorifexists").json(path)


def write_counted(df: DataFrame, path: str) -> int:
    """JSON lines, and how many were written, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.json(path)
    return seen.get["n"]


def write_envelope(df: DataFrame, path: str, pipeline: str) -> None:
    """Records as lines under ``records`` and one line with the pipeline's name and their number."""
    n = write_counted(df, f"{path}/records")
    head = df.sparkSession.createDataFrame([(pipeline, n)], "pipeline string, count long")
    head.coalesce(1).write.json(f"{path}/header")


def write_shards(df: DataFrame, path: str, index: str, shards: int) -> None:
    """One folder of gzip lines per shard (index modulo the number of shards)."""
    shard = F.pmod(F.col(index), F.lit(shards)).cast("int")
    df.withColumn("shard", shard).repartition(shards, "shard").write.partitionBy("shard").option("compression", "gzip").json(path)


def write_by_scene(df: DataFrame, path: str, scene: str = "scene_id") -> None:
    """A folder per scene; a rerun replaces only the scenes it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scene).parquet(path)


def write_beside(df: DataFrame, path: str, suffix: str = "_new") -> str:
    """Results next to their input, never over it."""
    target = path.rstrip("/") + suffix
    df.write.mode("overwrite").parquet(target)
    return target
