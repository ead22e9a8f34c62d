"""Directory listings and text formats as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.levels import gap_clusters


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, modified) of files below a folder. Contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def ordered_trajectories(listing: DataFrame, pattern: str = r"traj_(\d+)_") -> DataFrame:
    """Distinct parent folders by the number in their name; names without one come last."""
    names = listing.select(text.parent_part(F.col("path")).alias("traj_name")).distinct()
    return names.withColumn("traj_idx", text.number_in_name(F.col("traj_name"), pattern)).orderBy("traj_idx", "traj_name")


def ordered_images(listing: DataFrame) -> DataFrame:
    """Images by folder and step number."""
    return listing.select("path", text.parent_part(F.col("path")).alias("traj_name"), text.number_in_name(text.last_part(F.col("path")), r"(\d+)\.\w+$").alias("step")).orderBy("traj_name", "step", "path")


def scene_catalogue(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Scenes of listings in order of preference: the first source that has a scene gives its path."""
    parts = [df.select(F.lit(rank).alias("rank"), F.lit(name).alias("source"), "path", text.scene_stem(F.col("path")).alias("scene")) for rank, (name, df) in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = F.struct("rank", "path")
    return out.groupBy("scene").agg(F.min_by("source", best).alias("source"), F.min_by("path", best).alias("path"))


def complete_scenes(listing: DataFrame) -> DataFrame:
    """Scenes with both a mesh and a navigation mesh in the listing."""
    stem = F.regexp_replace(F.col("path"), r"\.(glb|navmesh)$", "")
    have = listing.where(F.col("path").rlike(r"\.(glb|navmesh)$")).select(stem.alias("stem"), F.regexp_extract("path", r"\.(glb|navmesh)$", 1).alias("kind"))
    return have.groupBy("stem").agg(F.countDistinct("kind").alias("kinds")).where("kinds = 2").select("stem", text.last_part(F.col("stem")).alias("scene"))


def house_heights(spark: SparkSession, path: str) -> DataFrame:
    """(scene, y): heights of a house file's rooms (R lines, sixth field from 0), or of its viewpoints (V lines, fifth) if it has no rooms."""
    lines = spark.read.text(path).select(F.regexp_replace(text.last_part(F.input_file_name()), r"\.house$", "").alias("scene"), F.split(F.trim("value"), r"\s+").alias("f"))
    at = lambda i: F.get("f", F.lit(i)).try_cast("double")
    kind = F.get("f", F.lit(0))
    rows = lines.where(kind.isin("R", "V")).select("scene", kind.alias("kind"), F.when(kind == "R", at(6)).otherwise(at(5)).alias("y")).where("y IS NOT NULL")
    rooms = rows.where("kind = 'R'").select("scene").distinct().withColumn("has_rooms", F.lit(True))
    return rows.join(rooms, "scene", "left").where(F.when(F.col("has_rooms"), F.col("kind") == "R").otherwise(True)).select("scene", "y")


def house_floors(spark: SparkSession, path: str, gap: float = 1.5) -> DataFrame:
    return gap_clusters(house_heights(spark, path), "scene", "y", gap)


def first_video_frames(listing: DataFrame) -> DataFrame:
    """Smallest path per file stem: of equal names the first wins."""
    return listing.groupBy(F.regexp_replace(text.last_part(F.col("path")), r"\.\w+$", "").alias("stem")).agg(F.min("path").alias("path"))


def trajectory_manifest(episodes: DataFrame, prefixes: list[str], most: int | None = None) -> DataFrame:
    """Trajectory names from a dataset: traj_idx, traj_name, language; only the languages asked for."""
    from ..operators.filters import language_matches

    rows = episodes.where(language_matches(F.col("instruction.language"), prefixes)).select(
        F.col("dataset_index").alias("traj_idx"),
        F.concat_ws("_", F.lit("traj"), F.col("dataset_index").cast("string"), text.sanitize_component(F.col("instruction.instruction_id"))).alias("traj_name"),
        F.col("instruction.language").alias("language"),
    )
    return rows if most is None else rows.orderBy("traj_idx").limit(most)
