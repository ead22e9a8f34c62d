"""Shards whose manifest is their commit.

Tasks write gzip JSON lines under names that no other attempt uses and report
what they wrote with their commit. Once all have, one manifest is written that
names those files and counts their rows, per shard. Files of failed attempts
are in no manifest, and a job that fails leaves none.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"


def _source() -> type:
    """The data source; made in a function, so that it travels by value to processes that lack this package."""
    from dataclasses import dataclass

    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

    manifest = MANIFEST

    @dataclass
    class Written(WriterCommitMessage):
        files: list  # of (shard, name, rows)

    class ShardWriter(DataSourceArrowWriter):
        """Rows (shard int, line string), of one shard after another in each task."""

        def __init__(self, path: str, overwrite: bool):
            self.path, self.overwrite = path.rstrip("/"), overwrite
            if not overwrite and self._read() is not None:
                raise ValueError(f"{path} has a manifest already")

        def _files(self):
            from pyarrow import fs

            return fs.FileSystem.from_uri(self.path)

        def _read(self):
            files, root = self._files()
            try:
                with files.open_input_stream(f"{root}/{manifest}") as f:
                    return json.loads(f.read())
            except FileNotFoundError:
                return None

        def write(self, iterator):
            import gzip
            import uuid

            files, root = self._files()
            done, shard, out, name, rows = [], None, None, "", 0

            def close():
                if out is not None:
                    out.close()
                    done.append((shard, name, rows))

            for batch in iterator:
                for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if out is None or key != shard:
                        close()
                        shard, name, rows = key, f"shard={key}/{uuid.uuid4().hex}.json.gz", 0
                        files.create_dir(f"{root}/shard={key}")
                        out = gzip.GzipFile(fileobj=files.open_output_stream(f"{root}/{name}", compression=None), mode="wb", mtime=0)
                    out.write(line.encode() + b"\n")
                    rows += 1
            close()
            return Written(done)

        def commit(self, messages):
            files, root = self._files()
            old = self._read() if self.overwrite else None
            shards: dict = {}
            for key, name, rows in sorted(f for m in messages if m is not None for f in m.files):
                shards.setdefault(key, []).append({"file": name, "count": rows})
            body = [{"shard": k, "count": sum(f["count"] for f in v), "files": v} for k, v in sorted(shards.items())]
            files.create_dir(root)
            with files.open_output_stream(f"{root}/.{manifest}.new") as f:
                f.write(json.dumps({"count": sum(s["count"] for s in body), "shards": body}).encode())
            files.move(f"{root}/.{manifest}.new", f"{root}/{manifest}")
            for s in old["shards"] if old else []:  # readers go by the manifest, so these are read no more
                for f in s["files"]:
                    files.delete_file(f"{root}/{f['file']}")

        def abort(self, messages):
            files, root = self._files()
            for m in messages:
                for _, name, _ in m.files if m is not None else []:
                    files.delete_file(f"{root}/{name}")

    class CountedShards(DataSource):
        @classmethod
        def name(cls) -> str:
            return "counted_shards"

        def writer(self, schema, overwrite: bool):
            return ShardWriter(self.options["path"], overwrite)

    return CountedShards


def write_counted_shards(df: DataFrame, path: str, index: str, shards: int, overwrite: bool = False) -> None:
    """All columns as gzip JSON lines, a folder per shard (index modulo the number of shards, null with 0), and a manifest.

    A shard is as many files as it has tasks; a large one is split over
    several. Fails if there is a manifest, unless told to ``overwrite``: then
    the new manifest takes the old one's place first, and its files go next.
    """
    spark = df.sparkSession
    spark.dataSource.register(_source())
    shard = F.coalesce(F.pmod(F.col(index), F.lit(shards)), F.lit(0)).cast("int")
    line = F.to_json(F.struct(*[df[c] for c in df.columns]))
    dealt = df.select(shard.alias("shard"), line.alias("line")).hint("rebalance", "shard").sortWithinPartitions("shard")
    dealt.write.format("counted_shards").option("path", path).mode("overwrite" if overwrite else "append").save()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(shard, file, count) of the files that make up the shards."""
    schema = "count long, shards array<struct<shard int, count long, files array<struct<file string, count long>>>>"
    listed = spark.read.schema(schema).option("multiLine", "true").json(f"{path}/{MANIFEST}")
    files = listed.select(F.explode("shards").alias("s")).select("s.shard", F.explode("s.files").alias("f"))
    return files.select("shard", "f.file", "f.count")


def read_counted_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the files in the manifest, with their ``shard``; other files are none of them."""
    files = [f"{path}/{r['file']}" for r in read_manifest(spark, path).collect()]
    if not files:
        return spark.createDataFrame([], f"{schema}, shard int")
    rows = spark.read.schema(schema).json(files)
    return rows.withColumn("shard", F.regexp_extract(F.col("_metadata.file_path"), r"shard=(\d+)/[^/]+$", 1).cast("int"))
