"""Readers of nested record files."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..folders import written
from ..functions import text
from ..shipping import ship

ENVELOPES = ("records", "episodes", "annotations")


def _type(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


def read_records(spark: SparkSession, path: str | Sequence[str], schema: str, envelopes: Sequence[str] = ENVELOPES) -> DataFrame:
    """Rows of JSON files (``.gz`` too) that hold a list, or a list under the first envelope key that has one.

    A corrupt file gives no rows; ``unreadable`` lists such files. Paths may be
    globs with braces. Each file is one row of one task; ``read_array`` is for
    files too large for that.
    """
    element = T.ArrayType(_type(schema))
    raw = spark.read.text(path, wholetext=True).select("value")
    listed = F.startswith(F.ltrim("value"), F.lit("["))
    keyed = [F.from_json(F.get_json_object("value", f"$.{k}"), element) for k in envelopes]
    rows = F.when(listed, F.from_json("value", element)).otherwise(F.coalesce(*keyed) if keyed else F.lit(None))
    return raw.select(F.inline(rows))


class ArrayParser:
    """Objects of the first list of a JSON text that comes in pieces: a list, or one under an envelope key.

    Only the object that is being read is held. A text may be joined in the
    middle, given what came before: whether that ended within a string, how
    deep it was, how deep the list is (None: it hasn't begun), whether it is
    over. ``continued`` is true until the object that began before is
    complete; it is the first one found, less what came before.
    """

    _TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|"|[{}\[\]]', re.DOTALL)

    def __init__(self, envelopes: Sequence[str] = ENVELOPES, in_string: bool = False, depth: int = 0, list_depth: int | None = None, done: bool = False):
        self.envelopes = envelopes
        self.text, self.at, self.depth = '"' if in_string else "", 0, depth
        self.list_depth, self.done = list_depth, done
        self.continued = not done and list_depth is not None and depth > list_depth + 1
        self.start: int | None = 0 if self.continued else None  # of the object that is being read
        self.key, self.skip = "", int(in_string)

    def feed(self, piece: str) -> list[str]:
        """Objects that this piece completes."""
        found: list[str] = []
        self.text += piece
        while not self.done and (m := self._TOKEN.search(self.text, self.at)):
            token = m.group()
            if token == '"':  # a string that goes on in the next piece
                self.at = m.start()
                break
            self.at = m.end()
            if token[0] == '"':
                if self.list_depth is None and self.depth == 1:
                    self.key = token[1:-1]
            elif token in "[{":
                if token == "[" and self.list_depth is None and (self.depth == 0 or self.depth == 1 and self.key in self.envelopes):
                    self.list_depth = self.depth
                elif token == "{" and self.list_depth is not None and self.depth == self.list_depth + 1:
                    self.start = m.start()
                self.depth += 1
            else:
                self.depth -= 1
                if self.start is not None and token == "}" and self.depth == self.list_depth + 1:
                    found.append(self.text[self.start : self.at])
                    self.start = None
                elif token == "]" and self.depth == self.list_depth:
                    self.done = True
        else:
            self.at = max(self.at, len(self.text))
        cut = self.at if self.start is None else self.start
        self.text, self.at = "" if self.done else self.text[cut:], self.at - cut
        self.start = None if self.start is None else 0
        return found

    def parts(self, piece: str) -> list[tuple[str, int]]:
        """``feed`` with a kind for each text: whole, or the end of an object that began before."""
        found = [(text, WHOLE) for text in self.feed(piece)]
        if found and self.continued:
            found[0] = found[0][0][self.skip :], LAST
            self.continued = False
        return found

    def rest(self) -> list[tuple[str, int]]:
        """What has begun and goes on after the text."""
        if self.start is None:
            return []
        return [(self.text[self.skip :], MIDDLE) if self.continued else (self.text, FIRST)]


#: Kinds of text of an object: all of it, or a part of one that lies in several splits.
WHOLE, FIRST, MIDDLE, LAST = range(4)


class SplitSummary:
    """What a split of a JSON text does to the state of its reader, for both cases: it starts outside (0) or within (1) a string.

    ``odd``: whether strings are open at its end that weren't at its start, or the reverse. For each case: the change
    of depth, its lowest value, and the lists under envelope keys by their depth, with whether they end here.
    """

    def __init__(self, envelopes: Sequence[str] = ENVELOPES):
        keyed = "|".join(re.escape(json.dumps(k, ensure_ascii=False)) for k in envelopes)
        self.token = re.compile((rf'(?:{keyed})\s*:\s*\[|' if keyed else "") + r'\\.|["{}\[\]]', re.DOTALL)
        self.odd, self.depth, self.low, self.lists = False, [0, 0], [0, 0], ({}, {})
        self.bare: bool | None = None  # a list that opens the text

    def feed(self, piece: str) -> None:
        if self.bare is None and piece.strip():
            self.bare = piece.lstrip()[0] == "["
            if self.bare:
                self.lists[0][0] = False
        for m in self.token.finditer(piece):
            token = m.group()
            case = int(self.odd)  # in this case the token is outside strings
            if token == '"':
                self.odd = not self.odd
            elif token[0] == '"':
                self.lists[case].setdefault(self.depth[case], False)
                self.depth[case] += 1
            elif token in "[{":
                self.depth[case] += 1
            elif token[0] != "\\":
                self.depth[case] -= 1
                self.low[case] = min(self.low[case], self.depth[case])
                if token == "]" and self.lists[case].get(self.depth[case]) is False:
                    self.lists[case][self.depth[case]] = True


def _starts(splits: pd.DataFrame) -> pd.DataFrame:
    """The reader's state at the start of each split of a file, from their summaries."""
    out, in_string, depth, list_depth, done = [], False, 0, None, False
    for s in splits.sort_values("block").itertuples():
        out.append((s.file, s.block, in_string, depth, -1 if list_depth is None else list_depth, done))
        case = int(in_string)
        lists = json.loads(s.lists)[case]
        if list_depth is None:
            if s.block == 0 and s.bare:
                list_depth, done = 0, lists["0"]
            elif str(1 - depth) in lists:
                list_depth, done = 1, lists[str(1 - depth)]
        elif not done:
            done = depth + s.low[case] <= list_depth
        depth, in_string = depth + s.depth[case], in_string != s.odd
    return pd.DataFrame(out, columns=["file", "block", "in_string", "depth", "list_depth", "done"])


#: So many splits' states (some bytes each) are sent to the readers; beyond it texts are shuffled to them.
SENT_SPLITS = 300_000


def read_array(spark: SparkSession, path: str | Sequence[str], schema: str, envelopes: Sequence[str] = ENVELOPES) -> DataFrame:
    """Rows of JSON files like those of ``read_records``, however large: no task holds more than some objects at a time.

    Splits of a file are read in parallel, twice. The first pass sums each
    split up (quotes, depth, lists) without knowing whether it starts within a
    string; from that follows the state at its start, with which the second
    pass finds its objects. Parts of an object that lies in several splits are
    put together. Splits end at closing braces, wherever those are; a gzip
    file is one split. Of a file that breaks off, the objects before the break
    are rows (but for one that ends exactly there).
    """
    ship(spark)
    pieces = spark.read.option("lineSep", "}").text(path)
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    pieces = pieces.select(*where, "value", F.monotonically_increasing_id().alias("at"))

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, summary, out = None, SplitSummary(envelopes), []

        def close() -> None:
            if at is not None:
                out.append((*at, summary.odd, bool(summary.bare), summary.depth, summary.low, json.dumps(summary.lists)))

        for batch in batches:
            for file, block, piece in zip(batch["file"], batch["block"], batch["value"]):
                if (file, block) != at:
                    close()
                    at, summary = (file, block), SplitSummary(envelopes)
                    summary.feed("}" + piece if block else piece)
                else:  # the brace that parted this piece from the last one
                    summary.feed("}" + piece)
        close()
        yield pd.DataFrame(out, columns=["file", "block", "odd", "bare", "depth", "low", "lists"])

    sums = pieces.select("file", "block", "value").mapInPandas(sum_up, "file string, block long, odd boolean, bare boolean, depth array<long>, low array<long>, lists string")
    starts = written(sums.groupBy("file").applyInPandas(_starts, "file string, block long, in_string boolean, depth long, list_depth long, done boolean"), "split-starts")
    if starts.count() <= SENT_SPLITS:
        joined = pieces.join(F.broadcast(starts), ["file", "block"], "left")
    else:
        joined = pieces.join(starts, ["file", "block"], "left").sortWithinPartitions("file", "block", "at")
    known = F.when(F.col("depth").isNull(), F.raise_error(F.lit("the files or their splits changed while they were read"))).otherwise(F.col("depth"))
    joined = joined.select("file", "block", "value", "in_string", known.cast("long").alias("depth"), "list_depth", "done")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parser = None, None
        for batch in batches:
            out: list[tuple] = []
            for file, block, piece, in_string, depth, list_depth, done in zip(*(batch[c].tolist() for c in batch.columns)):
                if (file, block) != at:
                    if parser is not None:
                        out += [(*at, *part) for part in parser.rest()]
                    at, parser = (file, block), ArrayParser(envelopes, in_string, depth, None if list_depth < 0 else list_depth, done)
                    found = parser.parts("}" + piece if block else piece)
                else:
                    found = parser.parts("}" + piece)
                out += [(*at, *part) for part in found]
            yield pd.DataFrame(out, columns=["file", "block", "element", "kind"])
        if parser is not None:
            yield pd.DataFrame([(*at, *part) for part in parser.rest()], columns=["file", "block", "element", "kind"])

    found = written(joined.mapInPandas(run, "file string, block long, element string, kind int"), "split-objects")
    parts = found.where(F.col("kind") != WHOLE).withColumn("turn", (F.col("kind") == FIRST).cast("int"))  # a split ends an object before it begins one
    in_order = Window.partitionBy("file").orderBy("block", "turn").rowsBetween(Window.unboundedPreceding, 0)  # two rows a split at most
    parts = parts.withColumn("object", F.sum("turn").over(in_order)).groupBy("file", "object")
    parts = parts.agg(F.sort_array(F.collect_list(F.struct("block", "turn", "element"))).alias("parts"), F.max("kind").alias("kind")).where(F.col("kind") == LAST)
    elements = found.where(F.col("kind") == WHOLE).select("element").unionByName(parts.select(F.array_join("parts.element", "").alias("element")))
    return elements.select(F.from_json("element", _type(schema)).alias("e")).where("e IS NOT NULL").select("e.*")


def unreadable(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Files whose content isn't JSON."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return raw.where(F.try_parse_json("value").isNull()).select("path")


def read_tagged(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Records of several folders with the folder each came from; missing folders are skipped."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(conf).globStatus(p)
        return found is not None and len(found) > 0

    parts = [read_records(spark, p, schema).withColumn("folder", F.lit(os.path.dirname(p))) for p in paths if there(p)]
    if not parts:
        return spark.createDataFrame([], _type(schema + ", folder string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are skipped. Splits like any text."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, number, line) of every line of text files, from 1 in each file.

    Splits count their lines; what lies before a split is a running sum of
    counts, and a split numbers its own lines as they come. No line is
    shuffled and no file has to pass one task, but for gzip, which has no splits.
    """
    ship(spark)
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    counts = raw.groupBy("path", "block").agg(F.count("*").alias("n"))
    starts = written(counts.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "line-starts")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n = None, 0
        for batch in batches:
            numbers = []
            for split in zip(batch["path"], batch["block"]):
                if split != at:
                    at, n = split, 0
                n += 1
                numbers.append(n)
            yield batch.assign(number=np.array(numbers, np.int64))

    numbered = raw.mapInPandas(number, "path string, block long, line string, number long")
    starts = F.broadcast(starts) if starts.count() <= SENT_SPLITS else starts
    joined = numbered.join(starts, ["path", "block"], "left")
    known = F.when(F.col("before").isNull(), F.raise_error(F.lit("the files or their splits changed while they were read"))).otherwise(F.col("before"))
    return joined.select("path", (known.cast("long") + F.col("number")).alias("number"), "line")


def malformed_lines(spark: SparkSession, path: str | Sequence[str], schema: str, numbers: bool = False) -> DataFrame:
    """Lines that ``read_lines`` skips; with ``numbers`` (path, number, line). Empty ones are none of them."""
    lines = numbered_lines(spark, path) if numbers else spark.read.text(path).select(F.col("value").alias("line"))
    parsed = F.from_json("line", schema + ", __bad string", {"columnNameOfCorruptRecord": "__bad"})
    return lines.where(F.trim("line") != "").where(parsed["__bad"].isNotNull())


def checkpoint_ids(spark: SparkSession, path: str, key: str = "episode_id", kind: str = "string") -> DataFrame:
    return read_lines(spark, path, f"{key} {kind}").where(F.col(key).isNotNull()).distinct()


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """Episodes with an instruction and a goal, and the first goal's position."""
    rows = read_records(spark, path, schemas.EPISODE, ("episodes",))
    said = F.trim(F.coalesce("instruction.instruction_text", F.lit(""))) != ""
    return rows.where(said & (F.size("goals") > 0)).withColumn("goal_position", F.get("goals", F.lit(0))["position"])


def read_language_episodes(spark: SparkSession, path: str, prefix: str = "en") -> DataFrame:
    """Episodes of a language. The goal falls back to the end of the reference path; rotations not of 4 numbers are null."""
    rows = read_records(spark, path, schemas.EPISODE, ("episodes",))
    language = F.lower(F.coalesce("instruction.language", F.lit("")))
    goal = F.coalesce(F.get("goals", F.lit(0))["position"], F.try_element_at("reference_path", F.lit(-1)))
    kept = rows.where(F.startswith(language, F.lit(prefix.lower()))).withColumn("goal_position", goal)
    return kept.withColumn("start_rotation", F.when(F.size("start_rotation") == 4, F.col("start_rotation")))


def with_dataset_index(spark: SparkSession, path: str) -> DataFrame:
    """Episodes with their place in the file and their instruction's tokens."""
    element = T.ArrayType(_type(schemas.EPISODE))
    raw = spark.read.text(path, wholetext=True)
    placed = raw.select(F.posexplode(F.from_json(F.get_json_object("value", "$.episodes"), element)).alias("dataset_index", "e")).select("dataset_index", "e.*")
    return placed.withColumn("words", F.filter(F.split("instruction.instruction_text", r"\s+"), lambda w: w != ""))


def vocabulary(episodes: DataFrame, words: str = "words") -> DataFrame:
    return episodes.select(F.explode(words).alias("word")).distinct().orderBy("word")


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    from ..operators.ordering import take_first

    return take_first(df, [order], n)


def _string(raw: Column) -> Column:
    """The string that raw JSON text of a string stands for; any other text as it is."""
    quoted = F.startswith(raw, F.lit('"')) & F.endswith(raw, F.lit('"'))
    return F.when(quoted, F.coalesce(F.get_json_object(F.concat(F.lit('{"s":'), raw, F.lit("}")), "$.s"), raw)).otherwise(raw)


def union_instruction(raw: Column) -> Column:
    """Instruction given as a string or as an object with instruction_text; raw JSON text of the field, or a plain string."""
    return F.coalesce(F.get_json_object(raw, "$.instruction_text"), F.when(~F.startswith(F.ltrim(raw), F.lit("{")), _string(raw)))


def union_list(raw: Column) -> Column:
    """List of strings given as a list or as one string; raw JSON text of the field, or a plain string, which may start with a bracket."""
    return F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))).when(raw.isNotNull(), F.array(_string(raw)))


def instruction_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(id, instruction) from either envelope: episode_id or id, first instruction, trimmed."""
    rows = read_records(spark, path, "episode_id string, id string, instructions array<string>, instruction string", ("records",))
    said = F.trim(F.coalesce(F.get("instructions", F.lit(0)), F.col("instruction")))
    return rows.select(F.coalesce("episode_id", "id").alias("id"), said.alias("instruction")).where("id IS NOT NULL AND instruction <> ''")


def read_by_suffix(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines if the path says so, else a JSON list."""
    return read_lines(spark, path, schema) if "jsonl" in path else read_records(spark, path, schema)


def flat_episode(rows: DataFrame, instruction_json: str = "instruction") -> DataFrame:
    """Episodes flattened for comparison; the instruction column is raw JSON text of either shape."""
    return rows.select(
        "episode_id",
        text.last_part(F.col("scene_id")).alias("scene"),
        union_instruction(F.col(instruction_json)).alias("instruction"),
        "start_position",
        "start_rotation",
        "goals",
        F.col("info.geodesic_distance").alias("geodesic_distance"),
    )


def load_config(path: str, variables: dict[str, str] | None = None) -> dict:
    """YAML or JSON settings; ``$NAME`` and ``${NAME}`` in strings, at any depth, come from ``variables`` or the environment. Unknown names stay."""
    with open(path, encoding="utf-8") as f:
        body = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        data = yaml.safe_load(body)
    else:
        data = json.loads(body)
    known = os.environ if variables is None else variables

    def expand(value):
        if isinstance(value, str):
            return re.sub(r"\$(?:\{(\w+)\}|(\w+))", lambda m: known.get(m[1] or m[2], m[0]), value)
        if isinstance(value, dict):
            return {k: expand(v) for k, v in value.items()}
        return [expand(v) for v in value] if isinstance(value, list) else value

    return expand(data)
