"""Best-fit-decreasing packing of token sequences.

Best fit sees nothing of a piece but its length, so the whole corpus is packed
from its histogram of lengths, which has at most ``capacity`` entries: the
driver runs the algorithm on runs of equal pieces, with a segment tree over
remaining capacities that finds the tightest open bin in logarithmic time.
The result is a table of moves (pieces of length x with ranks r to s go to
bins b, b+1, ... at an offset); executors rank their pieces within each
length and look their place up.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import materialize
from .workers import cache, give_back, only

CAPACITY = 4096
END_ID = 1
#: Distinct space-separated chunks whose ids a Python worker keeps.
CACHE_CHUNKS = 250_000
#: Pieces of one length that one task ranks, about: this many, or this fraction of all pieces if that is more.
RANK_GROUP, RANK_FRACTION = 512, 20_000

_BEYOND_LATIN = re.compile("[İ-\U0010ffff]")
_TAIL = ".,!?;:%*&$#|\"-()[]/"


class ChunkIds(dict):
    """Token ids (little-endian uint32 bytes) of chunks between spaces.

    The tokenizer drops white space and never joins across it, so a text's
    ids are those of its chunks in turn. Letters with a tail of punctuation
    are two pre-tokens and are looked up one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shown = self._byte_letters()
        self.letters = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0x80, 0x130)}

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """Byte-level vocabularies show each byte as a printable letter: printable Latin-1 as itself, the rest from U+0100 on."""
        plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
        others = [b for b in range(256) if b not in set(plain)]
        return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}

    def __missing__(self, chunk: str) -> bytes:
        body = chunk.rstrip(_TAIL)
        if body.isalpha() and body.islower() and not _BEYOND_LATIN.search(body):
            if len(body) < len(chunk):
                ids = self[body] + self[chunk[len(body) :]]
            else:
                mapped = body if body.isascii() else body.translate(self.letters)
                ids = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        else:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not _BEYOND_LATIN.search(text):
            text = text.lower()  # what the tokenizer does itself, so that fewer chunks differ
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_ids: dict[str, ChunkIds] = cache({})


def chunk_ids(path: str) -> ChunkIds:
    """One cache a worker process and tokenizer file."""
    only(_ids)
    if path not in _ids:
        _ids[path] = ChunkIds(path)
    return _ids[path]


class TightestBin:
    """Segment tree over remaining capacities 0..capacity: which have an open bin."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.bins: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]

    def put(self, left: int, first_bin: int, count: int) -> None:
        """Bins first_bin, first_bin + 1, ... have ``left`` tokens free."""
        if count:
            self.bins[left].append((first_bin, count))
            self._mark(left)

    def take(self, left: int) -> tuple[int, int]:
        run = self.bins[left].popleft()
        self._mark(left)
        return run

    def _mark(self, left: int) -> None:
        node = left + self.leaves
        self.any[node] = bool(self.bins[left])
        while node > 1:
            node >>= 1
            self.any[node] = self.any[2 * node] | self.any[2 * node + 1]

    def tightest(self, need: int) -> int | None:
        """Smallest remaining capacity of at least ``need`` that an open bin has."""
        node = need + self.leaves
        if self.any[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                break
            node >>= 1
        if node <= 1:
            return None
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Moves (length, first rank, pieces a bin, first bin, offset), by length and rank.

    After one piece has gone to the tightest bin, that bin is the tightest for
    the next equal piece as long as it holds one. So equal pieces fill bin
    after bin of a run, as many as go in, and a run costs one step.
    """
    tree, moves, bins = TightestBin(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit")
        while left:
            free = tree.tightest(length)
            if free is None:
                free, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = tree.take(free)
            each = free // length
            full = min(count, left // each)
            if full:
                moves.append((length, rank, each, first, capacity - free))
                tree.put(free - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < count:  # fewer are left than one bin takes
                moves.append((length, rank, left, first + full, capacity - free))
                tree.put(free - left * length, first + full, 1)
                left, full = 0, full + 1
            tree.put(free, first + full, count - full)
    return moves


def tokenize_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids): each document's ids, then ``end_id``, cut after every ``capacity``."""
    ship(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = chunk_ids(tokenizer).encode
        for batch in batches:
            ids, starts, lengths, crcs, pieces, tokens = [], [], [], [], [], []
            for key, body in zip(batch["id"], batch["body"]):
                data = encode(body) + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    ids.append(key)
                    pieces.append(piece)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    if with_ids:
                        tokens.append(np.frombuffer(part, "<u4").astype(np.int32))
            out = {"id": pd.Series(ids, dtype=batch["id"].dtype), "piece": np.array(pieces, np.int32), "start": np.array(starts, np.int64), "length": np.array(lengths, np.int64), "ids_crc32": np.array(crcs, np.int64)}
            yield pd.DataFrame(out | ({"ids": tokens} if with_ids else {}))
        give_back()

    return rows.mapInPandas(run, schema)


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Where each piece goes: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece with just ``end_id``. Longer documents
    are cut; nothing is dropped. Rows with equal ids are packed one by one.
    An empty table gives an empty result.
    """
    pieces = materialize(tokenize_pieces(df, tokenizer, id_col, text_col, capacity=capacity, end_id=end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    moves = np.array(best_fit_decreasing(histogram, capacity) or np.zeros((0, 5)), dtype=np.int64)
    moves = moves[np.lexsort((moves[:, 1], moves[:, 0]))]
    # Bounded by the capacity: a length takes from each run of bins once and splits at most one.
    plan = df.sparkSession.sparkContext.broadcast(moves)

    groups = -(-max(histogram.values(), default=0) // max(RANK_GROUP, sum(histogram.values()) // RANK_FRACTION))
    ranked = pieces.withColumn("part", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(max(1, groups))))
    sizes = ranked.groupBy("length", "part").count()
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")
    ranked = ranked.join(offsets, ["length", "part"]).withColumn("rank", F.col("ahead") + F.row_number().over(within) - 1)
    kind = dict(pieces.dtypes)["id"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = plan.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            move = table[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            step = rank - move[:, 1]
            batch["sequence_id"] = move[:, 3] + step // move[:, 2]
            batch["offset"] = move[:, 4] + step % move[:, 2] * length
            yield batch.drop(columns="rank")

    placed = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(
        place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return placed.withColumnRenamed("id", id_col)


def packed_sequences(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The sequences themselves: sequence_id, ids, and the documents in them with their offsets.

    Ids must be unique here: pieces are joined to their places by id.
    """
    placed = pack_documents(df, tokenizer, id_col, text_col, capacity=capacity, end_id=end_id)
    pieces = tokenize_pieces(df, tokenizer, id_col, text_col, capacity=capacity, end_id=end_id, with_ids=True).select(F.col("id").alias(id_col), "piece", "ids")
    one = F.struct("offset", F.col(id_col).alias("id"), "piece", "length", "ids")
    return (
        placed.join(pieces, [id_col, "piece"])
        .groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(one)).alias("parts"))
        .select(
            "sequence_id",
            F.flatten(F.col("parts.ids")).alias("ids"),
            F.transform("parts", lambda p: F.struct(p["id"].alias("id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("documents"),
        )
    )
