"""Hard negatives by distributed radix selection.

A window is what one anchor and one positive ask for: rows of another label
whose score lies in a range below the positive's. The k best rows of every
window are selected without sorting or gathering scores: each task counts the
scores of its rows in buckets of the window's range, the counts are added up,
the bucket that holds the k-th score becomes the next range, and so on digit
by digit until a range is one score wide. Then one last pass gathers the rows
that reach it. The positives of an anchor are selected in the same way.

Rows lie in blocks that are multiplied with a round of anchors at a time. A
round is bounded in bytes, so what is sent to tasks does not grow with the
table; the number of rounds does, as every anchor has to meet every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import materialize

#: Rows of a block, at most, and the bytes of its numbers.
BLOCK_ROWS, BLOCK_BYTES = 2048, 8 << 20
#: Anchors of a round, about, and the bytes of their numbers.
ROUND_ANCHORS, ROUND_BYTES = 4096, 16 << 20
#: Bits of a digit: a window's range is counted in so many (as a power of two) buckets.
DIGIT_BITS = 11
#: Floating-point products of whole numbers are exact below this, and scores have to stay below the second number.
EXACT, LARGEST = 2**53, 2**62
#: Stands for a null id, which ranks after all others.
NO_ID = 2**63 - 1

_BLOCK = "dim int, rows binary, ids binary, labels binary, numbers binary, most double"


def _blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pd.DataFrame]:
    """Rows (row, id, label, vector) packed into blocks of equal dimension."""
    open_blocks: dict[int, list] = {}

    def packed(dim: int, held: list) -> pd.DataFrame:
        rows, ids, labels, numbers = zip(*held)
        numbers = np.stack(numbers) if dim else np.zeros((len(rows), 0))
        most = float(np.abs(numbers).max(initial=0.0))
        if most >= LARGEST:
            raise ArithmeticError("a component is too large for whole-number scores")
        kind = next(k for k in (np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
        columns = [[dim], [np.array(rows, "<i8").tobytes()], [np.array(ids, "<i8").tobytes()], [np.array(labels, "<i8").tobytes()], [numbers.astype(kind).tobytes()], [most]]
        return pd.DataFrame(dict(zip(("dim", "rows", "ids", "labels", "numbers", "most"), columns)))

    for batch in batches:
        rows, ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        vectors = batch.column(3)
        flat, starts = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64), vectors.offsets.to_numpy()
        with np.errstate(over="ignore"):
            flat = np.floor(scale * flat)
        for k in range(batch.num_rows):
            vector = flat[starts[k] : starts[k + 1]]
            held = open_blocks.setdefault(len(vector), [])
            held.append((rows[k], ids[k], labels[k], vector.copy()))
            if len(held) >= BLOCK_ROWS or len(held) * max(1, len(vector)) * 8 >= BLOCK_BYTES:
                yield packed(len(vector), open_blocks.pop(len(vector)))
        while sum(len(held) * max(1, dim) * 8 for dim, held in open_blocks.items()) > 4 * BLOCK_BYTES:  # many dimensions are open
            dim = max(open_blocks, key=lambda d: len(open_blocks[d]) * max(1, d))
            yield packed(dim, open_blocks.pop(dim))
    for dim, held in open_blocks.items():
        yield packed(dim, held)


def _unpack(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows, ids, labels = (np.frombuffer(x, "<i8") for x in (block.rows, block.ids, block.labels))
    width = len(block.numbers) // max(1, len(rows) * block.dim)
    numbers = np.frombuffer(block.numbers, f"<i{width or 2}").reshape(len(rows), block.dim)
    return rows, ids, labels, numbers


class Anchors:
    """The anchors of a round: row, label and numbers of each, the latter padded to the longest."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray):
        self.rows, self.ids, self.labels, self.numbers = rows, ids, labels, numbers
        self.most = float(np.abs(numbers).max(initial=0))

    def scores(self, numbers: np.ndarray, most: float) -> np.ndarray:
        """Inner products, anchors by rows, exactly; a shorter vector counts as padded with zeros."""
        dim = min(numbers.shape[1], self.numbers.shape[1])
        bound = self.most * most * max(1, dim)
        kind = np.float64 if bound < EXACT else np.int64
        return (self.numbers[:, :dim].astype(kind) @ numbers[:, :dim].astype(kind).T).astype(np.int64)


class Windows:
    """Windows over scores: anchor (place in the round), whether rows share its label, and a range of scores."""

    def __init__(self, anchor: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray):
        self.anchor, self.same, self.low, self.high = anchor, same, low, high

    def narrowed(self, low: np.ndarray, high: np.ndarray) -> Windows:
        return Windows(self.anchor, self.same, low, high)

    def rows_of(self, anchors: Anchors, rows: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window, places in the block, their scores) of the rows in each window's range."""
        before, places, of = -1, None, None
        for w, (j, low, high) in enumerate(zip(self.anchor.tolist(), self.low.tolist(), self.high.tolist())):
            if j != before:
                like = labels == anchors.labels[j]
                places = np.flatnonzero(like & (rows != anchors.rows[j]) if self.same else ~like)
                before, of = j, scores[j, places]
            if low <= high:
                inside = (of >= low) & (of <= high)
                if inside.any():
                    yield w, places[inside], of[inside]


def _count(blocks: DataFrame, anchors: Anchors, windows: Windows, shifts: np.ndarray, k: int) -> DataFrame:
    """(w, bucket, n): rows of each window by their distance below its upper end, in units of two to its shift.

    A task leaves out what lies below its own k-th best row, as that can't be
    among the k best of all: at most k buckets of a window are sent on.
    """
    sc = blocks.sparkSession.sparkContext
    sent = sc.broadcast((anchors, windows, shifts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors, windows, shifts = sent.value
        found: dict[int, dict[int, int]] = {}
        for batch in batches:
            for block in batch.itertuples():
                rows, _, labels, numbers = _unpack(block)
                for w, _, of in windows.rows_of(anchors, rows, labels, anchors.scores(numbers, block.most)):
                    held = found.setdefault(w, {})
                    for bucket, n in zip(*(x.tolist() for x in np.unique((windows.high[w] - of) >> shifts[w], return_counts=True))):
                        held[bucket] = held.get(bucket, 0) + n
                    if len(held) > k:
                        _trim(held, k)
        out = [(w, bucket, n) for w, held in found.items() for bucket, n in _trim(held, k).items()]
        yield pd.DataFrame(out, columns=["w", "bucket", "n"]).astype({"w": "int64", "bucket": "int64", "n": "int64"})

    return blocks.mapInPandas(run, "w long, bucket long, n long").groupBy("w", "bucket").agg(F.sum("n").alias("n"))


def _trim(held: dict[int, int], k: int) -> dict[int, int]:
    """Only the first buckets that hold k rows together."""
    total = 0
    for bucket in sorted(held):
        if total >= k:
            del held[bucket]
        else:
            total += held[bucket]
    return held


def select_best(blocks: DataFrame, anchors: Anchors, windows: Windows, k: int) -> DataFrame:
    """(w, rank, id, score): the k best rows of each window, by score downwards and id upwards."""
    low, high, below = windows.low.copy(), windows.high.copy(), np.zeros(len(windows.low), np.int64)
    done = low > high
    while not done.all():
        width = np.where(done, 0, high - low)
        bits = np.array([int(x).bit_length() for x in width.tolist()])
        shifts = np.maximum(bits - DIGIT_BITS, 0)
        active = windows.narrowed(np.where(done, 1, low), np.where(done, 0, high))
        upto = F.sum("n").over(Window.partitionBy("w").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        # ``below`` rows lie above the range already; the k-th is in the first bucket that completes them.
        lacking = blocks.sparkSession.createDataFrame(pd.DataFrame({"w": np.flatnonzero(~done), "lacking": k - below[~done]}))
        located = (
            _count(blocks, anchors, active, shifts, k)
            .withColumn("upto", upto)
            .join(F.broadcast(lacking), "w")  # a round's windows
            .where("upto >= lacking")
            .groupBy("w")
            .agg(F.min(F.struct("bucket", "n", "upto")).alias("at"))
            .select("w", "at.*")
            .collect()
        )
        hit = np.zeros(len(done), bool)
        for r in located:
            w, top = r["w"], int(high[r["w"]])
            hit[w] = True
            below[w] += r["upto"] - r["n"]
            high[w] = top - (r["bucket"] << int(shifts[w]))
            low[w] = max(int(low[w]), int(high[w]) - (1 << int(shifts[w])) + 1)
        done |= ~hit | (low >= high)  # fewer than k rows in all, or one score
    return _gather(blocks, anchors, windows.narrowed(low, windows.high), k)


def _gather(blocks: DataFrame, anchors: Anchors, windows: Windows, k: int) -> DataFrame:
    """The k best rows of windows that reach down to the k-th score; a task sends on k of them at most."""
    sent = blocks.sparkSession.sparkContext.broadcast((anchors, windows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors, windows = sent.value
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block in batch.itertuples():
                rows, ids, labels, numbers = _unpack(block)
                for w, places, of in windows.rows_of(anchors, rows, labels, anchors.scores(numbers, block.most)):
                    of, of_ids = (np.concatenate(x) for x in zip((of, ids[places]), found.get(w, (of[:0], ids[:0]))))
                    best = np.lexsort((of_ids, -of))[:k]
                    found[w] = of[best], of_ids[best]
        columns = [np.repeat(list(found), [len(s) for s, _ in found.values()]), *(np.concatenate(x) for x in zip(*found.values()))] if found else [np.zeros(0, np.int64)] * 3
        yield pd.DataFrame(dict(zip(("w", "score", "id"), columns))).astype("int64")

    best = Window.partitionBy("w").orderBy(F.col("score").desc(), "id")
    rows = blocks.mapInPandas(run, "w long, score long, id long")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("w", "rank", "id", "score")


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    *,
    positives: int = 5,
    negatives: int = 5,
    least: int = 80,
    most: int = 100,
    scale: int = 256,
    round_anchors: int = ROUND_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is an inner product of whole
    numbers. An anchor's positives are the best ``positives`` other rows of
    its label; a pair's negatives are the best ``negatives`` rows of other
    labels with ``least`` * positive_score <= 100 * negative_score <= ``most``
    * positive_score. Equal scores are ranked by smaller ids. All anchors
    (``is_anchor`` over the columns of ``df``) meet all rows.

    Rows without a label or a vector, or with a null or non-finite component,
    take no part; a null id ranks after all others. Vectors of unequal length count as padded with
    zeros. Rows that repeat an id are rows of their own: a repeated anchor is
    an anchor each time, and another copy of it may be its positive. Components
    so large that scores may leave 64 bits are an error. Ids and labels are whole numbers. An empty
    table gives an empty result, as does one without anchors.
    """
    spark = df.sparkSession
    ship(spark)
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks")
    ).where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = materialize(rows, "negative-rows")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, scale):
            yield pa.RecordBatch.from_pandas(block.astype({"dim": "int32"}), preserve_index=False)

    blocks = materialize(rows.select("row", "id", "label", "vector").mapInArrow(pack, _BLOCK), "negative-blocks")
    asking = rows.where("asks")
    sizes = asking.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    each = max(1, min(round_anchors, ROUND_BYTES // (8 * max(1, sizes["dim"] or 1))))
    rounds = -(-sizes["n"] // each)
    found = []
    for r in range(rounds):
        mine = asking.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r).orderBy("row").toArrow()  # a round's anchors
        for at in range(0, mine.num_rows, each):
            found.append(materialize(_round(blocks, mine.slice(at, each), positives, negatives, least, most, scale), "negatives"))
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not found:
        return spark.createDataFrame([], out)
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def _round(blocks: DataFrame, mine: pa.Table, positives: int, negatives: int, least: int, most: int, scale: int) -> DataFrame:
    """The result for some anchors (row, id, label, vector)."""
    spark = blocks.sparkSession
    vectors = [np.floor(scale * np.array(v, np.float64)) for v in mine.column("vector").to_pylist()]
    numbers = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for k, v in enumerate(vectors):
        numbers[k, : len(v)] = v
    if np.abs(numbers).max(initial=0.0) >= LARGEST:
        raise ArithmeticError("a component is too large for whole-number scores")
    anchors = Anchors(*(mine.column(c).to_numpy() for c in ("row", "id", "label")), numbers.astype(np.int64))
    bound = int(blocks.agg(F.max("most")).first()[0] or 0) * int(anchors.most) * max(1, numbers.shape[1])
    if bound >= LARGEST:
        raise ArithmeticError("scores may be too large for 64 bits")
    every = np.arange(len(vectors))
    ends = np.full(len(every), bound, np.int64)
    best = select_best(blocks, anchors, Windows(every, True, -ends, ends), positives).orderBy("w", "rank").toArrow()  # some rows an anchor
    of, ids, scores = (best.column(c).to_numpy().astype(np.int64) for c in ("w", "id", "score"))
    low, high = ([to(s) for s in scores.tolist()] for to in (lambda s: -(-least * s // 100), lambda s: most * s // 100))  # beyond 64 bits on the way
    windows = Windows(of, False, *(np.array([min(max(x, -bound), bound) for x in side], np.int64) for side in (low, high)))
    chosen = select_best(blocks, anchors, windows, negatives)
    pairs = pd.DataFrame({"w": np.arange(len(of)), "anchor_id": anchors.ids[of], "positive_id": ids, "positive_score": scores}).astype("int64")
    pairs = spark.createDataFrame(pairs, "w long, anchor_id long, positive_id long, positive_score long")
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return chosen.join(F.broadcast(pairs), "w").select(  # a round's windows
        known("anchor_id").alias("anchor_id"), known("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
