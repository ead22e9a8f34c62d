"""Repeated passages by relative Lempel-Ziv parsing against an index of reference blocks.

Words are duplicates when they lie in a ``window``-word window that starts in a
document with a smaller id.

1. Reference blocks. In each stretch of ``window`` words the ``anchor``-word
   run with the smallest hash is an anchor (winnowing). Equal windows have
   equal anchors at equal places, so only windows whose anchor occurs in two
   documents can repeat. Of those, the ones that no document with a smaller id
   has make up the reference: stretches of them are the blocks.
2. Index. Each window of the reference is indexed by its hash, with its
   document and place. Within a chunk of documents later holders of a window
   are settled on the spot, against the chunk's own first holder, so a passage
   that is in very many documents is sent once per chunk.
3. Parsing. A window occurs once in the reference, so the greedy parse of a
   document needs no choice: from the first window that has an entry the
   factor is extended as long as the reference block goes on alike. Factors
   shorter than a window are literals. The windows across a factor's end are
   looked up too, so the next factor may begin inside it. The words of all
   factors are the duplicates.

Documents with the same words as an earlier one are one factor each and take
no part. Hashes of windows have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import hot_keys, materialize, salted_join, text_hash
from .wordhash import run_hashes, word_hashes

WINDOW_WORDS = 50
ANCHOR_WORDS = 10
#: Windows of a chunk of documents that are settled together in a worker.
CHUNK_WINDOWS = 1_000_000
_SEGMENT = 1 << 20
_LOW = np.uint64(_SEGMENT * 2 - 1)


def split_words(text: str) -> list[bytes]:
    """Words between ASCII white space, unchanged, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _sliding_argmin(key: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest (leftmost of equal) value in each run of ``width``."""
    out = []
    for first in range(0, len(key) - width + 1, _SEGMENT):
        part = key[first : first + _SEGMENT + width - 1]
        tagged = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        low, span = tagged, 1
        while 2 * span <= width:
            low, span = np.minimum(low[:-span], low[span:]), 2 * span
        if span < width:
            n = len(part) - width + 1
            low = np.minimum(low[:n], low[width - span : width - span + n])
        out.append((low & _LOW).astype(np.int64) + first)
    return np.concatenate(out)


def anchors(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each anchor-word run, and for each window the place of its anchor."""
    runs = run_hashes(hashes, anchor)
    return runs, _sliding_argmin(runs, window - anchor + 1)


def factors(source: np.ndarray, place: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy parse: (first word, end, source document, first word there) of each factor.

    ``source`` and ``place`` say where the reference has each window of the
    document; a negative place: nowhere. A factor goes on while the next window
    is the next one of the same reference block.
    """
    at = np.flatnonzero(place >= 0)
    if not len(at):
        return []
    on = (np.diff(at) == 1) & (source[at[1:]] == source[at[:-1]]) & (np.diff(place[at]) == 1)
    begin = np.concatenate([[0], np.flatnonzero(~on) + 1])
    last = np.concatenate([begin[1:], [len(at)]]) - 1
    return [(int(at[b]), int(at[e]) + window, int(source[at[b]]), int(place[at[b]])) for b, e in zip(begin, last)]


def merged(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Stretches (first word, end) that factors cover; those that overlap or touch are one."""
    spans: list[tuple[int, int]] = []
    for first, end, *_ in found:
        if spans and first <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((first, end))
    return spans


def _scan(df: DataFrame, window: int, anchor: int) -> DataFrame:
    """id, h, n_words, words_sha256 (words joined by one space), distinct anchors of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, shas, found = [], [], []
            for body in batch["body"]:
                words = split_words(body)
                n.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if len(words) < window:
                    found.append(np.zeros(0, np.int64))
                else:
                    runs, place = anchors(word_hashes(words), window, anchor)
                    found.append(np.unique(runs[np.unique(place)]).astype(np.int64))
            yield pd.DataFrame({"id": batch["id"], "h": batch["h"], "n_words": np.array(n, np.int64), "words_sha256": shas, "anchors": found})

    return df.mapInPandas(run, "id long, h long, n_words long, words_sha256 string, anchors array<long>")


def _index_rows(candidates: DataFrame, window: int, anchor: int) -> DataFrame:
    """Rows (id, hash, place) for the index, and rows (id, settled) of windows that repeat within a chunk.

    ``settled`` holds runs of windows as first, end, source document, first word there, ...
    """

    def chunk_rows(chunk: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        ids = np.repeat(np.array([i for i, _, _ in chunk], np.int64), [len(h) for _, h, _ in chunk])
        hashes = np.concatenate([h for _, h, _ in chunk])
        places = np.concatenate([p for _, _, p in chunk])
        order = np.lexsort((places, ids, hashes))
        h, i, p = hashes[order], ids[order], places[order]
        starts = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(starts) - 1
        first_id, first_place = i[starts][group], p[starts][group]
        own = i == first_id
        out = [pd.DataFrame({"id": i[starts], "hash": h[starts].astype(np.int64), "place": p[starts], "settled": None})]
        if not own.all():
            li, lp, ls, lq = i[~own], p[~own], first_id[~own], first_place[~own]
            order = np.lexsort((lp, li))
            li, lp, ls, lq = li[order], lp[order], ls[order], lq[order]
            on = (li[1:] == li[:-1]) & (lp[1:] == lp[:-1] + 1) & (ls[1:] == ls[:-1]) & (lq[1:] == lq[:-1] + 1)
            begin = np.concatenate([[0], np.flatnonzero(~on) + 1])
            end = np.concatenate([begin[1:], [len(lp)]]) - 1
            runs = np.stack([lp[begin], lp[end] + 1, ls[begin], lq[begin]], axis=1)
            cut = np.flatnonzero(np.concatenate([[True], np.diff(li[begin]) != 0]))
            out.append(pd.DataFrame({"id": li[begin][cut], "hash": None, "place": None, "settled": [r.ravel() for r in np.split(runs, cut[1:])]}))
        return pd.concat(out, ignore_index=True).astype({"hash": "Int64", "place": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, held = [], 0
        for batch in batches:
            for key, body, shared in zip(batch["id"], batch["body"], batch["shared"]):
                hashes = word_hashes(split_words(body))
                if len(hashes) < window:
                    continue
                runs, place = anchors(hashes, window, anchor)
                hit = np.isin(runs.astype(np.int64), np.asarray(shared, np.int64))
                at = np.flatnonzero(hit[place])
                if len(at):
                    chunk.append((key, run_hashes(hashes, window)[at], at))
                    held += len(at)
                if held >= CHUNK_WINDOWS:
                    yield chunk_rows(chunk)
                    chunk, held = [], 0
        if chunk:
            yield chunk_rows(chunk)

    return candidates.select("id", "body", "shared").mapInPandas(run, "id long, hash long, place long, settled array<long>")


def _parse(flagged: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """Factors, the stretches they cover and what is left of each document with repeating windows."""

    def looked_up(hashes: np.ndarray, index: np.ndarray, sources: np.ndarray, places: np.ndarray, settled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        source, place = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int64)
        if len(index):
            order = np.argsort(index)
            at = order[np.minimum(np.searchsorted(index, hashes, sorter=order), len(index) - 1)]
            hit = index[at] == hashes
            source[hit], place[hit] = sources[at[hit]], places[at[hit]]
        for first, end, document, there in settled.reshape(-1, 4):
            source[first:end], place[first:end] = document, np.arange(there, there + end - first)
        return source, place

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, body, *entries in zip(batch["id"], batch["body"], batch["hashes"], batch["sources"], batch["places"], batch["settled"]):
                words = split_words(body)
                whole = hashlib.sha256(b" ".join(words)).hexdigest()
                hashes = run_hashes(word_hashes(words), window).astype(np.int64)
                found = factors(*looked_up(hashes, *(np.asarray(e, np.int64) for e in entries)), window)
                spans = merged(found)
                kept, at = [], 0
                for first, end in spans:
                    kept += words[at:first]
                    at = end
                left = b" ".join(kept + words[at:])
                removed = sum(e - f for f, e in spans)
                rows.append(
                    (key, whole, removed, hashlib.sha256(left).hexdigest(), [x for s in spans for x in s], [x for f in found for x in f], left.decode("utf-8", "surrogatepass") if keep_text else None)
                )
            yield pd.DataFrame(rows, columns=["f_id", "f_sha", "removed", "left_sha256", "spans", "factors", "left"])

    columns = flagged.select("id", "body", "hashes", "sources", "places", "settled")
    return columns.mapInPandas(run, "f_id long, f_sha string, removed long, left_sha256 string, spans array<int>, factors array<long>, left string")


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW_WORDS, anchor: int = ANCHOR_WORDS, keep_text: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, spans, factors, and kept_text if asked for.

    A word is removed when it lies in ``window`` consecutive words that also
    start in a document with a smaller id; all windows are judged on the
    input. ``spans`` holds the removed stretches as first word, end, first
    word, end, ...; ``factors`` what they were made of, as first word, end,
    the document that has the same words (always one with a smaller id) and
    the first word there, ... A null text has no words; texts shorter than a window lose
    nothing. Ids are integers; rows that share an id never count as each other's
    duplicates, and a row with a null id neither loses words nor takes any
    away. An empty table gives an empty result.
    """
    if not 0 < anchor <= window:
        raise ValueError("an anchor must fit into a window")
    ship(df.sparkSession)
    body = F.coalesce(F.col(text_col), F.lit(""))
    bodies = df.select(F.col(id_col).cast("long").alias("id"), text_hash(body).alias("h"), body.alias("body"))
    scanned = materialize(_scan(bodies, window, anchor), "passage-scan")

    # Rows that cannot be copies (empty ones above all) meet nobody.
    long_enough = (F.col("n_words") >= window) & F.col("id").isNotNull()
    long_rows = scanned.where(long_enough)
    repeated = long_rows.groupBy("words_sha256").agg(F.min("id").alias("original"), F.max("id").alias("last"), F.count("*").alias("n")).where("original < last")
    repeated = materialize(repeated.select("words_sha256", "original", "n"), "passage-copies")
    hot = hot_keys(repeated, ["words_sha256"], "n", scanned.count())
    told = salted_join(long_rows, repeated.drop("n"), ["words_sha256"], hot, "left", ["id"]).unionByName(scanned.where(~F.coalesce(long_enough, F.lit(False))), allowMissingColumns=True)
    marked = told.withColumn("copy", F.coalesce(F.col("id") > F.col("original"), F.lit(False)))

    postings = marked.where("NOT copy AND id IS NOT NULL").select("id", F.explode("anchors").alias("anchor"))
    shared = postings.groupBy("anchor").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("first < last")
    shared = materialize(shared.select("anchor", "n"), "passage-anchors")
    total = shared.agg(F.sum("n")).first()[0] or 0
    wanted = salted_join(postings, shared.select("anchor"), ["anchor"], hot_keys(shared, ["anchor"], "n", total), "inner", ["id"]).groupBy("id").agg(F.collect_set("anchor").alias("shared"))
    candidates = materialize(bodies.drop("h").join(wanted, "id"), "passage-candidates")

    # A chunk of documents has one row per window, so a window that all documents have meets in one task once per chunk.
    rows = materialize(_index_rows(candidates, window, anchor), "passage-index")
    by_hash = Window.partitionBy("hash")
    first = F.min(F.struct("id", "place")).over(by_hash)
    later = rows.where("hash IS NOT NULL").select("id", "hash", first.alias("first")).where("id > first.id")
    later = later.groupBy("id").agg(F.collect_list(F.struct("hash", F.col("first.id").alias("source"), F.col("first.place").alias("place"))).alias("index"))
    settled = rows.where("settled IS NOT NULL").groupBy("id").agg(F.flatten(F.collect_list("settled")).alias("settled"))
    no_longs = F.array().cast("array<bigint>")
    entry = lambda name: F.coalesce(F.col("index")[name], no_longs)
    flags = later.join(settled, "id", "full_outer").select("id", entry("hash").alias("hashes"), entry("source").alias("sources"), entry("place").alias("places"), F.coalesce("settled", no_longs).alias("settled"))
    parsed = _parse(candidates.select("id", "body").join(flags, "id"), window, keep_text).dropDuplicates(["f_id", "f_sha"])

    result = marked.join(parsed, (F.col("id") == F.col("f_id")) & (F.col("words_sha256") == F.col("f_sha")) & ~F.col("copy"), "left")
    none = F.array().cast("array<int>")
    n, zero = F.col("n_words"), F.lit(0).cast("long")
    columns = [
        F.col("id").alias(id_col),
        "n_words",
        F.when(F.col("copy"), n).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("left_sha256", "words_sha256")).alias("kept_sha256"),
        F.when(F.col("copy"), F.array(F.lit(0), n.cast("int"))).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(F.col("copy"), F.array(zero, n, F.col("original"), zero)).otherwise(F.coalesce("factors", no_longs)).alias("factors"),
    ]
    if keep_text:
        texts = bodies.select(F.col("id").alias("t_id"), F.col("h").alias("t_h"), "body").dropDuplicates(["t_id", "t_h"])
        result = result.join(texts, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("h") == F.col("t_h")), "left")
        columns.append(F.when(F.col("copy"), "").otherwise(F.coalesce("left", "body")).alias("kept_text"))
    return result.select(*columns)
