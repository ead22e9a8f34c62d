"""Alignment of two tokenizers' tokens, and how often the corpus links their ids.

A text's bytes get one label each: no token ends here (n), one of A's does
(a), one of B's does (b), or both do (c). Scanning the labels for ``[^c]*c``
gives the smallest spans that both tokenizers cover exactly, and the counts of
labels in a span say how many tokens of either side make up its group. Every
label but n closes one link, the pair of the tokens that overlap there.

Both tokenizers end a token before a single space between two visible
characters, so a text is the chunks between such spaces, whose tokens, groups
and links don't depend on each other. A worker finds those of a chunk once and
keeps them; new chunks are encoded in runs, as if they were a text, and
labelled about a megabyte at once.

Corpus counts are looked up per block of documents: a block knows its distinct
id pairs, asks for the counts of those, and its documents are summed from the
answers, so no task needs the table of all pairs.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import hot_keys, materialize, salted_join

#: Distinct chunks whose groups and links a worker keeps, about, and the longest that it keeps.
CACHE_CHUNKS, CHUNK_CHARS = 300_000, 64
#: Characters of new chunks that are encoded as one text, about.
RUN_CHARS = 1 << 11
#: Characters of new chunks whose labels are made at a time, about; a longer chunk is labelled alone.
LABEL_CHARS = 1 << 20
#: Links of a block of documents, about; a longer document is a block of its own.
BLOCK_LINKS = 1 << 20
#: Pairs of ids are numbers: A's id times this and B's.
PAIR_BASE = 1 << 32

_SPAN = re.compile(rb"[^c]*c")
_LETTERS = bytes.maketrans(bytes(range(4)), b"nabc")
_ODD = "\\s\\x00-\\x20\\x7f-\\xa0\\xad\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u2581\\u3000\\ufeff"
_ODD_CHAR = re.compile(f"[{_ODD}]")
_BREAK = re.compile(f" (?<=[^{_ODD}] )(?=[^{_ODD}])")


def byte_letters() -> dict[str, int]:
    """The visible letter that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Tokens, groups and links under two tokenizers: ``a`` a byte-level file, ``b`` a piece model with byte fallback."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        letters = byte_letters()
        self.a_bytes = [b""] * (max(self.a.get_vocab(with_added_tokens=True).values()) + 1)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = [np.array([len(t) for t in of], np.int64) for of in (self.a_bytes, self.b_bytes)]
        written = [str(i).encode() + end for of, ends in ((self.a_bytes, (b",", b"|")), (self.b_bytes, (b",", b";"))) for i in range(len(of)) for end in ends]
        self.written = np.array(written, dtype=object)
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces) and self.a.normalizer is None
        self.odd = frozenset(c for c in map(chr, range(1 << 16)) if _ODD_CHAR.match(c))
        self.cache: dict[str, tuple[int, int, int, bytes, bytes] | None] = {}

    def chunks(self, text: str) -> list[str]:
        """Pieces of a text whose tokens don't depend on each other; each follows a space of its own."""
        return _BREAK.split(text) if self.cuts else [text]

    def runs(self, chunks: Sequence[str]) -> Iterator[list[str]]:
        """Chunks that may follow each other in a text, so that a run of them is encoded as one; others alone."""
        run, chars = [], 0
        for c in chunks:
            if not self.cuts or not c or c[0] in self.odd or c[-1] in self.odd or len(c) > CHUNK_CHARS:
                yield [c]
                continue
            run.append(c)
            chars += len(c)
            if chars >= RUN_CHARS:
                yield run
                run, chars = [], 0
        if run:
            yield run

    def encode(self, runs: Sequence[list[str]]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray] | tuple[list[str], None]]:
        """A run's chunks, both sides' ids of space + run and how many ids there are up to the end of each chunk.

        None for a chunk where either side's bytes are not those. A run whose
        bytes differ, or with a chunk whose end is no token's, is encoded chunk by chunk.
        """
        joined = [" ".join(run) for run in runs]
        of_a, alone = [e.ids for e in self.a.encode_batch_fast([" " + t for t in joined], add_special_tokens=False)], []
        for run, text, a, b in zip(runs, joined, of_a, self.b.encode(joined, num_threads=1)):
            data = (" " + text).encode()
            if b"".join([self.a_bytes[i] for i in a]) == data == b"".join([self.b_bytes[i] for i in b]):
                a, b = np.array(a, np.int64), np.array(b, np.int64)
                ends = np.cumsum([len(c) + 1 for c in run] if len(data) == len(text) + 1 else [len(c.encode()) + 1 for c in run])
                ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
                upto_a, upto_b = np.searchsorted(ends_a, ends, side="right"), np.searchsorted(ends_b, ends, side="right")
                if (ends_a[upto_a - 1] == ends).all() and (ends_b[upto_b - 1] == ends).all():
                    yield run, a, b, upto_a, upto_b
                    continue
            if len(run) == 1:
                yield run, None
            else:
                alone += [[c] for c in run]
        if alone:
            yield from self.encode(alone)

    def align(self, chunks: Sequence[str]) -> dict[str, tuple[int, int, int, bytes, bytes] | None]:
        """n_a, n_b, n_groups, groups as text (each with a separator after it) and links as pairs (64-bit) of every chunk; a chunk's end is a common one."""
        out: dict[str, tuple[int, int, int, bytes, bytes] | None] = {}
        there = []
        for run, *found in self.encode(list(self.runs(chunks))):
            if found[0] is None:
                out[run[0]] = None
            else:
                there.append((run, *found))
        if not there:
            return out
        a, b = (np.concatenate([x[side] for x in there]) for side in (1, 2))
        upto_a, upto_b = (np.concatenate([x[side + 2] + n for x, n in zip(there, np.cumsum([0] + [len(x[side]) for x in there]))]) for side in (1, 2))
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        marks = np.zeros(ends_a[-1] + 1, np.uint8)
        marks[ends_a] += 1
        marks[ends_b] += 2
        ends = marks[1:].tobytes().translate(_LETTERS).replace(b"n", b"")  # labels at which a token ends, one link each
        spans = _SPAN.findall(ends)
        kinds = {span: k for k, span in enumerate(set(spans))}
        kind = np.array([kinds[s] for s in spans])
        of_a, of_b = (np.array([span.count(letter) + 1 for span in kinds])[kind] for letter in (b"a", b"b"))
        last_a, last_b = np.cumsum(of_a), np.cumsum(of_b)  # tokens up to the end of each group
        groups = np.searchsorted(last_a, upto_a, side="right")

        written, final = np.empty(len(a) + len(b), np.int64), np.zeros(len(a), np.int64)
        final[last_a - 1] = 1
        written[np.arange(len(a)) + np.repeat(last_b - of_b, of_a)] = 2 * a + final
        final = np.zeros(len(b), np.int64)
        final[last_b - 1] = 1
        written[np.arange(len(b)) + np.repeat(last_a, of_b)] = 2 * (b + len(self.a_bytes)) + final
        text = self.written[written].tolist()

        label = np.frombuffer(ends, np.uint8)
        end_a, end_b = label != ord("b"), label != ord("a")
        links = (a[np.cumsum(end_a) - end_a] * PAIR_BASE + b[np.cumsum(end_b) - end_b]).astype("<i8").tobytes()
        upto = np.stack([upto_a, upto_b, groups])
        n_a, n_b, n_groups = np.diff(upto, prepend=0, axis=1).tolist()
        words, ended = (upto_a + upto_b).tolist(), (8 * (upto_a + upto_b - groups)).tolist()
        word = link = 0
        for c, *numbers, to_word, to_link in zip((c for x in there for c in x[0]), n_a, n_b, n_groups, words, ended):
            out[c] = (*numbers, b"".join(text[word:to_word]), links[link:to_link])
            word, link = to_word, to_link
        return out

    def texts(self, texts: Sequence[str | None]) -> list[tuple[int, int, int, bytes, np.ndarray] | None]:
        """n_a, n_b, n_groups, groups as text and links of each text; None for one without tokens (see the function ``align``)."""
        parts = [self.chunks(text) if text else [] for text in texts]
        known = self.cache
        if len(known) >= CACHE_CHUNKS:
            known.clear()
        part, chars, long = [], 0, []
        for c in set().union(*parts).difference(known):
            part.append(c)
            chars += len(c)
            if len(c) > CHUNK_CHARS:
                long.append(c)
            if chars >= LABEL_CHARS:
                known.update(self.align(part))
                part, chars = [], 0
        known.update(self.align(part))
        out: list[tuple[int, int, int, bytes, np.ndarray] | None] = []
        for chunks in parts:
            found = [known[c] for c in chunks]
            if not found or not all(found):
                out.append(None)
                continue
            n_a, n_b, n_groups, groups, links = zip(*found)
            out.append((sum(n_a), sum(n_b), sum(n_groups), b"".join(groups)[:-1], np.frombuffer(b"".join(links), "<i8")))
        for c in long:
            del known[c]
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """One a worker process and pair of files."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def align(df: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", *, digests: bool = False, links: bool = False, block_links: int = BLOCK_LINKS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links and groups of every row.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3`` (decimal ids in order); with
    ``digests`` it is the SHA-256 of that. Texts that are null, empty, or
    whose tokens' bytes are not a space and the text have no tokens: zeros
    and an empty string. Rows with equal or null ids are rows like others.

    With ``links`` there are also block, links (places of a document's links
    in its block's pairs, 2 or 4 bytes each) and rows with null counts that hold a block's
    distinct pairs and their numbers of links.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    empty = df.sparkSession.createDataFrame([], rows.select("id").schema)
    schema = f"id {empty.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string"
    schema += ", block long, links binary, pairs binary, counts binary" if links else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, block, held, ids, made = aligner(a, b).texts, TaskContext.get().partitionId() << 32, 0, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, held, ids, made
            if not made:
                return
            keys = pa.concat_arrays(ids)
            sizes = np.array([len(m[4]) if m else 0 for m in made])
            columns = [pa.array([m[k] if m else 0 for m in made], pa.int64()) for k in range(3)] + [pa.array(sizes, pa.int64())]
            groups = [(hashlib.sha256(m[3]).hexdigest() if digests else m[3].decode()) if m else "" for m in made]
            columns = [keys, *columns, pa.array(groups, pa.string())]
            names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups"]
            if not links:
                yield pa.RecordBatch.from_arrays(columns, names)
            else:
                pairs, at, counts = np.unique(np.concatenate([m[4] for m in made if m] or [np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
                at = at.astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
                parts = np.split(at, np.cumsum(sizes)[:-1])
                n, none = len(made), lambda kind: pa.nulls(len(made), kind)
                columns += [pa.array([block if s else None for s in sizes], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary()), none(pa.binary()), none(pa.binary())]
                names += ["block", "links", "pairs", "counts"]
                yield pa.RecordBatch.from_arrays(columns, names)
                if len(pairs):
                    last = [pa.nulls(1, c.type) for c in columns]
                    last[6], last[8], last[9] = pa.array([block], pa.int64()), pa.array([pairs.astype("<i8").tobytes()], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays(last, names)
            block, held, ids, made = block + 1, 0, [], []

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            begun = 0
            while begun < len(texts):  # some megabytes of texts at a time
                end, chars = begun, 0
                while end < len(texts) and (end == begun or chars < 2 * LABEL_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                for k, found in enumerate(of(texts[begun:end]), begun):
                    made.append(found)
                    held += len(found[4]) if found else 0
                    ids.append(keys.slice(k, 1))
                    if held >= block_links or len(made) >= 1 << 16:
                        yield from flush()
                begun = end
        yield from flush()

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, pairs, counts) as a row per pair."""
    for batch in batches:
        for block, pairs, counts in zip(*(c.to_pylist() for c in batch.columns)):
            pair, n = np.frombuffer(pairs, "<i8"), np.frombuffer(counts, "<i8")
            for at in range(0, len(pair), 1 << 16):
                part = slice(at, at + (1 << 16))
                here = pair[part]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), block)), pa.array(here), pa.array(n[part]), pa.array(np.arange(at, at + len(here), dtype=np.int32))], ["block", "pair", "n", "at"])


def link_counts(df: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", *, digests: bool = False, block_links: int = BLOCK_LINKS) -> DataFrame:
    """``align`` with n_best and count_sum.

    The count of a pair of ids is the number of links in all texts that hold
    it. ``n_best`` are a document's links whose pair has the highest count of
    its B id (ties included), ``count_sum`` is the sum of its links' counts.
    """
    blocks = materialize(align(df, a, b, id_col, text_col, digests=digests, links=True, block_links=block_links), "align-blocks").withColumnRenamed(id_col, "id")
    asked = materialize(blocks.where("pairs IS NOT NULL").select("block", "pairs", "counts").mapInArrow(_pairs, "block long, pair long, n long, at int"), "align-pairs")
    counts = materialize(asked.groupBy("pair").agg(F.sum("n").alias("total"), F.count("*").alias("blocks")), "align-counts")
    b_id = F.pmod(F.col("pair"), F.lit(PAIR_BASE))
    highest = materialize(counts.groupBy(b_id.alias("b")).agg(F.max("total").alias("most")), "align-highest")  # a row per id of B's vocabulary
    known = materialize(
        counts.withColumn("b", b_id).join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best")), "align-known"
    )
    hot = hot_keys(counts, ["pair"], "blocks", asked.count())
    answers = salted_join(asked.select("block", "at", "pair"), known, ["pair"], hot, spread=["block"]).select("block", "at", "total", "best")

    documents = blocks.where("pairs IS NULL")
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    kind = blocks.schema["id"].dataType.simpleString()

    def sums(docs: pa.Table, found: pa.Table) -> pa.Table:
        at = found.column("at").to_numpy()
        total, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        total[at], best[at] = found.column("total").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
        width = "<u2" if len(at) <= 1 << 16 else "<u4"
        best_of, sum_of = [], []
        for links in docs.column("links"):
            places = np.frombuffer(links.as_buffer(), width)
            best_of.append(int(best[places].sum()))
            sum_of.append(int(total[places].sum()))
        return docs.select(names).append_column("n_best", pa.array(best_of, pa.int64())).append_column("count_sum", pa.array(sum_of, pa.int64()))

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    linked = documents.where("n_links > 0").select(*names, "block", "links").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(sums, schema)
    zero = F.lit(0).cast("long")
    out = linked.unionByName(documents.where("n_links = 0").select(*names, zero.alias("n_best"), zero.alias("count_sum")))
    return out.withColumnRenamed("id", id_col)
