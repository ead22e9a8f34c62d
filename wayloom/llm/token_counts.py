"""Token counts under a unigram model, by dynamic programming over a trie.

Pre-tokens are the runs of anything but ASCII white space, each with the
vocabulary's word mark in front. The distinct unseen pre-tokens of a block of
texts form a trie: sorted, they are its leaves in depth-first order, and the
path from the root to the current node is the only part held in memory.
A node's forward score (best log-probability of a segmentation of its prefix)
depends on the prefix alone, so it is computed once however many pre-tokens
share the prefix; a terminal stores its token count.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

WORD_MARK = "▁"
#: Characters of text whose unseen pre-tokens go into one trie.
BLOCK_CHARS = 2_000_000
#: Terminal counts that a Python worker keeps.
CACHE_WORDS = 600_000
#: What each byte of a character outside the vocabulary costs beyond the rarest piece.
UNKNOWN_PENALTY = 10.0


class Unigram:
    """Pieces of a public vocabulary with log-probabilities from their rank.

    The vocabulary files hold merge ranks, not probabilities, and nothing is
    trained here, so Zipf's law gives them: the piece of rank r has a
    log-probability of ``-log(r + shift)``.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY

    @classmethod
    def from_sentencepiece(cls, path: str, shift: float = 1.0) -> "Unigram":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        return cls({model.id_to_piece(i): -math.log(rank + shift) for rank, i in enumerate(usual, 1)})

    def terminal_counts(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens of each word on its best path; of equal paths the one with fewer tokens."""
        scores, longest, unknown = self.scores, self.longest, self.unknown
        find, found = scores.get, {}
        best, used = [0.0], [0]
        path = ""
        for word in sorted(words):
            marked = WORD_MARK + word
            shared, most = 0, min(len(path), len(marked))
            while shared < most and path[shared] == marked[shared]:
                shared += 1
            del best[shared + 1 :], used[shared + 1 :]
            for end in range(shared + 1, len(marked) + 1):
                size = len(marked[end - 1].encode("utf-8", "surrogatepass"))
                top, n = best[end - 1] + size * unknown, used[end - 1] + size
                for start in range(max(0, end - longest), end):
                    score = find(marked[start:end])
                    if score is not None:
                        score += best[start]
                        if score > top or (score == top and used[start] + 1 < n):
                            top, n = score, used[start] + 1
                best.append(top)
                used.append(n)
            path = marked
            found[word] = used[-1]
        return found


_models: dict[tuple[str, float], tuple[Unigram, dict[str, int]]] = {}


def _counter(path: str, shift: float) -> tuple[Unigram, dict[str, int]]:
    if (path, shift) not in _models:
        _models[path, shift] = (Unigram.from_sentencepiece(path, shift), {})
    return _models[path, shift]


def _blocks(texts: Iterable[str]) -> Iterator[list[list[bytes]]]:
    """Words of whole texts, a block of texts at a time. Bytes split at ASCII white space only."""
    block, chars = [], 0
    for text in texts:
        block.append((text or "").encode("utf-8", "surrogatepass").split())
        chars += len(text or "")
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, shift: float = 1.0) -> DataFrame:
    """id, n_words, n_tokens of every row of ``df``, in one pass without a shuffle.

    A null, empty or blank text has no words and no tokens. Characters that no
    piece covers count as their UTF-8 bytes. Repeated rows are counted one by
    one. Other columns are not read.
    """
    ship(df.sparkSession)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = _counter(model_path, shift)
        for batch in batches:
            n_words, n_tokens = [], []
            for block in _blocks(batch["body"]):
                fresh = set().union(*block).difference(known)
                if len(known) + len(fresh) > CACHE_WORDS:
                    known.clear()
                    fresh = set().union(*block)
                spelled = {w.decode("utf-8", "surrogatepass"): w for w in fresh}
                known.update((spelled[w], n) for w, n in model.terminal_counts(spelled).items())
                n_words += map(len, block)
                n_tokens += (sum(map(known.__getitem__, words)) for words in block)
            yield pd.DataFrame({"id": batch["id"], "n_words": np.array(n_words, np.int64), "n_tokens": np.array(n_tokens, np.int64)})

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return rows.mapInPandas(run, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
