"""Toxicity scores that see through obfuscated spelling.

A noisy channel turns intended words into what is written: letters become
look-alike digits or symbols, are repeated, or are spaced out. Suspicious
spellings become character lattices, and a Viterbi search under a character
trigram model, whose counts come from all documents, restores them. Restored
words and plain ones are then scored by word and word-start weights learned
from labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import materialize
from .sampling import fold, thin

#: Bounds of the labelled sample (toxic and clean rows).
TOXIC_ROWS, CLEAN_ROWS = 8_000, 24_000
#: A lexicon entry occurs in at least so many toxic rows of the sample, and in this share of them; its weight is more than LEAST_WEIGHT.
SUPPORT, SUPPORT_SHARE, LEAST_WEIGHT = 3, 0.001, 1.5
THRESHOLD = 0.5
#: Shortest and longest word starts that have weights.
STARTS = (4, 5, 6)

#: Letters that digits and symbols stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¥": "y", "(": "c", "*": "aeiou",
}
_EDGE = ".,!?;:\"'()[]{}<>|*#%&-_/\\+=~^`…«»“”„‘’"
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!])(?:(?:\s+|[.\-_*·~]{1,2})(?:[^\W_]|[@$!])){2,}(?![^\W_])")
_WIDE = re.compile(r"\s{2,}")
_RUN = re.compile(r"([^\W\d_])\1")
#: Punctuation that may also be a letter, and what stands alone as a word next to a spaced one.
_EITHER = "".join(c for c in _EDGE if c in LOOKALIKES)
_NEVER = "".join(c for c in _EDGE if c not in LOOKALIKES)
_BEFORE, _AFTER = re.compile(f"[{re.escape(_EITHER)}]*$"), re.compile(f"[{re.escape(_EITHER)}]*")
_ALONE = "aeiouyr"
#: A word has at most so many letters, here and in the lexicon; what is longer is no word.
MOST_LETTERS = 64
_REPEATED, _RUNS = re.compile(r"(.)\1+"), re.compile(r"(.)\1*", re.DOTALL)
_ALPHABET = 64  # a..z are 1..26, other letters share 27..63, anything else is 0
_TABLE = np.zeros(0x3000, np.int64)
for _c in range(0x80, 0x3000):
    if chr(_c).isalpha():
        _TABLE[_c] = 27 + _c % 37
for _c in range(26):
    _TABLE[97 + _c] = 1 + _c


def _classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _TABLE[np.minimum(codes, len(_TABLE) - 1)]


def _class(letter: str) -> int:
    return int(_TABLE[min(ord(letter), len(_TABLE) - 1)])


def _blocks(texts: pd.Series, chars: int = 200_000) -> Iterator[np.ndarray]:
    """Classes of whole texts, several to a block. Each text has two blanks before it and one after."""
    parts, held = [], 0
    for text in texts:
        parts.append(_classes(f"  {text.lower()} "))
        held += len(parts[-1])
        if held >= chars:
            yield np.concatenate(parts)
            parts, held = [], 0
    if parts:
        yield np.concatenate(parts)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts of character-class trigrams over all texts: at most 64^3 rows."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_ALPHABET**3, np.int64)
        for batch in batches:
            for c in _blocks(batch["body"]):
                total += np.bincount((c[:-2] * _ALPHABET + c[1:-1]) * _ALPHABET + c[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    bodies = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return bodies.mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _joined(text: tuple | None) -> str:
    parts = []
    while text:
        text, part = text
        parts.append(part)
    return "".join(reversed(parts))


def _cells(written: str) -> list[tuple[str, int]]:
    """Characters and how often each is repeated."""
    return [(m.group(1), m.end() - m.start()) for m in _RUNS.finditer(written)]


class Restorer:
    """Most likely intended spelling of a suspicious one."""

    SWAP, REPEAT, KEEP_SYMBOL = 1.5, 0.7, 9.0  # costs in nats

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        grams = counts.reshape(_ALPHABET, _ALPHABET, _ALPHABET).astype(float)
        pairs, ones = grams.sum(axis=0), grams.sum(axis=(0, 1))
        one = (ones + 1) / (ones.sum() + _ALPHABET)
        two = (pairs + 8 * one) / (pairs.sum(axis=1, keepdims=True) + 8)
        self.cost = -np.log((grams + 4 * two) / (grams.sum(axis=2, keepdims=True) + 4))
        self.seen: dict = {}

    def _forward(self, cells: list[tuple[str, int]], breaks: bool = False) -> Iterator[dict[tuple[int, int], tuple[float, tuple | None]]]:
        """Viterbi over (last two letters), cell by cell: cost and text (linked backwards) of each state.

        A cell is a character and how often it is repeated; a run of a letter may stand for one or two of it.
        """
        beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for c, n in cells:
            options = []
            if c.isalpha():
                options.append((c, 0.0))
            options += [(x, self.SWAP) for x in LOOKALIKES.get(c, "")]
            if not options:
                options = [("", self.KEEP_SYMBOL if c.isalnum() else 0.5)]
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for letter, price in options:
                for times in (1, 2) if n > 1 and letter else (1,):
                    extra = price + (self.REPEAT if times != n else 0.0)
                    for (a, b), (cost, text) in beam.items():
                        x, y, total = a, b, cost + extra
                        for _ in range(times if letter else 0):
                            z = _class(letter)
                            total += self.cost[x, y, z]
                            x, y = y, z
                        if (x, y) not in after or total < after[x, y][0]:
                            after[x, y] = (total, (text, letter * times))
            if breaks:
                for (x, y), (cost, text) in list(after.items()):
                    total = cost + self.cost[x, y, 0]
                    if y and ((y, 0) not in after or total < after[y, 0][0]):
                        after[y, 0] = (total, (text, " "))
            beam = after
            yield beam

    def _best(self, beam: dict[tuple[int, int], tuple[float, tuple | None]], breaks: bool = False) -> str:
        return min((cost + (self.cost[a, b, 0] if b or not breaks else 0.0), _joined(text)) for (a, b), (cost, text) in beam.items())[1]

    def _keep(self, written, value):
        if len(self.seen) > 200_000:
            self.seen.clear()
        self.seen[written] = value
        return value

    def word(self, written: str, breaks: bool = False) -> str:
        """The best spelling. With ``breaks``, blanks may be put between letters."""
        known = f" {written}" if breaks else written
        if known in self.seen:
            return self.seen[known]
        beam = {(0, 0): (0.0, None)}
        for beam in self._forward(_cells(written), breaks):
            pass
        return self._keep(known, self._best(beam, breaks))

    def stretches(self, written: str, least: int, first: int, last: int) -> set[str]:
        """The best spelling of every stretch that leaves out up to ``first`` cells in front and ``last`` at the end.

        A stretch has from ``least`` to MOST_LETTERS cells. One pass from each
        start gives all its ends, so this takes time in proportion to the cells.
        """
        known = (written, least, first, last)
        if known in self.seen:
            return self.seen[known]
        cells, out = _cells(written), set()
        for start in range(max(0, len(cells) - last - MOST_LETTERS), first + 1):
            for at, beam in enumerate(self._forward(cells[start : start + MOST_LETTERS]), start + 1):
                if at >= max(start + least, len(cells) - last):
                    out.add(self._best(beam))
        return self._keep(known, out)

    def unrepeated(self, letters: str) -> str:
        """``word`` of letters alone: each run is decided by its neighbours, as its last letter is the same either way."""

        def run(m: re.Match) -> str:
            a = _class(letters[m.start() - 1]) if m.start() else 0
            b = _class(letters[m.end()]) if m.end() < len(letters) else 0
            c, cost = _class(m.group(1)), self.cost
            double = cost[a, c, c] + cost[c, c, b] + (self.REPEAT if m.end() - m.start() > 2 else 0.0)
            return m.group(1) * (1 if cost[a, c, b] + self.REPEAT <= double else 2)

        return self.seen[letters] if letters in self.seen else self._keep(letters, _REPEATED.sub(run, letters))

    def edged(self, token: str, core: str) -> set[str]:
        """Restored spellings of a word whose first or last letters are written as punctuation."""
        if len(core) < 2 or not any(c.isalpha() for c in core):
            return set()
        at = token.index(core)
        fore = _BEFORE.search(token[:at]).group()
        back = _AFTER.match(token[at + len(core) :]).group()
        if not fore and not back:
            return set()
        return self.stretches(fore + core + back, len(_cells(core)), len(_cells(fore)), len(_cells(back)))

    def spaced(self, written: str) -> set[str]:
        """Restored words of letters that are parted by blanks or marks; neighbours of one letter may belong to them or not."""
        out: set[str] = set()
        for part in {written, *_WIDE.split(written)}:
            letters = "".join(c for c in part if c.isalnum() or c in "@$!")
            if len(letters) < 3:
                continue
            out.update(self.word(letters, breaks=True).split())
            fore, back = len(_cells(letters)) - len(_cells(letters.lstrip(_ALONE))), len(_cells(letters)) - len(_cells(letters.rstrip(_ALONE)))
            out |= self.stretches(letters, 3, fore, back)
        return out

    def words(self, text: str) -> set[str]:
        """Plain words of a text, lower-cased, with suspicious spellings restored."""
        low = text.lower()
        out: set[str] = set()
        for token in set(low.split()):
            if not token.isalpha():
                core, token = token.strip(_EDGE), token.strip(_NEVER)
                if token != core:
                    out |= self.edged(token, core)
                if not core.isalpha():
                    if len(core) > 1 and any(c.isalpha() for c in core):
                        out.add(self.word(core))
                        out.update(p for p in re.split(r"[\W_]+", core) if len(p) > 2 and p.isalpha())
                    continue
                token = core
            out.add(token)
            if _RUN.search(token):
                out.add(self.unrepeated(token))
        for spaced in _SPACED.finditer(low):
            out |= self.spaced(spaced.group())
        return out

    def features(self, text: str) -> set[str]:
        """Words and, marked by ^, their starts."""
        words = {w for w in self.words(text) if len(w) <= MOST_LETTERS}
        return words.union(*({"^" + w[:k] for w in words if len(w) > k} for k in STARTS))


def restorer(docs: DataFrame, text_col: str = "text") -> Restorer:
    counts = np.zeros(_ALPHABET**3, np.int64)
    for row in trigram_counts(docs, text_col).collect():  # at most 64^3 rows
        counts[row["gram"]] = row["n"]
    return Restorer(counts)


def _summary(restore: Restorer, weights: dict[str, float], text: str) -> list[float]:
    """Strongest weight, sum of all (its logarithm), and how many count at all."""
    find, found = weights.get, []
    for w in restore.words(text):
        if len(w) > MOST_LETTERS:
            continue
        best = max([find(w, 0.0), *(find("^" + w[:k], 0.0) for k in STARTS if len(w) > k)])
        if best > 0:
            found.append(best)
    return [max(found, default=0.0), math.log1p(math.fsum(found)), math.log1p(len(found))]


def _fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, decay: float = 1e-3) -> np.ndarray:
    """Weights (last: bias) by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + (decay * len(a) + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - decay * len(a) * w * np.append(np.ones(len(w) - 1), 0))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Restorer, lexicon and calibration, from labels outside fold 0.

    Half of the sample yields the lexicon, the other half the calibration, so
    that neither sees the other's texts. Without labels of both kinds every
    score is 0.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    restore = restorer(docs, text_col)
    model = {"counts": restore.counts, "weights": {}, "link": np.array([0.0, 0.0, 0.0, -30.0])}
    trusted = labels.where((fold(F.col(id_col)) != 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__pick"), (F.col(label_col) == 1).alias("__toxic")
    )
    sizes = {r["__toxic"]: r["count"] for r in trusted.groupBy("__toxic").count().collect()}
    if len(sizes) < 2:
        return model
    picked = thin(trusted.where("__toxic"), "__pick", TOXIC_ROWS, sizes[True], 3).union(thin(trusted.where("NOT __toxic"), "__pick", CLEAN_ROWS, sizes[False], 4))
    texts = docs.select(id_col, text_col)
    sample = texts.join(F.broadcast(picked), texts[id_col] == picked["__pick"]).select(
        F.coalesce(F.col(text_col), F.lit("")).alias("body"), F.col("__toxic").alias("toxic"), (F.crc32(F.col("__pick").cast("string").cast("binary")) % 2 == 0).alias("half")
    )
    shared = spark.sparkContext.broadcast(restore)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with_, without, rows = Counter(), Counter(), Counter()
        for batch in batches:
            for body, toxic in zip(batch["body"], batch["toxic"]):
                (with_ if toxic else without).update(shared.value.features(body))
                rows[bool(toxic)] += 1
        yield pd.DataFrame([("", rows[True], rows[False]), *((f, with_[f], without[f]) for f in with_.keys() | without.keys())], columns=["f", "t", "c"])

    counted = sample.where("half").select("body", "toxic").mapInPandas(count, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counted = materialize(counted, "toxic-counts")
    rows = counted.where("f = ''").first()
    if rows is None:
        return model
    toxic_rows, clean_rows = max(1, rows["t"]), max(1, rows["c"])
    odds = F.log((F.col("t") + 0.1) / (toxic_rows + 1)) - F.log((F.col("c") + 0.5) / (clean_rows + 1))
    supported = counted.where((F.col("f") != "") & (F.col("t") >= max(SUPPORT, SUPPORT_SHARE * toxic_rows)))
    # Support bounds the lexicon: at most 1 / SUPPORT_SHARE times the distinct words of an average toxic row.
    weights = {r["f"]: r["w"] for r in supported.select("f", odds.alias("w")).where(F.col("w") > LEAST_WEIGHT).toLocalIterator()}
    model["weights"] = weights
    lexicon = spark.sparkContext.broadcast(weights)

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [_summary(shared.value, lexicon.value, body) for body in batch["body"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "x": x})

    rows = sample.where("NOT half").select("body", "toxic").mapInPandas(summarize, "toxic boolean, x array<double>").toPandas()
    if len(rows) and rows["toxic"].nunique() == 2:
        y = rows["toxic"].to_numpy(float)
        model["link"] = _fit_logistic(np.array(rows["x"].tolist()).reshape(len(rows), -1), y)
    return model


def toxicity_score(docs: DataFrame, model: dict, text: Column) -> Column:
    """Score from 0 to 1 of a text column; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast((model["counts"], model["weights"], model["link"]))
    built: dict[str, Restorer] = {}

    @F.pandas_udf("double")
    def score(bodies: pd.Series) -> pd.Series:
        counts, weights, link = shared.value
        restore = built.setdefault("restorer", None) or Restorer(counts)
        built["restorer"] = restore
        x = np.array([_summary(restore, weights, body) for body in bodies]).reshape(len(bodies), -1)
        z = x @ link[:-1] + link[-1] if len(bodies) else np.zeros(0)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score(F.coalesce(text, F.lit("")))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every row of ``docs``, from its text alone.

    A null text is scored as an empty one. A null id counts as empty text when
    folds are dealt; repeated rows are scored one by one. Labels that are null
    or have no document don't count, several of one document do. An empty table
    gives an empty result; columns other than id and text are not read.
    """
    model = fit_toxicity(docs, labels, id_col, text_col)
    return docs.select(F.col(id_col), (fold(F.col(id_col)) == 0).alias("held_out"), toxicity_score(docs, model, F.col(text_col)).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
