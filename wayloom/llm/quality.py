"""Quality classifier from positive and unlabelled texts.

Trusted positives and unlabelled web text fit a logistic model that minimises
the non-negative unbiased risk: prior * R+(positives) + max(0, R-(unlabelled)
- prior * R-(positives)). The class prior is estimated from the positives and
the unlabelled texts alone; no negative label is read.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .sampling import fold, thin
from .workers import give_back, only

#: Bounds of the samples the model is fitted on. All rows are scored.
POSITIVES, UNLABELLED = 12_000, 24_000
THRESHOLD = 0.3
#: Buckets that words are hashed into: how a text's words are spread over them is part of its features.
WORD_BUCKETS = 128
#: Decay of the weights of shape and of words.
SHAPE_DECAY, WORD_DECAY = 1e-4, 1e-3
_SYMBOLS = b"%*&$#!|.,?\"'-_/\\<>{}[]()=+:;@~^"
_HALF_WORD = re.compile(rb"[a-z]")


def features(text: str) -> list[float]:
    """Words of a text, hashed, and its shape: shares of character classes, symbols, repeated words and lines, lengths."""
    data = (text or "").encode("utf-8", "replace")
    n = max(1, len(data))
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digits = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    high, control = seen[128:].sum(), seen[:9].sum() + seen[14:32].sum()
    symbols = [float(seen[c]) for c in _SYMBOLS]
    words = data.split()
    m = max(1, len(words))
    counts = Counter(words)
    lines = data.split(b"\n")
    kinds = Counter(lines)
    repeated = sum(len(k) * (c - 1) for k, c in kinds.items())
    shout = sum(c for w, c in counts.items() if len(w) > 2 and not _HALF_WORD.search(w) and w.isupper())
    odd = sum(c for w, c in counts.items() if not w.strip(b".,!?;:\"'()").isalpha() and w.isascii())
    top = counts.most_common(3)
    echoes = sum(map(eq, words, words[1:]))
    long_words = sum(c for w, c in counts.items() if len(w) > 25)
    out = [
        upper / n, lower / n, digits / n, high / n, control / n,
        sum(symbols) / m, shout / m, odd / m, long_words / m,
        len(counts) / m, sum(c for _, c in top) / m, (top[0][1] if top else 0) / m,
        repeated / n, len(kinds) / max(1, len(lines)), len(lines) / m,
        np.log1p(len(words)), (n - seen[32]) / m,
        float(not words), float(len(words) < 5),
    ]
    out += [np.sqrt(s / m) for s in symbols]
    out += [np.log(len(counts) + 1) / np.log(m + 1), np.sqrt(shout / m), np.sqrt(repeated / n), np.sqrt(odd / m), echoes / m, np.sqrt(echoes / m)]
    buckets = np.bincount([crc32(w.lower()) % WORD_BUCKETS for w in counts], list(counts.values()), WORD_BUCKETS) if counts else np.zeros(WORD_BUCKETS)
    return [float(x) for x in out] + np.sqrt(buckets / m).tolist()


def _matrix(texts: pd.Series) -> np.ndarray:
    """Features (32-bit) of each text, a row at a time: lists of all rows' numbers would take several times as much."""
    out = np.empty((len(texts), len(features(""))), np.float32)
    for row, text in zip(out, texts):
        row[:] = features(text)
    return out


def nnpu_risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Risk of the positives, estimated risk of the negatives, and the gradient of each, with logistic loss.

    Rows of ``p`` and ``u`` end with a 1 for the bias.
    """
    at = w.astype(p.dtype)
    zp, zu = np.clip(p @ at, -30, 30), np.clip(u @ at, -30, 30)
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return positive, negative, -prior * ((1 - sp) @ p) / len(p), (su @ u) / len(u) - prior * (sp @ p) / len(p)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 600, rate: float = 0.05, decay: float | np.ndarray = 1e-4) -> np.ndarray:
    """Weights (last: bias) that minimise the non-negative risk, by Adam on whole samples.

    While the estimated negative risk is below nothing, the step goes against
    it instead, which is what keeps the estimate from being overfitted.
    """
    if not len(positive) or not len(unlabelled):
        bias = np.zeros((positive.shape[1] if positive.ndim == 2 else 0) + 1)
        bias[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return bias
    p, u = (np.hstack([x, np.ones((len(x), 1), x.dtype)]) for x in (positive, unlabelled))
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    for t in range(1, steps + 1):
        _, negative, toward, away = nnpu_risk(w, p, u, prior)
        g = (toward + away if negative >= 0 else -away) + np.append(decay * w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled rows, from both samples alone; one half if there are too few.

    Half of each sample fits a classifier of positives against unlabelled
    rows. On the other halves, the unlabelled rows that score above a
    threshold, as a share, are at least the prior times the positives that do:
    the quotient is smallest where hardly a negative scores so high. The
    threshold is the one with the smallest upper confidence bound.
    """
    rng = np.random.default_rng(0)
    p, u = (x[rng.permutation(len(x))] for x in (positive, unlabelled))
    if min(len(p), len(u)) < 40:
        return 0.5
    fit_p, fit_u, p, u = p[: len(p) // 2], u[: len(u) // 2], p[len(p) // 2 :], u[len(u) // 2 :]
    w = fit_nnpu(fit_p, fit_u, 0.5)
    sp, su = (np.sort(x @ w[:-1].astype(x.dtype)) for x in (p, u))
    cuts = np.quantile(sp, np.linspace(0, 0.99, 400))
    above_p, above_u = 1 - np.searchsorted(sp, cuts) / len(sp), 1 - np.searchsorted(su, cuts) / len(su)
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    best = np.argmin((above_u + slack) / above_p)
    return float(min(0.99, max(0.01, above_u[best] / above_p[best])))


def _sampled_features(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Features (32-bit) of the sampled rows; the sample's bound is what bounds the broadcast and what is collected."""
    picked = sample.select(F.col(id_col).alias("__pick")).distinct()
    texts = docs.select(id_col, text_col)
    chosen = texts.join(F.broadcast(picked), texts[id_col] == picked["__pick"], "left_semi").select(_features(F.col(text_col)).alias("x"))
    rows = sorted(chosen.limit(POSITIVES + UNLABELLED).toPandas()["x"])  # in whatever order rows arrive
    return np.frombuffer(b"".join(rows), "<f4").reshape(len(rows), len(features(""))).copy()


@F.pandas_udf(T.BinaryType())
def _features(text: pd.Series) -> pd.Series:
    only(None)
    found = text.map(lambda t: np.array(features(t), "<f4").tobytes())
    give_back()
    return found


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict[str, np.ndarray]:
    """Model from positive labels outside fold 0 and unlabelled texts of ``docs``.

    Labels that are null, or of a null id, don't count. Without enough
    positives the prior is one half.
    """
    ship(docs.sparkSession)
    trusted = labels.where((fold(F.col(id_col)) != 0) & (F.col(label_col) == 1) & F.col(id_col).isNotNull())
    positives = thin(trusted, id_col, POSITIVES, trusted.count(), 1)
    unlabelled = thin(docs.select(id_col).where(F.col(id_col).isNotNull()), id_col, UNLABELLED, docs.count(), 2)
    p = _sampled_features(docs, positives, id_col, text_col)
    u = _sampled_features(docs, unlabelled, id_col, text_col)
    n = max(1, len(p) + len(u))
    mean = sum(x.sum(axis=0, dtype=float) for x in (p, u)) / n
    square = sum(np.einsum("ij,ij->j", x, x, dtype=float, casting="same_kind") for x in (p, u)) / n
    spread = np.sqrt(np.maximum(square - mean * mean, 0.0))
    spread = np.where(spread > 1e-6, spread, 1.0)
    for x in (p, u):  # in place: the driver holds each sample once
        x -= mean.astype(np.float32)
        x /= spread.astype(np.float32)
        np.clip(x, -6, 6, out=x)
    prior = class_prior(p, u)
    decay = np.full(p.shape[1], SHAPE_DECAY)
    decay[len(decay) - WORD_BUCKETS :] = WORD_DECAY
    return {"mean": mean, "spread": spread, "weights": fit_nnpu(p, u, prior, decay=decay), "prior": np.array([prior])}


def quality_score(model: dict[str, np.ndarray], text: Column) -> Column:
    """Score from 0 to 1 of a text column; null counts as empty."""
    mean, spread, weights = model["mean"], model["spread"], model["weights"]

    @F.pandas_udf("double")
    def score(body: pd.Series) -> pd.Series:
        only(None)
        x = _matrix(body).astype(float)
        z = np.clip((x - mean) / spread, -6, 6) @ weights[:-1] + weights[-1] if len(body) else np.zeros(0)
        give_back()
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score(F.coalesce(text, F.lit("")))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every row of ``docs``, from its text alone.

    A null text is scored as an empty one. A null id counts as empty text when
    folds are dealt; repeated rows are scored one by one. Labels that are null
    or have no document don't count, several of one document do. An empty table
    gives an empty result; columns other than id and text are not read.
    """
    model = fit_quality(docs, labels, id_col, text_col)
    return docs.select(F.col(id_col), (fold(F.col(id_col)) == 0).alias("held_out"), quality_score(model, F.col(text_col)).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text the classifier accepts (see ``score_quality``), with all their columns."""
    model = fit_quality(docs, labels, id_col, text_col)
    return docs.where(quality_score(model, F.col(text_col)) >= THRESHOLD)
