"""Alignment of two tokenizers against pairwise overlap of whole-text tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from wayloom.llm import alignment
from wayloom.llm.alignment import PAIR_BASE, Aligner, align, link_counts
from wayloom.llm.queries import tokenizer_path

from .corpus import documents, frame

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
BITS = ["a", "the", "ing", "'s", "'ll", "1", "23", "  ", " ", " ", " ", "\n", "\t", "é", "日本", "\U0001f600", "▁", "<s>", "<|endoftext|>", "<0x41>", "́", "\xa0", "​", ".", "!!", "\x00", "\x1c", "x" * 30, "ﬁ", "　", "\r\n"]


@pytest.fixture(scope="module")
def aligner():
    return Aligner(A, B)


def plain(aligner, text):
    """n_a, n_b, groups and links by whole-text encoding and a test of every pair of tokens for overlap."""
    if not text:
        return None
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    bytes_a, bytes_b = [aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum([len(t) for t in bytes_a]).tolist(), np.cumsum([len(t) for t in bytes_b]).tolist()
    groups, begun = [], 0
    for end in sorted(set(ends_a) & set(ends_b)):
        groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if begun < e <= end) for ids, ends in ((a, ends_a), (b, ends_b))))
        begun = end
    links = [
        x * PAIR_BASE + y
        for x, e, t in zip(a, ends_a, bytes_a)
        for y, f, u in zip(b, ends_b, bytes_b)
        if max(e - len(t), f - len(u)) < min(e, f)
    ]
    return len(a), len(b), ";".join(groups).encode(), sorted(links)


def shown(found):
    return found and (found[0], found[1], found[3], sorted(found[4].tolist()))


def test_texts(aligner, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(0, 16))) for _ in range(1500)]
    want = [plain(aligner, t) for t in texts]
    assert [shown(x) for x in aligner.texts(texts)] == want and None in want[1:]
    monkeypatch.setattr(alignment, "LABEL_CHARS", 7)  # every text in parts
    monkeypatch.setattr(alignment, "CACHE_CHUNKS", 50)
    assert [shown(x) for x in aligner.texts(texts)] == want


def test_new_chunks_are_encoded_in_runs_and_once(monkeypatch):
    """A chunk is encoded and labelled where it is new, many in one call; a run with a chunk without tokens is taken apart."""
    fresh, seen = Aligner(A, B), []
    encode = fresh.encode
    monkeypatch.setattr(fresh, "encode", lambda runs: (seen.append(runs), encode(runs))[1])
    rng = random.Random(8)
    words = ["".join(rng.choice(["a", "the", "ing", "'s", "1", "é", "日本", "́", "ﬁ", ".", "<s>", "´", "x"]) for _ in range(rng.randrange(1, 6))) for _ in range(300)] + ["a▁b"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 8))) for _ in range(400)] + ["so a▁b it is"]
    want = [plain(fresh, t) for t in texts]
    assert [shown(x) for x in fresh.texts(texts)] == want and None in want and any(want)
    assert max(len(run) for run in seen[0]) > 20 and len([c for runs in seen[:1] for run in runs for c in run]) <= len(set(words))
    seen.clear()
    assert [shown(x) for x in fresh.texts(texts[::-1])] == want[::-1] and not any(seen)


def test_groups_hold_the_bytes(aligner):
    for (_, _, n, groups, links), text in zip(aligner.texts(["so naïve, 日本 \U0001f600!", "plain words"]), ["so naïve, 日本 \U0001f600!", "plain words"]):
        both = [[[int(i) for i in ids.split(",")] for ids in g.split("|")] for g in groups.decode().split(";")]
        assert len(both) == n and len(links) == sum(len(a) + len(b) - 1 for a, b in both)
        for a, b in both:
            assert b"".join(aligner.a_bytes[i] for i in a) == b"".join(aligner.b_bytes[i] for i in b)
        assert b"".join(aligner.a_bytes[i] for a, _ in both for i in a) == (" " + text).encode()


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_counts(spark, aligner, block):
    rows = documents(n=40) + [(2000 + k, t, None, None, None) for k, t in enumerate(("▁", "of the of the", "of the of the"))] + [(None, "of the", None, None, None), (None, None, None, None, None)]
    of = [plain(aligner, r[1]) for r in rows]
    counts = Counter(p for x in of if x for p in x[3])
    most = {}
    for p, n in counts.items():
        most[p % PAIR_BASE] = max(n, most.get(p % PAIR_BASE, 0))
    want = []
    for r, x in zip(rows, of):
        if x is None:
            want.append((r[0], 0, 0, 0, 0, "", 0, 0))
        else:
            n, m, groups, links = x
            best = sum(counts[p] == most[p % PAIR_BASE] for p in links)
            want.append((r[0], n, m, groups.count(b";") + 1, len(links), hashlib.sha256(groups).hexdigest(), best, sum(counts[p] for p in links)))
    got = link_counts(frame(spark, rows, clashing=True), A, B, digests=True, block_links=block)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_whole_groups(spark, aligner):
    rows = documents(n=5)
    got = {r["doc_id"]: r["groups"] for r in align(frame(spark, rows), A, B).collect()}
    assert all(got[r[0]].encode() == (plain(aligner, r[1]) or (0, 0, b""))[2] for r in rows)
