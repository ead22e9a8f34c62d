"""Mixing and packing against plain versions of their rules."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from wayloom.llm import mixing, packing
from wayloom.llm.queries import tokenizer_path

from .corpus import COLUMNS, documents, frame, words

TOKENIZER = tokenizer_path("word_bpe_49k.json")


def brute_mix(rows, weights=(1, 2, 3), passes=3):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full, targets = sum(sizes.values()), set(), {}
    while True:  # water-filling, a source at a time
        left = budget - sum(passes * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > passes * sizes[s]]
        if not over:
            targets = {s: passes * sizes[s] if s in full else share[s] for s in order}
            break
        full.update(over)
    queue, upto = [], defaultdict(int)
    for r in sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0])):
        n = len(words(r[1]))
        upto[r[3]] += n
        if n:
            queue += [((c * sizes[r[3]] + upto[r[3]]) / weight[r[3]], order.index(r[3]), hashlib.md5(str(r[0]).encode()).hexdigest(), r[0], c, n) for c in range(passes)]
    taken, spent = defaultdict(int), 0
    for *_, i, _, n in sorted(queue):
        spent += n
        if spent > budget:
            break
        taken[i] += n
    return {r[0]: (len(words(r[1])), sizes[r[3]], targets[r[3]], taken[r[0]]) for r in rows}


@pytest.mark.parametrize(("seed", "cut_rows"), [(0, mixing.CUT_ROWS), (1, mixing.CUT_ROWS), (1, 2), (2, 0)])
def test_mix(spark, seed, cut_rows):
    """The same documents are taken however finely the range of the cut is ranged again."""
    rows = documents(seed)
    want = brute_mix(rows)
    got = {r["doc_id"]: r for r in mixing.mix_counts(frame(spark, rows, clashing=True), cut_rows=cut_rows).collect()}
    assert {i: (r["size"], r["source_size"], r["taken"]) for i, r in got.items()} == {i: (w[0], w[1], w[3]) for i, w in want.items()}
    assert all(got[i]["target"] == pytest.approx(w[2]) and got[i]["taken"] <= 3 * w[0] for i, w in want.items())
    mixed = mixing.mix_documents(frame(spark, rows, clashing=True), ordered=True)
    assert mixed.columns == frame(spark, rows, clashing=True).columns
    plain = mixing.mix_documents(frame(spark, rows, clashing=True), cut_rows=cut_rows)
    for once in (mixed, plain):
        taken = defaultdict(int)
        for r in once.collect():
            taken[r["doc_id"]] += len(words(r["text"]))
        assert taken == {i: w[3] for i, w in want.items() if w[3]}
    assert "Exchange" not in plain.select("text")._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


def test_mix_odd_tables(spark):
    assert mixing.mix_counts(spark.createDataFrame([], COLUMNS)).count() == 0
    nothing = spark.createDataFrame([(1, None, None, "a", 0), (2, "", None, None, 0)], COLUMNS)
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix_counts(nothing).collect()] == [(0, 0.0, 0)] * 2
    repeats = spark.createDataFrame([(None, "a b", None, "a", 0)] * 3 + [(1, "c d e", None, "b", 0)] * 2, COLUMNS)
    got = mixing.mix_counts(repeats).collect()
    assert len(got) == 5 and sum(r["taken"] for r in got) <= 12 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix_documents(repeats).count() >= 1
    shared = spark.createDataFrame([(i % 3 or None, f"text {i} " + "w " * i, None, "a", 0) for i in range(30)], COLUMNS)  # ids that texts share: none is lost
    assert sorted(r["text"] for r in mixing.mix_documents(shared).collect()) == sorted(r["text"] for r in shared.collect())
    with pytest.raises(ValueError):
        mixing.mix_counts(nothing, share=4.0)


def test_chunk_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(TOKENIZER), packing.ChunkIds(TOKENIZER)
    rng = random.Random(4)
    letters = "abcXYZéßÜœİΣσ 'st.,!?0123-_\n\t\r\x0b  ́語%$&*|\x1c\x85"
    texts = [r[1] or "" for r in documents()] + ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(1500)] + ["a<|endoftext|>b it's WE'LL é Ａ"]
    for t in texts:
        assert np.frombuffer(fast.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def brute_best_fit(lengths, capacity):
    free = []
    for length in sorted(lengths, reverse=True):
        open_ = [i for i, f in enumerate(free) if f >= length]
        if open_:
            best = min(open_, key=lambda i: free[i])
            free[best] -= length
        else:
            free.append(capacity - length)
    return sorted(free)


@pytest.mark.parametrize("seed", range(25))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice((10, 37, 100))
    lengths = [rng.randrange(1, capacity + 1) if rng.random() < 0.5 else rng.randrange(1, 1 + capacity // 3) for _ in range(rng.randrange(0, 300))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    used = defaultdict(list)
    for length, rank, each, first, offset in (moves := packing.best_fit_decreasing(histogram, capacity)):
        later = [m[1] for m in moves if m[0] == length and m[1] > rank]
        for k in range((min(later) if later else histogram[length]) - rank):
            used[first + k // each].append((offset + k % each * length, length))
    free = []
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        free.append(capacity - at)
    assert sorted(free) == brute_best_fit(lengths, capacity)


def test_pack(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    rows = documents() + [(3001, "long words here " * 6000, "en", "a", 0), (3001, "long words here " * 6000, "en", "a", 0)]
    got = packing.pack_documents(frame(spark, rows, clashing=True), TOKENIZER).collect()
    want = []
    for r in rows:
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want += [(r[0], k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(used) == len(brute_best_fit([w[3] for w in want], 4096))
    assert packing.pack_documents(spark.createDataFrame([], COLUMNS), TOKENIZER).count() == 0


def test_packed_sequences(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    rows = documents(1, 40)
    texts = {r[0]: plain.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows}
    found = defaultdict(dict)
    for r in packing.packed_sequences(frame(spark, rows), TOKENIZER).collect():
        for d in r["documents"]:
            found[d["id"]][d["piece"]] = r["ids"][d["offset"] : d["offset"] + d["length"]]
    assert {i: sum((p[k] for k in sorted(p)), []) for i, p in found.items()} == texts


def test_rank_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 7)
    rows = [(i, "same words", "en", "a", 0) for i in range(100)]
    got = packing.pack_documents(frame(spark, rows), TOKENIZER).collect()
    assert sorted(r["offset"] for r in got) == [r["length"] * k for k, r in enumerate(sorted(got, key=lambda r: r["offset"]))]
