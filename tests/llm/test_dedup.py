"""Exact, near and substring dedup against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from wayloom.llm import common, exact_dedup, near_dedup, substring_dedup
from wayloom.llm.components import connected_components

from .corpus import COLUMNS, components, documents, frame, sentence, words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("hot", "broadcast"), [(256, "10MB"), (2, "-1")])
def test_exact(spark, hot, broadcast, monkeypatch):
    """Also with groups of three rows dealt over tasks, and without broadcasts by size."""
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10**6 if hot > 2 else 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    rows = documents()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = {r[0]: (max(groups[r[1] or ""]), len(groups[r[1] or ""]), r[0] == max(groups[r[1] or ""]), sha(r[1] or "")) for r in rows}
    got = exact_dedup.exact_groups(frame(spark, clashing=True), digests=True).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == want and len(got) == len(rows)
    left = exact_dedup.exact_dedup(frame(spark, clashing=True))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, w in want.items() if w[2]) and "size" in left.columns
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exact_with_a_full_bit_set(spark, monkeypatch):
    """A set of bits that is far too small only costs time."""
    monkeypatch.setattr(exact_dedup, "LEAST_BITS", 4)
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 8)
    rows = documents()
    best = {}
    for r in rows:
        best[r[1] or ""] = max(best.get(r[1] or "", -1), r[0])
    assert sorted(r["doc_id"] for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()) == sorted(best.values())


def test_full_hashes_are_of_survivors(spark):
    """Only texts that share length and prefix with another are hashed in full."""
    start = "p" * 10
    rows = [(1, start + "a"), (2, start + "b"), (3, start + "a"), (4, start + "cc"), (5, "q" + start), (6, "é" * 5 + "x"), (7, None), (8, ""), (9, start), (10, start + "cc" * 5)]
    shared = {1, 2, 3, 7, 8}  # 5 has the length of those, but another start; 6 has the bytes of 1, but no equal start
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = exact_dedup.hashed_rows(df, prefix_chars=10).collect()
    assert sorted(r["id"] for r in hashed) == sorted(shared)
    assert all(r["sha"] == hashlib.sha256((dict(rows)[r["id"]] or "").encode()).hexdigest() for r in hashed)
    wide = frame(spark)
    n = Counter((len((r["text"] or "").encode()), (r["text"] or "")[: exact_dedup.PREFIX_CHARS]) for r in wide.collect())
    assert exact_dedup.hashed_rows(wide).count() == sum(k for k in n.values() if k > 1)
    plan = exact_dedup.exact_dedup(wide).select("text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == plan.count("THEN sha2(")


def test_exact_odd_rows(spark):
    df = spark.createDataFrame([(None, "x"), (1, "x"), (2, "y"), (2, "y"), (None, "z")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df).collect()), key=str)
    assert got == sorted([(None, 1, 2, False), (1, 1, 2, True), (2, 2, 2, True), (2, 2, 2, True), (None, None, 1, True)], key=str)
    assert exact_dedup.exact_groups(df.limit(0), digests=True).count() == 0 and exact_dedup.exact_dedup(df.limit(0)).count() == 0
    left = exact_dedup.exact_dedup(df.union(spark.createDataFrame([(2, "only"), (0, "y"), (0, "own")], df.schema)))
    assert sorted((tuple(r) for r in left.collect()), key=str) == sorted([(1, "x"), (2, "y"), (None, "z"), (2, "only"), (0, "own")], key=str)
    same = [(1, "a" * 200 + "b"), (2, "a" * 200 + "c"), (3, "a" * 200 + "b")]  # equal length and prefix
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(spark.createDataFrame(same, "doc_id long, text string")).collect()} == {1: 3, 2: 2, 3: 3}


def shingles(text, k):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_near(rows, k, similarity=(80, 100)):
    sets = {r[0]: shingles(r[1], k) for r in rows}
    ids, (share, whole) = sorted(sets), similarity
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and whole * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])]
    roots = components(ids, links)
    return {i: (len(sets[i]), roots[i], roots[i] == i) for i in ids}


def edited(rng, base, most, tag="y"):
    copy = list(base)
    for _ in range(rng.randrange(1, most)):
        copy[rng.randrange(len(copy))] = f"{tag}{rng.randrange(10**6)}"
    return " ".join(copy)


@pytest.mark.parametrize(("shingle", "block", "hot", "few", "similarity"), [(4, 256, 256, 4, (80, 100)), (4, 4, 2, 0, (80, 100)), (5, 4, 2, 10, (80, 100)), (4, 256, 256, 4, (1, 2)), (4, 4, 2, 0, (9, 10)), (5, 256, 256, 4, (1, 1))])
def test_near(spark, shingle, block, hot, few, similarity, monkeypatch):
    """With a block of four rows, lists are compared in many chunks, in pools, and by wide sketches (always with ``few`` of 0)."""
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10**6 if hot > 2 else 0)
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "BUNDLE", 4 * block)
    rng = random.Random(5)
    rows = documents()
    base = sentence(rng, 90, 5000).split(" ")
    passage = sentence(rng, 60, 5000)
    for i in range(60):  # a large group around one text, not all of it within the threshold of each other
        rows.append((2000 + i, edited(rng, base, 7), "en", "a", 0))
    for i in range(40):  # one passage makes up half of texts that have nothing else in common
        rows.append((3000 + i, f"{sentence(rng, 30, 10**6)} {passage} {sentence(rng, 20 + i, 10**6)}", "en", "a", 0))
    got = near_dedup.near_groups(frame(spark, rows, clashing=True), shingle=shingle, block=block, wide=64, similarity=similarity).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_near(rows, shingle, similarity) and len(got) == len(rows)


def test_near_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(df).collect()), key=str)
    assert got == sorted([(None, None, True), (1, 1, True), (3, 1, False), (3, 1, False), (4, 4, True)], key=str)
    assert near_dedup.near_groups(df.limit(0)).count() == 0
    assert sorted(r["doc_id"] or 0 for r in near_dedup.near_dedup(df).collect()) == [0, 1, 4]
    for low in ((0, 100), (101, 100)):
        with pytest.raises(ValueError, match="similarity"):
            near_dedup.near_groups(df, similarity=low)


def test_near_repeated_ids(spark):
    """Rows that share an id go with their own text; full repeats are one document."""
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [(3, x), (5, x), (5, y), (2, x + " end"), (3, z), (7, z), (7, z), (9, y + " end"), (11, "single"), (11, "single"), (11, None), (11, None)]
    left = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in left) == sorted([(2, x + " end"), (5, y), (3, z), (11, "single"), (11, "")])


def test_near_large_groups(spark, monkeypatch):
    """Ten thousand copies, as many texts without words, and a large group of near copies."""
    rng = random.Random(9)
    base = sentence(rng, 60, 10**6).split(" ")
    rows = [(i, "one text that very many rows have") for i in range(10_000)] + [(20_000 + i, " " * (i % 3)) for i in range(10_000)]
    rows += [(40_000 + i, edited(rng, base, 2)) for i in range(700)] + [(50_000 + i, sentence(rng, 20, 10**6)) for i in range(50)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and all(got[i] == 0 for i in range(10_000)) and all(got[i] == i for i in range(20_000, 30_000))
    small = [r for r in rows if r[0] >= 40_000]
    assert {i: got[i] for i, _ in small} == {i: w[1] for i, w in brute_near(small, 5).items()}


def test_least_shared():
    for k, similarity in ((32, (80, 100)), (256, (4, 5)), (32, (1, 2)), (8, (1, 1)), (4, (1, 10))):
        c, p = near_dedup.least_shared(k, similarity), similarity[0] / similarity[1]
        tail = lambda upto: sum(math.comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(upto))  # noqa: E731, B023
        assert c == 1 or tail(c) <= near_dedup.MISSED
        assert tail(c + 1) > near_dedup.MISSED


def test_union_shares():
    rng, k = np.random.default_rng(3), 8
    sets = [np.unique(rng.integers(1, 60, size).astype(np.uint64)) for size in (3, 5, 20, 30, 30, 40)]
    padded = np.full((len(sets), k), near_dedup._PAD)
    for row, s in zip(padded, sets):
        row[: min(k, len(s))] = s[:k]
    for i, one in enumerate(sets):
        size, both = near_dedup.union_shares(padded[i], padded, k)
        for j, other in enumerate(sets):
            lowest = sorted(set(one[:k]) | set(other[:k]))[:k]
            assert (size[j], both[j]) == (len(lowest), len([v for v in lowest if v in one and v in other]))


def test_shared_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 25)).astype(np.uint64) for _ in range(12)]
    left, right = np.arange(5), np.arange(5, 12)
    want = [[len(np.intersect1d(sets[a], sets[b])) for b in right] for a in left]
    assert near_dedup._shared_counts(sets, left, right).tolist() == want


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {x for a, b in links for x in (a, b) if a != b}
    assert got == components(sorted(ids), links)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_passages(rows, window):
    where = {}
    for i, text in sorted((r[0], r[1]) for r in rows):
        w = words(text)
        for at in range(len(w) - window + 1):
            where.setdefault(tuple(w[at : at + window]), i)
    out = {}
    for i, text in [(r[0], r[1]) for r in rows]:
        w = words(text)
        gone = {k for at in range(len(w) - window + 1) if where[tuple(w[at : at + window])] < i for k in range(at, at + window)}
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def brute_factors(rows, window):
    """Greedy parse of every document against the reference: all windows where they occur first."""
    split, first, out = {r[0]: words(r[1]) for r in rows}, {}, {}
    for i, w in sorted(split.items()):
        for at in range(len(w) - window + 1):
            first.setdefault(tuple(w[at : at + window]), (i, at))
    for i, w in split.items():
        out[i], at = [], 0
        while at + window <= len(w):
            source, place = first[tuple(w[at : at + window])]
            length = 0
            while source < i and at + length + window <= len(w) and first[tuple(w[at + length : at + length + window])] == (source, place + length):
                length += 1
            if length:
                out[i].append((at, at + length - 1 + window, source, place))
            at += max(length, 1)
    return out


@pytest.mark.parametrize(("window", "anchor", "chunks"), [(50, 10, 1), (12, 4, 1), (6, 6, 4)])
def test_passages(spark, window, anchor, chunks, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = documents(3)
    table = frame(spark, rows, clashing=True).repartition(chunks)
    got = substring_dedup.repeated_passages(table, window=window, anchor=anchor, keep_text=True).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_passages(rows, window) and len(got) == len(rows)
    split, want = {r[0]: words(r[1]) for r in rows}, brute_factors(rows, window)
    for r in got:
        assert sha(" ".join(words(r["kept_text"]))) == r["kept_sha256"]
        assert sum(r["spans"][1::2]) - sum(r["spans"][::2]) == r["n_removed"]
        found = [tuple(r["factors"][at : at + 4]) for at in range(0, len(r["factors"]), 4)]
        for first, end, source, place in found:
            assert source < r["doc_id"] and end - first >= window and split[r["doc_id"]][first:end] == split[source][place : place + end - first]
        if chunks == 1 and r["kept_text"]:  # copies are one factor of their original
            assert found == want[r["doc_id"]]


def test_passages_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, None, None, None), (5, text, None, None, None), (5, text, None, None, None), (7, "start " + text, None, None, None), (8, None, None, None, None)]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 60, 0), (5, 60, 0), (5, 60, 0), (7, 61, 60), (8, 0, 0)], key=str)
    assert substring_dedup.repeated_passages(spark.createDataFrame([], COLUMNS)).count() == 0
    twice = [(5, text, None, None, None), (5, "other", None, None, None), (None, "nobody's", None, None, None), (7, text + " end", None, None, None)]
    got = sorted((str(r["doc_id"]), r["kept_text"]) for r in substring_dedup.repeated_passages(frame(spark, twice), keep_text=True).collect())
    assert got == sorted([("5", text), ("5", "other"), ("None", "nobody's"), ("7", "end")])


def test_sliding_argmin(monkeypatch):
    rng = np.random.default_rng(1)
    key = rng.integers(0, 2**63, 3000).astype(np.uint64)
    want = [int(np.argmin(key[i : i + 41])) + i for i in range(len(key) - 40)]
    assert substring_dedup._sliding_argmin(key, 41).tolist() == want
    monkeypatch.setattr(substring_dedup, "_SEGMENT", 512)
    assert substring_dedup._sliding_argmin(key, 41).tolist() == want


def test_factors():
    source, place = np.zeros(400, np.int64), np.full(400, -1)
    place[[0, 1, 2, 5, 60, 61, 300]] = [7, 8, 9, 10, 3, 5, 0]
    source[[60, 61]] = 4
    found = substring_dedup.factors(source, place, 50)
    assert found == [(0, 52, 0, 7), (5, 55, 0, 10), (60, 110, 4, 3), (61, 111, 4, 5), (300, 350, 0, 0)]
    assert substring_dedup.merged(found) == [(0, 55), (60, 111), (300, 350)]
    assert substring_dedup.factors(source[:0], place[:0], 50) == [] and substring_dedup.merged([]) == []


def test_near_sends_texts_once(spark):
    """Near copies that share many lists are one bundle: a text goes there once, and lists of joined rows are not compared again."""
    rng = random.Random(3)
    base, rows = sentence(rng, 90, 10**6).split(" "), []
    for i in range(24):
        rows.append((i, edited(rng, base, 3), "en", "a", 0))
    blocks = [(number, 0, i, i, 3) for number in range(40) for i in sorted(rng.sample(range(24), 12))]
    held, bundles = near_dedup._bundles(spark.createDataFrame(blocks, "list long, part long, id long, root long, role int"))
    held = held.toPandas()
    assert bundles == 1 and sorted(held["id"]) == sorted({b[2] for b in blocks})
    assert sorted((x, i) for i, lists in zip(held["id"], held["lists"]) for x in lists) == sorted((b[0], b[2]) for b in blocks)
    held["body"] = [rows[i][1] for i in held["id"]]
    sets = [near_dedup.shingle_set(body, 5) for body in held["body"]]
    held["n"], held["sketch"] = [len(x) for x in sets], [x[:32].astype(np.int64) for x in sets]
    links = near_dedup.bundle_links(held, shingle=5, similarity=(80, 100), k=32)
    want = {i: w[1] for i, w in brute_near(rows, 5).items()}
    got = components(range(24), links)
    assert got == want and len(links) == 24 - len(set(want.values()))


def test_found_by(spark, monkeypatch):
    """Beyond the broadcasts a bit set keeps rows out of the shuffle; one that is too small changes nothing in the result."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "LEAST_BITS", 4)
    monkeypatch.setattr(common, "MOST_BITS", 1 << 12)
    rows, right = spark.range(5000), spark.range(0, 5000, 50).withColumn("x", common.F.col("id") * 2)
    marked = common.marked_likely(rows, ["id"], *common.bit_set(right, ["id"], "bits"))
    assert marked.where("likely AND id % 50 = 0").count() == 100 and marked.where("likely").count() < 500
    monkeypatch.setattr(common, "MOST_BITS", 8)
    assert sorted(map(tuple, common.found_by(rows, right, ["id"], "bits").collect())) == [(i, 2 * i) for i in range(0, 5000, 50)]
