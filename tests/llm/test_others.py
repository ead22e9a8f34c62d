"""Token counts, fingerprints, WARC, the classifiers and the pipeline."""

import gzip
import hashlib
import math
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wayloom.llm import common, fingerprints, quality, token_counts, toxicity, warc
from wayloom.llm.queries import ORACLES, QUERIES, tokenizer_path

from .corpus import COLUMNS, documents, frame, sentence, words

PIECES = tokenizer_path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"


def brute_tokens(model, word):
    marked = token_counts.WORD_MARK + word
    best = {0: (0.0, 0)}
    for end in range(1, len(marked) + 1):
        size = len(marked[end - 1].encode())
        options = [(best[end - 1][0] + size * model.unknown, -(best[end - 1][1] + size))]
        options += [(best[s][0] + model.scores[marked[s:end]], -(best[s][1] + 1)) for s in range(end) if marked[s:end] in model.scores]
        top = max(options)
        best[end] = (top[0], -top[1])
    return best[len(marked)][1]


def test_token_counts(spark):
    rows = documents()
    model = token_counts.Unigram.from_sentencepiece(PIECES)
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.count_tokens(frame(spark, rows, clashing=True), PIECES).collect()}
    assert got == {r[0]: (len(words(r[1])), sum(brute_tokens(model, w) for w in words(r[1]))) for r in rows}
    assert token_counts.count_tokens(spark.createDataFrame([], COLUMNS), PIECES).count() == 0


def test_token_counts_random_words():
    rng = random.Random(0)
    model = token_counts.Unigram.from_sentencepiece(PIECES)
    spelled = {"".join(rng.choice("abetrinsoéЖ語😀") for _ in range(rng.randrange(1, 14))) for _ in range(800)}
    assert model.terminal_counts(spelled) == {w: brute_tokens(model, w) for w in spelled}


def brute_sketch(text, k=fingerprints.SHINGLE_WORDS, scale=fingerprints.SCALE):
    signed = lambda u: u - 2**64 if u >= 2**63 else u

    def chain(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v, seed)
        return signed(seed)

    hashes = [chain([w.encode()]).to_bytes(8, "little", signed=True) for w in words(text)]
    if not hashes:
        return set(), None
    rolled = [chain(hashes[i : i + k]) for i in range(max(1, len(hashes) - k + 1))]
    return {h for h in rolled if h < -(2**63) + 2**64 // scale}, min(rolled)


def sketch_likeness(a, b):
    return len(a[0] & b[0]) / len(a[0] | b[0]) if a[0] | b[0] else float(a[1] == b[1])


def shown(found):
    return "" if found[1] is None else f"{found[1] % 2**64:016X}" + "".join(f"{h % 2**32:08X}" for h in sorted(found[0]))


@pytest.mark.parametrize("range_bytes", [fingerprints.RANGE_BYTES, 3000])
def test_fingerprints(spark, range_bytes):
    rows = documents()
    df = frame(spark, rows, clashing=True)
    got = {r["doc_id"]: r for r in fingerprints.compare_with_edits(df, range_bytes=range_bytes).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for r, nxt in zip(order, order[1:] + order[:1]):
        text, other = r[1] or "", nxt[1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        a, b, c = (brute_sketch(t) for t in (text, edited, other))
        g = got[r[0]]
        assert (g["n_chars"], g["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert g["near_edited"] == pytest.approx(sketch_likeness(a, b)) and g["near_next"] == pytest.approx(sketch_likeness(a, c))
        assert (g["fingerprint"], g["edited_fingerprint"]) == (shown(a), shown(b))


def test_fingerprint_odd_tables(spark):
    assert fingerprints.compare_with_edits(spark.createDataFrame([], COLUMNS)).count() == 0
    one = fingerprints.compare_with_edits(spark.createDataFrame([(1, "a b c d e f g", None, None, 0)], COLUMNS)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    repeats = spark.createDataFrame([(None, "x", None, None, 0)] * 2 + [(3, "a b", None, None, 0)] * 3 + [(3, "c", None, None, 0)], COLUMNS)
    assert fingerprints.compare_with_edits(repeats).count() == 6
    assert [r["least"] is None for r in fingerprints.fingerprint_documents(spark.createDataFrame([(1, None, None, None, 0), (2, " ", None, None, 0), (3, "a", None, None, 0)], COLUMNS)).orderBy("doc_id").collect()] == [True, True, False]


def test_fingerprints_merge(spark):
    """The fingerprint of a union is the merged fingerprints, and a part of a long text is wholly contained in it."""
    rng = random.Random(1)
    rows = []
    for i in range(60):
        whole = sentence(rng, rng.choice((3, 12, 400, 4000)), 10**6).split(" ")
        first, n = rng.randrange(len(whole)), len(whole)
        cut = rng.randrange(5, n) if n > 10 else n
        rows.append((i, " ".join(whole), " ".join(whole[first : first + 300]), " ".join(whole[:cut]), " ".join(whole[max(0, cut - 4) :])))
    df = spark.createDataFrame(rows, "i long, whole string, part string, head string, tail string")
    of = {c: fingerprints.fingerprint(F.col(c)) for c in ("whole", "part", "head", "tail")}
    whole_again = fingerprints.merge(of["head"], of["tail"])  # every shingle of five words lies in one of the two, or both
    got = df.where("size(split(whole, ' ')) > 10").select((whole_again == of["whole"]).alias("same"), fingerprints.containment(of["part"], of["whole"]).alias("inside"), F.size(F.split("part", " ")).alias("n")).collect()
    assert len(got) > 30 and all(r["same"] for r in got)
    assert all(r["inside"] in (None, 1.0) for r in got if r["n"] >= 5)


def pages():
    rng = random.Random(2)
    copy = "<p>" + sentence(rng, 300) + "</p>"
    rows = [(i, f"http://h/{i} x\r\ny", copy if i % 4 == 0 else "<p>short</p>" if i % 4 == 1 else sentence(rng, rng.randrange(0, 400))) for i in range(60)]
    return rows + [(70, None, None), (71, "", ""), (72, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 60), (73, "u", "é" * 500), (74, "u", "é" * 500), (75, "u", "e" * 999), (76, "u", "e" * 999)]


def test_warc(spark):
    rows = pages()
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    want = {}
    for i, _, html in rows:
        body, top = (html or "").encode(), max(groups[html or ""])
        revisit = len(body) >= 1000 and i < top
        want[i] = (len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top if revisit else None)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("body", F.lit(2))
    got = warc.roundtrip(df.repartition(5).orderBy(F.rand(3))).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want and len(got) == len(rows)


def test_warc_odd_rows(spark, tmp_path):
    rows = [(None, "u", "a"), (None, "u", "a"), (5, "u", "b" * 2000), (5, "u", "b" * 2000), (6, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"]) for r in warc.roundtrip(df).collect()), key=str)
    assert got == sorted([(None, 1, "response")] * 2 + [(5, 2000, "response"), (5, 2000, "revisit"), (6, 0, "response")], key=str)
    assert warc.roundtrip(df.limit(0)).count() == 0
    warc.write_warc(df, str(tmp_path / "archive"))
    captures = warc.assemble(warc.read_warc(spark, str(tmp_path / "archive"))).collect()
    assert len(captures) == 5 and all(c["request"] and c["metadata"] and c["response"]["digest_agrees"] for c in captures)
    assert sorted(bytes(c["response"]["payload"]) for c in captures) == [b"", b"a", b"a", b"b" * 2000, b"b" * 2000]


@pytest.mark.parametrize("file_bytes", [1, 4_000, 10**9])
def test_warc_files(spark, tmp_path, file_bytes):
    """Each record is a gzip member; files are rolled by bytes; a page longer than 16 MB comes back whole."""
    rows = [*pages(), (80, "u", "long " * 4_000_000)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "a"), file_bytes=file_bytes)
    sizes = []
    for file in (tmp_path / "a").rglob("*.txt"):
        data, members, raw = file.read_bytes(), 0, 0
        while data:
            one = zlib.decompressobj(31)
            block = one.decompress(data)
            found = list(warc.parse_records(block))
            assert len(found) <= 1
            members, raw, data = members + len(found), raw + len(block), one.unused_data
        sizes.append((members, raw))
    assert sum(m for m, _ in sizes) == 3 * len(rows) and all(m % 3 == 0 and (raw <= file_bytes or m == 3) for m, raw in sizes)
    whole = {c["key"]: c["response"] for c in warc.assemble(warc.read_warc(spark, str(tmp_path / "a"))).collect()}
    assert {i: bytes(c["payload"]).decode() for i, c in whole.items()} == {r[0]: r[2] or "" for r in rows} and all(c["digest_agrees"] for c in whole.values())


def test_warc_reader(tmp_path):
    """Members, one member for all, and plain bytes read alike; a wrong length is refused."""
    records = [b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n" for b in (b"", b"a\r\n\r\nWARC/1.1", b"x" * 3_000_000)]
    want = [b"", b"a\r\n\r\nWARC/1.1", b"x" * 3_000_000]
    for data in (b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records)), b"".join(records)):
        assert [b for _, b in warc.parse_records(warc.unpacked(data))] == want
    for bad in (records[1][:-3], b"nothing", records[0].replace(b": 0", b": 1")):
        with pytest.raises(ValueError, match="byte"):
            list(warc.parse_records(bad))


def labelled(spark, seed=0):
    """Clean prose, shouted prose with symbols (label 0), and clean prose with a few words that mark it as toxic."""
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(900):
        body = [word() for _ in range(rng.randrange(30, 120))]
        junk, toxic = i % 7 == 0, i % 7 in (3, 4)
        if toxic:
            for _ in range(3):
                body[rng.randrange(len(body))] = rng.choice(("zorbak", "quimble", "wuzzit"))
        text = " ".join(w.upper() + "!!%%%" for w in body) if junk else " ".join(body)
        docs.append((i, text, "en", "a", len(text)))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r for r in labels}


def test_quality(spark):
    docs, labels, truth = labelled(spark)
    labels = labels.union(spark.createDataFrame([(None, 1, 0), (5, None, None)], labels.schema))
    got = quality.score_quality(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert 100 < len(held) < 300 and all(r["held_out"] == (__import__("zlib").crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]][1] for r in held]) > 0.97
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and sum(truth[r["doc_id"]][1] for r in kept.collect()) > 0.97 * sum(t[1] for t in truth.values())


def test_toxicity(spark):
    docs, labels, truth = labelled(spark, 1)
    odd = [(5000, "he said z0rb4k and qu1mble to wuzz1t all then", "en", "a", 0), (5001, "so z o r b a k and w u z z i t thin the er", "en", "a", 0), (5002, "then zorbaaaak the quimmmmble er on an", "en", "a", 0), (5003, None, None, None, None), (5004, "", None, None, 0)]
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs.union(spark.createDataFrame(odd, COLUMNS)), labels).collect()}
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]][2] for r in held]) > 0.97
    assert [got[i]["predicted"] for i in (5000, 5001, 5002, 5003, 5004)] == [1, 1, 1, 0, 0]


def test_classifiers_without_labels(spark):
    docs = frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        got = score(docs, none).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
        assert score(spark.createDataFrame([], COLUMNS), none).count() == 0
    clashing = frame(spark, clashing=True)
    assert quality.keep_quality(clashing, none).columns == clashing.columns


def test_nnpu_separates():
    rng = np.random.default_rng(0)
    positive, negative = rng.normal(1.5, 1, (2000, 3)), rng.normal(-1.5, 1, (600, 3))
    w = quality.fit_nnpu(positive[:1000], np.vstack([positive[1000:], negative]), 1000 / 1600)
    score = lambda x: 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert (score(positive) > 0.5).mean() > 0.95 and (score(negative) < 0.5).mean() > 0.95


def plain_risks(w, positive, unlabelled, prior):
    """The two parts of the risk, row by row."""
    loss = lambda x, y: math.log1p(math.exp(-y * (sum(a * b for a, b in zip(x, w)) + w[-1])))
    mean = lambda rows, y: sum(loss(r, y) for r in rows) / len(rows)
    return prior * mean(positive, 1), mean(unlabelled, -1) - prior * mean(positive, -1)


def test_nnpu_is_the_plain_risk():
    rng = np.random.default_rng(4)
    positive, unlabelled, w = rng.normal(0.5, 1, (20, 3)), rng.normal(0, 1, (30, 3)), rng.normal(0, 1, 4)
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (positive, unlabelled))
    part, negative, toward, away = quality.nnpu_risk(w, p, u, 0.4)
    assert (part, negative) == pytest.approx(plain_risks(w, positive, unlabelled, 0.4))
    for k in range(4):
        step = np.eye(4)[k] * 1e-5
        more, less = plain_risks(w + step, positive, unlabelled, 0.4), plain_risks(w - step, positive, unlabelled, 0.4)
        assert (toward[k], away[k]) == pytest.approx(((more[0] - less[0]) / 2e-5, (more[1] - less[1]) / 2e-5), abs=1e-6)
    fitted = quality.fit_nnpu(positive, unlabelled, 0.4, decay=0.0)
    risk = lambda w: (lambda a, b: a + max(0.0, b))(*plain_risks(w, positive, unlabelled, 0.4))
    assert all(risk(fitted) <= risk(fitted + 0.05 * rng.normal(0, 1, 4)) + 1e-3 for _ in range(50))


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_class_prior(prior):
    rng = np.random.default_rng(0)
    one = lambda n: rng.normal(1.5, 1, (n, 3))
    n = round(6000 * prior)
    unlabelled = np.vstack([one(n), rng.normal(-1.5, 1, (6000 - n, 3))])
    assert quality.class_prior(one(4000), unlabelled) == pytest.approx(prior, abs=0.04)
    assert quality.class_prior(one(10), unlabelled) == 0.5


def test_range_buckets(spark):
    df = spark.range(0, 5000).select((F.col("id") * 977 % 100003).alias("k"))
    got = df.withColumn("b", common.range_bucket(df, "k", 40)).groupBy("b").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n")).orderBy("b").collect()
    assert len(got) >= 30 and all(a["hi"] < b["lo"] for a, b in zip(got, got[1:])) and max(r["n"] for r in got) < 500


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, df.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_pipeline(spark):
    """Each stage against brute force on its own input, and all of it."""
    import corpus_pipeline

    from .test_dedup import brute_near, sha
    from .test_mixing_packing import brute_mix

    docs = common.table(spark, FOLDER, "documents")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select(*columns).collect()]
        docs = common.materialize(stage(spark, docs, FOLDER), f"test-{name}")
        rows[name] = (before, docs.collect())
        if name != "pack":
            assert docs.columns == columns
    before, after = rows["quality"]
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, FOLDER, "labels").collect()}
    kept = {r["doc_id"] for r in after}
    assert len([i for i, q in labels.items() if q == 1 and i in kept]) >= 0.97 * sum(labels.values())
    before, after = rows["exact"]
    best = defaultdict(int)
    for r in before:
        best[sha(r[1] or "")] = max(best[sha(r[1] or "")], r[0])
    assert sorted(r["doc_id"] for r in after) == sorted(best.values())
    before, after = rows["near"]
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, w in brute_near(before, 5).items() if w[2])
    before, after = rows["mix"]
    want = {i: w[3] // w[0] for i, w in brute_mix(before).items() if w[3]}
    counts = defaultdict(int)
    for r in after:
        counts[r["doc_id"]] += 1
    assert dict(counts) == want
    before, after = rows["pack"]
    assert sum(r["piece"] == 0 for r in after) == len(before)
    assert math.ceil(sum(r["length"] for r in after) / 4096) <= len({r["sequence_id"] for r in after})
