"""Small documents with copies, near copies, shared passages and odd rows."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators might use themselves.
CLASHING = ["id", "body", "size", "key", "n", "kept", "keep_id", "rank", "copies", "score", "list", "part", "length", "range", "sketch", "hash", "h", "h2", "copy", "COPIES", "finish", "last0", "Last1_", "order", "place", "again"]
CLASHING += ["__h", "__H_", "__rh", "__id", "__dropped", "__copies", "__copy", "__finish", "__pick", "__toxic", "__parts", "__salt", "__row", "__size", "__crc"]


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(seed=0, n=120):
    rng = random.Random(seed)
    rows, texts = [], []
    passage = sentence(rng, 70)
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and texts:
            text = rng.choice(texts)
        elif kind < 0.4 and texts:
            words = rng.choice(texts).split(" ")
            for _ in range(max(1, len(words) // rng.choice((20, 60, 150)))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
            text = " ".join(words)
        elif kind < 0.55:
            text = f"{sentence(rng, rng.randrange(0, 60))} {passage} {sentence(rng, rng.randrange(0, 60))}".strip()
        else:
            text = sentence(rng, rng.choice((1, 2, 3, 4, 5, 30, 49, 50, 51, 120, 300)))
        texts.append(text)
        rows.append((i, text, rng.choice(("en", "de", None)), rng.choice(("a", "b", "c", None)), len(text)))
    rows += [
        (1001, None, None, None, None),
        (1002, "", "en", "a", 0),
        (1003, " \t\n\x0b\x0c\r ", "en", "b", 7),
        (1004, "É à Ü ß " * 40, "fr", "c", 280),
        (1005, "same " * 300, "en", "a", 1500),
        (1006, "A b\tC  d\nE f " * 20, "en", "é", 0),
        (1007, "a B c D e F " * 20, "en", "z", 0),
    ]
    return rows


def frame(spark, rows=None, clashing=False):
    df = spark.createDataFrame(documents() if rows is None else rows, COLUMNS)
    if clashing:
        from pyspark.sql import functions as F

        for name in CLASHING:
            df = df.withColumn(name, F.lit("extra"))
    return df


def words(text):
    """Words between ASCII white space."""
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
