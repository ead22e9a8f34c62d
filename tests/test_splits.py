"""Long JSON lists and numbered lines over many splits."""

import gzip
import json
import random

import pytest

from wayloom.sources import records

ENVELOPES = records.ENVELOPES


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(seed, n):
    rng = random.Random(seed)
    odd = ('a } "b" {', "[x]}", "back\\slash\\", '"records": [', "plain", "é }", "}" * 30, "\\", '\\"}', "long " * 90, "")
    return [{"id": i, "said": "".join(rng.choice(odd) for _ in range(rng.randrange(3))), "deep": [{"b": [i, {}]}]} for i in range(n)]


def forms(found):
    return [
        json.dumps(found), json.dumps(found, indent=2, ensure_ascii=False), json.dumps({"x": [1, {"id": -1}], "y": {"records": [{"id": -2}]}, "long": ["}"] * 40, "records": found, "episodes": [{"id": -3}]}),
        json.dumps({"about": "records", "episodes": found, "z": [{"id": -4}] * 9}), json.dumps([[{"id": -5}], "records", 7, "}{", *found, [[]], "end"]),
    ]


def test_states_at_every_brace():
    """Cut anywhere after a brace, the summaries lead to what one reader finds in the whole text."""
    import pandas as pd

    for body in forms(rows(1, 12)):
        pieces = body.split("}")
        whole = records.ArrayParser().feed(body)
        for width in (1, 2, 5, 9):
            parts = ["}".join(pieces[k : k + width]) for k in range(0, len(pieces), width)]
            parts = parts[:1] + ["}" + p for p in parts[1:]]
            assert "".join(parts) == body
            sums = []
            for k, part in enumerate(parts):
                s = records.SplitSummary()
                s.feed(part)
                sums.append(("f", k, s.odd, bool(s.bare), s.depth, s.low, json.dumps(s.lists)))
            states = records._starts(pd.DataFrame(sums, columns=["file", "block", "odd", "bare", "depth", "low", "lists"]))
            out, held = [], ""
            for part, state in zip(parts, states.itertuples()):
                parser = records.ArrayParser(ENVELOPES, state.in_string, state.depth, None if state.list_depth < 0 else state.list_depth, state.done)
                for text, kind in [*parser.parts(part), *parser.rest()]:
                    held = text if kind in (records.FIRST, records.WHOLE) else held + text
                    out += [held] if kind in (records.WHOLE, records.LAST) else []
            assert out == whole and len(out) == 12


def test_lists_over_many_splits(spark, tmp_path, small_splits):
    want = []
    for k, body in enumerate(forms(rows(2, 25))):
        (tmp_path / f"{k}.json").write_text(body, encoding="utf-8")
        want += [(r["id"], r["said"]) for r in rows(2, 25)]
    (tmp_path / "z.json.gz").write_bytes(gzip.compress(json.dumps(rows(2, 25)).encode()))
    (tmp_path / "broken.json").write_text(json.dumps(rows(2, 25))[:-150])
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text('{"records": []}')
    broken = len(records.ArrayParser().feed(json.dumps(rows(2, 25))[:-150]))
    want += [(r["id"], r["said"]) for r in rows(2, 25) + rows(2, 25)[:broken]]
    read = records.read_array(spark, str(tmp_path), "id long, said string")
    assert sorted((r["id"], r["said"]) for r in read.collect()) == sorted(want)
    splits = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
    assert splits > 100


def test_numbered_lines(spark, tmp_path, small_splits):
    rng, want = random.Random(3), []
    for name in ("a.txt", "b.txt", "c.txt.gz"):
        lines = ["x" * rng.choice((0, 1, 30, 400)) + str(i) * (i % 3 > 0) for i in range(120)]
        body = "\n".join(lines) + ("\n" if name != "b.txt" else "")
        (tmp_path / name).write_bytes(gzip.compress(body.encode()) if name.endswith("gz") else body.encode())
        lines = lines if name != "b.txt" or lines[-1] else lines[:-1]
        want += [(name, n, line) for n, line in enumerate(lines, 1)]
    got = [(r["path"].rsplit("/", 1)[1], r["number"], r["line"]) for r in records.numbered_lines(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_numbers_of_bad_lines(spark, tmp_path, small_splits):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": \n{"id": 2}\n' + '{"id": 3}\n' * 60 + "nothing\n")
    got = records.malformed_lines(spark, str(tmp_path), "id long", numbers=True).collect()
    assert sorted((r["number"], r["line"]) for r in got) == [(3, '{"id": '), (65, "nothing")]
