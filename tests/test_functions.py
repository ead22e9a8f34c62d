"""Golden values and edge rows of the functions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayloom.functions import draws, geometry, sequences, text
from wayloom.operators import filters, trajectories


@pytest.fixture(scope="module")
def one(spark):
    def run(*columns):
        return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()

    return run


@pytest.mark.parametrize(
    ("reply", "most", "want"),
    [
        ("Move Forward, Turn Left", 4, ["move_forward", "turn_left"]),
        ("forward forward stop", 5, ["move_forward", "move_forward", "stop"]),
        ("Final Answer: ↑→STOP", 5, ["move_forward", "turn_right", "stop"]),
        ("Final Answer: ↑STOP→", 5, ["move_forward", "stop"]),
        ("no actions here", 4, []),
        ("", 4, []),
    ],
)
def test_answers(one, reply, most, want):
    assert one(text.parse_answer(F.lit(reply), most))[0] == want


def test_mixed_stop_does_not_end(one):
    assert one(text.parse_mixed(F.lit("unstoppable ↑ Turn Left"), 6))[0] == ["stop", "move_forward", "turn_left"]


def test_overlap(one):
    row = one(
        text.token_overlap(F.lit("the"), F.lit("kitchen")), text.token_overlap(F.lit("kitchen"), F.lit("")), text.token_overlap(F.lit("Kitchen door"), F.lit("kitchen"))
    )
    assert list(row) == [1.0, 0.0, 0.5]


def test_template_order(one):
    said = F.lit("If there is a lamp in the hall, stop where you are; otherwise, go on.")
    row = one(text.reparse_template(said), text.reparse_template(said, compat=True))
    assert (row[0]["template"], row[0]["thing"], row[0]["body"]) == ("D_if_stay", "a lamp", "go on")
    assert row[1]["template"] == "B_if_then"


@pytest.mark.parametrize(("value", "want"), [(0.25, "0.25"), (1.5, "1.5"), (3.0, "3"), (10.0, "10"), (100.0, "100"), (0.0, "0")])
def test_meters(one, value, want):
    assert one(text.format_meters(F.lit(value)))[0] == want


def test_first_occurrence_only(one):
    row = one(text.swap_first(F.lit("a.b.b"), F.lit("b"), F.lit("c")), text.swap_first(F.lit("abc"), F.lit("x"), F.lit("y")), text.swap_first(F.lit("abc"), F.lit(""), F.lit("y")))
    assert list(row) == ["a.c.b", "abc", "abc"]


def test_seven_digit_ids(one):
    row = one(text.ep_tag(F.lit("s"), F.lit("t"), F.lit(9_000_001)), text.parse_step_id(F.lit("s_t_9000001_step_4")))
    assert row[0] == "s_t_9000001" and tuple(row[1]) == (9_000_001, 4)


def test_all_stop(one):
    six, five = "Final Answer: " + ", ".join(["Stop"] * 6), "Final Answer: " + ", ".join(["Stop"] * 5)
    assert list(one(filters.all_stop(F.lit(six)), filters.all_stop(F.lit(five)), filters.all_stop(F.lit(six + ", Turn Left")))) == [True, False, False]


def test_positions(one):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(2.0 + 1e-7))
    null, nan = F.lit(None).cast("array<double>"), F.array(F.lit(1.0), F.lit(math.nan))
    assert list(one(geometry.positions_equal(a, b), geometry.positions_equal(a, null), geometry.positions_equal(null, null), geometry.positions_equal(nan, nan))) == [True, False, True, False]


def test_spl(one):
    assert list(one(*(geometry.spl(F.lit(s), F.lit(a), F.lit(b)) for s, a, b in [(1.0, 5.0, 5.0), (0.0, 4.0, 6.0), (1.0, 3.0, 6.0), (1.0, 0.0, 0.0)]))) == [1.0, 0.0, 0.5, 0.0]


def test_rotation_round_trip(one):
    row = one(geometry.yaw_of(geometry.of_yaw(F.lit(0.7))), geometry.rotation(F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.9))), "xyzw"))
    assert row[0] == pytest.approx(0.7) and row[1]["w"] == 0.9 and row[1]["x"] == 0.1
    with pytest.raises(KeyError):
        geometry.rotation(F.lit(None), "zyx")


def test_windows(one):
    actions = F.array(*map(F.lit, (-1, 1, 2, 0)))
    row = one(sequences.history(F.lit(2), F.lit(4)), sequences.future(actions, F.lit(1), 4), sequences.rebase(actions), sequences.spread_rounded(F.lit(5), 1), sequences.spread_cut(F.lit(0), 4))
    assert [list(x) for x in row] == [[1, 2, 3, 3, 3, 3, 3, 3], [2, 0, 0, 0], [1, 2, 0, 0], [5], []]


def test_fixed_rate(one):
    row = one(sequences.fixed_rate(F.lit(20), F.lit(1.0), 1.0, 8))[0]
    assert len(row["places"]) == 8 and row["duration"] == 20.0 and row["places"][-1] == 19


def python_linspace(first, last, n):
    import numpy as np

    return np.linspace(first, last, n, dtype=int).tolist()


def test_linspace_is_numpy(spark):
    cases = [(n, m) for n in range(1, 60) for m in range(2, 13)]
    rows = spark.createDataFrame(cases, "n int, m int").select("n", "m", sequences.linspace(F.lit(0), F.col("n") - 1, F.col("m")).alias("x")).collect()
    assert all(r["x"] == python_linspace(0, r["n"] - 1, r["m"]) for r in rows)


def test_segments_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice((1, 1, 1, 2, 3)) for _ in range(rng.randrange(0, 30))]) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, actions array<int>")
    out = df.select("actions", trajectories.expand_segments(trajectories.segments_of(F.col("actions"))).alias("back")).collect()
    assert all(r["actions"] == r["back"] for r in out)


def test_precise_sentences_keep_their_numbers(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        segments = [("forward", rng.randrange(1, 20) * 0.25) if k % 2 else (rng.choice(("turn_left", "turn_right")), float(30 * rng.randrange(1, 7))) for k in range(rng.randrange(1, 6))]
        rows.append((draws.precise_sentence(segments, draws.episode_random(i, 0, 7)), [n for _, n in segments]))
    df = spark.createDataFrame(rows, "said string, want array<double>")
    bad = df.where(~text.numbers_match(text.numbers_in(F.col("said")), F.col("want"))).collect()
    # Several half turns in one sentence may be worded without a number, which counts once.
    assert all(sum(n == 180 for n in r["want"]) > 1 for r in bad)


def test_draws_are_reproducible():
    assert draws.episode_random(5, 1, 42).random() == draws.episode_random(5, 1, 42).random()
    assert draws.episode_random(5, 1, 42).random() != draws.episode_random(5, 2, 42).random()


def test_manual_episode(one):
    verbs = F.array(*map(F.lit, ("move_forward", "turn_left", "stop", "move_forward")))
    assert list(one(filters.manual_actions(verbs), filters.manual_reason(verbs, F.lit(3), F.lit("go")), filters.manual_reason(F.array(F.lit("jump")), F.lit(2), F.lit("go")))) == [[-1, 1, 2], None, "unknown_verb"]


def test_fill_template(one):
    assert one(text.fill_template("{a} of {b} {c}", a=F.lit(1), b=F.lit("x")))[0] == "1 of x {c}"


def test_utc_text(one):
    assert one(text.utc_text(F.lit(86399)))[0] == "1970-01-01T23:59:59Z"
