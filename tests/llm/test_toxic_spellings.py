"""Spellings that reach the decoder of op10."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest

from wayloom.llm import toxicity


@pytest.fixture(scope="module")
def restore():
    text = pd.Series(["you are such a loser and an idiot they said the stupid clown is a fool and the class was all in good order to the end of it we saw a mess of an ass in the field"] * 20)
    counts = np.zeros(toxicity._ALPHABET**3, np.int64)
    for c in toxicity._blocks(text):
        counts += np.bincount((c[:-2] * toxicity._ALPHABET + c[1:-1]) * toxicity._ALPHABET + c[2:], minlength=len(counts))
    return toxicity.Restorer(counts)


@pytest.mark.parametrize(
    "written, meant",
    [
        ("a s s", "ass"), ("such a l o s e r", "loser"), ("l\to\ts\te\tr", "loser"), ("l\no\ns\ne\nr", "loser"), ("l  o  s  e  r", "loser"), ("y o u  l o s e r", "loser"), ("y o u a r e s t u p i d", "stupid"),
        ("stuupid", "stupid"), ("idiiot", "idiot"), ("|diot", "idiot"), ("!diot", "idiot"), ("idio+", "idiot"), ("(lown", "clown"), ("|d1ot!!!", "idiot"), ("idio+!!!", "idiot"),
    ],
)
def test_obfuscations_are_decoded(restore, written, meant):
    assert meant in restore.words(f"so {written}, then")


def test_plain_neighbours_stay_whole(restore):
    assert restore.words("b a s s (class)") >= {"bass", "class"} and "ass" not in restore.words("b a s s")


def test_runs_are_decided_as_in_the_lattice(restore):
    for word in ("stuupid", "idiiot", "coool", "ffield", "messss", "aallooss", "classs", "goodd", "oo", "bookkeeper"):
        assert restore.unrepeated(word) == restore.word(word)


def enumerated(restore, written, breaks):
    """Cheapest way through the lattice, by trying every path."""
    runs = [(c, len(list(g))) for c, g in itertools.groupby(written)]
    cells = []
    for c, n in runs:
        options = [(c, 0.0)] if c.isalpha() else []
        options += [(x, restore.SWAP) for x in toxicity.LOOKALIKES.get(c, "")]
        if not options:
            options = [("", restore.KEEP_SYMBOL if c.isalnum() else 0.5)]
        paths = []
        for letter, price in options:
            for times in (1, 2) if n > 1 and letter else (1,):
                for blank in ("", " ") if breaks else ("",):
                    paths.append((letter * times, blank, price + (restore.REPEAT if times != n else 0.0)))
        cells.append(paths)
    best = (float("inf"), "")
    for path in itertools.product(*cells):
        text, total, ok = "", 0.0, True
        context = (0, 0)
        for letters, blank, price in path:
            total += price
            for c in letters:
                total += restore.cost[*context, toxicity._class(c)]
                context = (context[1], toxicity._class(c))
            if blank:
                ok &= context[1] != 0  # no blank after a blank
                total += restore.cost[*context, 0]
                context = (context[1], 0)
            text += letters + blank
        if context[1] or not breaks:
            total += restore.cost[*context, 0]
        if ok:
            best = min(best, (total, text))
    return best


@pytest.mark.parametrize("breaks", [False, True])
def test_decoding_is_the_best_path(restore, breaks):
    rng, letters = random.Random(7), "aeloscd01$@!|(*x%9"
    for _ in range(300):
        written = "".join(rng.choice(letters) * rng.choice((1, 1, 1, 2, 3)) for _ in range(rng.randrange(1, 5)))
        assert restore.word(written, breaks) == enumerated(restore, written, breaks)[1], written


@pytest.mark.parametrize("written,least,first,last", [("!|(+!diot+!(|*", 4, 5, 5), ("aeiouloserya", 3, 5, 2), ("|+|+|diot", 4, 5, 0), ("ayeyaeiouyrey", 3, 13, 13), ("ab", 3, 1, 1)])
def test_every_stretch_is_tried(restore, written, least, first, last):
    """However many symbols stand at a word's ends, each number of them is tried."""
    cells = [c * n for c, n in toxicity._cells(written)]
    spans = [(i, j) for i in range(first + 1) for j in range(len(cells) - last, len(cells) + 1) if least <= j - i <= toxicity.MOST_LETTERS]
    assert restore.stretches(written, least, first, last) == {restore.word("".join(cells[i:j])) for i, j in spans}


def test_long_tokens_take_proportional_time(restore):
    """Thousands of symbols around letters, or of spaced letters: every stretch that can be a word, and no more."""
    import time

    began = time.perf_counter()
    words = restore.words("!|" * 2000 + "diot " + "a e " * 3000 + "l o s e r")
    assert "idiot" in words and "loser" in words and time.perf_counter() - began < 60
    assert all(len(w) <= toxicity.MOST_LETTERS for w in restore.features("x" * 65 + " " + "y" * 64) if not w.startswith("^")) and "y" * 64 in restore.features("y" * 64)


def test_all_weights_count(restore):
    weights = {f"w{chr(97 + i)}": 1.0 for i in range(9)}
    assert toxicity._summary(restore, weights, " ".join(weights))[1] == pytest.approx(np.log1p(9.0))
