"""Functions over arrays, maps and steps of one row: samplers, windows, re-basing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_INTS = "array<int>"


def indices(n: Column) -> Column:
    """0 .. n-1, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast(NO_INTS))


def rebase(actions: Column) -> Column:
    """Without the sentinel in front, with a stop at the end."""
    return F.concat(F.slice(actions, F.lit(2), F.greatest(F.size(actions) - 1, F.lit(0))), F.array(F.lit(0)))


def last_of(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def turn_count(actions: Column) -> Column:
    return F.size(F.filter(actions, lambda a: a.isin(2, 3)))


def history(step: Column, frames: Column, size: int = 8) -> Column:
    """1-based frames of a trailing window that ends at ``step`` (0-based); short ones repeat the current frame."""
    current = F.least(step + 1, frames).cast("int")
    first = F.greatest(F.lit(1), current - (size - 1))
    seen = F.sequence(first, F.greatest(current, first))
    return F.concat(seen, F.array_repeat(F.greatest(current, F.lit(1)), F.lit(size) - F.size(seen)))


def future(actions: Column, step: Column, size: int = 6) -> Column:
    """The next actions after ``step``; beyond the end and below 0 it is a stop."""
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda j: F.greatest(F.coalesce(F.get(actions, (step + j).cast("int")), F.lit(0)), F.lit(0)))


def chunks(actions: Column, size: int) -> Column:
    """Tumbling chunks of ``size``, the last one filled with stops."""
    starts = F.when(F.size(actions) > 0, F.sequence(F.lit(0), F.size(actions) - 1, F.lit(size))).otherwise(F.array().cast(NO_INTS))
    return F.transform(
        starts,
        lambda s: F.struct(
            s.alias("start"),
            F.concat(F.slice(actions, s + 1, F.lit(size)), F.array_repeat(F.lit(0), F.greatest(F.lit(0), s + size - F.size(actions)))).alias("actions"),
        ),
    )


def spread_rounded(last: Column, most: int) -> Column:
    """At most ``most`` of the places 0..last, evenly spread, halves rounded to even. One place is the last."""
    if most == 1:
        return F.array(last.cast("int"))
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * last / F.lit(float(most - 1)), 0).cast("int"))
    return F.when(last + 1 <= most, indices(last + 1)).otherwise(F.array_distinct(even))


def linspace(first: Column, last: Column, n: Column) -> Column:
    """n whole numbers from first to last, evenly spaced and cut down; the last one is exact."""
    step = F.try_divide(last - first, n - 1)
    return F.when(n == 1, F.array(first.cast("int"))).otherwise(
        F.transform(indices(n), lambda i: F.when(i == n - 1, last.cast("int")).otherwise(F.floor(first + i * step).cast("int")))
    )


def spread_cut(total: Column, most: int) -> Column:
    """All places of ``total``, or ``most`` of them by ``linspace``."""
    return F.when(total <= most, indices(total)).otherwise(linspace(F.lit(0), total - 1, F.lit(most)))


def first_current_middle(step: Column, total: Column, size: int = 8) -> Column:
    """First and current frame and an even choice between; a short middle repeats the current one."""
    last = F.least(step, total - 1).cast("int")
    middle = size - 2
    if size <= 1:
        return F.array(last)
    between = F.when(last - 1 <= middle, F.when(last > 1, F.sequence(F.lit(1), F.greatest(last - 1, F.lit(1)))).otherwise(F.array().cast(NO_INTS))).otherwise(
        linspace(F.lit(1), last - 1, F.lit(middle))
    )
    full = F.concat(F.array(F.lit(0)), between, F.array_repeat(last, F.lit(middle) - F.size(between)), F.array(last))
    return F.when(last == 0, F.array_repeat(F.lit(0), F.lit(size))).otherwise(full)


def fixed_rate(total: Column, fps: Column, target: float, most: int, force: bool = False) -> Column:
    """Places sampled at a target rate, or ``most`` evenly spread ones if that gives more (or always); times and duration."""
    stride = F.greatest(F.lit(1), F.bround(fps / target, 0).cast("int"))
    by_rate = F.when(total > 0, F.sequence(F.lit(0), total.cast("int") - 1, stride)).otherwise(F.array().cast(NO_INTS))
    places = F.when((F.size(by_rate) > most) | F.lit(force), linspace(F.lit(0), total - 1, F.lit(most))).otherwise(by_rate)
    times = F.array_join(F.transform(places, lambda i: F.format_string("%.2fs", i / fps)), ",")
    return F.struct(places.alias("places"), times.alias("times"), F.coalesce(F.try_divide(total, fps), F.lit(0.0)).alias("duration"))


def even_frames(total: Column, n: int) -> Column:
    """n places from first to last, halves rounded to even, without repeats; the last place is always in."""
    if n == 1:
        return F.when(total > 1, F.array(F.lit(0))).otherwise(indices(total))
    return F.when(total <= n, indices(total)).otherwise(spread_rounded(total - 1, n))


def frame_times(n: Column, fps: float = 1.0) -> Column:
    return F.array_join(F.transform(indices(n), lambda i: F.format_string("%.2fs", i / F.lit(fps))), ",")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def sample_length(conversations: Column, has_image: Column, image_words: int = 128) -> Column:
    return F.aggregate(conversations, F.lit(0), lambda n, c: n + word_count(c["value"])) + F.when(has_image, image_words).otherwise(0)


def modality_length(conversations: Column, has_image: Column, image_words: int = 128) -> Column:
    """As ``sample_length``, negative for text alone."""
    n = sample_length(conversations, has_image, image_words)
    return F.when(has_image, n).otherwise(-n)


def two_turns(prompt: Column, answer: Column) -> Column:
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    return F.array(turn("human", prompt), turn("gpt", answer))
