"""Text functions over instruction, action and conversation strings. All are SQL expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and marks that records use.
ACTION_NAMES = {
    "move forward": "move_forward", "forward": "move_forward", "turn left": "turn_left", "left": "turn_left",
    "turn right": "turn_right", "right": "turn_right", "move backward": "move_backward", "backward": "move_backward",
    "look up": "look_up", "look down": "look_down", "stop": "stop",
}
GLYPH_NAMES = {"↑": "move_forward", "←": "turn_left", "→": "turn_right", "STOP": "stop"}
ACTION_GLYPHS = {0: "STOP", 1: "↑", 2: "←", 3: "→"}
ACTION_IDS = {"stop": 0, "move_forward": 1, "turn_left": 2, "turn_right": 3}
FINAL_ANSWER = "Final Answer:"
# Words that say nothing about an instruction's content.
STOP_WORDS = (
    "a an the and or but if then to of on in at for by with into onto from as is are was were be been being this that "
    "these those your you it its there do does doing you'll ll we i go head move walk turn down up left right forward"
).split()
# Phrases that place things in space.
SPATIAL_PATTERN = (
    r"(?i)(?:\b(first|second|third|fourth|fifth|1st|2nd|3rd|4th|5th)\b|\b(between|along|beside)\b|"
    r"\b(on your left|on your right|to the left of|to the right of)\b|\b(leftmost|rightmost|next to|opposite|very end|end of)\b|"
    r"\bthrough the (?:first|second|third|fourth|fifth|last)\b|\b(?:first|second|third|fourth|fifth) (?:open )?door\b|\bacross from\b)"
)
# Ways to speak of stairs.
_MOVE = r"(?:walk|go|head|move|come|continue|proceed|do)"
_STEPS = r"(?:stair(?:s|case|way)?|steps?)"
STAIR_PATTERN = "(?i)" + "|".join(
    [
        rf"\b{_MOVE}\s+(?:up|down)\s+(?:the\s+|another\s+|a\s+)?(?:flight|set)\s+of\s+stairs?\b",
        rf"\b{_MOVE}\s+(?:up|down)\s+(?:the\s+)?(?:\w+\s+){{0,3}}{_STEPS}\b",
        rf"\b{_MOVE}\s+(?:upstairs|downstairs)\b",
        r"\b(?:ascend|descend)(?:\s+(?:the\s+)?(?:stair(?:s|case|way)?|steps?))?\b",
        rf"\btake\s+(?:the\s+)?{_STEPS}(?:\s+(?:up|down))?\b",
        rf"\b(?:up|down)\s+(?:the\s+)?(?:\w+\s+){{0,2}}{_STEPS}\b",
    ]
)
BARE_STAIR_PATTERN = r"(?i)\b(upstairs|downstairs)\b"
ORDINALS = {1: "first", 2: "second", 3: "third", 4: "fourth", 5: "fifth"}
EMPTY_INSTRUCTIONS = ("no", "none", "n/a")


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def lookup(pairs: dict, key: Column) -> Column:
    """Value of a key in a small fixed map, null if it has none."""
    return F.try_element_at(literal_map(pairs), key)


def texts() -> Column:
    return F.array().cast("array<string>")


# Names and paths


def sanitize_name(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(value, "[^a-zA-Z0-9._-]+", "-"), "^-+|-+$", ""))


def sanitize_component(value: Column, fallback: str = "unknown") -> Column:
    kept = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "[^a-zA-Z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(kept == "", fallback).otherwise(kept)


def last_part(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(-1))


def parent_part(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(-2))


def scene_stem(path: Column) -> Column:
    """Last component without ``.basis.glb`` or ``.glb``."""
    return F.regexp_replace(last_part(path), r"(\.basis)?\.glb$", "")


def strip_prefix(path: Column, prefix: str) -> Column:
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def model_name(path: Column) -> Column:
    """Last part of a model path; a checkpoint also gets its parent."""
    trimmed = F.regexp_replace(path, "^/+|/+$", "")
    return F.when(F.startswith(last_part(trimmed), F.lit("checkpoint-")), F.concat(parent_part(trimmed), F.lit("_"), last_part(trimmed))).otherwise(last_part(trimmed))


def ep_tag(scan: Column, tag: Column, episode: Column, variant: Column | None = None) -> Column:
    base = F.format_string("%s_%s_%06d", scan, tag, episode.cast("long"))
    return base if variant is None else F.when(variant > 0, F.format_string("%s_v%d", base, variant.cast("long"))).otherwise(base)


def parse_step_id(sample: Column) -> Column:
    """``…_<episode>_step_<n>`` as a struct of two numbers, nulls if it isn't one."""
    pattern = r"_(\d+)_step_(\d+)$"
    part = lambda g: F.regexp_extract(sample, pattern, g).try_cast("long")
    return F.struct(part(1).alias("episode"), part(2).alias("step"))


def number_in_name(name: Column, pattern: str = r"traj_(\d+)_", missing: int = 1_000_000_000) -> Column:
    return F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(missing))


# Actions in text


def parse_answer(text: Column, most: int = 4) -> Column:
    """Actions of an answer: glyphs of its last final answer up to STOP, else verbs of the whole text."""
    segment = F.element_at(F.split(text, FINAL_ANSWER), -1)
    marks = F.regexp_extract_all(segment, F.lit("(↑|←|→|STOP)"), 1)
    stop = F.array_position(marks, "STOP").cast("int")
    cut = F.slice(marks, F.lit(1), F.least(F.lit(most), F.when(stop > 0, stop).otherwise(F.lit(most))))
    verbs = F.regexp_extract_all(
        text, F.lit(r"(?i)\b(move forward|turn left|turn right|move backward|look up|look down|forward|left|right|backward|stop)\b"), 1
    )
    by_glyph = F.transform(cut, lambda m: lookup(GLYPH_NAMES, m))
    by_verb = F.transform(F.slice(verbs, 1, most), lambda v: lookup(ACTION_NAMES, F.lower(v)))
    return F.when(segment.rlike(r"[↑←→]|\bSTOP\b"), by_glyph).otherwise(by_verb)


def parse_mixed(text: Column, most: int = 6) -> Column:
    """Actions of the last final answer, glyphs and verbs mixed, stop in any case anywhere."""
    segment = F.element_at(F.split(text, FINAL_ANSWER), -1)
    found = F.regexp_extract_all(segment, F.lit(r"(?i)(stop|[↑←→]|\b(?:move forward|turn left|turn right|forward|left|right)\b)"), 1)
    names = ACTION_NAMES | GLYPH_NAMES
    return F.transform(F.slice(found, 1, most), lambda m: lookup(names, F.lower(m)))


def parse_glyphs(text: Column) -> Column:
    """One action per arrow; ``stop`` alone if there is none."""
    found = F.regexp_extract_all(text, F.lit("([↑←→])"), 1)
    return F.when(F.size(found) == 0, F.array(F.lit("stop"))).otherwise(F.transform(found, lambda m: lookup(GLYPH_NAMES, m)))


def glyphs_to_ids(text: Column) -> Column:
    back = {g: i for i, g in ACTION_GLYPHS.items()}
    return F.transform(F.regexp_extract_all(text, F.lit("(STOP|↑|←|→)"), 1), lambda m: lookup(back, m))


def ids_to_glyphs(ids: Column, joiner: str = "") -> Column:
    return F.array_join(F.transform(ids, lambda i: F.coalesce(lookup(ACTION_GLYPHS, i.cast("int")), F.lit("STOP"))), joiner)


def action_id(name: Column) -> Column:
    """Number of an action given as a name or a number; unknown and null are 0."""
    return F.coalesce(lookup(ACTION_IDS, F.lower(name.cast("string"))), name.cast("string").try_cast("int"), F.lit(0))


def final_answer_parts(text: Column) -> Column:
    """What the first final answer lists between commas, trimmed, blanks dropped."""
    after = F.regexp_extract(text, r"(?s)Final Answer:(.*)$", 1)
    return F.filter(F.transform(F.split(after, ","), lambda p: F.trim(p)), lambda p: p != "")


def first_action(answer: Column) -> Column:
    return action_id(F.trim(F.split_part(answer, F.lit(","), F.lit(1))))


# Instructions


def spatial_phrase(text: Column) -> Column:
    """First phrase that places something in space, null if none."""
    return F.nullif(F.regexp_extract(text, SPATIAL_PATTERN, 0), F.lit(""))


def content_tokens(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z][A-Za-z\-']+)"), 1), F.lower)
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def token_overlap(reference: Column, candidate: Column) -> Column:
    """Share of the reference's content tokens that the candidate has too."""
    ref, cand = F.array_distinct(content_tokens(reference)), F.array_distinct(content_tokens(candidate))
    return F.when(F.size(ref) == 0, 1.0).when(F.size(cand) == 0, 0.0).otherwise(F.size(F.array_intersect(ref, cand)) / F.size(ref))


def swap_first(text: Column, old: Column, new: Column) -> Column:
    """Replace the first occurrence only; unchanged if there is none or ``old`` is empty."""
    at = F.instr(text, old)
    return F.when((at > 0) & (old != ""), F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)


def prompt_instruction(prompt: Column, start: str = "Instruction: ", end: str = "\n") -> Column:
    """What stands between two marks of a prompt, trimmed; null if the first is missing."""
    at = F.instr(prompt, start)
    rest = F.substring(prompt, at + len(start), F.length(prompt))
    return F.when(at > 0, F.trim(F.substring_index(rest, end, 1)))


def strip_marks(text: Column) -> Column:
    """Without the sentence marks and white space at its end."""
    return F.regexp_replace(F.trim(text), r"[.!?\s]+$", "")


def decapitalize(text: Column) -> Column:
    low = F.ltrim(text)
    return F.concat(F.lower(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 30))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def ensure_period(text: Column) -> Column:
    low = F.trim(text)
    return F.when(low.rlike(r"[.!?]+\s*$"), low).otherwise(F.concat(low, F.lit(".")))


def clean_output(text: Column) -> Column:
    """Model output without outer white space, quotes and code fences."""
    out = F.trim(F.coalesce(text, F.lit("")))
    for quote in ('"', "'"):
        out = F.regexp_replace(out, f"^{quote}+|{quote}+$", "")
    return F.when(F.startswith(out, F.lit("```")), F.trim(F.regexp_replace(out, "^`+|`+$", ""))).otherwise(out)


def rewrite_accepted(rewritten: Column, original: Column) -> Column:
    bad = F.lower(rewritten).rlike("^(starting from|from the|you will)")
    return F.coalesce((rewritten != "") & (F.length(rewritten) <= F.length(original) + 80) & (token_overlap(original, rewritten) >= 0.6) & ~bad, F.lit(False))


def instruction_of(instructions: Column) -> Column:
    """First instruction, trimmed; null when it is blank or says there is none."""
    text = F.trim(F.get(instructions, F.lit(0)))
    return F.when((text != "") & ~F.lower(text).isin(*EMPTY_INSTRUCTIONS), text)


# Conditional instructions


def normalize_room(room: Column, fallback: str = "room") -> Column:
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(room, F.lit("")))), r"^(the|a|an)\s+", "")
    return F.when(low == "", fallback).otherwise(low)


def normalize_object(noun: Column, fallback: str = "pool table") -> Column:
    """With a or an, unless it is a plural or a count."""
    low = F.lower(F.trim(F.coalesce(noun, F.lit(fallback))))
    low = F.regexp_replace(low, r"^[.,;:!?]+|[.,;:!?]+$", "")
    bare = F.regexp_replace(F.trim(low), r"^(a|an|the|some)\s+", "")
    many = bare.rlike("^(two|three|four|five|several|many) ") | (bare.rlike("s$") & ~bare.rlike("(ss|is|us|ws)$"))
    article = F.when(F.substring(bare, 1, 1).isin(*"aeiou"), "an").otherwise("a")
    return F.when(low == "", fallback).when(many, bare).otherwise(F.concat_ws(" ", article, bare))


def normalize_condition(phrase: Column, observable: Column, room: Column) -> Column:
    stated = F.regexp_replace(F.trim(F.coalesce(phrase, F.lit(""))), r"\.+$", "")
    item = F.regexp_replace(F.trim(F.coalesce(F.get(observable, F.lit(0)), F.lit(""))), r"\.+$", "")
    return (
        F.when(stated.rlike(r"(?i)^(there\s+is|there\s+are|both|the\b)"), decapitalize(stated))
        .when(item != "", F.concat(F.lit("there is "), item))
        .otherwise(F.concat(F.lit("there is something in the "), room))
    )


def conditional(template: Column, room: Column, condition: Column, thing: Column, original: Column) -> Column:
    """Instruction of one of the four templates; null for any other."""
    body = decapitalize(strip_marks(original))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when(template == "A_starting_if", text("Starting from the ", room, ", if ", condition, ", ", body, ". Otherwise, stop in the ", room, "."))
        .when(template == "B_if_then", text("If ", condition, ", ", body, "; otherwise, return to your starting point."))
        .when(template == "D_if_stay", text("If there is ", thing, " in the ", room, ", stop where you are; otherwise, ", body, "."))
        .when(template == "E_from_here", text("From where you are right now, if there is ", thing, ", stop in the ", room, "; otherwise, ", body, "."))
    )


# The four templates read back, as (template, pattern, groups of room, condition, thing, body).
TEMPLATE_PATTERNS = {
    "A_starting_if": (r"(?is)^Starting from the ([^,]+), if ([^,]+?),\s*(.+?)(?:\s*\.\s*Otherwise[, ].*)?$", 1, 2, 0, 3),
    "D_if_stay": (r"(?is)^If there is (.+?) in the ([^,]+?), stop where you are;\s*otherwise,\s*(.+?)\.?$", 2, 0, 1, 3),
    "E_from_here": (r"(?is)^From where you are right now, if there is (.+?), stop in the ([^,]+?);\s*otherwise,\s*(.+?)\.?$", 2, 0, 1, 3),
    "B_if_then": (r"(?is)^If ([^,]+?),\s*(.+?)(?:;\s*otherwise[, ].*)?$", 0, 1, 0, 2),
}


def reparse_template(text: Column, compat: bool = False) -> Column:
    """template, room, condition, thing and body of a conditional instruction; nulls if it is none.

    The narrower pattern D is tried before B; ``compat`` tries B first, which
    then takes every D sentence.
    """
    order = ["A_starting_if", "B_if_then", "D_if_stay", "E_from_here"] if compat else list(TEMPLATE_PATTERNS)
    fields = ["room", "condition", "thing", "body"]
    out = F.lit(None).cast("struct<template:string,room:string,condition:string,thing:string,body:string>")
    for name in reversed(order):
        pattern, *groups = TEMPLATE_PATTERNS[name]
        part = [F.trim(F.regexp_extract(text, pattern, g)) if g else F.lit(None).cast("string") for g in groups]
        part[0] = F.lower(part[0])
        part[3] = F.regexp_replace(part[3], r"^[ .]+|[ .]+$", "")
        found = F.struct(F.lit(name).alias("template"), *[p.alias(f) for p, f in zip(part, fields)])
        out = F.when(text.rlike(pattern), found).otherwise(out)
    return out


def sibling(parsed: Column, original: Column) -> Column:
    """The opposite branch of a conditional instruction."""
    body = decapitalize(strip_marks(original))
    stay = F.concat(F.lit("Starting from the "), F.coalesce(parsed["room"], F.lit("room")), F.lit(", if "), parsed["condition"], F.lit(", stop where you are. Otherwise, "), body, F.lit("."))
    walk = F.concat(F.lit("If there is "), parsed["thing"], F.lit(" in the "), F.coalesce(parsed["room"], F.lit("room")), F.lit(", "), body, F.lit("; otherwise, stop where you are."))
    return F.when(parsed["condition"].isNotNull(), stay).when(parsed["thing"].isNotNull(), walk)


# Floors and stairs


def ordinal_word(n: Column) -> Column:
    return F.coalesce(lookup(ORDINALS, n.cast("int")), F.concat(n.cast("string"), F.lit("th")))


def vertical_rule(style: Column, start: Column, end: Column, total: Column, direction: Column) -> Column:
    delta = F.abs(end - start)
    floors = F.concat(delta.cast("string"), F.when(delta == 1, " floor").otherwise(" floors"))
    to_floor = F.concat(F.lit("Please go to the "), ordinal_word(end), F.lit(" floor and stop."))
    return (
        F.when((style == "absolute") & (direction == "up"), F.concat(F.lit("Please head up to the "), ordinal_word(end), F.lit(" floor and stop.")))
        .when(style == "absolute", to_floor)
        .when(style == "relative", F.concat(F.when(direction == "up", "Go up ").otherwise("Go down "), floors, F.lit(" and stop.")))
        .when(end == total, "Please go to the top floor and stop.")
        .when(end == 1, "Please go to the bottom floor of the house and stop.")
        .otherwise(to_floor)
    )


def stair_phrase(text: Column) -> Column:
    """First phrase about stairs, else a bare upstairs or downstairs, else null."""
    return F.coalesce(F.nullif(F.regexp_extract(text, STAIR_PATTERN, 0), F.lit("")), F.nullif(F.regexp_extract(text, BARE_STAIR_PATTERN, 0), F.lit("")))


def floor_phrase(style: Column, direction: Column, end: Column, total: Column, pick: Column) -> Column:
    """Target wording; ``pick`` is a number that chooses among the equivalent ones."""
    verbs = F.when(direction == "up", F.array(*map(F.lit, ("go up to", "head up to", "go to")))).when(
        direction == "down", F.array(*map(F.lit, ("go down to", "head down to", "go to")))
    ).otherwise(F.array(F.lit("go to")))
    choose = lambda options, n: F.get(options, F.pmod(n, F.size(options)).cast("int"))
    exact = F.concat(F.lit("the "), ordinal_word(end), F.lit(" floor"))
    top, low = F.array(*map(F.lit, ("the top floor", "the topmost floor"))), F.array(*map(F.lit, ("the bottom floor", "the ground floor", "the lowest floor")))
    vague = F.when(end == total, choose(top, pick)).when(end == 1, choose(low, pick)).otherwise(exact)
    word = F.when(direction == "up", "upstairs").otherwise("downstairs")
    updown = F.concat_ws(" ", choose(F.array(F.lit("go"), F.lit("head")), pick), word)
    return F.when(style == "updown", updown).otherwise(F.concat_ws(" ", choose(verbs, pick), F.when(style == "fuzzy", vague).otherwise(exact)))


def substitute_stairs(text: Column, phrase: Column) -> Column:
    """Put ``phrase`` where the text speaks of stairs, capitalised at the start of a sentence; unchanged if it doesn't."""
    found = stair_phrase(text)
    at = F.instr(text, found)
    opens = (at == 1) | F.substring(text, at - 2, F.lit(2)).isin(". ", "? ", "! ")
    return F.when(found.isNull(), text).otherwise(swap_first(text, found, F.when(opens, capitalize(phrase)).otherwise(phrase)))


# Numbers


def format_meters(value: Column) -> Column:
    """Six significant digits as %g has them, without trailing zeros, for values from 0.0001 to 999999."""
    plain = F.format_string("%.6f", value)
    return F.when(value.isNotNull(), F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def numbers_in(text: Column) -> Column:
    """Numbers of an instruction; half circles and full rotations count as 180 unless it is there."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+\.?\d*)"), 1), lambda n: n.cast("double"))
    turns = F.lower(text).rlike("half a circle|half circle|full clockwise rotation|full counter-clockwise rotation")
    return F.when(turns & ~F.array_contains(found, F.lit(180.0)), F.concat(found, F.array(F.lit(180.0)))).otherwise(found)


def numbers_match(found: Column, expected: Column, tolerance: float = 0.01) -> Column:
    """Equal multisets within a tolerance. Both sides are compared in order of size."""
    pairs = F.zip_with(F.array_sort(found), F.array_sort(expected), lambda a, b: F.abs(a - b) <= tolerance)
    return (F.size(found) == F.size(expected)) & F.forall(pairs, lambda ok: F.coalesce(ok, F.lit(False)))


# Prompts and conversations


def fill_template(template: str, **values: Column) -> Column:
    """A template with ``{name}`` places filled by columns; any other brace stays. A null value gives null."""
    parts = re.split(r"\{(" + "|".join(map(re.escape, values)) + r")\}", template) if values else [template]
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def utc_text(seconds: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    """Epoch seconds as text in UTC, whatever the session's zone."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.to_timestamp_ntz(F.timestamp_seconds(seconds).cast("string"))), pattern)


def future_prompt(instruction: Column, future: int = 6) -> Column:
    """Prompt for the next actions of an episode (fixed wording)."""
    head = (
        "<image>\nYou are an autonomous indoor navigation agent. You observe the environment through sequential RGB frames and follow "
        f"natural language instructions to reach a goal location. At each decision step, predict the next {future} low-level actions from: "
        "FORWARD (↑) moves 25 cm, TURN LEFT (←) rotates 30°, TURN RIGHT (→) rotates 30°, STOP ends navigation.\n\n"
        "These frames show your navigation history. Instruction: "
    )
    return F.concat(F.lit(head), instruction, F.lit(f"\nPredict the next {future} actions."))


def image_tokens(n: Column) -> Column:
    return F.repeat(F.lit("<image>\n"), n)


def anchor_image_tokens(text: Column, n: Column) -> Column:
    """All image tokens of a text moved to its front, as many as there are images."""
    return F.concat(image_tokens(n), F.trim(F.replace(text, F.lit("<image>"), F.lit(""))))


def linearize(messages: Column, style: str, system: str = "", sep: str = "###", sep2: str = "</s>") -> Column:
    """Conversation as one string. ``messages`` is an array of structs (role, text); a null or empty text leaves the role open."""
    has = lambda m: F.coalesce(m["text"], F.lit("")) != ""
    turn_sep = lambda i: F.when(i % 2 == 0, sep).otherwise(sep2)
    s = F.lit
    turns = {
        "SINGLE": lambda m, i: F.when(has(m), F.concat(m["role"], s(": "), m["text"], s(sep))).otherwise(F.concat(m["role"], s(":"))),
        "TWO": lambda m, i: F.when(has(m), F.concat(m["role"], s(": "), m["text"], turn_sep(i))).otherwise(F.concat(m["role"], s(":"))),
        "CHATML": lambda m, i: F.when(has(m), F.concat(m["role"], s("\n"), m["text"], s(sep + "\n"))).otherwise(F.concat(m["role"], s("\n"))),
        "MPT": lambda m, i: F.when(has(m), F.concat(m["role"], m["text"], s(sep))).otherwise(m["role"]),
        "GEMMA": lambda m, i: F.when(has(m), F.concat(m["role"], m["text"], s(sep))).otherwise(m["role"]),
        "LLAMA_2": lambda m, i: F.when(
            i % 2 == 0, F.concat(s(sep + "[INST] "), F.when((i == 0) & s(system != ""), f"<<SYS>>\n{system}\n<</SYS>>\n\n").otherwise(""), m["text"], s(" [/INST]"))
        ).otherwise(F.concat(s(" "), m["text"], s(" " + sep2))),
        "PLAIN": lambda m, i: F.when(has(m), F.concat(m["text"], turn_sep(i))).otherwise(""),
    }
    heads = {"SINGLE": system + sep, "TWO": system + sep, "CHATML": system + sep + "\n" if system else "", "MPT": system + sep, "GEMMA": "", "LLAMA_2": "", "PLAIN": system}
    if style not in turns:
        raise ValueError(f"unknown style {style}")
    body = F.array_join(F.transform(F.filter(messages, has) if style == "LLAMA_2" else messages, turns[style]), "")
    if style == "LLAMA_2" and sep:  # the first separator is dropped
        body = F.when(F.startswith(body, F.lit(sep)), F.substring(body, len(sep) + 1, 1 << 30)).otherwise(body)
    return F.concat(F.lit(heads[style]), body)


def speaker_lines(messages: Column, header: str = "", mark: str = "### ") -> Column:
    """Header, then a ``### role: text`` line per turn."""
    return F.concat(F.lit(header), F.array_join(F.transform(messages, lambda m: F.concat(F.lit(mark), m["role"], F.lit(": "), m["text"], F.lit("\n"))), ""), F.lit(mark))


def metric_line(n: Column, success: Column, error: Column, oracle: Column, spl: Column) -> Column:
    return F.format_string("[%d] Eval Results: Success:%.3f, NE:%.3f, OS:%.3f, SPL:%.3f", n.cast("long"), success, error, oracle, spl)


def json_object(text: Column) -> Column:
    """The JSON object in a reply: from its first brace to its last; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
