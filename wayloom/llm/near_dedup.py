"""Near duplicates from bottom-k sketches of one hash function.

1. Each text's set of word shingles is hashed; the k smallest hashes are its
   sketch. Texts with the same set form a class; one row stands for it.
2. Inverted lists of retained values bring together rows whose sketches
   overlap. Two sets that are alike enough share at least ``least_shared`` of
   the k smallest values of their union (all but 3 in 10^8 pairs; sets of at
   most k shingles are whole in their sketch, so there it is certain). So a
   row only needs the lists of its rarest values, all but that many less one:
   values that no other sketch has come first and cost nothing, and very
   common ones are left out.
3. Lists are compared in blocks of bounded size. In a block the overlap of
   sketches proposes pairs, the union sketch of a pair (the k smallest values
   of both) estimates its likeness and filters, and whole shingle sets verify.
   Pairs that are already in one component are skipped, so a block does one
   row's worth of work per row of a group of copies, and returns the links of
   a spanning forest, never all pairs.
4. Lists longer than a block are compared in chunks that all hold the same
   pivot. Where such a list is in several components afterwards, the rows
   outside its largest one are compared with all its rows of like size, block
   by block, as long as they are few.
5. Many such rows mean a passage that texts share without being alike. They
   get a second, eight times wider sketch, and lists of its rarest values:
   only rows with two thirds of their shingles in common still meet. What is
   open even then is compared as in 4, however much it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import bit_set, found_by, hot_keys, marked_likely, materialize, salted_join, text_hash, without_repeats, without_rows
from .components import connected_components
from .wordhash import keep_words, run_hashes, word_hashes
from .workers import give_back

SHINGLE_WORDS = 5
SIMILARITY = (80, 100)  # intersection : union
SKETCH, WIDE_SKETCH = 32, 256
#: Share of linked pairs whose union sketch may show less than ``least_shared`` common values.
MISSED = 3e-8
BLOCK, BUNDLE = 256, 1024
#: Bundles are dealt two to a task, or more if that made more tasks than this.
MOST_TASKS = 20_000
#: Components of open lists whose other rows fill at most this many half blocks are compared with all of them at once.
FEW = 4
_COLUMNS = 4096
_PAD = np.uint64(2**64 - 1)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; A-Z are lower-cased, ASCII white space separates."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(run_hashes(word_hashes(words), min(shingle, len(words))))


def least_shared(k: int, similarity: tuple[int, int]) -> int:
    """How many of the k smallest values of their union two sets of that likeness share, but for ``MISSED`` of all pairs.

    Each of the k is shared with the likeness as its probability, and drawing
    without repetition only narrows the spread, so the binomial tail bounds it.
    """
    p = similarity[0] / similarity[1]
    if p >= 1:
        return k
    below = 0.0
    for c in range(k + 1):
        below += math.comb(k, c) * p**c * (1 - p) ** (k - c)
        if below > MISSED:
            return max(1, c)
    return k


def sketches(df: DataFrame, shingle: int, k: int, carried: str = "h long") -> DataFrame:
    """id, a carried column, n (set size), key (128-bit hash of the set), sketch (k smallest hashes) of rows with id and body."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_words()
        for batch in batches:
            n, keys, kept = [], [], []
            for body in batch["body"]:
                hashes = shingle_set(body, shingle)
                n.append(len(hashes))
                keys.append(xxhash.xxh3_128_hexdigest(hashes.tobytes()))
                kept.append(hashes[:k].astype(np.int64))
            yield pd.DataFrame({"id": batch["id"], name: batch[name], "n": np.array(n, np.int64), "key": keys, "sketch": kept})
        give_back()

    name = carried.split()[0]
    return df.select("id", *dict.fromkeys((name, "body"))).mapInPandas(run, f"id long, {carried}, n long, key string, sketch array<long>")


def _lists(rows: DataFrame, k: int, similarity: tuple[int, int]) -> DataFrame:
    """(list, id, size): inverted lists of retained values of rows (id, n, sketch), each membership once."""
    share, whole = similarity
    total = rows.count() * k
    postings = rows.select("id", "n", F.explode("sketch").alias("value"))
    common = materialize(postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "near-common")
    # Most values are of one sketch alone; a bit set keeps them out of the shuffle at any size, so what is sent grows with shared values only.
    likely = marked_likely(postings, ["value"], *bit_set(common, ["value"], "near-bits")).where("likely").drop("likely")
    met = salted_join(likely, common, ["value"], hot_keys(common, ["value"], "df", total), "inner", ["id"], few=0)
    # One row a value is smaller on its way than the one-element arrays of a partial list would be.
    shared = met.repartition("id").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
    enough = F.least(F.lit(least_shared(k, similarity)), F.ceil(F.col("n") * share / whole)).cast("int")
    rarest = shared.withColumn("take", F.size("shared") - enough + 1).where("take > 0").select("id", F.explode(F.slice("shared", F.lit(1), F.col("take"))["value"]).alias("value"))
    rarest = materialize(rarest, "near-postings")
    by_value = rarest.groupBy("value").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", "id") % (1 << 40)).alias("y")).where("size > 1")
    chosen = materialize(by_value.groupBy("size", "x", "y").agg(F.min("value").alias("value")).select("value", "size"), "near-chosen")
    return salted_join(rarest, chosen, ["value"], hot_keys(chosen, ["value"], "size", total), "inner", ["id"]).select(F.col("value").alias("list"), "id", "size")


def _shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values the sets of rows ``left`` and ``right`` share, by products of incidence blocks."""
    joined = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, counts = np.unique(joined, return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    repeated = counts[at] > 1
    column, owner = number[at[repeated]], owner[repeated]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [first, first + _COLUMNS])
        incidence = np.zeros((len(sets), _COLUMNS), np.float32)
        incidence[owner[a:b], column[a:b] - first] = 1
        out += incidence[left] @ incidence[right].T
    return out.astype(np.int64)


def union_shares(one: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the k smallest values of the union of a sketch with each of others: how many, and how many are in both.

    Sketches are sorted rows of width k, padded at the end.
    """
    merged = np.sort(np.concatenate([np.broadcast_to(one, others.shape), others], axis=1), axis=1)
    real = merged != _PAD
    twice = np.zeros(merged.shape, bool)
    twice[:, 1:] = (merged[:, 1:] == merged[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~twice, axis=1)
    return np.minimum(rank[:, -1], k), (twice & (rank <= k)).sum(axis=1)


def block_links(
    ids: np.ndarray, roots: np.ndarray, n: np.ndarray, kept: list[np.ndarray], texts: list[str], left: np.ndarray, right: np.ndarray, *, shingle: int, similarity: tuple[int, int], k: int, sets: dict[int, np.ndarray]
) -> list[tuple[int, int]]:
    """Links between rows of ``left`` and of ``right`` that join components (``roots``) not joined yet. ``sets`` keeps shingle sets by id."""
    share, whole = similarity
    least = least_shared(k, similarity)
    kept = [np.asarray(s).astype(np.uint64) for s in kept]
    enough = np.minimum(least, -(-n * share // whole))
    nl, nr = n[left][:, None], n[right][None, :]
    hopeful = _shared_counts(kept, left, right) >= np.minimum(enough[left][:, None], enough[right][None, :])
    hopeful &= whole * np.minimum(nl, nr) >= share * np.maximum(nl, nr)
    if not hopeful.any():
        return []
    padded = np.full((len(kept), k), _PAD)
    for row, s in zip(padded, kept):
        row[: len(s)] = s
    component = roots.copy()

    def whole_set(i: int) -> np.ndarray:
        if ids[i] not in sets:
            sets[ids[i]] = shingle_set(texts[i], shingle)
        return sets[ids[i]]

    links = []
    for row, i in enumerate(left):
        to = right[hopeful[row] & (component[right] != component[i])]
        if not len(to):
            continue
        size, both = union_shares(padded[i], padded[to], k)
        to = to[both >= np.where(size < k, -(-size * share // whole), least)]
        if not len(to):
            continue
        own, theirs = whole_set(i), [whole_set(j) for j in to]
        joined = np.concatenate(theirs)
        at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
        common = np.add.reduceat((own[at] == joined).astype(np.int64), np.concatenate([[0], np.cumsum([len(t) for t in theirs])[:-1]]))
        for j, c in zip(to, common):
            if whole * c >= share * (n[i] + n[j] - c) and component[i] != component[j]:
                component[component == component[j]] = component[i]
                links.append((int(ids[i]), int(ids[j])))
    return links


def _bundles(blocks: DataFrame) -> tuple[DataFrame, int]:
    """(bundle, id, root, lists, parts, roles) of blocks (see ``_compare``), each id once a bundle, and the number of bundles.

    Near copies are together in many lists, so blocks that overlap are dealt
    to one bundle and a text is sent there once: each block goes where the
    smallest id leads that any of its rows meets in any of their blocks.
    Places with more rows than a bundle are dealt block by block instead.
    Which bundle a block is in never decides what is compared.
    """
    key = ["list", "part"]
    blocks = materialize(blocks.groupBy(*key).agg(F.collect_list(F.struct("id", "root", "role")).alias("rows"), F.min("id").alias("lead")), "near-blocks")
    # A row is in few blocks, so its blocks are a short list.
    met = blocks.select(*key, "lead", F.explode("rows.id").alias("id")).groupBy("id").agg(F.min("lead").alias("lead"), F.collect_set(F.struct(*key)).alias("of"))
    places = met.select("lead", F.explode("of").alias("of")).groupBy("of.list", "of.part").agg(F.min("lead").alias("place"))
    placed = materialize(blocks.drop("lead").join(places, key), "near-placed")
    sizes = materialize(placed.groupBy("place").agg(F.count("*").alias("blocks"), F.sum(F.size("rows")).alias("n")), "near-places")
    total, rows = sizes.agg(F.sum("blocks"), F.sum("n")).first()
    bundles = max(1, math.ceil((rows or 0) / BUNDLE))
    large = sizes.where(F.col("n") > BUNDLE).select("place", F.lit(True).alias("large"))
    dealt = salted_join(placed, large, ["place"], hot_keys(sizes, ["place"], "blocks", total or 0), "left", key)
    unit = F.when(F.col("large"), F.xxhash64(*key)).otherwise(F.xxhash64("place"))
    dealt = dealt.select(F.pmod(unit, F.lit(bundles)).alias("bundle"), *key, F.explode("rows").alias("row"))
    held = dealt.groupBy("bundle", F.col("row.id").alias("id")).agg(F.first("row.root").alias("root"), F.collect_list(F.struct(*key, "row.role")).alias("held"))
    return held.select("bundle", "id", "root", F.col("held.list").alias("lists"), F.col("held.part").alias("parts"), F.col("held.role").alias("roles")), bundles


def bundle_links(bundle: pd.DataFrame, **options) -> list[tuple[int, int]]:
    """Links within the blocks of a bundle, the largest first: rows that one block has joined are one component in the next."""
    ids, roots, n, kept, texts = (bundle[c].to_numpy() for c in ("id", "root", "n", "sketch", "body"))
    roots, at = roots.copy(), {i: row for row, i in enumerate(ids)}
    lists, parts, roles = (np.concatenate(bundle[c].to_numpy()) for c in ("lists", "parts", "roles"))
    row = np.repeat(np.arange(len(ids)), [len(x) for x in bundle["lists"]])
    order = np.lexsort((row, parts, lists))
    lists, parts, roles, row = lists[order], parts[order], roles[order], row[order]
    starts = np.flatnonzero(np.concatenate([[True], (lists[1:] != lists[:-1]) | (parts[1:] != parts[:-1]), [True]]))
    links, sets = [], {}
    for b in np.argsort(starts[:-1] - starts[1:], kind="stable"):
        of, role = row[starts[b] : starts[b + 1]], roles[starts[b] : starts[b + 1]]
        if (roots[of] == roots[of[0]]).all():
            continue
        found = block_links(ids[of], roots[of], n[of], kept[of], texts[of], np.flatnonzero(role & 1), np.flatnonzero(role & 2), sets=sets, **options)
        for one, other in found:
            roots[roots == roots[at[other]]] = roots[at[one]]
        links += found
    return links


def _compare(blocks: DataFrame, texts: DataFrame, **options) -> DataFrame:
    """Links (a, b) within blocks: rows (list, part, id, root, role), role 1: left, 2: right, 3: both; texts (id, n, sketch, body).

    Blocks are dealt into bundles of about ``BUNDLE`` rows, because most are far too small for a group of their own.
    """

    def run(bundle: pd.DataFrame) -> pd.DataFrame:
        keep_words()
        links = bundle_links(bundle, **options)
        give_back()
        return pd.DataFrame(sorted(links), columns=["a", "b"], dtype=np.int64)

    held, bundles = _bundles(blocks)
    whole = held.join(texts.select("id", "n", "sketch", "body"), "id").repartition(min(math.ceil(bundles / 2), MOST_TASKS), "bundle")
    return whole.groupBy("bundle").applyInPandas(run, "a long, b long")


def _chunks(lists: DataFrame, block: int) -> DataFrame:
    """(list, part, id, root, role) of lists (list, id, size, root); each chunk of a long list also holds the list's smallest id."""
    chunks = F.ceil(F.col("size") / F.lit(block)).cast("long")
    members = lists.select("list", F.pmod(F.xxhash64("id"), chunks).alias("part"), "id", "root", F.lit(3).alias("role"))
    pivots = (
        lists.where(F.col("size") > block)
        .groupBy("list", "size")
        .agg(F.min(F.struct("id", "root")).alias("p"))
        .select("list", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("part"), "p.id", "p.root", F.lit(3).alias("role"))
    )
    return members.union(pivots).distinct()


def _open(lists: DataFrame, components: DataFrame, rows: int) -> DataFrame:
    """(list, id, size, root, main) of the lists that are in several components; main is the largest one's root."""
    rooted = materialize(lists.select("list", "id", "size").join(components.select(F.col("node").alias("id"), "root"), "id", "left").select("list", "id", "size", F.coalesce("root", "id").alias("root")), "near-rooted")
    counted = rooted.groupBy("list", "size", "root").agg(F.count("*").alias("c"))
    open_lists = materialize(counted.groupBy("list", "size").agg(F.count("*").alias("roots"), F.max(F.struct("c", "root"))["root"].alias("main")).where("roots > 1"), "near-open")
    return salted_join(rooted, open_lists.select("list", "main"), ["list"], hot_keys(open_lists, ["list"], "size", rows), "inner", ["id"])


def _pools(open_rows: DataFrame, block: int, similarity: tuple[int, int], rows: int) -> DataFrame:
    """Blocks that compare rows outside a largest component with all rows of like size.

    Lists with the same largest component hold much the same rows, so they
    are taken together and each row is sent once. Sizes of linked sets are at
    most 1 / similarity apart, so rows meet in their own band of sizes and the
    two next to it.
    """
    share, whole = similarity
    band = F.col("n") if share == whole else F.floor(F.log("n") / F.lit(math.log(whole / share) * 1.0001))
    half, zero = block // 2, F.lit(0).cast("long")
    pooled = materialize(open_rows.select("main", "id", "root", band.cast("long").alias("band")), "near-pools")
    own = pooled.where(F.col("root") != F.col("main"))
    others = own.select("main", "id", "root", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.lit(1).alias("role"))
    sides = others.unionByName(pooled.withColumn("role", F.lit(2)))
    chunked = lambda role: F.greatest(F.ceil(F.count_if(F.col("role") == role) / F.lit(half)), F.lit(1)).cast("long")
    sizes = sides.groupBy("main", "band").agg(chunked(1).alias("o"), chunked(2).alias("m"), F.count("*").alias("size"), F.countDistinct("role").alias("roles"))
    sizes = materialize(sizes.where("roles = 2").drop("roles"), "near-bands")
    sides = salted_join(sides, sizes.drop("size"), ["main", "band"], hot_keys(sizes, ["main", "band"], "size", rows), "inner", ["id", "role"])
    across = F.transform(F.sequence(zero, F.col("m") - 1), lambda j: F.pmod(F.xxhash64("id"), F.col("o")) * F.col("m") + j)
    down = F.transform(F.sequence(zero, F.col("o") - 1), lambda i: i * F.col("m") + F.pmod(F.xxhash64("id", F.lit(7)), F.col("m")))
    return sides.select(F.xxhash64("main", "band").alias("list"), F.explode(F.when(F.col("role") == 1, across).otherwise(down)).alias("part"), "id", "root", "role")


def _links(classes: DataFrame, texts_of, shingle: int, similarity: tuple[int, int], k: int, wide: int, block: int) -> DataFrame:
    """(node, root) of the linked classes (id, n, sketch). ``texts_of(ids)`` gives tables that make up (id, n, sketch, body)."""
    options = {"shingle": shingle, "similarity": similarity}
    lists = materialize(_lists(classes, k, similarity), "near-lists")
    tables = texts_of(lists.select("id").distinct())
    rows = lists.count()

    def texts(of: DataFrame | None = None) -> DataFrame:
        """(id, n, sketch, body) of all rows in lists, or of those whose id ``of`` has."""
        if of is None:
            return reduce(lambda a, b: a.join(b, "id"), tables)
        ids = materialize(of.select("id").distinct(), "near-ids")
        return reduce(lambda a, b: a.join(b, "id"), [found_by(t, ids, ["id"], "near-bits") for t in tables])

    def linked(components: DataFrame | None, blocks: DataFrame, texts: DataFrame, k: int) -> DataFrame:
        links = materialize(_compare(blocks, texts, k=k, **options), "near-links")
        if components is None:
            return connected_components(links)
        return components if links.isEmpty() else connected_components(components.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))

    def pooled(lists: DataFrame) -> DataFrame:
        """(main, id, root, n): rows of open long lists with the root of the list's largest component."""
        found = _open(lists.where(F.col("size") > block), components, rows).select("main", "id", "root").distinct()
        return materialize(found.join(classes.select("id", "n"), "id").select("main", "id", "root", "n"), "near-pooled")

    components = linked(None, _chunks(lists.withColumn("root", F.col("id")), block), texts(), k)
    opened = pooled(lists)
    mains = opened.groupBy("main").agg(F.count_if(F.col("root") != F.col("main")).alias("others"), F.count("*").alias("size"))
    mains = materialize(mains.withColumn("few", F.col("others") <= FEW * (block // 2)), "near-mains")
    hot = hot_keys(mains, ["main"], "size", rows)
    any_few, any_many = mains.agg(F.max(F.col("few")), F.max(~F.col("few"))).first()
    if any_few:
        few = salted_join(opened, mains.where("few").select("main"), ["main"], hot, "left_semi", ["id"])
        components = linked(components, _pools(few, block, similarity, rows), texts(few), k)
    if any_many:
        many = salted_join(opened, mains.where("NOT few").select("main"), ["main"], hot, "left_semi", ["id"])
        tables = [materialize(sketches(texts(many), shingle, wide, "body string"), "near-wide")]
        lists = materialize(_lists(texts(), wide, similarity), "near-lists")
        rows = lists.count()
        components = linked(components, _chunks(_open(lists, components, rows), block), texts(), wide)
        opened = pooled(lists)
        if not opened.isEmpty():
            components = linked(components, _pools(opened, block, similarity, rows), texts(opened), wide)
    return components


def _decide(df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: tuple[int, int], k: int, wide: int, block: int) -> DataFrame:
    """id, h, n, component of every row; the component of a null id is null."""
    body: Column = F.coalesce(F.col(text_col), F.lit(""))
    bodies = df.select(F.col(id_col).cast("long").alias("id"), text_hash(body).alias("h"), body.alias("body"))
    all_rows = materialize(sketches(bodies, shingle, k), "near-sketches")
    counted = F.col("id").isNotNull() & (F.col("n") > 0)

    # A class is a distinct set; its first row's text stands for it, and that row's id names it. Sets of one row alone are left where they are.
    digests = all_rows.where(counted).groupBy(F.xxhash64("key").alias("digest")).agg(F.count("*").alias("c")).where("c > 1")
    marked = marked_likely(all_rows.where(counted).withColumn("digest", F.xxhash64("key")), ["digest"], *bit_set(materialize(digests, "near-digests"), ["digest"], "near-bits"))
    same_set = marked.where("likely").groupBy("key").agg(F.min(F.struct("id", "h")).alias("f"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    same_set = same_set.select("key", F.col("f.id").alias("rep"), F.col("f.h").alias("h"), "copies", "n", "sketch")
    single = marked.where("NOT likely").select("key", F.col("id").alias("rep"), "h", F.lit(1).cast("long").alias("copies"), "n", "sketch")
    classes = materialize(same_set.unionByName(single), "near-classes")
    clashes = materialize(classes.groupBy("rep").agg(F.count("*").alias("c")).where("c > 1").select("rep"), "near-clashes")
    named = clashes.isEmpty()
    if named:
        classes = classes.withColumn("id", F.col("rep"))
    else:  # sets whose first rows share an id get numbers of their own, so that none is taken for the other
        clash = classes.join(clashes.withColumn("clash", F.lit(True)), "rep", "left")
        classes = materialize(clash.withColumn("id", F.when(F.col("clash"), F.xxhash64("key")).otherwise(F.col("rep"))).drop("clash"), "near-classes")

    def texts_of(ids: DataFrame) -> list[DataFrame]:
        ids = materialize(ids, "near-ids")
        wanted = materialize(found_by(classes.select("id", "rep", "h", "n", "sketch"), ids, ["id"], "near-bits"), "near-wanted")
        source = bodies.withColumnRenamed("id", "rep")
        found = materialize(found_by(source, wanted.select("rep", "h", "id"), ["rep", "h"], "near-bits").select("id", "body"), "near-texts")
        # Only where rows repeat both id and text are there more.
        if found.count() != wanted.count():
            found = materialize(found.dropDuplicates(["id"]), "near-texts")
        return [found, wanted.select("id", "n", "sketch")]

    components = _links(classes.select("id", "n", "sketch"), texts_of, shingle, similarity, k, wide, block)
    rooted = classes.select("key", "id", "rep", "copies").join(components, F.col("id") == F.col("node"), "left").select("key", "rep", "copies", F.coalesce("root", "id").alias("component"))
    if not named:
        rooted = materialize(rooted, "near-rooted")
        names = materialize(rooted.groupBy("component").agg(F.min("rep").alias("name"), F.count("*").alias("c")), "near-names")
        rooted = salted_join(rooted, names.drop("c"), ["component"], hot_keys(names, ["component"], "c", rooted.count()), "inner", ["key"]).withColumn("component", F.col("name"))
    rooted = materialize(rooted.select("key", "copies", "component"), "near-classes")
    hot = hot_keys(rooted, ["key"], "copies", all_rows.count())
    found = salted_join(all_rows.where(counted).select("id", "h", "n", "key"), rooted.select("key", "component"), ["key"], hot, "inner", ["id", "h"]).drop("key")
    alone = all_rows.where(~counted).select("id", "h", "n", F.col("id").alias("component"))
    return found.unionByName(alone)


def near_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY, k: int = SKETCH, wide: int = WIDE_SKETCH, block: int = BLOCK
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Texts are linked when their shingle sets have a Jaccard likeness of at
    least ``similarity`` (intersection : union); a text with fewer words than
    a shingle has its whole sequence as one, a text without words (or null) is
    linked with nothing. component_id is the smallest id reachable through
    links; kept rows are those with that id. Ids are integers; rows that share
    an id each go with their own text. A row with a null id is its own
    component (null) and kept, and links nothing. An empty table gives an
    empty result; other columns of ``df`` are not read.
    """
    if not 0 < similarity[0] <= similarity[1]:
        raise ValueError("a similarity lies above 0 and is at most 1")
    found = _decide(df, id_col, text_col, shingle, similarity, k, wide, block)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def near_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY, k: int = SKETCH, wide: int = WIDE_SKETCH, block: int = BLOCK
) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id (see ``near_groups``).

    Rows without words stay, rows with a null id too. Rows with equal ids and
    different texts don't share their fate: those whose own text is in a
    component of a smaller id go. Rows that repeat both id and text are one
    document, of which one row stays.
    """
    found = materialize(_decide(df, id_col, text_col, shingle, similarity, k, wide, block).where("id IS NOT NULL"), "near-found")
    kept = F.col("id") == F.col("component")
    repeats = found.where(kept).groupBy("id", "h").agg(F.count("*").alias("c")).where("c > 1").select("id", "h")
    rest = without_rows(df, found.where(~kept), id_col, text_col)
    return without_repeats(rest, materialize(repeats, "near-repeats"), id_col, text_hash(F.col(text_col)))
