"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, materialize, salted_join

MOST_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is its component's smallest node.

    Large-star and small-star steps alternate until the links no longer
    change; the driver sees a count and a checksum a round. Each round is
    written to the shared folder. The links of a node with very many are
    dealt over several tasks. Links that already point at roots (an earlier
    result) may be passed together with new ones.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links"
    )
    state, rows = None, edges.count()
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        stars = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        least = stars.select("a", F.least("a", "low").alias("low"))
        large = salted_join(both, least, ["a"], hot_keys(stars, ["a"], "n", 2 * rows), "inner", ["b"], few=0).where("b > a")
        # A row's b is a larger neighbour of a; it is linked with a's smallest neighbour (or a) instead.
        large = large.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        edges = materialize(small.union(least.select("a", F.col("low").alias("b"))).where("a > b").distinct(), "links")
        seen = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())
        if seen == state:
            break
        state, rows = seen, seen[0]
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
