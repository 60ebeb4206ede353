"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node links the neighbours that its turn covers to the smallest node it knows.

    Only a minimum per node is aggregated, so a node with many neighbours is never gathered.
    """
    both = edges.select(F.col("a").alias("n"), F.col("b").alias("m"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
        low = both.groupBy("n").agg(F.min("m").alias("m0")).select("n", F.least("n", "m0").alias("low"))
        out = both.where("m > n").join(low, "n").select(F.col("m").alias("a"), F.col("low").alias("b"))
    else:
        low = both.groupBy("n").agg(F.min("m").alias("low"))
        out = both.join(low, "n").select(F.col("m").alias("a"), F.col("low").alias("b"))
        out = out.unionByName(low.select(F.col("n").alias("a"), F.col("low").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    ``edges`` has columns a, b in any direction; self-loops and repeats are harmless, nulls are
    dropped, an empty table gives an empty result. Each round is written to shared storage.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.table(now, f"{tag}-0")
    before, round_ = None, 0
    while True:
        # stars: every a has one b, and no b is itself an a
        stats = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(stats) == before or not stats["n"]:
            break
        before, round_ = tuple(stats), round_ + 1
        now = scratch.table(_stars(_stars(now, large=True), large=False), f"{tag}-{round_}")
        if round_ > 1:
            scratch.drop(f"{tag}-{round_ - 2}")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
