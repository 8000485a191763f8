"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _towards_least(pairs: DataFrame) -> DataFrame:
    """Every node's larger neighbours point to the least node around it (the large star)."""
    both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _towards_root(pairs: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the least of them (the small star)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """Least reachable node of every linked node.

    ``links`` has the columns u and v (long, any order, repeats allowed, u <> v). Returns
    (node, component) with one row per node that has a link. Alternating stars: a few
    rounds whatever the shape; each round is two aggregates and two joins over links,
    written to the shared folder. Hubs are safe: minima are pre-aggregated in the map tasks.
    """
    pairs = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if state[0] == 0 or state == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        pairs = stored(_towards_root(_towards_least(pairs).where("u <> v").distinct()), "links")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
