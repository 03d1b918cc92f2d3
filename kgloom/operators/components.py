"""Connected components of any graph of links, by alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): each is a grouped minimum and an equi-join, cut by a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut


#: Rows of links that a task takes at least: short tables in many partitions would be little but files.
ROWS = 100_000


def _toward_least(edges: DataFrame, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each node's greater neighbours get its least neighbour, or itself if that is less."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = few(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return few(few(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")).distinct())


def _among_lesser(edges: DataFrame, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each node (a) and its lesser neighbours (b) get the least of these."""
    least = few(edges.groupBy("a").agg(F.min("b").alias("m")))
    lesser = few(edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))
    return few(lesser.unionByName(least.select("a", F.col("m").alias("b"))).distinct())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) of any comparable type -> (node, root): the least node of the component of each node that has a link to another. Loops,
    repeated links and nulls are ignored."""
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    tasks = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = None
    for _ in range(most_rounds):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        parts = max(1, -(-state[0] // ROWS))
        few = (lambda df, parts=parts: df.coalesce(parts)) if parts < tasks else (lambda df: df)
        before, now = state, cut(_among_lesser(_toward_least(few(now), few), few))
    raise RuntimeError(f"components still change after {most_rounds} rounds")
