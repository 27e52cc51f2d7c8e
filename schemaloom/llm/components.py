"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.shared import saved


def components(links: DataFrame) -> DataFrame:
    """(`node`, `root`) for every node of `links` (`a`, `b`): the smallest node that it reaches.

    Large star and small star in turn: each node hands its larger neighbours,
    then its smaller ones, to its smallest neighbour, until nothing moves. The
    trees get flatter each time, so few rounds do even for long chains. Every
    round is a written table.
    """
    edges = saved(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _state(edges)
    while state[0]:
        edges = saved(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """The number of links and two sums over them; equal only when nothing moved."""
    mixed = F.xxhash64("u", "v").cast("decimal(38,0)")
    row = edges.agg(F.count(F.lit(1)), F.sum(mixed), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """The larger neighbours of every node, linked to its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = saved(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of every node, and the node, linked to the smallest of them."""
    edges = saved(edges)
    least = saved(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()
