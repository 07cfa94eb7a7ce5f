"""Connected components of an edge list, by alternating star steps on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize


HUB_SHARE = 1000


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """The edges (u, v) with the minimum m of their node u.

    Nodes with a thousandth of all ``total`` edges, at most twice a thousand as each edge has
    two ends, are sent to every task with their minimum; the edges of the others are joined.
    """
    hubs = least.filter(F.col("degree") * HUB_SHARE >= total).select("u", "m")
    marked = edges.join(F.broadcast(hubs), "u", "left")
    rest = marked.filter("m is null").select("u", "v")
    others = least.filter(F.col("degree") * HUB_SHARE < total).select("u", "m")
    return marked.filter("m is not null").select("u", "v", "m").union(rest.join(others, "u").select("u", "v", "m"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node passes its larger neighbours on to its smallest neighbour."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
    return _with_least(both.filter("v > u"), least, total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node joins itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    joined = _with_least(down, least, total)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))


def _settled(edges: DataFrame) -> bool:
    """Whether the (distinct) edges are stars: one edge up from a node, none from its end."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    places = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("root"))
    return places.filter("up > 1 or (up = 1 and root = 0)").limit(1).count() == 0


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) of every node of an edge (u, v) of integers; the root is the smallest.

    Edges are written after each step, so a lost executor costs one step, and a plan holds
    one step: a step names its edges several times, so two in one plan multiply it. The
    minimum of a node's neighbours is combined on the map side, and (node, minimum) is
    joined back, for the few nodes with a thousandth of all edges by a broadcast.
    The end is a star per component, written; the driver sees a yes or no per step.
    """
    now = materialize(edges.filter("u <> v").select("u", "v"), "edges")
    for _ in range(rounds):
        total = now.count()
        up = materialize(_large_star(now, total), "edges")
        now = materialize(_small_star(up, total).filter("u <> v").distinct(), "edges")
        if _settled(now):
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select("root", "root").distinct())
