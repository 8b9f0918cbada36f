"""Connected components by alternating large-star and small-star steps, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import HOT_ROWS, drop, materialise, spread_join


def _with_least(edges: DataFrame, least: DataFrame, total: int, most: int) -> DataFrame:
    """Edges with the least neighbour of u; a node that many edges share is split over tasks."""
    return spread_join(edges, least.select("u", "m"), "u", "v", least.select("u", "n"), total=total, most=most)


def _large_star(edges: DataFrame, n_edges: int, most: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    return _with_least(both.filter("v > u"), least, 2 * n_edges, most).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, n_edges: int, most: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(down, least, n_edges, most).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    """How many edges, a sum that tells states apart, and the edges of the busiest node."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    if row[0] <= HOT_ROWS:
        return row[0], row[1], row[0]
    ends = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return row[0], row[1], ends.agg(F.max("n")).first()[0]


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(u, v) pairs -> (node, component): the smallest node that each node reaches, for nodes with an edge.

    Every step keeps the components and shortens paths; both steps leave a star
    forest as it is, and that is where the loop ends. Of a hub's edges only the
    minimum is aggregated, and they are split where they meet it.
    """
    now = materialise(edges.select("u", "v").filter("u <> v").distinct(), "components")
    state = _state(now)
    for _ in range(most_rounds):
        # A node has no more lower neighbours after the large star than it had neighbours before.
        after = materialise(_small_star(_large_star(now, state[0], state[2]), state[0], state[2]), "components")
        new = _state(after)
        drop(now)
        now = after
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
