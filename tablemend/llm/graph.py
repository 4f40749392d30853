"""Connected components by alternating stars: DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemend.llm.common import stored
from tablemend.operators.joins import join_per_key


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """The smallest member of the component of every node in ``edges``: (node, component).

    Each round moves all links of a node to its smallest neighbour, first for the larger neighbours and then
    for the smaller ones (large star, small star); the rounds needed grow with the logarithm of the nodes. Minima
    combine before the shuffle, a hub's links can be split over tasks, and every round ends in stored files.
    Links with a null end and links to oneself count for nothing; no links give no rows.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    # greatest() and least() skip nulls; a link with one end then becomes a link to itself.
    edges = stored(edges.where("u <> v").distinct(), "links")
    state = _state(edges)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(edges.select("v", "u"))
        least = both.groupBy("x").agg(F.min(F.least("x", "y")).alias("m"))
        large = join_per_key(both.where("y > x"), least, ["x"], "inner").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_per_key(large, least, ["u"], "inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionAll(ends.select("component", "component").distinct())
