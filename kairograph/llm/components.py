"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over undirected ``edges`` (u, v), u > v.

    Each node's smallest neighbour is a grouped minimum (partial aggregation), joined back on the node; the join's
    large side can be split by the adaptive skew join, so a hub needs no task of its own.
    """
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select("u", "v")
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    joined = around.join(least, "u")
    if large:  # each larger neighbour moves to the smallest one
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # the node and its smaller neighbours move to the smallest one
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the component's smallest node.

    Self loops, repeated edges and either direction are allowed; null ends are left out; no edges give no rows.
    Every round is written to the shared folder, so the lineage stays short. It stops when a round leaves the edges as
    they are: then all are stars. Raises if that takes more than ``max_rounds``.
    """
    state = edges.filter("a is not null and b is not null and a != b")
    state = state.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = materialize(state, "edges")
    size = F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    seen = tuple(state.agg(*size).first())
    for _ in range(max_rounds):
        if not seen[0]:
            break
        state = materialize(_star(_star(state, large=True), large=False), "edges")
        now = tuple(state.agg(*size).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
