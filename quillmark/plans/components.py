"""Connected components of an edge table, by alternating large and small stars.

Each round is two equi-joins of the edges with the least neighbour of each node; no node's
neighbours are gathered in one row, so a hub costs what any skewed join costs. Rounds are staged in
the shared folder, and the loop ends when a round changes no edge. Least neighbours are as many as nodes:
beyond MOST_BROADCAST edges they are merged, so that the driver never gathers them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.plans.staging import drop_staged, staged


#: Edges up to which Spark may broadcast a round's least neighbours.
MOST_BROADCAST = 100_000


def _starred(edges: DataFrame, large: bool, merged: bool) -> DataFrame:
    """edges: (a, b) with a > b. Links every larger (large) or smaller neighbour of a node to the node's least one."""
    sent = lambda least: least.hint("merge") if merged else least
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # a neighbour larger than the node goes to the node's least neighbour (or the node itself)
        out = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(sent(least), "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        linked = edges.join(sent(least), "a")
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node with an edge; a component is named by its least node. drop_staged takes the result."""
    x, y = F.col(left), F.col(right)
    now = staged(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        merged = state[0] > MOST_BROADCAST
        after = staged(_starred(_starred(now, True, merged), False, merged), "edges")
        before, state = state, _state(after)
        drop_staged(now)
        now = after
        if state == before:
            break
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out._staged_path = now._staged_path
    return out
