"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch


def _toward_min(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b). Per node the least neighbour is a partial aggregate, so a node of very many edges costs one row a task."""
    if large:
        arcs = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        arcs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = arcs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = arcs.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def component_roots(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Edges (a long, b long) to (a, b): each node that is not its component's least, with that least node.

    Rounds grow with the logarithm of the longest path. Every round is written to the shared folder. Raises if it does not settle.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0")
    mark = None
    for k in range(1, max_rounds + 1):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now
        mark = seen
        now = scratch.save(_toward_min(_toward_min(now, True), False), f"edges{k}")
        if k > 1:
            scratch.drop(f"edges{k - 2}")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
