"""Connected components of an edge table by alternating star contraction, in Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: Edges of a partition: small graphs, and the last rounds of large ones, don't pay for a task on every shuffle partition.
EDGES = 100_000


def _star(edges: DataFrame, keep_larger: bool, parts: int) -> DataFrame:
    """One contraction: every node's larger (or smaller) neighbours are linked to its least neighbour.

    A hub's neighbours are never gathered: its least neighbour is a pre-aggregated minimum that is written
    before it is joined back, so that adaptive execution can split a hub's rows over many tasks.
    """
    if keep_larger:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(parts), "star-least")
    linked = both.join(least, "u")
    if keep_larger:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where(F.col("u") != F.col("v")).distinct().coalesce(parts)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edge table (u, v); root is the least node that it reaches.

    Self-links and repeated edges are allowed. Rows with a null end are ignored. No edges: no rows.
    Rounds grow with the logarithm of the number of nodes; each round's edges are written to shared storage.
    """
    nodes = edges.where("u IS NOT NULL AND v IS NOT NULL")
    selves = nodes.select("u").union(nodes.select("v")).distinct()
    state = materialize(nodes.where("u != v").distinct(), "edges")
    before, parts = None, 1 + state.count() // EDGES
    state = state.coalesce(parts)
    while True:
        larger = materialize(_star(state, True, parts), "edges-larger")
        state = materialize(_star(larger, False, parts), "edges")
        # a star forest keeps its edges: same count and same checksum mean a fixed point
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return selves.join(state, selves.u == state.u, "left").select(
        selves.u.alias("node"), F.coalesce(state.v, selves.u).alias("root")
    )
