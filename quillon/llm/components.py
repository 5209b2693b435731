"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond", 2014. Each step
is a join and an aggregate on the edges, so no task needs a component or the
neighbours of a hub together. Every round's edges are written in the shared
folder, and the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import discard, redealt, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (u long, v long); root is the smallest node that it reaches.

    Loops, repeated edges and edges with a null end are ignored; without edges the result is empty.
    """
    state = stored(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    seen = _signature(state)
    while seen[0]:
        following = stored(_small_star(_large_star(state)), "edges")
        now = _signature(following)
        discard(state)
        state = following
        if now == seen:
            break
        seen = now
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties each neighbour above u to the smallest node around u."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(redealt(low, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties u and its neighbours below to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(redealt(low, "u"), "u").select(F.explode(F.when(F.col("v") != F.col("m"), F.array("u", "v")).otherwise(F.array("u"))).alias("u"), F.col("m").alias("v"))
    return tied.distinct()
