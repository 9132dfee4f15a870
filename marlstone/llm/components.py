"""Connected components by alternating large-star and small-star steps, one pair of written tables per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import write_cut


def _larger_first(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v, each once."""
    return edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long); component is the smallest node it is connected to.

    Large-star links each larger neighbour of a node to the smallest one around it, small-star the smaller
    neighbours; the rounds end when no edge changes, after about log2 squared of the longest chain.  The
    smallest neighbour comes from a grouping and is joined back, so a node with very many neighbours is
    never held in one group.  Loops and repeated edges are fine; an edge with a null end is left out; no
    edges, no rows.
    """
    edges = write_cut(_larger_first(edges.where(F.col("u").isNotNull() & F.col("v").isNotNull())), "edges")
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: v > u goes to the smallest node around u.
        up = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = write_cut(_larger_first(up), "large-star")
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = write_cut(_larger_first(down.unionAll(low.select("u", F.col("m").alias("v")))), "small-star")
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == state:
            break
        state = seen
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
