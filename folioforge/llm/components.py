"""Connected components by alternating large-star and small-star (Kiveris et al., 2014).

Every step is a grouped minimum and an equi-join on edges; nothing is gathered
on the driver but two numbers per round. The grouped minimum is combined before
its shuffle, and the joins are plain enough for Spark to split a vertex with a
large part of all edges (adaptive skew join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.workspace import Workspace


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v.

    Large star: each vertex hooks its larger neighbours to the least vertex among its
    neighbours and itself. Small star: each vertex hooks its smaller neighbours, and
    itself, to the least of them.
    """
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        hooked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return hooked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    # a larger neighbour v of u: hooked to m
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def connected_components(edges: DataFrame, ws: Workspace, rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (u, v), component being the least id it reaches.

    Loops, repeated and reversed edges and null ends do no harm; no edges give no rows.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now = ws.save(now, "edges")
    before = None
    for _ in range(rounds):
        # edges are distinct; a sum of hashes would overflow where there are many
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).head()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        after = ws.save(_star(_star(now, small=False), small=True), "stars")
        ws.drop(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
