"""Connected components by alternating star contractions, each round a written table.

Defined results: null ends are left out, as are loops; a node without an edge doesn't appear; an empty table gives none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut, free


def components(edges: DataFrame, most_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """node, component (the smallest node that can be reached) from edges (a, b).

    Every round moves each node's larger neighbours to its smallest one, then each node and its smaller neighbours to the
    smallest of them, until nothing changes: O(log^2) rounds at worst, two or three for stars. A node's edges are never
    gathered; only minima are, and those are summed before they are shuffled. A round is one written table, which also
    counts and sums its edges, so that no second job is needed to see whether anything changed; the next one is cut for as
    many. rows: how many edges there are, where that is known."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    state = last = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        seen = Observation()
        of = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("a"), F.sum(F.hash("u", "v").cast("long")).alias("b"))
        e = cut(small.where("u <> v").distinct().observe(seen, *of), "edges", rows=rows)
        if last is not None:
            free(last)
        now, last = seen.get, e
        if now == state or not now["n"]:
            break
        state, rows = now, now["n"]
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
