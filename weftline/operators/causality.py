"""Causal paths: backward from effects along cause labels, each cause strictly earlier than what it causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Time units in which half of the gap's penalty has nearly set in.
GAP_SCALE = 50.0


def cleanliness(weights: Column, gap: Column, divergence: Column) -> Column:
    """mean(weights) * (1 - (1 - e^(-gap / 50)) / 2) / (1 + divergence), within 0 and 1; 0 without edges."""
    mean = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w) / F.size(weights)
    raw = mean * (1 - 0.5 * (1 - F.exp(-gap / GAP_SCALE))) / (1 + divergence)
    return F.when(F.size(weights) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(0.0)


def causal_paths(edges: DataFrame, effects: DataFrame, labels: dict[str, float], hops: int) -> DataFrame:
    """Every path of 1 to hops edges that ends in an effect (rows with a column effect).

    nodes runs from the first cause to the effect; times and weights are the edges' in that order. divergence adds, for every
    node that was expanded, its causes beyond one. One join a hop on the node reached, which each hop's rows are hashed by."""
    weight = F.create_map(*[x for k, w in labels.items() for x in (F.lit(k), F.lit(float(w)))])
    causes = edges.where((F.col("rank") == 0) & F.col("label").isin(*labels)).select(F.col("s").alias("at"), F.col("source").alias("cause"), F.col("start_t").alias("t"), weight[F.col("label")].alias("w"))
    counted = causes.groupBy("at").agg(F.count(F.lit(1)).alias("branches"))
    causes = causes.join(counted, "at")
    front = effects.select(F.col("effect"), F.col("effect").alias("at"), F.array("effect").alias("nodes"), F.array().cast("array<bigint>").alias("times"), F.array().cast("array<double>").alias("weights"), F.lit(0).cast("bigint").alias("divergence"))
    out = None
    for _ in range(hops):
        step = front.join(causes, "at").where((F.size("times") == 0) | (F.col("t") < F.get("times", F.lit(0)))).where(~F.array_contains("nodes", F.col("cause")))
        front = step.select(
            "effect", F.col("cause").alias("at"), F.concat(F.array("cause"), "nodes").alias("nodes"), F.concat(F.array("t"), "times").alias("times"), F.concat(F.array("w"), "weights").alias("weights"), (F.col("divergence") + F.col("branches") - 1).alias("divergence")
        )
        out = front if out is None else out.unionByName(front)
    if out is None:
        out = front.limit(0)
    return out.drop("at").withColumns({"total_gap": total_gap(F.col("times")), "confidence": F.array_min("weights")})


def total_gap(times: Column) -> Column:
    """The sum of the distances of consecutive times."""
    return F.aggregate(F.zip_with(F.slice(times, F.lit(1), F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, F.lit(2), F.size(times)), lambda a, b: F.abs(b - a)), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))


def scored(paths: DataFrame, unit: int = 1) -> DataFrame:
    """With cleanliness; unit: time units of the table in one of the gap scale."""
    return paths.withColumn("cleanliness", cleanliness(F.col("weights"), F.col("total_gap") / unit, F.col("divergence")))


def ranked(paths: DataFrame) -> DataFrame:
    """Cleanest first, ties by the nodes."""
    return paths.orderBy(F.desc("cleanliness"), "nodes")


def causal_surprise(paths: DataFrame, effects: DataFrame) -> DataFrame:
    """effect, surprise: 1 less the best path's cleanliness; 1 without a path."""
    best = paths.groupBy("effect").agg(F.max("cleanliness").alias("best"))
    return effects.select("effect").join(best, "effect", "left").select("effect", (1 - F.coalesce("best", F.lit(0.0))).alias("surprise"))
