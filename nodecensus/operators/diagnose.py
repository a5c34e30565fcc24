"""Diagnosis of one walk: coverage, lift, rank correlation with degrees, most visited nodes, binned medians, verdict."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpoints(most: int, n: int = 220) -> list[int]:
    """About n distinct whole numbers from 1 to most at equal ratios."""
    return sorted({max(1, round(math.exp(i * math.log(most) / (n - 1)))) for i in range(n)}) if most > 0 else []


def coverage(trace: DataFrame, points: list[int]) -> DataFrame:
    """steps, distinct: nodes seen in the first ``steps`` rows of the trace: first occurrences, counted up to each point."""
    first = trace.groupBy("node").agg(F.min("idx").alias("at"))
    marks = trace.sparkSession.createDataFrame([(p,) for p in points], "steps long")
    # Each first occurrence goes to the next checkpoint by search in the fixed list, so no row meets all checkpoints.
    grid = F.lit(points)
    slot = F.try_element_at(F.filter(grid, lambda p: p > F.col("at")), F.lit(1))  # null behind the last checkpoint
    per = first.select(slot.cast("long").alias("steps")).where("steps is not null").groupBy("steps").agg(F.count("*").alias("new"))
    w = Window.orderBy("steps").rowsBetween(Window.unboundedPreceding, 0)  # at most as many rows as checkpoints
    return marks.join(per, "steps", "left").select("steps", F.sum(F.coalesce("new", F.lit(0))).over(w).cast("long").alias("distinct"))


def lift(trace: DataFrame) -> DataFrame:
    """k, uis (C(k,2) / collisions), lift (mean weight times mean inverse weight)."""
    from nodecensus.operators.estimate import per_set, thinned

    s = per_set(thinned(trace), [], 0, True)
    return s.select("k", "n_col", "uis", (F.col("mean_w") * F.col("mean_inv")).alias("lift"), "katzir")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation; ranks come from counts per value, so no window spans the table."""

    def ranks(column: str) -> DataFrame:
        from nodecensus.sources.scratch import stored

        counts = stored(df.groupBy(column).agg(F.count("*").alias("c")).orderBy(column).withColumn("part", F.spark_partition_id()), "ranks")
        parts = counts.groupBy("part").agg(F.sum("c").alias("n"))
        before = parts.withColumn("off", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        w = Window.partitionBy("part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
        out = counts.withColumn("less", F.coalesce(F.sum("c").over(w), F.lit(0))).join(before, "part")
        return out.select(F.col(column).alias(f"_{column}"), (F.col("less") + F.col("off") + (F.col("c") + 1) / 2.0).alias(f"rank_{column}"))

    both = df.join(ranks(x), F.col(x) == F.col(f"_{x}")).join(ranks(y), F.col(y) == F.col(f"_{y}"))
    spread = F.stddev_pop(f"rank_{x}") * F.stddev_pop(f"rank_{y}")  # 0 where all ranks are equal: no correlation then
    return both.agg(F.try_divide(F.covar_pop(f"rank_{x}", f"rank_{y}"), F.nullif(spread, F.lit(0.0))).alias("rho"))


def top_nodes(visits: DataFrame, names: DataFrame, degrees: DataFrame, k: int = 10) -> DataFrame:
    total = visits.agg(F.sum("visits").alias("total"))
    best = visits.orderBy(F.col("visits").desc(), F.col("node")).limit(k)
    out = best.join(total).withColumn("share", F.col("visits") / F.col("total")).drop("total")
    return out.join(names.select(F.col("id").alias("node"), "name"), "node", "left").join(degrees.withColumnRenamed("id", "node"), "node", "left")


def geometric_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges of bins at equal ratios."""
    return [low * (high / low) ** (k / bins) for k in range(bins)] + [high]


def binned_medians(points: DataFrame, edges: list[float], least: int = 5) -> DataFrame:
    """Medians of x and y in bins of x between given edges; bins with fewer than ``least`` points are left out."""
    grid = F.lit(edges)
    slot = F.least(F.greatest(F.size(F.filter(grid, lambda e: e <= F.col("x"))), F.lit(1)), F.lit(len(edges) - 1))
    return points.where("x > 0").groupBy(slot.alias("bin")).agg(F.count("*").alias("n"), F.median("x").alias("x"), F.median("y").alias("y")).where(F.col("n") >= least)


def verdict(reachable: Column, size: Column) -> Column:
    return F.when(reachable < 0.01 * size, F.lit("stuck")).otherwise(F.lit("free"))
