"""From traces to estimates: prefixes by budget, thinning into sets, weights, collision counts, formulas, and their median.

A trace has key columns, idx (place in the trace), node, degree, and where it matters walk and cum_cost (hundredths of a query).
Everything is aggregation: node counts first (so that a node visited by all meets as one row a task), then sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: By name: trace, step -> trace with subset and pos (place within the subset).
THINNINGS = {
    "none": lambda trace, step: trace.withColumns({"subset": F.lit(0), "pos": F.col("idx")}),
    "simple": lambda trace, step: trace.where(F.col("idx") % step == 0).withColumns({"subset": F.lit(0), "pos": F.floor(F.col("idx") / step)}),
    "shifted": lambda trace, step: trace.withColumns({"subset": (F.col("idx") % step).cast("int"), "pos": F.floor(F.col("idx") / step)}),
    "by_walk": lambda trace, step: trace.withColumns({"subset": F.col("walk").cast("int"), "pos": F.col("idx")}),
}


def prefix(trace: DataFrame, ladder: DataFrame) -> DataFrame:
    """Each budget's part of the trace: rows whose cost up to them is within the budget (a ladder has a few rows)."""
    return trace.join(ladder.select("budget_rel", "budget_abs", "cap"), F.col("cum_cost") <= F.col("cap"))


def thinned(trace: DataFrame, how: str = "none", step: int = 5) -> DataFrame:
    """trace with subset and pos (place within the subset).  THINNINGS takes further ways."""
    if how not in THINNINGS:
        raise ValueError(f"no thinning {how!r}")
    return THINNINGS[how](trace, step)


def weight(inverse_degree: bool) -> Column:
    return F.lit(1.0) / F.greatest(F.col("degree"), F.lit(1)) if inverse_degree else F.lit(1.0)


def near_collisions(sets: DataFrame, keys: list[str], margin: int) -> DataFrame:
    """near: pairs of equal nodes at most ``margin`` places apart, per key and subset.

    Windows are cut into blocks of places (each block also gets the last places of the one before), so a node that fills the
    trace is spread over many tasks.
    """
    size = max(4096, 16 * margin)
    block = F.floor(F.col("pos") / size)
    copies = F.when(F.col("pos") % size >= size - margin, F.array(block, block + 1)).otherwise(F.array(block))
    rows = sets.select(*keys, "subset", "node", "pos", F.posexplode(copies).alias("copy", "block"))
    w = Window.partitionBy(*keys, "subset", "block", "node").orderBy("pos").rangeBetween(-margin, -1)
    return rows.withColumn("n", F.count("*").over(w)).where(F.col("copy") == 0).groupBy(*keys, "subset").agg(F.sum("n").alias("near"))


def pair_count(k: Column, margin: int) -> Column:
    m = F.least(F.lit(margin), k - 1)
    return F.when(k < 2, F.lit(0.0)).otherwise((k * (k - 1) / 2.0) - (m * k - m * (m + 1) / 2.0))


def per_set(sets: DataFrame, keys: list[str], margin: int = 0, inverse_degree: bool = False) -> DataFrame:
    """Per key and subset: k, n_col, pairs, mean_w, mean_inv, uis and katzir (null where there is no estimate)."""
    w = weight(inverse_degree)
    counts = sets.withColumn("w", w).groupBy(*keys, "subset", "node").agg(F.count("*").alias("c"), F.sum("w").alias("sw"), F.sum(1 / F.col("w")).alias("si"))
    out = counts.groupBy(*keys, "subset").agg(F.sum("c").alias("k"), F.sum(F.col("c") * (F.col("c") - 1) / 2).cast("long").alias("all_col"), F.sum("sw").alias("sw"), F.sum("si").alias("si"))
    if margin > 0:
        near = near_collisions(sets, keys, margin)
        both = [F.col(f"_{x}").eqNullSafe(F.col(x)) for x in (*keys, "subset")]
        out = out.join(near.withColumnsRenamed({x: f"_{x}" for x in (*keys, "subset")}), F.expr("true") if not both else _all(both), "left").drop(*(f"_{x}" for x in (*keys, "subset")))
        out = out.withColumn("n_col", F.col("all_col") - F.coalesce("near", F.lit(0)))
    else:
        out = out.withColumn("n_col", F.col("all_col"))
    out = out.withColumns({"pairs": pair_count(F.col("k"), margin), "mean_w": F.col("sw") / F.col("k"), "mean_inv": F.col("si") / F.col("k")})
    uis = F.when((F.col("pairs") > 0) & (F.col("n_col") > 0), F.try_divide(F.col("pairs"), F.nullif(F.col("n_col").cast("double"), F.lit(0.0))))
    return out.withColumn("uis", uis).withColumn("katzir", F.col("uis") * F.col("mean_w") * F.col("mean_inv"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out &= c
    return out


def over_subsets(sets: DataFrame, keys: list[str], value: str, n_subsets: int) -> DataFrame:
    """Median over the subsets with an estimate, and n_samples, n_subsets, n_valid, subset_std, subset_spread."""
    v = F.col(value)
    return sets.groupBy(*keys).agg(
        F.median(v).alias("estimate"),
        F.sum("k").alias("n_samples"),
        F.lit(n_subsets).alias("n_subsets"),
        F.count(v).alias("n_valid"),
        F.when(F.count(v) > 1, F.stddev_samp(v)).otherwise(F.when(F.count(v) == 1, F.lit(0.0))).alias("subset_std"),
        F.when(F.count(v) > 1, F.max(v) - F.min(v)).otherwise(F.lit(0.0)).alias("subset_spread"),
    )


def captures(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Capture-recapture in one row per key: n1, n2, overlap, lp, chapman, n_unique_total, recaptures, schnabel, cross_pairs,
    cross_collisions, cross, cross_wis (inverse degree)."""
    cells = sets.withColumn("w", weight(True)).groupBy(*keys, "node", "subset").agg(F.count("*").alias("c"), F.sum("w").alias("sw"), F.sum(1 / F.col("w")).alias("si"))
    by_node = cells.groupBy(*keys, "node").agg(
        F.sum("c").alias("c"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("within"), F.min("subset").alias("first"), F.count("*").alias("seen"),
        F.max((F.col("subset") == 0).cast("int")).alias("in1"), F.max((F.col("subset") == 1).cast("int")).alias("in2"), F.sum("sw").alias("sw"), F.sum("si").alias("si"),
    )
    total = by_node.groupBy(*keys).agg(
        F.sum("in1").cast("long").alias("n1"), F.sum("in2").cast("long").alias("n2"), F.sum(F.col("in1") * F.col("in2")).cast("long").alias("overlap"),
        F.count("*").alias("n_unique_total"), F.sum(F.col("seen") - 1).cast("long").alias("recaptures"),
        F.sum(F.col("c") * (F.col("c") - 1) / 2 - F.col("within")).alias("cross_collisions"), F.sum("c").alias("k"), F.sum("sw").alias("sw"), F.sum("si").alias("si"),
    )
    # Per set: distinct nodes, and how many of all nodes were first met in it.  Sets are few.
    of_set = cells.groupBy(*keys, "subset").agg(F.count("*").alias("distinct"), F.sum("c").alias("size"))
    new = by_node.groupBy(*keys, F.col("first").alias("subset")).agg(F.count("*").alias("new"))
    both = of_set.join(new, [*keys, "subset"], "left") if keys else of_set.join(new, "subset", "left")
    marked = F.coalesce(F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy(*keys).orderBy("subset").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = both.withColumn("marked", marked).groupBy(*keys).agg(F.sum(F.col("distinct") * F.col("marked")).cast("double").alias("cm"), F.sum("size").alias("s"), F.sum(F.col("size") * F.col("size")).alias("s2"))
    out = total.join(sums, keys) if keys else total.join(sums)
    pairs = (F.col("s") * F.col("s") - F.col("s2")) / 2.0
    out = out.withColumn("cross_pairs", pairs)
    cross = F.when((F.col("cross_collisions") > 0) & (pairs > 0), F.try_divide(pairs, F.nullif(F.col("cross_collisions").cast("double"), F.lit(0.0))))
    return out.select(
        *keys, "n1", "n2", "overlap", F.try_divide(F.col("n1").cast("double") * F.col("n2"), F.nullif(F.col("overlap").cast("double"), F.lit(0.0))).alias("lp"),
        ((F.col("n1") + 1.0) * (F.col("n2") + 1.0) / (F.col("overlap") + 1.0) - 1.0).alias("chapman"), "n_unique_total", "recaptures",
        F.try_divide(F.col("cm"), F.nullif(F.col("recaptures").cast("double"), F.lit(0.0))).alias("schnabel"), F.col("cross_collisions").cast("long").alias("cross_collisions"), "cross_pairs",
        cross.alias("cross"), (cross * F.col("sw") / F.col("k") * F.col("si") / F.col("k")).alias("cross_wis"),
    )
