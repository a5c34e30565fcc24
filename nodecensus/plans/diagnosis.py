"""Diagnosis of one walk in one call: why its estimate is what it is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodecensus.operators import diagnose as parts
from nodecensus.operators import draws, estimate, graph
from nodecensus.sources.scratch import stored


@dataclass
class Diagnosis:
    """``facts``: one row; ``top``: most visited nodes; ``coverage``: nodes met by steps; ``visits``: visits and degrees of the nodes met;
    ``bins``: medians of visits by view degree."""

    facts: DataFrame
    top: DataFrame
    coverage: DataFrame
    visits: DataFrame
    bins: DataFrame

    def panels(self) -> dict[str, DataFrame]:
        """What a figure of the diagnosis shows, a table a panel."""
        f = self.facts
        sizes = f.select(F.explode(F.create_map(*(x for k in ("n_nodes", "reachable", "reachable_end", "distinct_nodes", "uis", "katzir") for x in (F.lit(k), F.col(k).cast("double"))))).alias("quantity", "value"), "n_nodes")
        return {"sizes": sizes.select("quantity", "value", (F.col("value") / F.col("n_nodes")).alias("share")), "coverage": self.coverage, "degrees": self.bins, "top": self.top}

    def report(self) -> str:
        f = self.facts.first().asDict()
        number = lambda x: "none" if x is None else f"{x:,.0f}"
        share = lambda x: "" if x is None else f"{x / f['n_nodes']:.5f}"
        lines = [f"{f['view']}, dead ends by {f['dead_end']}, seed {f['seed']}: budget {f['budget_rel']:g} = {f['budget_abs']:,}, {f['steps']:,} samples", ""]
        for label, k in (("nodes", "n_nodes"), ("reachable from the start", "reachable"), ("reachable from the end", "reachable_end"), ("met", "distinct_nodes"), ("estimate without weights", "uis"), ("estimate by inverse degree", "katzir")):
            lines.append(f"{label:32}{number(f[k]):>16}{share(f[k]):>12}")
        lines += ["", f"verdict: {f['verdict']}", f"correction: {f['lift']:.2f} observed, {f['lift_needed']:.2f} needed" if f["uis"] is not None else "correction: no repeated node"]
        rho = lambda x: "none" if x is None else f"{x:+.3f}"
        lines.append(f"rank correlation of visits with degree: {rho(f['rho_view'])}" if f["view"] == "undirected" else f"rank correlation of visits with out-degree {rho(f['rho_out'])}, in-degree {rho(f['rho_in'])}")
        lines += ["", f"{'most visited':40}{'visits':>10}{'share':>9}{'out':>8}{'in':>8}"]
        for r in self.top.orderBy(F.col("visits").desc(), "node").collect():
            name = r["name"] if len(r["name"]) <= 38 else f"{r['name'][:18]}…{r['name'][-18:]}"
            lines.append(f"{name:40}{r['visits']:>10,}{r['share']:>9.2%}{r['deg_out']:>8}{r['deg_in']:>8}")
        return "\n".join(lines)


def diagnose(n: DataFrame, a: DataFrame, view: str = "directed", dead_end: str = "history", budget: float = 0.01, top: int = 15, seed: int = 42, start: str | None = None) -> Diagnosis:
    """One walk over a view of nodes and arcs, from a node by name (any, drawn by the seed, if none is named).

    Visits count charges, the start's draw included; the share of a node is its visits to the number of samples.
    """
    spark, size = n.sparkSession, n.count()
    seen = stored(graph.view(a, view), "diagnose-view")
    cap = max(round(budget * size), 2)
    seeds = [r["id"] for r in n.where(F.col("name") == start).select("id").collect()] if start is not None else []
    if start is not None and not seeds:
        raise ValueError(f"no node {start!r}")
    log = stored(draws.walk_log(n, seen, seeds, 1, cap * 100, seed, f"diag|{dead_end}", dead_end=dead_end), "diagnose-log")
    trace = draws.trace_of(log)
    visits = log.groupBy("node").agg(F.count("*").alias("visits"))
    degree = lambda arcs, name: arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias(name))
    known = visits
    for arcs, name in ((a, "deg_out"), (graph.view(a, "reverse"), "deg_in"), (seen, "deg_view")):
        known = known.join(degree(arcs, name), "node", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    known = stored(known.join(n.select(F.col("id").alias("node"), "name"), "node"), "diagnose-visits")
    k = trace.count()
    ends = trace.agg(F.max_by("node", "idx").alias("end")).join(log.agg(F.min_by("node", "seq").alias("begin"))).first()
    reach = lambda at: graph.reachable(seen, spark.createDataFrame([(at,)], "id long")).count() if at is not None else 0
    # Collisions, weights and lift by visits, as the walk paid for them.
    w = 1 / F.greatest(F.col("deg_view"), F.lit(1))
    sums = known.agg(F.count("*").alias("distinct_nodes"), F.sum(F.col("visits") * (F.col("visits") - 1) / 2).alias("n_col"), (F.sum(F.col("visits") * w) / k * F.sum(F.col("visits") / w) / k).alias("lift") if k else F.lit(None).cast("double").alias("lift"))
    facts = sums.withColumn("uis", F.when((F.col("n_col") > 0) & F.lit(k > 1), F.lit(k * (k - 1) / 2) / F.nullif(F.col("n_col"), F.lit(0.0)))).withColumn("katzir", F.col("uis") * F.col("lift"))
    reachable, reachable_end = reach(ends["begin"]), reach(ends["end"])
    for name, column in (("rho_out", "deg_out"), ("rho_in", "deg_in"), ("rho_view", "deg_view")):
        facts = facts.join(parts.spearman(known.select("visits", F.col(column).alias("_d")), "visits", "_d").withColumnRenamed("rho", name))
    said = {"view": view, "dead_end": dead_end, "seed": seed, "budget_rel": float(budget), "budget_abs": cap, "steps": k, "n_nodes": size, "reachable": reachable, "reachable_end": reachable_end}
    facts = facts.withColumns({c: F.lit(v) for c, v in said.items()}).withColumns({"lift_needed": F.lit(float(size)) / F.col("uis"), "verdict": parts.verdict(F.lit(reachable_end), F.lit(size))})
    best = known.orderBy(F.col("visits").desc(), "node").limit(top).withColumn("share", F.col("visits") / F.lit(max(k, 1)))
    # A walk's only draw is its start's: the other charges are steps.
    steps = log.where("kind <> 'draw'").select("node", (F.col("seq") - 1).alias("idx"))
    points = known.select(F.col("deg_view").cast("double").alias("x"), F.col("visits").cast("double").alias("y"))
    bound = points.where("x > 0").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).first()
    edges = parts.geometric_edges(bound["lo"], bound["hi"], 18) if bound["n"] >= 10 and bound["hi"] > bound["lo"] else [1.0, 2.0]
    bins = parts.binned_medians(points if bound["n"] >= 10 else points.limit(0), edges)
    return Diagnosis(stored(facts, "diagnose-facts"), best.select("node", "name", "visits", "share", "deg_out", "deg_in", "deg_view"), parts.coverage(steps, parts.checkpoints(60 * cap)), known, bins)
