"""Command line: ``python -m nodecensus.cli run|diagnose|figures|list|convert|instances``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from nodecensus.operators import draws, graph, results
from nodecensus.plans import diagnosis, estimators, experiment, figures, provenance
from nodecensus.sources.catalogue import Catalogue, convert_pickle
from nodecensus.sources.files import exists, unique_path, write_text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="nodecensus", description=__doc__)
    p.add_argument("--folder", default="graphs", help="folder of stored adjacency")
    p.add_argument("--results", default="results", help="folder of results")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list", help="graphs, estimators and views")
    r = sub.add_parser("run", help="compute what results lack")
    r.add_argument("--graphs", nargs="+", help="default: all")
    r.add_argument("--estimators", nargs="+", help="default: all")
    r.add_argument("--budgets", nargs="+", type=float, help="relative to the number of nodes")
    r.add_argument("--views", nargs="+", choices=graph.VIEWS, default=["directed", "undirected"])
    r.add_argument("--runs", type=int, default=10)
    r.add_argument("--seed", type=int, default=42)
    r.add_argument("--seeds", nargs="+", help="names of nodes to start from")
    r.add_argument("--start-node", help="one of the seeds, whatever its case, or all; default: the first")
    r.add_argument("--no-visits", action="store_true", help="don't store visits")
    r.add_argument("--replace", action="store_true", help="compute known runs too and replace them")
    r.add_argument("--deprecate", nargs="?", const="", metavar="REASON", help="move all results aside first")
    r.add_argument("--jobs", type=int, help="tasks at a time of a local session")
    for name in ("--share-walks", "--checkpoint-budgets"):
        r.add_argument(name, action="store_true", help="always done: results are the same, and each walk is made once")
    d = sub.add_parser("diagnose", help="report on one walk a view")
    d.add_argument("--graph", required=True)
    d.add_argument("--views", nargs="+", choices=graph.VIEWS, default=["directed"])
    d.add_argument("--dead-end", choices=draws.DEAD_ENDS, default="history")
    d.add_argument("--budget", type=float, default=0.01)
    d.add_argument("--top", type=int, default=15)
    d.add_argument("--seed", type=int, default=42)
    d.add_argument("--start-node")
    d.add_argument("--no-plot", action="store_true", help="don't store the panels' tables")
    f = sub.add_parser("figures", help="store the points of figures")
    f.add_argument("--graphs", nargs="+", required=True)
    f.add_argument("--seed", type=int)
    f.add_argument("--estimators", nargs="+", help="a comparison of these instead of the named figures")
    f.add_argument("--views", nargs="+", choices=graph.VIEWS, default=["directed", "undirected"])
    f.add_argument("--out", default="figures")
    c = sub.add_parser("convert", help="store a pickled adjacency")
    c.add_argument("source")
    c.add_argument("name")
    c.add_argument("--force", action="store_true")
    i = sub.add_parser("instances", help="store a graph without nodes that aren't instances")
    i.add_argument("name")
    i.add_argument("types", help="table (name, type)")
    i.add_argument("out")
    i.add_argument("--force", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if spark is None:
        builder = SparkSession.builder.appName("nodecensus")
        spark = (builder.master(f"local[{args.jobs}]") if getattr(args, "jobs", None) else builder).getOrCreate()
    graphs = Catalogue(spark, args.folder)
    estimates, visits = f"{args.results}/estimates", f"{args.results}/visits"
    if args.what == "list":
        print("graphs:", ", ".join(graphs.available()), "\nestimators:", ", ".join(estimators.names()), "\nviews:", ", ".join(graph.VIEWS))
    elif args.what == "run":
        if args.deprecate is not None and exists(spark, args.results):
            print("moved to", provenance.archive(spark, args.results, args.deprecate))
        for name in map(graphs.resolve, args.graphs or graphs.available()):
            stored = results.load(spark, estimates)
            rows, seen = experiment.run(
                graphs.edges(name), name, args.estimators, tuple(args.views), args.budgets, args.runs, args.seed, args.start_node, None if args.replace else stored, provenance.fingerprint(), args.seeds,
                lambda done, all_, now, left: print(f"{name}: {done} of {all_}, median {'none' if now is None else f'{now:.3f}'} of the size, {left:.0f} s left", flush=True),
            )
            old = stored.where(f"graph = '{name}' and seed = {args.seed}")
            merge = results.replace if args.replace else results.append
            results.save(experiment.stored(merge(old, rows), "merged"), estimates)
            if not args.no_visits:
                known = spark.read.schema(experiment.VISITS).parquet(visits).where(f"graph = '{name}' and seed = {args.seed}") if exists(spark, visits) else spark.createDataFrame([], experiment.VISITS)
                results.save(experiment.stored(results.replace(known, seen, results.VISIT_KEYS), "merged"), visits)
        write_text(spark, f"{args.results}/README.md", provenance.readme(results.load(spark, estimates)))
    elif args.what == "diagnose":
        n, a = graphs.load(args.graph)
        for view in args.views:
            d = diagnosis.diagnose(n, a, view, args.dead_end, args.budget, args.top, args.seed, args.start_node)
            print(d.report())
            if not args.no_plot:
                for name, df in d.panels().items():
                    df.write.parquet(unique_path(spark, f"{args.results}/diagnosis/{args.graph}__{view}__{name}"))
    elif args.what == "figures":
        for name in args.graphs:
            all_ = results.load(spark, estimates, name, args.seed)
            for seed, start in [(r["seed"], r["start_node"]) for r in results.conditions(all_).collect()]:
                own = results.rows(all_, seed=seed, start_node=start)
                made = {"comparison": figures.comparison(own, args.estimators, args.views)} if args.estimators else figures.figures(own)
                for slug, df in made.items():
                    path = unique_path(spark, f"{args.out}/{name}__seed{seed}{f'__{start}' if start else ''}__{slug}")
                    df.write.parquet(path)
                    print(path, "|", figures.note(own, seed, start))
    elif args.what == "convert":
        convert_pickle(spark, args.source, graphs, args.name, args.force)
    else:
        graphs.save_instances(args.name, spark.read.parquet(args.types), args.out, args.force)


if __name__ == "__main__":
    main()
