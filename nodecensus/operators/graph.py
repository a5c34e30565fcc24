"""Graphs as tables: raw arcs or adjacency to nodes(id, name, is_key) and arcs(src, dst), and views of them.

Self-loops and repeated arcs are dropped when arcs are built.  Ids follow the order of keys, then of nodes that occur only
as targets, by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodecensus.sources.scratch import dense_ids, new_path, stored

VIEWS = ("directed", "reverse", "undirected")


def raw_edges(adjacency: DataFrame) -> DataFrame:
    """(pos, s, d) from (pos, key, nbrs); a key without neighbours keeps one row with d null."""
    return adjacency.select("pos", F.col("key").alias("s"), F.explode_outer("nbrs").alias("d"))


def nodes(edges: DataFrame) -> DataFrame:
    """id, name, is_key of (s, d) with an optional pos; every key and every target is a node."""
    pos = F.min("pos") if "pos" in edges.columns else F.lit(None).cast("long")
    keys = edges.groupBy("s").agg(pos.alias("pos")).select(F.col("s").alias("name"), "pos", F.lit(True).alias("is_key"))
    targets = edges.where(F.col("d").isNotNull()).select(F.col("d").alias("name"), F.lit(None).cast("long").alias("pos"), F.lit(False).alias("is_key"))
    all_ = keys.union(targets).groupBy("name").agg(F.min("pos").alias("pos"), F.max("is_key").alias("is_key"))
    return dense_ids(all_, [F.col("is_key").desc(), F.col("pos").asc_nulls_last(), F.col("name")]).select("id", "name", "is_key")


def simple_names(edges: DataFrame) -> DataFrame:
    """Distinct arcs by name without self-loops."""
    return edges.where(F.col("d").isNotNull() & (F.col("s") != F.col("d"))).select("s", "d").distinct()


def arcs(edges: DataFrame, of: DataFrame, dedup: bool = True) -> DataFrame:
    """Distinct (src, dst) without self-loops, by id; repeated arcs stay with ``dedup=False``.  Names become ids first, so that what is
    sorted out are pairs of numbers, and nodes are the hashed side, so that edges aren't sorted."""
    ids = lambda name, id_: of.select(F.col("name").alias(name), F.col("id").alias(id_)).hint("shuffle_hash")
    pairs = edges.where(F.col("d").isNotNull() & (F.col("s") != F.col("d"))).select("s", "d")
    a = pairs.join(ids("s", "src"), "s").join(ids("d", "dst"), "d").select("src", "dst")
    return a.distinct() if dedup else a


def build(edges: DataFrame, dedup: bool = True) -> tuple[DataFrame, DataFrame]:
    """Stored nodes and arcs of raw edges; repeated arcs stay with ``dedup=False``, for those who sort them anyway."""
    n = stored(nodes(edges), "nodes")
    return n, stored(arcs(edges, n, dedup), "arcs")


def view(a: DataFrame, name: str, dedup: bool = True) -> DataFrame:
    """The arcs as seen by a view; ``dedup=False`` keeps both arcs of a reciprocal pair in ``undirected``."""
    turned = a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if name == "directed":
        return a.select("src", "dst")
    if name == "reverse":
        return turned
    if name == "undirected":
        both = a.select("src", "dst").union(turned)
        return both.distinct() if dedup else both
    raise ValueError(f"no view {name!r}; there are {', '.join(VIEWS)}")


def degrees(n: DataFrame, a: DataFrame) -> DataFrame:
    """id, deg (0 for nodes without arcs)."""
    return n.select("id").join(a.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg")), "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def adjacency(n: DataFrame, a: DataFrame) -> DataFrame:
    """id, deg, nbrs in ascending order."""
    lists = a.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))
    return n.select("id").join(lists, "id", "left").select("id", F.coalesce(F.size("nbrs"), F.lit(0)).alias("deg"), F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"))


def sizes(n: DataFrame, a: DataFrame) -> DataFrame:
    """n_nodes, n_edges, n_with_out_edges in one row."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(n, "n_nodes").join(count(a, "n_edges")).join(count(a.select("src").distinct(), "n_with_out_edges"))


def dead_ends(n: DataFrame, a: DataFrame) -> DataFrame:
    """Nodes without an arc to leave by."""
    return n.join(a.select(F.col("src").alias("id")), "id", "left_anti")


def keep_instances(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges whose both ends are kept; a kept key that loses all neighbours stays, with d null."""
    keep = keep.select("name").distinct()
    keys = edges.join(keep.withColumnRenamed("name", "s"), "s", "left_semi")
    inside = keys.join(keep.withColumnRenamed("name", "d"), "d", "left_semi")
    bare = keys.select("s").distinct().join(inside.select("s"), "s", "left_anti").select("s", F.lit(None).cast("string").alias("d"))
    return inside.select("s", "d").union(bare)


def resolve_seeds(n: DataFrame, seeds: DataFrame) -> DataFrame:
    """ord, name, id of seeds; id null where the graph has no such node."""
    return seeds.select("ord", "name").join(n.select("name", "id"), "name", "left").select("ord", "name", "id")


def check_seeds(resolved: DataFrame) -> DataFrame:
    missing = [r["name"] for r in resolved.where(F.col("id").isNull()).orderBy("ord").limit(20).collect()]
    if missing:
        raise ValueError(f"seeds that are no nodes: {missing}")
    return resolved


def restrict_seeds(seeds: DataFrame, names: list[str]) -> DataFrame:
    """The seeds of these names, in their order; a name that is no seed raises.  The full table stays, so that it can be restricted anew."""
    kept = seeds.where(F.col("name").isin(names))
    if lost := set(names) - {r["name"] for r in kept.select("name").distinct().collect()}:
        raise ValueError(f"names that are no seeds: {sorted(lost)}")
    return kept.orderBy("ord")


def reachable(a: DataFrame, start: DataFrame) -> DataFrame:
    """Ids that can be reached from the ids of ``start``, themselves included: a frontier loop over arcs that are stored by their
    source once; each level is written for itself and none again."""
    spark, path = a.sparkSession, new_path(a.sparkSession, "reached")
    outs = stored(a.select("src", "dst").repartition("src"), "arcs-by-source")
    frontier, level = start.select(F.col("id").cast("long").alias("id")).distinct(), 0
    while True:
        frontier.write.parquet(f"{path}/level={level}")
        frontier = spark.read.schema("id long").parquet(f"{path}/level={level}")
        if frontier.isEmpty():
            return spark.read.schema("id long, level int").parquet(path).select("id")
        seen = spark.read.schema("id long, level int").parquet(path).select("id")
        near = outs.join(frontier, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier, level = near.join(seen, "id", "left_anti"), level + 1
