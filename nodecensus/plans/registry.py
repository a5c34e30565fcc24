"""Queries over the test tables, one per operator, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodecensus.functions.rng import draw_sql
from nodecensus.operators import diagnose, draws, estimate, graph, results
from nodecensus.plans import diagnosis, estimators, experiment
from nodecensus.sources.scratch import dense_ids, stored, table

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_O: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _O[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_O)


# Graphs and traces of the test tables ------------------------------------------------------------------------------

LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"
RAW = {
    "g1": f"SELECT 'p' || l_partkey AS s, 'p' || lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {LINES.removeprefix('l_orderkey, ')}) AS d FROM lineitem",
    "g2": "SELECT 'p' || l_partkey AS s, 's' || l_suppkey AS d FROM lineitem",
    "g4": "SELECT 'c' || o_custkey AS s, 'p' || l_partkey AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
}


def raw(spark: SparkSession, d: str, g: str) -> DataFrame:
    frames = {t: table(spark, d, t) for t in ("lineitem", "orders") if f" {t}" in RAW[g]}
    sql = RAW[g]
    for t in frames:
        sql = sql.replace(f" {t}", f" {{{t}}}")
    return spark.sql(sql, **frames).where("d IS NOT NULL")


def nodes_sql(g: str) -> str:
    """CTEs raw, nodes(id, name, is_key) and arcs(src, dst)."""
    return f"""raw AS (SELECT * FROM ({RAW[g]}) WHERE d IS NOT NULL),
names AS (SELECT name, max(k) AS is_key FROM (SELECT s AS name, 1 AS k FROM raw UNION ALL SELECT d, 0 FROM raw) GROUP BY name),
nodes AS (SELECT row_number() OVER (ORDER BY is_key DESC, name) - 1 AS id, name, is_key = 1 AS is_key FROM names),
arcs AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM raw JOIN nodes a ON a.name = s JOIN nodes b ON b.name = d WHERE s <> d)"""


TRACES = {
    "t1": ("events", "user_id", "ts, event_id"),
    "t2": ("orders", "o_custkey", "o_orderkey"),
    "t3": ("lineitem", "l_partkey", LINES),
}


def trace(spark: SparkSession, d: str, t: str) -> DataFrame:
    """idx, node, degree (a rule on the node, so that both engines have it) and walk (four parts of the trace in turn)."""
    name, node, order = TRACES[t]
    rows = table(spark, d, name).select(F.col(node).alias("node"), *order.split(", "))
    return dense_ids(rows, order.split(", "), "idx").select("idx", "node", (F.col("node") % 7 + 1).cast("int").alias("degree"), F.floor(F.col("idx") / 500 % 4).cast("int").alias("walk"))


def trace_sql(t: str) -> str:
    name, node, order = TRACES[t]
    return f"tr AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS idx, {node} AS node, {node} % 7 + 1 AS degree, ((row_number() OVER (ORDER BY {order}) - 1) // 500) % 4 AS walk FROM {name})"


def R(x: str) -> str:  # noqa: N802
    return f"round_even({x}, 6)"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.bround(F.col(c), 6) for c in columns})


def per_set_sql(t: str, subset: str = "0", where: str = "true", pos: str = "idx", margin: int = 0, w: str = "1.0") -> str:
    """CTE s(subset, k, n_col, pairs, mean_w, mean_inv, uis, katzir)."""
    return f"""{trace_sql(t)},
th AS (SELECT *, {subset} AS subset, {pos} AS pos, {w} AS w FROM tr WHERE {where}),
nc AS (SELECT subset, node, count(*) AS c, sum(w) AS sw, sum(1 / w) AS si FROM th GROUP BY ALL),
nr AS (SELECT subset, sum(n) AS near FROM (SELECT subset, count(*) OVER (PARTITION BY subset, node ORDER BY pos RANGE BETWEEN {max(margin, 1)} PRECEDING AND 1 PRECEDING) AS n FROM th) GROUP BY subset),
s0 AS (SELECT subset, sum(c)::DOUBLE AS k, sum(c * (c - 1) // 2)::DOUBLE AS col, sum(sw) AS sw, sum(si) AS si FROM nc GROUP BY subset),
s1 AS (SELECT s0.subset, k, col - {'near' if margin else 0} AS n_col, CASE WHEN k < 2 THEN 0 ELSE k * (k - 1) / 2 - (least({margin}, k - 1) * k - least({margin}, k - 1) * (least({margin}, k - 1) + 1) / 2) END AS pairs, sw / k AS mean_w, si / k AS mean_inv FROM s0 JOIN nr ON s0.subset = nr.subset),
s AS (SELECT *, CASE WHEN pairs > 0 AND n_col > 0 THEN pairs / n_col END AS uis, CASE WHEN pairs > 0 AND n_col > 0 THEN pairs / n_col * mean_w * mean_inv END AS katzir FROM s1)"""


# Graph construction and views --------------------------------------------------------------------------------------


@query(f"WITH {nodes_sql('g4')} SELECT id, name, is_key FROM nodes")
def graph_nodes(spark, d):
    return graph.nodes(raw(spark, d, "g4"))


@query(f"SELECT DISTINCT s, d FROM ({RAW['g1']}) WHERE d IS NOT NULL AND s <> d")
def graph_simplify(spark, d):
    return graph.simple_names(raw(spark, d, "g1"))


@query(f"WITH {nodes_sql('g1')} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM arcs) AS n_edges, (SELECT count(DISTINCT src) FROM arcs) AS n_with_out_edges")
def graph_sizes(spark, d):
    return graph.sizes(*graph.build(raw(spark, d, "g1")))


@query(f"WITH {nodes_sql('g2')} SELECT id, count(src) AS deg FROM nodes LEFT JOIN arcs ON src = id GROUP BY id")
def degree_out(spark, d):
    return graph.degrees(*graph.build(raw(spark, d, "g2")))


@query(f"WITH {nodes_sql('g2')} SELECT id, count(dst) AS deg FROM nodes LEFT JOIN arcs ON dst = id GROUP BY id")
def degree_in(spark, d):
    n, a = graph.build(raw(spark, d, "g2"))
    return graph.degrees(n, graph.view(a, "reverse"))


@query(f"WITH {nodes_sql('g2')} SELECT id, count(dst)::INTEGER AS deg, coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst), '') AS nbrs FROM nodes LEFT JOIN arcs ON src = id GROUP BY id")
def neighbours(spark, d):
    return graph.adjacency(*graph.build(raw(spark, d, "g2"))).withColumn("nbrs", F.array_join(F.col("nbrs").cast("array<string>"), ","))


@query(f"WITH {nodes_sql('g4')} SELECT src, dst FROM arcs")
def view_directed(spark, d):
    return graph.view(graph.build(raw(spark, d, "g4"))[1], "directed")


@query(f"WITH {nodes_sql('g4')} SELECT dst AS src, src AS dst FROM arcs")
def view_reverse(spark, d):
    return graph.view(graph.build(raw(spark, d, "g4"))[1], "reverse")


@query(f"WITH {nodes_sql('g1')} SELECT src, dst FROM arcs UNION SELECT dst, src FROM arcs")
def view_undirected(spark, d):
    return graph.view(graph.build(raw(spark, d, "g1"))[1], "undirected")


@query(f"WITH {nodes_sql('g1')} SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM arcs UNION ALL SELECT dst, src FROM arcs) GROUP BY ALL")
def view_multigraph(spark, d):
    return graph.view(graph.build(raw(spark, d, "g1"))[1], "undirected", dedup=False).groupBy("src", "dst").agg(F.count("*").alias("n"))


KEEP = "SELECT 'p' || p_partkey AS name FROM part WHERE p_size % 2 = 0"


@query(f"WITH keep AS ({KEEP}), r AS (SELECT * FROM ({RAW['g1']}) WHERE d IS NOT NULL AND s IN (SELECT name FROM keep)), i AS (SELECT * FROM r WHERE d IN (SELECT name FROM keep)) SELECT s, d, count(*) AS n FROM (SELECT s, d FROM i UNION ALL SELECT DISTINCT s, NULL FROM r WHERE s NOT IN (SELECT s FROM i)) GROUP BY ALL")
def instances_only(spark, d):
    keep = table(spark, d, "part").where("p_size % 2 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("name"))
    return graph.keep_instances(raw(spark, d, "g1"), keep).groupBy("s", "d").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN p_size % 2 = 0 THEN 'instance' ELSE 'literal' END AS type, count(*) AS n FROM part GROUP BY 1")
def node_type_counts(spark, d):
    return table(spark, d, "part").groupBy(F.when(F.col("p_size") % 2 == 0, "instance").otherwise("literal").alias("type")).agg(F.count("*").alias("n"))


@query(f"WITH {nodes_sql('g4')} SELECT id, name, is_key FROM nodes WHERE id NOT IN (SELECT src FROM arcs)")
def dead_ends(spark, d):
    return graph.dead_ends(*graph.build(raw(spark, d, "g4")))


@query(f"WITH {nodes_sql('g4')}, s(ord, name) AS (VALUES (0, 'c1'), (1, 'p7'), (2, 'nobody')) SELECT ord, s.name, id FROM s LEFT JOIN nodes USING (name)")
def seed_resolution(spark, d):
    return graph.resolve_seeds(graph.nodes(raw(spark, d, "g4")), spark.createDataFrame([(0, "c1"), (1, "p7"), (2, "nobody")], "ord int, name string"))


@query(f"""WITH RECURSIVE {nodes_sql('g2')}, reach(id) AS (SELECT id FROM nodes WHERE name = (SELECT min(s) FROM raw) UNION SELECT dst FROM arcs JOIN reach ON src = id) SELECT id FROM reach""")
def reachability(spark, d):
    e = raw(spark, d, "g2")
    n, a = graph.build(e)
    return graph.reachable(a, n.join(e.agg(F.min("s").alias("name")), "name"))


# Estimates on fixed traces ------------------------------------------------------------------------------------------

_SET = ["k", "n_col", "pairs", "mean_w", "mean_inv", "uis", "katzir"]
_SET_SQL = ", ".join(["subset::INTEGER AS subset", "k::BIGINT AS k", "n_col::BIGINT AS n_col", "pairs::DOUBLE AS pairs", *(f"{R(x)} AS {x}" for x in ("mean_w", "mean_inv", "uis", "katzir"))])


def _sets(df: DataFrame) -> DataFrame:
    return rounded(df.select("subset", *_SET).withColumn("subset", F.col("subset").cast("int")), "mean_w", "mean_inv", "uis", "katzir")


def _set_query(name: str, t: str, how: str, sql: dict, margin: int = 0, by_degree: bool = False) -> None:
    def run(spark, d):
        return _sets(estimate.per_set(estimate.thinned(trace(spark, d, t), how), [], margin, by_degree))

    run.__name__ = name
    query(f"WITH {per_set_sql(t, margin=margin, w='1.0 / degree' if by_degree else '1.0', **sql)} SELECT {_SET_SQL} FROM s")(run)


_set_query("collision_uis", "t1", "none", {})
_set_query("collision_margin", "t3", "none", {}, margin=10)
_set_query("katzir", "t2", "none", {}, by_degree=True)
_set_query("katzir_margin", "t1", "none", {}, margin=10, by_degree=True)
_set_query("thin_simple", "t1", "simple", {"where": "idx % 5 = 0", "pos": "idx // 5"})
_set_query("thin_shifted", "t1", "shifted", {"subset": "idx % 5", "pos": "idx // 5"}, margin=3)
_set_query("thin_by_walk", "t2", "by_walk", {"subset": "walk"})


@query(f"WITH {per_set_sql('t1', subset='idx % 5', pos='idx // 5')} SELECT {R('median(uis)')} AS estimate, sum(k)::BIGINT AS n_samples, 5 AS n_subsets, count(uis) AS n_valid, {R('stddev_samp(uis)')} AS subset_std, {R('max(uis) - min(uis)')} AS subset_spread FROM s")
def subset_agg(spark, d):
    one = estimate.per_set(estimate.thinned(trace(spark, d, "t1"), "shifted"), [])
    return rounded(estimate.over_subsets(one, [], "uis", 5), "estimate", "subset_std", "subset_spread")


def captures_sql(t: str, n: int) -> str:
    return f"""{trace_sql(t)}, c AS (SELECT node, walk % {n} AS t, count(*) AS c, sum(1.0 / degree) AS sw, sum(degree) AS si FROM tr GROUP BY ALL),
b AS (SELECT node, sum(c) AS c, sum(c * (c - 1) // 2) AS inside, min(t) AS first, count(*) AS seen, max((t = 0)::INT) AS a1, max((t = 1)::INT) AS a2, sum(sw) AS sw, sum(si) AS si FROM c GROUP BY node),
z AS (SELECT t, count(*) AS dn, sum(c) AS size, (SELECT count(*) FROM b WHERE b.first < c.t) AS marked FROM c GROUP BY t),
q AS (SELECT sum(dn * marked)::DOUBLE AS cm, sum(size)::DOUBLE AS s, sum(size * size)::DOUBLE AS s2 FROM z),
f AS (SELECT sum(a1)::DOUBLE AS n1, sum(a2)::DOUBLE AS n2, sum(a1 * a2)::DOUBLE AS overlap, sum(seen - 1)::DOUBLE AS rec, sum(c * (c - 1) // 2 - inside)::DOUBLE AS cc, sum(c)::DOUBLE AS k, sum(sw) AS sw, sum(si) AS si, count(*) AS uniq FROM b)"""


def _capture_query(name: str, t: str, n: int, columns: dict[str, str]) -> None:
    def run(spark, d):
        c = estimate.captures(trace(spark, d, t).withColumn("subset", (F.col("walk") % n).cast("int")), [])
        return rounded(c.select(*columns), *(x for x, v in columns.items() if v.startswith("round_even")))

    run.__name__ = name
    query(f"WITH {captures_sql(t, n)} SELECT {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM f, q")(run)


_capture_query("lincoln_petersen", "t2", 2, {"n1": "n1::BIGINT", "n2": "n2::BIGINT", "overlap": "overlap::BIGINT", "lp": R("n1 * n2 / nullif(overlap, 0)")})
_capture_query("chapman", "t1", 2, {"chapman": R("(n1 + 1) * (n2 + 1) / (overlap + 1) - 1")})
_capture_query("schnabel", "t2", 4, {"n_unique_total": "uniq", "recaptures": "rec::BIGINT", "schnabel": R("cm / nullif(rec, 0)")})
_capture_query("cross", "t2", 2, {"cross_collisions": "cc::BIGINT", "cross_pairs": "(s * s - s2) / 2", "cross": R("(s * s - s2) / 2 / nullif(cc, 0)")})
_capture_query("cross_wis", "t3", 2, {"cross_wis": R("(s * s - s2) / 2 / nullif(cc, 0) * (sw / k) * (si / k)")})

# Draws, costs, prefixes ----------------------------------------------------------------------------------------------

RUNS = 10
STEPS = (0.1, 0.2, 0.5)


def draws_sql(g: str, group: str, kind: str) -> str:
    """CTE tr(run, idx, node, degree, cum_cost, fresh) of independent draws up to half the nodes' number."""
    pick = {"uniform": f"SELECT run, i, {draw_sql('key', 'i')} % (SELECT count(*) FROM nodes) AS node FROM tries", "by_degree": f"SELECT run, i, src AS node FROM tries JOIN (SELECT src, row_number() OVER (ORDER BY src, dst) - 1 AS arc FROM arcs) x ON x.arc = {draw_sql('key', 'i')} % (SELECT count(*) FROM arcs)"}[kind]
    return f"""{nodes_sql(g)}, lim AS (SELECT round_even(0.5 * count(*), 0)::BIGINT * 100 AS cap FROM nodes),
tries AS (SELECT r AS run, i, '42|{group}|' || r AS key FROM range({RUNS}) a(r), range((SELECT (cap + 101) // 102 + 1 FROM lim)) b(i)), drawn AS ({pick}),
priced AS (SELECT *, row_number() OVER (PARTITION BY run, node ORDER BY i) = 1 AS fresh FROM drawn),
summed AS (SELECT *, sum(CASE WHEN fresh THEN 200 ELSE 102 END) OVER (PARTITION BY run ORDER BY i) AS cum_cost FROM priced),
deg AS (SELECT src, count(*) AS degree FROM arcs GROUP BY src),
tr AS (SELECT run, i AS idx, node, coalesce(degree, 0) AS degree, cum_cost, fresh FROM summed LEFT JOIN deg ON src = node WHERE cum_cost <= (SELECT cap FROM lim)),
lad AS (SELECT b::DOUBLE AS budget_rel, greatest(round_even(b * (SELECT count(*) FROM nodes), 0), 2)::BIGINT AS budget_abs FROM (VALUES (0.1), (0.2), (0.5)) v(b)),
cut AS (SELECT budget_rel, budget_abs, tr.* FROM tr JOIN lad ON cum_cost <= budget_abs * 100)"""


def _independent(spark, d, g: str, kind: str) -> tuple[DataFrame, int]:
    n, a = graph.build(raw(spark, d, g))
    size = n.count()
    steps = experiment.ladder(size, STEPS)
    made = (draws.uniform(n, a, RUNS, steps[-1][1] * 100, 42, "uniform") if kind == "uniform" else draws.by_degree(a, RUNS, steps[-1][1] * 100, 42, "by_degree"))
    frame = spark.createDataFrame([(b, x, x * 100) for b, x in steps], "budget_rel double, budget_abs long, cap long")
    return estimate.prefix(stored(made, "trace"), frame), size


def _estimates_sql(g: str, kind: str, w: str, formula: str) -> str:
    return f"""WITH {draws_sql(g, kind, kind)}, c AS (SELECT budget_rel, budget_abs, run, node, count(*) AS c, sum({w}) AS sw, sum(1 / {w}) AS si FROM cut GROUP BY ALL),
s AS (SELECT budget_rel, budget_abs, run, sum(c)::DOUBLE AS k, sum(c * (c - 1) // 2)::DOUBLE AS n_col, sum(sw) AS sw, sum(si) AS si FROM c GROUP BY ALL)
SELECT budget_rel, budget_abs, run::INTEGER AS run, k::BIGINT AS k, {R(f'CASE WHEN n_col > 0 THEN k * (k - 1) / 2 / n_col {formula} END')} AS estimate FROM s"""


def _estimates(cut: DataFrame, column: str, by_degree: bool = False) -> DataFrame:
    one = estimate.per_set(estimate.thinned(cut), ["budget_rel", "budget_abs", "run"], 0, by_degree)
    return rounded(one.select("budget_rel", "budget_abs", "run", "k", F.col(column).alias("estimate")), "estimate")


@query(_estimates_sql("g2", "uniform", "1.0", ""))
def uniform_collision(spark, d):
    return _estimates(_independent(spark, d, "g2", "uniform")[0], "uis")


@query(_estimates_sql("g2", "uniform", "1.0", "* (sw / k) * (si / k)"))
def uniform_weighted(spark, d):
    return _estimates(_independent(spark, d, "g2", "uniform")[0], "katzir")


@query(_estimates_sql("g1", "by_degree", "(1.0 / greatest(degree, 1))", "* (sw / k) * (si / k)"))
def wis_indep(spark, d):
    return _estimates(_independent(spark, d, "g1", "by_degree")[0], "katzir", True)


@query(f"WITH {draws_sql('g4', 'uniform', 'uniform')} SELECT budget_rel, run::INTEGER AS run, idx, node, degree::INTEGER AS degree, cum_cost::BIGINT AS cum_cost FROM cut")
def nested_prefix(spark, d):
    return _independent(spark, d, "g4", "uniform")[0].select("budget_rel", "run", "idx", "node", "degree", "cum_cost")


@query(f"WITH {draws_sql('g4', 'uniform', 'uniform')} SELECT budget_rel, run::INTEGER AS run, {R('max(cum_cost) / 100')} AS queries, count(DISTINCT node) AS unique_nodes, count(*) AS n_random_node, sum(fresh::INT)::BIGINT AS n_neighbors, sum((NOT fresh)::INT)::BIGINT AS cached_queries FROM cut GROUP BY ALL")
def cost_counters(spark, d):
    cut = _independent(spark, d, "g4", "uniform")[0]
    out = cut.groupBy("budget_rel", "run").agg((F.max("cum_cost") / 100).alias("queries"), F.countDistinct("node").alias("unique_nodes"), F.count("*").alias("n_random_node"))
    return rounded(out.withColumn("n_neighbors", F.col("unique_nodes")).withColumn("cached_queries", F.col("n_random_node") - F.col("unique_nodes")), "queries")


@query(f"WITH {draws_sql('g2', 'uniform', 'uniform')} SELECT budget_rel, name, 2 * count(*) AS visits FROM cut JOIN nodes ON id = node GROUP BY ALL")
def visits_uniform(spark, d):
    cut = _independent(spark, d, "g2", "uniform")[0]
    n = graph.nodes(raw(spark, d, "g2"))
    return cut.groupBy("budget_rel", "node").agg((2 * F.count("*")).alias("visits")).join(n.select(F.col("id").alias("node"), "name"), "node").select("budget_rel", "name", "visits")


def walk_sql(view: str, dead_end: str, cap: object, group: str, runs: int = 3) -> str:
    """A budgeted walk from the first node by recursion; rows run, idx, node, degree, cum_cost."""
    seen = "SELECT src, dst FROM arcs" + (" UNION SELECT dst, src FROM arcs" if view == "undirected" else "")
    lost = {"restart": "0", "history": f"list_append(trace, nxt)[1 + {draw_sql('key', 't')} % (len(trace) + 1)]"}[dead_end]
    price = "CASE WHEN list_contains(trace, nxt) THEN 2 ELSE 100 END"
    return f"""WITH RECURSIVE {nodes_sql('g4')}, v AS ({seen}), nb AS (SELECT id, count(dst) AS deg, list(dst ORDER BY dst) AS nbrs FROM nodes LEFT JOIN v ON src = id GROUP BY id),
go(run, key, t, node, deg, cum, nxt, trace) AS (
  SELECT r, '42|{group}|' || r, 0::BIGINT, -1::BIGINT, 0::BIGINT, 100::BIGINT, 0::BIGINT, []::BIGINT[] FROM range({runs}) a(r)
  UNION ALL SELECT run, key, t + 1, nxt, nb.deg, cum + {price}, CASE WHEN nb.deg > 0 THEN nbrs[1 + {draw_sql('key', 't')} % nb.deg] ELSE {lost} END, list_append(trace, nxt) FROM go JOIN nb ON nb.id = nxt WHERE cum + {price} <= {cap})
SELECT run::INTEGER AS run, t - 1 AS idx, node, deg::INTEGER AS degree, cum AS cum_cost FROM go WHERE t > 0"""


def backtrack_sql(cap: int, group: str, select: str) -> str:
    """Charges of a walk that backs up at dead ends, on directed g4; a row of ``go`` is a charge: a seed's draw (mode D), a sample's
    fetch (S) or a look back (L).  ``look`` is the neighbours of the node above without the child that the walk came from."""
    price = "CASE WHEN list_contains(trace, nxt) THEN 2 ELSE 100 END"
    pick = lambda nodes, at: f"{nodes}[1 + {draw_sql('key', at)} % len({nodes})]"
    # After a charge at nxt: "on" is where a step leads to; failing that the walk looks back to "up", or starts again.
    return f"""WITH RECURSIVE {nodes_sql('g4')}, nb AS (SELECT id, list(dst ORDER BY dst) FILTER (WHERE dst IS NOT NULL) AS nbrs FROM nodes LEFT JOIN arcs ON src = id GROUP BY id),
go(run, key, seq, mode, node, cost, cum, t, j, nxt, to_mode, child, path, trace, idx, deg) AS (
  SELECT r, '42|{group}|' || r, 0::BIGINT, 'D', 0::BIGINT, 100::BIGINT, 100::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 'S', -1::BIGINT, [0]::BIGINT[], []::BIGINT[], 0::BIGINT, 0::BIGINT FROM range(3) a(r)
  UNION ALL
  SELECT run, key, seq + 1, to_mode, spot, price, cum, CASE WHEN nxt_mode = 'S' THEN t + 1 ELSE t END, CASE WHEN nxt_mode = 'S' THEN 0 ELSE j END, CASE WHEN nxt_mode = 'S' THEN coalesce(on_, 0) ELSE path[-1] END, nxt_mode, child,
         CASE WHEN nxt_mode = 'S' THEN list_append(path, coalesce(on_, 0)) ELSE path END, trace, idx, deg
  FROM (SELECT *, CASE WHEN on_ IS NULL AND len(path) > 0 THEN 'L' ELSE 'S' END AS nxt_mode FROM (
    SELECT run, key, seq, to_mode, spot, price, cum, t, idx + (to_mode = 'S')::BIGINT AS idx, coalesce(len(nbrs), 0) AS deg, list_append(trace, spot) AS trace,
           CASE WHEN to_mode = 'S' AND len(nbrs) > 0 THEN {pick('nbrs', 't')} WHEN to_mode = 'L' AND len(look) > 0 THEN {pick('look', "t || '.' || j")} END AS on_,
           CASE WHEN to_mode = 'L' THEN j + 1 ELSE 0 END AS j,
           CASE WHEN to_mode = 'S' AND coalesce(len(nbrs), 0) = 0 OR to_mode = 'L' AND len(look) = 0 THEN path[-1] ELSE child END AS child,
           CASE WHEN to_mode = 'S' AND coalesce(len(nbrs), 0) = 0 OR to_mode = 'L' AND len(look) = 0 THEN path[:len(path) - 1] ELSE path END AS path
    FROM (SELECT go.* EXCLUDE (mode, node, cost, cum, nxt, deg), nxt AS spot, {price} AS price, cum + {price} AS cum, nbrs, list_filter(nbrs, lambda x: x <> child) AS look FROM go JOIN nb ON nb.id = nxt WHERE cum + {price} <= {cap}) a) b) c)
{select}"""


def captures_walk_sql(cap: int, group: str) -> str:
    """CTE tr(run, node, degree, walk) of two captures that share a budget, on undirected g4: the first ends at half of it."""
    price = "CASE WHEN list_contains(trace, nxt) THEN 2 ELSE 100 END"
    over = f"(w = 0 AND 2 * cum >= {cap})"
    return f"""{nodes_sql('g4')}, v AS (SELECT src, dst FROM arcs UNION SELECT dst, src FROM arcs), nb AS (SELECT id, count(dst) AS deg, list(dst ORDER BY dst) AS nbrs FROM nodes LEFT JOIN v ON src = id GROUP BY id),
go(run, key, t, w, node, deg, cum, nxt, trace) AS (
  SELECT r, '42|{group}|' || r, 0::BIGINT, 0, -1::BIGINT, 0::BIGINT, 100::BIGINT, 0::BIGINT, []::BIGINT[] FROM range(3) a(r)
  UNION ALL SELECT run, key, CASE WHEN {over} THEN t ELSE t + 1 END, CASE WHEN {over} THEN 1 ELSE w END, CASE WHEN {over} THEN -1 ELSE nxt END, nb.deg, cum + CASE WHEN {over} THEN 100 ELSE {price} END,
    CASE WHEN NOT {over} AND nb.deg > 0 THEN nbrs[1 + {draw_sql('key', 't')} % nb.deg] ELSE 0 END, CASE WHEN {over} THEN trace ELSE list_append(trace, nxt) END
  FROM go JOIN nb ON nb.id = nxt WHERE cum + CASE WHEN {over} THEN 100 ELSE {price} END <= {cap}),
tr AS (SELECT run, node, deg AS degree, w AS walk FROM go WHERE node >= 0)"""


def walk5_sql(samples: int) -> str:
    """CTE tr(run, node, degree) of end nodes of five free steps on undirected g4, which has no node without arcs."""
    steps = "".join(f", w{k} AS (SELECT run, key, i, nbrs[1 + {draw_sql('key', f"i || '.{k}'")} % deg] AS node FROM w{k - 1} JOIN nb ON id = node)" for k in range(1, 6))
    return f"""{nodes_sql('g4')}, v AS (SELECT src, dst FROM arcs UNION SELECT dst, src FROM arcs), nb AS (SELECT id, count(dst) AS deg, list(dst ORDER BY dst) AS nbrs FROM nodes JOIN v ON src = id GROUP BY id),
w0 AS (SELECT run, key, i, {draw_sql('key', "i || '.0'")} % (SELECT count(*) FROM nodes) AS node FROM (SELECT r AS run, '42|walk5|' || r AS key, i FROM range(3) a(r), range({samples}) b(i))){steps},
tr AS (SELECT run, node, deg AS degree FROM w5 JOIN nb ON id = node)"""


def _walk(spark, d, view: str, cap: int, group: str, **how) -> DataFrame:
    n, a = graph.build(raw(spark, d, "g4"))
    return draws.walks(n, stored(graph.view(a, view), "view"), [0], 3, cap, 42, group, **how)


@query(walk_sql("directed", "restart", 2000, "r"))
def walk_restart(spark, d):
    return _walk(spark, d, "directed", 2000, "r", dead_end="restart").select("run", "idx", "node", "degree", "cum_cost")


@query(walk_sql("directed", "history", 2000, "h"))
def walk_history(spark, d):
    return _walk(spark, d, "directed", 2000, "h", dead_end="history").select("run", "idx", "node", "degree", "cum_cost")


@query(walk_sql("undirected", "restart", 20000, "r"))
def walk_undirected(spark, d):
    return _walk(spark, d, "undirected", 20000, "r", dead_end="restart").select("run", "idx", "node", "degree", "cum_cost")


@query(backtrack_sql(5000, "b", "SELECT run::INTEGER AS run, idx - 1 AS idx, node, deg::INTEGER AS degree, cum AS cum_cost FROM go WHERE mode = 'S'"))
def walk_backtrack(spark, d):
    return _walk(spark, d, "directed", 5000, "b", dead_end="backtrack").select("run", "idx", "node", "degree", "cum_cost")


@query(backtrack_sql(5000, "b", "SELECT run::INTEGER AS run, seq, CASE WHEN mode = 'D' THEN 'draw' WHEN cost = 100 THEN 'fetch' ELSE 'cached' END AS kind, node, cost, cum AS cum_cost FROM go"))
def walk_charges(spark, d):
    return _walk(spark, d, "directed", 5000, "b", charges=True, dead_end="backtrack")


@query(f"""WITH RECURSIVE {captures_walk_sql(40000, 'c')}, c AS (SELECT run, walk, node, count(*) AS c FROM tr GROUP BY ALL), b AS (SELECT run, node, count(*) AS seen, max((walk = 0)::INT) AS a1, max((walk = 1)::INT) AS a2, sum(c) AS c, sum(c * (c - 1) // 2) AS inside FROM c GROUP BY ALL),
f AS (SELECT run, sum(a1)::BIGINT AS n1, sum(a2)::BIGINT AS n2, sum(a1 * a2)::BIGINT AS overlap, sum(seen - 1)::BIGINT AS recaptures, sum(c * (c - 1) // 2 - inside)::BIGINT AS cross_collisions FROM b GROUP BY run)
SELECT run::INTEGER AS run, n1, n2, overlap, recaptures, cross_collisions, {R('n1 * n2::DOUBLE / nullif(overlap, 0)')} AS lp FROM f""")
def capture_recapture(spark, d):
    c = estimate.captures(estimate.thinned(_walk(spark, d, "undirected", 40000, "c", n_walks=2), "by_walk"), ["run"])
    return rounded(c.select("run", "n1", "n2", "overlap", "recaptures", "cross_collisions", "lp"), "lp")


def _walk5(spark, d) -> DataFrame:
    n, a = graph.build(raw(spark, d, "g4"))
    return stored(draws.short_walks(n, stored(graph.view(a, "undirected"), "view"), 3, 20000), "walk5")


_WALK5 = f"""WITH {walk5_sql(200)}, c AS (SELECT run, node, count(*) AS c, sum(1.0 / degree) AS sw, sum(degree) AS si FROM tr GROUP BY ALL),
s AS (SELECT run::INTEGER AS run, sum(c)::BIGINT AS k, sum(c * (c - 1) // 2)::BIGINT AS n_col, sum(sw) AS sw, sum(si) AS si FROM c GROUP BY ALL)"""


@query(f"{_WALK5} SELECT run, k, n_col, {R('k * (k - 1) / 2 / nullif(n_col, 0)')} AS uis FROM s")
def walk5_uis(spark, d):
    return rounded(estimate.per_set(estimate.thinned(_walk5(spark, d)), ["run"]).select("run", "k", "n_col", "uis"), "uis")


@query(f"{_WALK5} SELECT run, k, n_col, {R('k * (k - 1) / 2 / nullif(n_col, 0) * (sw / k) * (si / k)')} AS katzir FROM s")
def walk5_wis(spark, d):
    return rounded(estimate.per_set(estimate.thinned(_walk5(spark, d)), ["run"], 0, True).select("run", "k", "n_col", "katzir"), "katzir")


# Experiments -----------------------------------------------------------------------------------------------------------


@query("SELECT n, max(b)::DOUBLE AS budget_rel, budget_abs FROM (SELECT n, b, greatest(round_even(b * n, 0), 2)::BIGINT AS budget_abs FROM (SELECT DISTINCT p_partkey AS n FROM part) x, (VALUES (0.005), (0.01), (0.02), (0.05), (0.1), (0.2)) v(b)) GROUP BY n, budget_abs")
def budget_ladder(spark, d):
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("n")).distinct()
    return experiment.ladder_frame(sizes, spark.createDataFrame([(b,) for b in experiment.BUDGETS], "budget_rel double")).select("n", "budget_rel", "budget_abs")


_EST_VALUES = ", ".join(f"('{e.name}', '{e.category}', '{e.walk_group}', {e.nested})" for e in estimators.build_all())


@query(f"SELECT walk_group, bool_and(nested) AS nested, count(*) AS n_estimators, string_agg(estimator, ',' ORDER BY estimator) AS members FROM (VALUES {_EST_VALUES}) v(estimator, category, walk_group, nested) GROUP BY walk_group")
def walk_groups(spark, d):
    return estimators.frame(spark).groupBy("walk_group").agg(F.bool_and("nested").alias("nested"), F.count("*").alias("n_estimators"), F.array_join(F.sort_array(F.collect_list("estimator")), ",").alias("members"))


@query(f"SELECT v.view, e.estimator, b.budget_rel::DOUBLE AS budget_rel, r::INTEGER AS run FROM (VALUES ('directed'), ('reverse'), ('undirected')) v(view), (VALUES {_EST_VALUES}) e(estimator, category, walk_group, nested), (VALUES (0.1), (0.2)) b(budget_rel), range(3) r(r) WHERE e.category = 'comparison'")
def task_plan(spark, d):
    one = lambda values, schema: spark.createDataFrame([(v,) for v in values], schema).coalesce(1)
    return one(graph.VIEWS, "view string").crossJoin(estimators.frame(spark).coalesce(1).where(F.col("category") == estimators.COMPARISON).select("estimator")).crossJoin(one((0.1, 0.2), "budget_rel double")).crossJoin(one(range(3), "run int"))


# Result rows for the analytics, made from orders: each group of status and priority is an estimator's condition.
FAKE = """SELECT 'g' AS graph, CASE o_orderstatus WHEN 'F' THEN 'directed' WHEN 'O' THEN 'reverse' ELSE 'undirected' END AS view, 'comparison' AS category, o_orderpriority AS estimator, CAST(o_custkey % 2 AS BIGINT) AS seed, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'n' || (o_custkey % 3) END AS start_node, 'w' AS walk_group,
CAST(0.1 AS DOUBLE) AS budget_rel, CAST(100 AS BIGINT) AS budget_abs, CAST(row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority, o_custkey % 2, o_custkey % 3 ORDER BY o_orderkey) AS INT) AS run, o_orderkey % 2 = 0 AS nested, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS estimate, CAST(100000 AS BIGINT) AS true_size, CAST(o_custkey % 100 AS DOUBLE) AS queries_used, CASE WHEN o_orderkey % 5 = 0 THEN 'no_path' ELSE 'budget' END AS stopped_by FROM orders"""


def fake(spark, d) -> DataFrame:
    return spark.sql(FAKE.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


_KEYS_SQL = "graph, seed, start_node, view, estimator, budget_rel, run"


@query(f"WITH r AS ({FAKE}), k AS (SELECT * FROM r WHERE run % 3 = 0) SELECT {_KEYS_SQL} FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.seed = r.seed AND k.start_node IS NOT DISTINCT FROM r.start_node AND k.view = r.view AND k.estimator = r.estimator AND k.run = r.run)")
def skip_known(spark, d):
    r = stored(fake(spark, d), "fake")
    return results.not_known(r, r.where("run % 3 = 0"), results.RUN_KEYS).select(*results.RUN_KEYS)


@query(f"WITH r AS ({FAKE}) SELECT {_KEYS_SQL}, estimate FROM r")
def append_idempotent(spark, d):
    r = stored(fake(spark, d), "fake")
    once = results.append(r.where("run % 2 = 0"), r.where("run % 4 <> 2"))
    return results.append(once, r).select(*results.RUN_KEYS, "estimate")


@query(f"WITH r AS ({FAKE}) SELECT {_KEYS_SQL}, CASE WHEN run % 5 = 0 THEN -1.0::DOUBLE ELSE estimate END AS estimate FROM r")
def replace_rows(spark, d):
    r = stored(fake(spark, d), "fake")
    return results.replace(r, r.where("run % 5 = 0").withColumn("estimate", F.lit(-1.0))).select(*results.RUN_KEYS, "estimate")


@query(f"WITH r AS ({FAKE}) SELECT {_KEYS_SQL}, nested, walk_group, CAST(NULL AS VARCHAR) AS code FROM r")
def read_backfill(spark, d):
    return results.backfilled(fake(spark, d)).select(*results.RUN_KEYS, "nested", "walk_group", "code")


@query(f"WITH r AS ({FAKE}) SELECT graph, view, category, estimator, budget_rel, seed, start_node, count(*) AS n_runs, min(estimate) AS min, {R('median(estimate)')} AS median, max(estimate) AS max, max(true_size) AS true_size, max(budget_abs) AS budget_abs, max(walk_group) AS walk_group, bool_or(nested) AS nested, min(queries_used) AS used_min, median(queries_used) AS used_median, max(queries_used) AS used_max FROM r GROUP BY ALL")
def summarize(spark, d):
    return rounded(results.summarise(fake(spark, d)), "median")


@query(f"""WITH r AS ({FAKE}), a AS (SELECT graph, category, estimator, budget_rel, seed, start_node, view, median(estimate / true_size) AS m, min(estimate / true_size) AS lo, max(estimate / true_size) AS hi, max(true_size) AS true_size FROM r GROUP BY ALL),
b AS (SELECT r.estimator, r.seed, r.start_node, r.view, median(r.estimate / nullif(x.estimate, 0)) AS q FROM r JOIN r x ON x.view = 'directed' AND x.estimator = r.estimator AND x.seed = r.seed AND x.start_node IS NOT DISTINCT FROM r.start_node AND x.run = r.run GROUP BY ALL)
SELECT a.graph, a.category, a.estimator, a.budget_rel, a.seed, a.start_node, a.view, {R('m')} AS median_rel, {R('lo')} AS min_rel, {R('hi')} AS max_rel, {R('hi - lo')} AS spread_rel, {R('q')} AS ratio_vs_directed, true_size FROM a LEFT JOIN b ON a.estimator = b.estimator AND a.seed = b.seed AND a.start_node IS NOT DISTINCT FROM b.start_node AND a.view = b.view""")
def compare_views(spark, d):
    return rounded(results.compare_views(stored(fake(spark, d), "fake")), "median_rel", "min_rel", "max_rel", "spread_rel", "ratio_vs_directed")


@query("WITH v AS (SELECT event_type AS estimator, user_id AS node, count(*) AS visits FROM events GROUP BY ALL) SELECT estimator, node, visits, CAST(rank AS INTEGER) AS rank, label FROM (SELECT *, row_number() OVER (PARTITION BY estimator ORDER BY visits DESC, node) AS rank, 'top' AS label FROM v UNION ALL SELECT *, row_number() OVER (PARTITION BY estimator ORDER BY visits, node), 'bottom' FROM v) WHERE rank <= 10")
def visit_summary(spark, d):
    return results.visit_summary(table(spark, d, "events").groupBy(F.col("event_type").alias("estimator"), F.col("user_id").alias("node")).agg(F.count("*").alias("visits")))


@query(f"WITH r AS ({FAKE}) SELECT DISTINCT seed, start_node FROM r")
def conditions(spark, d):
    return results.conditions(fake(spark, d))


@query(f"WITH r AS ({FAKE}) SELECT {_KEYS_SQL} FROM r WHERE view IN ('directed', 'reverse') AND regexp_matches(estimator, 'H') AND seed = 1 AND start_node IS NULL")
def row_filters(spark, d):
    return results.rows(fake(spark, d), pattern="H", views=["directed", "reverse"], seed=1, start_node=None).select(*results.RUN_KEYS)


@query(f"WITH r AS ({FAKE}) SELECT graph, seed, start_node, stopped_by, count(*) AS n_rows, count(DISTINCT estimator) AS n_estimators, count(DISTINCT run) AS n_runs, string_agg(DISTINCT view, ',' ORDER BY view) AS views FROM r GROUP BY ALL")
def manifest(spark, d):
    return results.manifest(fake(spark, d))


@query(f"WITH r AS ({FAKE}), s AS (SELECT graph, view, category, estimator, budget_rel, seed, start_node, min(estimate) AS lo, median(estimate) AS m, max(estimate) AS hi, max(true_size) AS t, min(queries_used) AS u FROM r GROUP BY ALL) SELECT graph, view, category, estimator, budget_rel, seed, start_node, {R('lo / t')} AS low, {R('m / t')} AS middle, {R('hi / t')} AS high, '10%' || chr(10) || '100' || CASE WHEN u < 98 THEN chr(10) || u::BIGINT || ' used' ELSE '' END AS tick FROM s")
def range_points(spark, d):
    return rounded(results.range_points(fake(spark, d)), "low", "middle", "high")


# Diagnosis -------------------------------------------------------------------------------------------------------------

_POINTS = [1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000]


@query(f"WITH {trace_sql('t1')}, f AS (SELECT node, min(idx) AS at FROM tr GROUP BY node) SELECT p::BIGINT AS steps, (SELECT count(*) FROM f WHERE f.at < p) AS distinct FROM (VALUES {', '.join(f'({p})' for p in _POINTS)}) v(p)".replace("AS distinct", 'AS "distinct"'))
def coverage(spark, d):
    return diagnose.coverage(trace(spark, d, "t1"), _POINTS)


@query(f"WITH {per_set_sql('t2', w='1.0 / degree')} SELECT k::BIGINT AS k, n_col::BIGINT AS n_col, {R('uis')} AS uis, {R('mean_w * mean_inv')} AS lift, {R('katzir')} AS katzir FROM s")
def lift(spark, d):
    return rounded(diagnose.lift(trace(spark, d, "t2")), "uis", "lift", "katzir")


_VISITS = "SELECT l_partkey AS node, count(*) AS visits, count(DISTINCT l_suppkey) AS deg FROM lineitem GROUP BY 1"


def _visits(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("visits"), F.countDistinct("l_suppkey").alias("deg"))


@query(f"WITH v AS ({_VISITS}), r AS (SELECT rank() OVER (ORDER BY visits) + (count(*) OVER (PARTITION BY visits) - 1) / 2.0 AS a, rank() OVER (ORDER BY deg) + (count(*) OVER (PARTITION BY deg) - 1) / 2.0 AS b FROM v) SELECT {R('corr(a, b)')} AS rho FROM r")
def spearman(spark, d):
    return rounded(diagnose.spearman(stored(_visits(spark, d), "visits"), "visits", "deg"), "rho")


_EDGES = [1.0, 5.0, 10.0, 20.0, 25.0, 30.0, 35.0, 40.0, 80.0]


@query(f"WITH v AS ({_VISITS}) SELECT bin::INTEGER AS bin, count(*) AS n, median(deg::DOUBLE) AS x, median(visits::DOUBLE) AS y FROM (SELECT *, least(greatest({' + '.join(f'({e} <= deg)::INT' for e in _EDGES)}, 1), {len(_EDGES) - 1}) AS bin FROM v) GROUP BY bin HAVING count(*) >= 5")
def binned_median(spark, d):
    return diagnose.binned_medians(_visits(spark, d).select(F.col("deg").cast("double").alias("x"), F.col("visits").cast("double").alias("y")), _EDGES)


@query(f"WITH v AS ({_VISITS}) SELECT node, visits, {R('visits / (SELECT sum(visits) FROM v)')} AS share, p_name AS name, deg FROM v JOIN part ON p_partkey = node ORDER BY visits DESC, node LIMIT 10")
def top_entities(spark, d):
    v = stored(_visits(spark, d), "visits")
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return rounded(diagnose.top_nodes(v.select("node", "visits"), names, v.select(F.col("node").alias("id"), "deg")), "share")


_DIAG_CAP = "(SELECT 100 * greatest(round_even(0.02 * count(*), 0), 2)::BIGINT FROM nodes)"


@query(f"""WITH RECURSIVE w AS ({walk_sql("directed", "history", _DIAG_CAP, "diag|history", 1)}), {nodes_sql('g4')}, c AS (SELECT node, count(*) AS c FROM (SELECT node FROM w WHERE run = 0 UNION ALL SELECT 0) GROUP BY node),
o AS (SELECT node, c, (SELECT count(*) FROM arcs WHERE src = node) AS deg FROM c), k AS (SELECT count(*) AS k FROM w WHERE run = 0),
f AS (SELECT count(*) AS distinct_nodes, sum(c * (c - 1) / 2) AS n_col, sum(c / greatest(deg, 1)::DOUBLE) / any_value(k) * (sum(c * greatest(deg, 1)::DOUBLE) / any_value(k)) AS lift, any_value(k) AS k FROM o, k)
SELECT k AS steps, distinct_nodes, {R('lift')} AS lift, {R('k * (k - 1) / 2 / nullif(n_col, 0)')} AS uis, {R('k * (k - 1) / 2 / nullif(n_col, 0) * lift')} AS katzir FROM f""")
def diagnose_walk(spark, d):
    facts = diagnosis.diagnose(*graph.build(raw(spark, d, "g4")), "directed", "history", 0.02, start="c0").facts
    return rounded(facts.select(F.col("steps").cast("long").alias("steps"), "distinct_nodes", "lift", "uis", "katzir"), "lift", "uis", "katzir")


@query()
def run_experiment(spark, d):
    chosen = ["uniform-collision", "wis-katzir__indep", "rw-plain__restart__shifted", "capture-recapture__restart", "uis__walk5"]
    return experiment.run(raw(spark, d, "g2"), "g2", chosen, ("undirected",), (0.1, 0.2), 3)[0]
