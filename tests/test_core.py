"""Hand-checked fixtures, properties, and DuckDB comparisons at the smallest scale."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from nodecensus import cli
from nodecensus.functions.rng import draw_python, draws_python
from nodecensus.operators import diagnose, draws, estimate, graph, results
from nodecensus.plans import diagnosis, estimators, experiment, figures, provenance, registry
from nodecensus.sources import catalogue, files, scratch

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
DEGREE = {1: 2, 2: 4, 3: 1, 4: 5, 5: 1}


def sets(spark, *traces):
    rows = [(i, s, i, n, DEGREE[n]) for s, t in enumerate(traces) for i, n in enumerate(t)]
    return spark.createDataFrame(rows, "idx long, subset int, pos long, node long, degree int")


F1 = [1, 2, 1, 3, 2, 1, 4, 2]


@pytest.mark.parametrize(("margin", "near", "pairs", "value"), [(0, 0, 28, 28 / 6), (1, 0, 21, 3.5), (2, 1, 15, 3.0), (3, 4, 10, 5.0), (7, None, 0, None)])
def test_collisions(spark, margin, near, pairs, value):
    r = estimate.per_set(sets(spark, F1), [], margin).first()
    assert r["pairs"] == pairs
    assert r["uis"] == (pytest.approx(value) if value else None)
    if near is not None:
        assert r["n_col"] == 6 - near


def test_katzir(spark):
    r = estimate.per_set(sets(spark, F1), [], 0, True).first()
    assert r["mean_w"] * r["mean_inv"] == pytest.approx(1.29375)
    assert r["katzir"] == pytest.approx(6.0375)


def test_no_estimate(spark):
    assert estimate.per_set(sets(spark, [1]), []).first()["uis"] is None
    assert estimate.per_set(sets(spark, [1, 2, 3]), []).first()["uis"] is None


def test_captures(spark):
    a, b, c = [1, 2, 1, 3], [2, 1, 4, 2], [1, 5, 2]
    two, three = estimate.captures(sets(spark, a, b), []).first(), estimate.captures(sets(spark, a, b, c), []).first()
    assert (two["lp"], two["schnabel"], two["cross"], two["cross_collisions"]) == (4.5, 4.5, 4.0, 4)
    assert two["chapman"] == pytest.approx(16 / 3 - 1)
    assert two["cross_wis"] == pytest.approx(5.175)
    assert three["schnabel"] == 5.25
    empty = estimate.captures(sets(spark, a), []).first()
    assert (empty["lp"], empty["chapman"], empty["cross"]) == (None, 3.0, None)


def test_graph(spark):
    adjacency = spark.createDataFrame([(0, "a", ["b", "b", "a", "c"]), (1, "b", ["c"]), (2, "c", []), (3, "d", ["d"]), (4, "e", ["z"])], "pos long, key string, nbrs array<string>")
    n, a = graph.build(graph.raw_edges(adjacency))
    assert [r["name"] for r in n.orderBy("id").collect()] == ["a", "b", "c", "d", "e", "z"]
    pairs = lambda v: sorted((r["src"], r["dst"]) for r in graph.view(a, v).collect())
    assert pairs("directed") == [(0, 1), (0, 2), (1, 2), (4, 5)]
    assert len(pairs("undirected")) == 8
    assert sorted(r["name"] for r in graph.dead_ends(n, a).collect()) == ["c", "d", "z"]
    assert graph.reachable(a, n.where("name = 'a'")).count() == 3
    with pytest.raises(ValueError, match="no view"):
        graph.view(a, "sideways")
    with pytest.raises(ValueError, match="nobody"):
        graph.check_seeds(graph.resolve_seeds(n, spark.createDataFrame([(0, "nobody")], "ord int, name string")))


@pytest.mark.parametrize("dead_end", draws.DEAD_ENDS)
def test_prefix(dead_end):
    near = {u: [v for v in range(40) if (u * 7 + v * 3) % 11 == 0 and u != v and u % 4] for u in range(40)}
    import numpy as np

    g = {u: np.array(v, np.int64) for u, v in near.items()}
    long = draws.walk(g, [1], "k", 3000, dead_end)[0]
    for cap in (100, 150, 700, 1999, 2999):
        short = draws.walk(g, [1], "k", cap, dead_end)[0]
        assert short == [s for s in long if s[5] <= cap]


def test_stored_arcs(spark):
    """Walks over many small files are those over lists, a node with more arcs than a file included."""
    import numpy as np

    near = {u: [v for v in range(400) if u != v and (u == 7 or (u * 7 + v * 3) % 101 == 0) and u % 5] for u in range(400)}
    a = spark.createDataFrame([(u, v) for u, x in near.items() for v in x], "src long, dst long")
    arcs = draws.store_arcs(a, 50)
    arcs.held = 2
    assert len(arcs.files) > 20
    assert all([x[i] for i in range(len(x))] == near[u] for u in near for x in [arcs[u]])
    g = {u: np.array(v, np.int64) for u, v in near.items()}
    for how in draws.DEAD_ENDS:
        assert draws.walk(arcs, [], "k", 4000, how, size=400) == draws.walk(g, [], "k", 4000, how, size=400)
    log = draws.walk_log(spark.range(400), a, [1], 2, 3000, dead_end="backtrack")
    assert draws.trace_of(log).count() < log.count() and log.where("kind = 'draw'").count() == 2
    assert [tuple(r) for r in draws.trace_of(log).where("run = 1").orderBy("idx").drop("run").collect()] == draws.walk(g, [1], "42|walk|1", 3000, "backtrack")[0]


def test_walks_in_lots(spark, monkeypatch):
    """Walks handed on lot by lot, and neighbours dropped and read again, are those made at once."""
    near = {u: [v for v in range(400) if u != v and (u * 7 + v * 3) % 101 == 0 and u % 5] for u in range(400)}
    a = spark.createDataFrame([(u, v) for u, x in near.items() for v in x], "src long, dst long")
    want = {how: draws.walk(near, [1], "42|walk|0", 4000, how, n_walks=2) for how in draws.DEAD_ENDS}
    arcs = draws.store_arcs(a, 50)
    monkeypatch.setattr(draws, "LOT", 7)
    monkeypatch.setattr(draws, "NEAR_ARCS", 60)
    for how, (samples, charges) in want.items():
        assert draws.walk(arcs, [1], "42|walk|0", 4000, how, n_walks=2) == (samples, charges) and arcs.near_arcs <= 60
        lots = list(draws.walk_lots(near, [1], "42|walk|0", 4000, how, n_walks=2))
        assert len(lots) > 5 and sum(len(x[0]) for x in lots) == len(charges)
        log = draws.walk_log(spark.range(400), a, [1], 1, 4000, arcs=arcs, dead_end=how, n_walks=2)
        assert [tuple(r)[1:] for r in draws.charges_of(log).orderBy("seq").collect()] == charges
        assert [tuple(r)[1:] for r in draws.trace_of(log).orderBy("idx").collect()] == samples


def test_arcs_are_stored_once(spark, monkeypatch):
    """All walks over a view read the same files."""
    views, store = [], draws.store_arcs
    monkeypatch.setattr(draws, "store_arcs", lambda a, *more: views.append(a) or store(a, *more))
    edges = spark.createDataFrame([(f"a{k}", f"a{(k * 7 + j) % 30}") for k in range(30) for j in range(1, 4)], "s string, d string")
    rows, _ = experiment.run(edges, "g", ["rw-plain__restart__none", "capture-recapture__restart"], ("undirected",), (0.3, 0.6), 1)
    assert len(views) == 1 and rows.count() == 4


def test_draws_read_stored_arcs(spark):
    """Draws by degree and short walks read the arcs that walks read, and get what sorted lists give; repeated arcs go in the sort."""
    near = {u: sorted({(u * 7 + j * j) % 40 for j in range(1, 6)} - {u}) for u in range(40)}
    pairs = [(u, v) for u, x in near.items() for v in x]
    twice = spark.createDataFrame(pairs + pairs[::2], "src long, dst long")
    arcs = draws.store_arcs(twice, 30, True)
    assert arcs.size == len(pairs) and len(arcs.files) > 4 and all(list(arcs[u]) == near[u] for u in near)
    lost = twice.where(F.raise_error(F.lit("read")).isNull())
    log = draws.by_degree_log(lost, 2, 3000, arcs=arcs)
    got = [(r["run"], r["seq"] // 2, r["node"]) for r in log.where("kind = 'draw'").orderBy("run", "seq").collect()]
    assert got == [(r, i, pairs[draw_python(f"42|by_degree|{r}", i) % len(pairs)][0]) for r, i, _ in got] and len(got) > 30
    for r in draws.short_walks(spark.range(40), lost, 2, 2000, 3, arcs=arcs).collect():
        u = draw_python(key := f"42|walk5|{r['run']}", f"{r['idx']}.0") % 40
        for k in (1, 2, 3):
            u = near[u][draw_python(key, f"{r['idx']}.{k}") % len(near[u])]
        assert (r["node"], r["degree"]) == (u, len(near[u]))


def test_self_loops():
    g = {0: [0, 1], 1: [0, 1], 2: [2]}
    for allowed in (False, True):
        path = [s[1] for s in draws.walk(g, [0], "k", 2000, allow_self_loops=allowed)[0]]
        assert any(a == b for a, b in zip(path, path[1:], strict=False)) == allowed


def test_priced_over_blocks(spark, monkeypatch):
    """Running costs over several blocks of draws, against a loop."""
    monkeypatch.setattr(draws, "BLOCK", 8)
    n, a = spark.range(9), spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    log = draws.uniform_log(n, a, 2, 5050).orderBy("run", "seq").collect()
    for run in range(2):
        cum, seen, want, i = 0, set(), [], 0
        while cum + 100 <= 5050:
            u = draw_python(f"42|uniform|{run}", i) % 9
            cum += 100
            want.append(("draw", u, cum))
            price = 2 if u in seen else 100
            if cum + price > 5050:
                break
            cum += price
            want.append(("cached" if u in seen else "fetch", u, cum))
            seen.add(u)
            i += 1
        assert [(r["kind"], r["node"], r["cum_cost"]) for r in log if r["run"] == run] == want


def test_prefix_of_many_budgets(spark):
    trace = spark.createDataFrame([(0, 100)], "node long, cum_cost long")
    ladder = spark.range(1500).select((F.col("id") / 1500).alias("budget_rel"), (F.col("id") + 1).alias("budget_abs"), ((F.col("id") + 1) * 100).alias("cap"))
    assert estimate.prefix(trace, ladder).count() == 1500


def test_ladder():
    assert experiment.ladder(210, (0.1, 0.005, 0.01)) == [(0.01, 2), (0.1, 21)]
    assert experiment.ladder(50, (0.05, 0.07)) == [(0.05, 2), (0.07, 4)]  # 2.5 rounds to even, 3.5 too


def test_estimators():
    assert len(estimators.names()) == 39
    assert len({estimators.build(x).walk_group for x in estimators.names()}) == 12
    assert estimators.build("wis-katzir__rw-restart__margin50").margin == 50
    assert [e.name for e in estimators.build_all(["rw-plain__restart__margin3"], "realizable")] == ["rw-plain__restart__margin3"]
    with pytest.raises(ValueError, match="no estimator"):
        estimators.build("guess")


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("g", 1, "v", "e", 0.1, 0, 5.0), ("h", 1, "v", "e", 0.1, 0, 6.0)], "graph string, seed long, view string, estimator string, budget_rel double, run int, estimate double")
    path = str(tmp_path / "r")
    assert results.load(spark, path).count() == 0
    results.save(rows, path)
    results.save(rows.where("graph = 'g'").withColumn("estimate", rows["estimate"] + 1), path)
    assert {(r["graph"], r["estimate"]) for r in results.load(spark, path).collect()} == {("g", 6.0), ("h", 6.0)}
    with pytest.raises(FileNotFoundError):
        results.load(spark, path, "nowhere")


def test_experiment(spark):
    r = registry.queries()["run_experiment"](spark, SF).collect()
    assert len(r) == 5 * 2 * 3
    of = lambda name: sorted(x["estimate"] / x["true_size"] for x in r if x["estimate"] and x["estimator"] == name and x["budget_rel"] == 0.2)
    assert 0.2 < of("uniform-collision")[0] < 5
    # Parts and suppliers alternate, and nearly all nodes are parts: five steps end at one of the 10 suppliers of 210 nodes.
    assert all(0.02 < x < 0.12 for x in of("uis__walk5"))


def test_short_walks_with_dead_ends(spark):
    """Walks back up from dead ends: budgets are filled, and the last steps are uniform choices."""
    n = spark.range(60)  # most starts have no path
    a = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (1, 3), (4, 2)], "src long, dst long")
    got = draws.short_walks(n, a, 2, 40_000).collect()
    assert sorted((r["run"], r["idx"]) for r in got) == [(r, i) for r in range(2) for i in range(400)]
    assert all(140 < sum(r["node"] == u for r in got) < 260 for u in range(4))
    # From 0, paths of two steps end at 3 or, by 1, at 0 again; 2 is no way to go.
    two = draws.short_walks(spark.range(2), a.where("src < 2"), 1, 40_000, 2).collect()
    assert len(two) == 400 and all(60 < sum(r["node"] == u for r in two) < 140 for u in range(4))
    assert draws.short_walks(spark.range(2), spark.createDataFrame([(0, 1)], "src long, dst long"), 2, 1000).count() == 0
    # A path from one start in 20,000: runs give up.
    assert draws.short_walks(spark.range(20_000), spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long"), 2, 100_000).count() < 100


def test_no_path(spark):
    """A directed graph without paths of five steps gives rows without estimates; the view turned round too."""
    edges = spark.createDataFrame([(f"p{i}", f"s{i % 3}") for i in range(20)], "s string, d string")
    r = experiment.run(edges, "g", ["uis__walk5", "wis-katzir__walk5"], ("directed", "reverse", "undirected"), (0.1, 0.5), 3)[0].collect()
    assert len(r) == 2 * 3 * 2 * 3
    assert all((x["estimate"], x["stopped_by"], x["queries_used"], x["extra_n_samples"]) == (None, "no_path", 0.0, 0) for x in r if x["view"] != "undirected")
    assert all((x["stopped_by"], x["queries_used"]) == ("budget", x["budget_abs"]) for x in r if x["view"] == "undirected")


def test_all_estimators_and_views(spark):
    """Full rows of all estimators in all views, what is known is skipped, and nothing known needs no graph."""
    edges = spark.createDataFrame([(f"n{i}", f"n{(i * 7 + k * k) % 60}") for i in range(60) for k in range(1, 6)] + [("n1", "end")], "s string, d string")
    said = []
    rows, visits = experiment.run(edges, "g", None, experiment.graph.VIEWS, (0.5, 1.0), 2, seeds=["n3", "N5"], progress=lambda *x: said.append(x))
    got = rows.collect()
    assert len(got) == 39 * 3 * 2 * 2 and len(said) > 30 and said[-1][0] == said[-1][1]
    assert all(r["stopped_by"] == "budget" and r["queries_used"] <= r["budget_abs"] and r["start_node"] == "n3" for r in got)
    for r in got:
        if r["walk_group"] == "uniform":
            assert r["n_random_node"] - (r["n_neighbors"] + r["cached_queries"]) in (0, 1)
            assert abs(r["n_random_node"] + r["n_neighbors"] + r["cached_queries"] * 0.02 - r["queries_used"]) < 1e-9
    assert {(r["estimator"], r["budget_rel"]) for r in got if r["seconds"] and r["walk_group"] == "uniform"} == {("uniform-collision", 1.0)}
    counts = {(r["view"], r["estimator"], r["budget_rel"]): r["n"] for r in visits.groupBy("view", "estimator", "budget_rel").agg(F.sum("visits").alias("n")).collect()}
    paid = {}
    for r in got:
        paid[r["view"], r["estimator"], r["budget_rel"]] = paid.get((r["view"], r["estimator"], r["budget_rel"]), 0) + r["n_random_node"] + r["n_neighbors"] + r["cached_queries"]
    assert counts.items() <= paid.items() and ("directed", "uniform-collision", 0.5) not in counts and ("directed", "capture-recapture__restart", 0.5) in counts
    known = spark.createDataFrame([tuple(r) for r in got], results.ESTIMATES)
    lost = spark.createDataFrame([], "s string, d string").withColumn("d", F.raise_error(F.lit("read")))
    assert experiment.run(lost, "g", None, experiment.graph.VIEWS, (0.5, 1.0), 2, seeds=["n3"], known=known)[0].count() == 0
    more = experiment.run(edges, "g", ["uniform-collision", "uniform-collision__weighted"], ("directed",), (0.5, 1.0), 3, seeds=["n3"], known=known.where("estimator <> 'uniform-collision'"))[0].collect()
    assert sorted((r["estimator"], r["run"]) for r in more if r["budget_rel"] == 1.0) == [("uniform-collision", 0), ("uniform-collision", 1), ("uniform-collision", 2), ("uniform-collision__weighted", 2)]
    with pytest.raises(ValueError, match="61 nodes, this one has 2"):
        experiment.run(spark.createDataFrame([("a", "b")], "s string, d string"), "g", None, ("directed",), (0.5,), 3, seeds=["n3"], known=known)


def test_starts():
    assert experiment.starts_of(["a", "B"], None) == ["a"] and experiment.starts_of(None, None) == [None]
    assert experiment.starts_of(["a", "B"], "ALL") == ["a", "B"] and experiment.starts_of(["a", "B"], "b") == ["B"] and experiment.starts_of(None, "x") == ["x"]
    with pytest.raises(ValueError, match="no seed"):
        experiment.starts_of(["a"], "c")


def test_groups_and_formulas(spark):
    two = [estimators.build("uniform-collision"), estimators.build("uis__walk5")]
    with pytest.raises(ValueError, match="same walk"):
        experiment.estimate_group(spark.createDataFrame([], draws.LOG), two, [(0.1, 2)], 1)
    with pytest.raises(ValueError, match="nested"):
        experiment.estimate_group(spark.createDataFrame([], draws.LOG), [estimators.build("capture-recapture__restart")], [(0.1, 2), (0.2, 4)], 1)
    estimators.register_formula("twice-uis", lambda: 2 * F.col("uis"))
    e = estimators.register(estimators.Estimator("own", "comparison", "uniform", formula="twice-uis"))
    try:
        log = draws.uniform_log(spark.range(9), spark.createDataFrame([(0, 1)], "src long, dst long"), 1, 4000)
        a, b = (experiment.estimate_group(log, [x], [(1.0, 40)], 1)[0].first() for x in (two[0], e))
        assert b["estimate"] == 2 * a["estimate"]
        with pytest.raises(ValueError, match="already"):
            estimators.register_formula("uis", lambda: F.col("uis"))
    finally:
        del estimators._registry["own"], estimators.FORMULAS["twice-uis"]


EDGES = [(f"n{i}", f"n{(i * 7 + k * k) % 60}") for i in range(60) for k in range(1, 6)]


def test_catalogue(spark, tmp_path):
    import pickle

    store = catalogue.Catalogue(spark, str(tmp_path / "graphs"), {"small": "one"})
    assert store.available() == []
    adjacency = spark.createDataFrame([(0, "a", ["b", "c"]), (1, "b", ["z"]), (2, "c", [])], catalogue.ADJACENCY)
    store.save(adjacency, "one")
    with pytest.raises(FileExistsError):
        store.save(adjacency, "one")
    store.save(adjacency, "one", force=True)
    (tmp_path / "g.pkl").write_bytes(pickle.dumps({"x": ["y", 3], "y": []}))
    catalogue.convert_pickle(spark, str(tmp_path / "g.pkl"), store, "two", rows=1)
    assert store.available() == ["one", "two"]
    assert sorted(map(tuple, store.adjacency("two").collect())) == [(0, "x", ["y", "3"]), (1, "y", [])]
    (tmp_path / "bad.pkl").write_bytes(pickle.dumps(print))
    with pytest.raises(pickle.UnpicklingError):
        catalogue.convert_pickle(spark, str(tmp_path / "bad.pkl"), store, "three")
    n, a = store.load("small")
    assert (n.count(), a.count()) == (4, 3) and store.load("one")[0] is n
    assert store.load("two")[0].count() == 3 and store.kept[0] == "two"
    with pytest.raises(ValueError, match="no graph"):
        store.load("three")
    types = spark.createDataFrame([("a", "instance"), ("b", "instance"), ("z", "literal"), ("c", None)], "name string, type string")
    store.save_instances("one", types, "inst")
    assert sorted(map(tuple, store.adjacency("inst").collect())) == [(0, "a", ["b"]), (1, "b", [])]
    assert {r["type"]: r["n"] for r in catalogue.type_counts(types).collect()} == {"instance": 2, "literal": 1, None: 1}
    seeds = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ord int, name string")
    assert [r["name"] for r in graph.restrict_seeds(seeds, ["c", "a"]).collect()] == ["a", "c"]
    with pytest.raises(ValueError, match="no seeds"):
        graph.restrict_seeds(seeds, ["q"])


def test_command_line(spark, tmp_path, capsys):
    """Run, run again (nothing to do), replace, archive, figures and diagnosis."""
    folder, out, figs = (str(tmp_path / x) for x in ("graphs", "results", "figures"))
    rows = {}
    for s, d in EDGES:
        rows.setdefault(s, []).append(d)
    catalogue.Catalogue(spark, folder).save(spark.createDataFrame([(k, s, d) for k, (s, d) in enumerate(rows.items())], catalogue.ADJACENCY), "g")
    call = lambda *x: cli.main(["--folder", folder, "--results", out, *x], spark)
    call("list")
    assert "graphs: g" in capsys.readouterr().out
    some = ["run", "--estimators", "uniform-collision", "wis-katzir__indep", "rw-plain__history__none", "--budgets", "0.5", "1", "--runs", "2", "--views", "undirected", "--seeds", "n1"]
    call(*some)
    assert "of the size" in capsys.readouterr().out
    assert provenance.count_rows(spark, f"{out}/estimates") == 3 * 2 * 2
    visits = provenance.count_rows(spark, f"{out}/visits")
    call(*some)
    assert "of the size" not in capsys.readouterr().out and provenance.count_rows(spark, f"{out}/visits") == visits > 0
    call(*some, "--replace")
    assert provenance.count_rows(spark, f"{out}/estimates") == 12 and provenance.count_rows(spark, f"{out}/visits") == visits
    text = (tmp_path / "results" / "README.md").read_text()
    assert "g, seed 42, start n1" in text and provenance.fingerprint() in text and "Outdated" not in text
    call("figures", "--graphs", "g", "--out", figs)
    call("figures", "--graphs", "g", "--out", figs, "--estimators", "uniform-collision", "rw-plain__history__none")
    assert sorted(p.name for p in (tmp_path / "figures").iterdir()) == ["g__seed42__n1__comparison", "g__seed42__n1__wis_indep__undirected"]
    call("diagnose", "--graph", "g", "--views", "directed", "undirected", "--budget", "0.5", "--start-node", "n1")
    assert "verdict: free" in capsys.readouterr().out
    call(*some[:2], "uniform-collision", *some[5:], "--deprecate", "new prices")
    (old,) = (tmp_path / "deprecated").iterdir()
    assert "new prices" in (old / "REASON.txt").read_text() and (old / "results" / "estimates").exists()
    assert provenance.count_rows(spark, f"{out}/estimates") == 4


def test_provenance(spark, tmp_path):
    assert len(provenance.fingerprint()) == 12 and provenance.archive(spark, str(tmp_path / "none")) is None
    old = spark.createDataFrame([("g", "directed", "e", 0.1, 0, 5.0)], "graph string, view string, estimator string, budget_rel double, run int, estimate double")
    assert "stopped_by" in provenance.missing_columns(old) and "Outdated" in provenance.readme(old)
    (tmp_path / "x.png").write_text("")
    (tmp_path / "x-2.png").write_text("")
    assert files.unique_path(spark, str(tmp_path / "x.png")) == str(tmp_path / "x-3.png")


def test_figures():
    assert len(figures.FIGURES) == 5 and len(set(figures.PALETTE)) == 8
    with pytest.raises(ValueError, match="8 colours"):
        figures.color(8)
    with pytest.raises(ValueError, match="two estimators"):
        figures.comparison(None, ["a"], [])
    with pytest.raises(ValueError, match="share a colour"):
        figures.comparison(None, ["a", "b"], [], {"a": "#fff", "b": "#fff"})


def test_diagnose(spark):
    """Facts of a diagnosis against the walk itself, in plain Python; a sink is found to be one."""
    n, a = graph.build(spark.createDataFrame([*EDGES, ("n1", "s1"), ("s1", "s2"), ("s2", "s1")], "s string, d string"))
    d = diagnosis.diagnose(n, a, "undirected", "restart", 2.0, 5, 7, "n1")
    ids = {r["name"]: r["id"] for r in n.collect()}
    near = {i: [] for i in ids.values()}
    for r in graph.view(a, "undirected").orderBy("src", "dst").collect():
        near[r["src"]].append(r["dst"])
    samples, paid = draws.walk(near, [ids["n1"]], "7|diag|restart|0", round(2.0 * len(ids)) * 100, "restart")
    counts = Counter(c[2] for c in paid)
    f, k = d.facts.first(), len(samples)
    n_col = sum(c * (c - 1) / 2 for c in counts.values())
    lift = sum(c / len(near[u]) for u, c in counts.items()) / k * sum(c * len(near[u]) for u, c in counts.items()) / k
    assert (f["steps"], f["distinct_nodes"], f["n_nodes"], f["reachable"], f["verdict"]) == (k, len(counts), len(ids), len(ids), "free")
    assert f["uis"] == pytest.approx(k * (k - 1) / 2 / n_col) and f["lift"] == pytest.approx(lift) and f["katzir"] == pytest.approx(f["uis"] * lift)
    assert [(r["node"], r["visits"]) for r in d.top.collect()] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:5]
    steps = [c[2] for c in paid[1:]]
    assert all(r["distinct"] == len(set(steps[: r["steps"]])) for r in d.coverage.collect() if r["steps"] <= len(steps))
    assert set(d.panels()) == {"sizes", "coverage", "degrees", "top"} and "most visited" in d.report()
    long = spark.createDataFrame([(f"x{i}", f"x{i + 1}") for i in range(500)] + [("x0", "q"), ("q", "r"), ("r", "q")], "s string, d string")
    stuck = diagnosis.diagnose(*graph.build(long), "directed", "history", 0.1, 3, 1, "q").facts.first()
    assert (stuck["reachable_end"], stuck["verdict"]) == (2, "stuck")


def test_coverage_behind_the_last_point(spark):
    """Nodes met for the first time behind the last checkpoint count in none."""
    trace = spark.range(40).selectExpr("id AS idx", "id % 25 AS node")
    assert list(map(tuple, diagnose.coverage(trace, [1, 5, 10]).orderBy("steps").collect())) == [(1, 1), (5, 5), (10, 10)]
    assert diagnose.coverage(trace.where("idx >= 10"), [1, 5]).agg(F.sum("distinct")).first()[0] == 0


def test_scratch(spark):
    df = scratch.stored(spark.range(3), "x")
    (path,) = {x.rpartition("/")[0] for x in df.inputFiles()}
    assert scratch.own_dir(spark) in path and files.exists(spark, path)
    name = scratch.new_table(spark, "t")
    spark.range(2).write.saveAsTable(name)
    other = spark.newSession()
    scratch.clear(other)
    assert not files.exists(spark, path) and not spark.catalog.tableExists(name)


def test_random():
    assert draw_python("42|x", 1) == 484041811072957956
    for key in ("42|x", "é|", "x" * 49, "x" * 60):
        for at, n in ((0, 1200), (99_998, 5)):
            assert draws_python(key, at, n) == [draw_python(key, k) for k in range(at, at + n)]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    said = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in said.description]
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    clean = lambda rows: sorted((tuple(None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 5) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert clean(tuple(r) for r in got.select(*columns).collect()) == clean(said.fetchall())
