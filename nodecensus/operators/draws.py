"""Traces: independent draws as declarative plans, and walks by a kernel over arcs in shared files.

Prices in hundredths of a query: DRAW for a draw, FETCH for a node's neighbours the first time, CACHED after that.
"""

from __future__ import annotations

import bisect
import os
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodecensus.functions.rng import BITS, draw, draw_python, running_lots
from nodecensus.sources.scratch import new_path, stored

DRAW, FETCH, CACHED = 100, 100, 2
DEAD_ENDS = ("restart", "backtrack", "history")
#: Arcs of a file that walks read from (16 bytes each).
FILE_ARCS = 1_000_000
#: Arcs of short lists of neighbours that a walk keeps at hand (8 bytes each), and the longest such list.
NEAR_ARCS, NEAR_LIST = 1 << 22, 1 << 16
#: Charges of a walk that are handed on together.
LOT = 1 << 18
#: Kinds of charges by number, and their prices.
KINDS, PRICES = ("draw", "fetch", "cached"), (DRAW, FETCH, CACHED)
#: Starts in a row without a path after which a run of short walks gives up.
RESTARTS = 1000
#: Draws of a run whose fresh fetches are counted together.
BLOCK = 1 << 16
#: What a run pays for, one row a charge; idx, degree, step and walk only where the charge makes a sample.
LOG = "run int, seq long, kind string, node long, cost long, cum_cost long, idx long, degree int, step long, walk int"
TRACE = "run int, idx long, node long, degree int, step long, walk int, cum_cost long"
#: A node's arcs in a file of sorted arcs: the file, the place of the first in it, and how many there are.
COUNTS = "part int, k int, attempt long, node long, at long, n long"
CHARGES = "run int, seq long, kind string, node long, cost long, cum_cost long"


def attempts(spark, runs: int, cap: int, least_price: int, key: str) -> DataFrame:
    """run, i, key for as many draws as a budget can pay for; a run's draws are dealt over many tasks."""
    most = -(-cap // least_price) + 1
    return spark.range(runs * most).select(F.floor(F.col("id") / most).cast("int").alias("run"), (F.col("id") % most).alias("i")).withColumn("key", F.concat(F.lit(f"{key}|"), F.col("run").cast("string")))


def _priced(drawn: DataFrame, cap: int) -> DataFrame:
    """Adds the running cost of draw and degree fetch up to each draw, and keeps the draws that the budget pays for.

    A node's first draw in a run is a fresh fetch.  Fresh ones are counted by blocks of draws and then within their block, so
    neither a run nor a node that is drawn again and again gathers in one task.
    """
    first = drawn.groupBy("run", "node").agg(F.min("i").alias("_i")).select(F.col("run").alias("_run"), "_i")
    marked = drawn.join(first, (F.col("run") == F.col("_run")) & (F.col("i") == F.col("_i")), "left").withColumn("fresh", F.col("_i").isNotNull().cast("long")).drop("_run", "_i").withColumn("block", F.floor(F.col("i") / BLOCK))
    sums = marked.groupBy("run", "block").agg(F.sum("fresh").alias("n"))
    blocks = sums.select(F.col("run").alias("_run"), F.col("block").alias("_block"), F.coalesce(F.sum("n").over(Window.partitionBy("run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum("fresh").over(Window.partitionBy("run", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("_within", within).join(blocks, (F.col("run") == F.col("_run")) & (F.col("block") == F.col("_block")))
    cum = (F.col("i") + 1) * (DRAW + CACHED) + (F.col("_before") + F.col("_within")) * (FETCH - CACHED)
    out = out.withColumn("cost", F.when(F.col("fresh") == 1, DRAW + FETCH).otherwise(DRAW + CACHED).cast("long")).withColumn("cum_cost", cum.cast("long"))
    return out.where(F.col("cum_cost") - F.col("cost") + DRAW <= cap).drop("fresh", "block", "_within", "_run", "_block", "_before")


def _sampled(priced: DataFrame, deg: DataFrame, cap: int) -> DataFrame:
    """LOG of priced draws: each is a draw and, if the budget goes that far, the fetch that makes it a sample."""
    fetch = F.col("cost") - DRAW
    events = F.array(
        F.struct(F.lit("draw").alias("kind"), F.lit(DRAW).cast("long").alias("cost"), (F.col("cum_cost") - fetch).alias("cum_cost"), F.lit(0).alias("part")),
        F.struct(F.when(fetch == FETCH, "fetch").otherwise("cached").alias("kind"), fetch.alias("cost"), F.col("cum_cost").alias("cum_cost"), F.lit(1).alias("part")),
    )
    rows = priced.join(deg, "node", "left").withColumn("e", F.explode(events)).where(F.col("e.cum_cost") <= cap)
    sample = lambda c: F.when(F.col("e.part") == 1, c)
    i = F.col("i").cast("long")
    return rows.select("run", (2 * i + F.col("e.part")).alias("seq"), "e.kind", "node", "e.cost", "e.cum_cost", sample(i).alias("idx"), sample(F.coalesce("degree", F.lit(0)).cast("int")).alias("degree"), sample(i).alias("step"), sample(F.lit(0)).alias("walk"))


def trace_of(log: DataFrame) -> DataFrame:
    """TRACE: the samples of a log."""
    return log.where(F.col("idx").isNotNull()).select("run", "idx", "node", "degree", "step", "walk", "cum_cost")


def charges_of(log: DataFrame) -> DataFrame:
    """CHARGES of a log: all that was paid for, samples or not."""
    return log.select("run", "seq", "kind", "node", "cost", "cum_cost")


def uniform_log(n: DataFrame, a: DataFrame, runs: int, cap: int, seed: int = 42, group: str = "uniform", arcs: StoredArcs | None = None) -> DataFrame:
    """LOG of uniform draws with replacement; a sample costs its draw and the fetch of its degree.  ``arcs`` are those of ``a``
    where they are stored already."""
    size = n.agg(F.count("*").alias("size"))
    tries = attempts(n.sparkSession, runs, cap, DRAW + CACHED, f"{seed}|{group}")
    drawn = tries.join(F.broadcast(size)).where(F.col("size") > 0).withColumn("node", draw(F.col("key"), F.col("i")) % F.col("size"))
    deg = degrees(n.sparkSession, arcs).drop("first") if arcs else a.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return _sampled(_priced(drawn, cap), deg, cap)


def by_degree_log(a: DataFrame, runs: int, cap: int, seed: int = 42, group: str = "by_degree", arcs: StoredArcs | None = None) -> DataFrame:
    """LOG of draws in proportion to degree: the source of a uniformly drawn arc.  ``arcs`` are those of ``a`` where they are stored
    already."""
    spark, arcs = a.sparkSession, arcs or store_arcs(a)
    tries = attempts(spark, runs if arcs.size else 0, cap, DRAW + CACHED, f"{seed}|{group}")
    drawn = tries.withColumn("arc", draw(F.col("key"), F.col("i")) % max(arcs.size, 1))
    got = stored(arc_ends(drawn, arcs, "src").select("run", "i", "key", "node"), "drawn")
    return _sampled(_priced(got, cap), degrees(spark, arcs).drop("first"), cap)


def uniform(n: DataFrame, a: DataFrame, runs: int, cap: int, seed: int = 42, group: str = "uniform") -> DataFrame:
    return trace_of(uniform_log(n, a, runs, cap, seed, group))


def by_degree(a: DataFrame, runs: int, cap: int, seed: int = 42, group: str = "by_degree") -> DataFrame:
    return trace_of(by_degree_log(a, runs, cap, seed, group))


def _depths(a: DataFrame, steps: int) -> DataFrame:
    """id, depth: how many steps (``steps`` at most) can be walked from each node that has arcs."""
    depth = stored(a.select(F.col("src").alias("id")).distinct().withColumn("depth", F.lit(1)), "depths")
    for k in range(2, steps + 1):
        longer = a.join(depth.where(F.col("depth") == k - 1).select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("_id")).distinct()
        depth = stored(depth.join(longer, F.col("id") == F.col("_id"), "left").select("id", F.when(F.col("_id").isNotNull(), k).otherwise(F.col("depth")).alias("depth")), "depths")
    return depth


def _starts(n: DataFrame, live: DataFrame, runs: int, need: int, key: str) -> DataFrame:
    """run, i, key, node: starts in ``live`` among uniform draws, as many as needed, unless RESTARTS in a row are not."""
    size, good = n.count(), live.count()
    # Enough for all budgets, but no more than rare starts need to give up; doubled below where that was too few.
    most = need if good == size else min(int(1.2 * need * size / good) + 100, need + 20 * RESTARTS) if good else 0
    in_run = Window.partitionBy("run").orderBy("i")
    while True:
        tries = attempts(n.sparkSession, runs, most * DRAW, DRAW, key).withColumn("node", draw(F.col("key"), F.concat(F.col("i"), F.lit(".0"))) % size)
        if good == size:
            return tries
        found = tries.join(live.select(F.col("id").alias("node")), "node").withColumn("failed", F.col("i") - F.lag("i", 1, -1).over(in_run) - 1)
        found = stored(found.withColumn("most", F.max("failed").over(in_run)).where(F.col("most") < RESTARTS).select("run", "i", "key", "node"), "starts")
        filled = found.groupBy("run").agg(F.count("*").alias("k"), F.max("i").alias("last")).agg(F.count("*").alias("runs"), F.count_if((F.col("k") < need) & (F.col("last") + RESTARTS >= most)).alias("open")).first()
        if not good or filled["open"] == 0 and (filled["runs"] == runs or most >= RESTARTS):
            return found
        most *= 2


def short_walks(n: DataFrame, a: DataFrame, runs: int, cap: int, steps: int = 5, seed: int = 42, group: str = "walk5", arcs: StoredArcs | None = None) -> DataFrame:
    """End nodes of free walks of ``steps`` steps from uniform starts, each paid as one draw: chained joins with degrees, whose picks
    are read from stored arcs (``arcs``, where those of ``a`` are stored already), or with the adjacency if there are dead ends.

    At a dead end a walk backs up one step and leaves the tried branch out, and where all branches of a start are tried, another
    start is drawn; a run ends early (no path) after RESTARTS such starts in a row.  As branches are tried at random until one
    goes on far enough, each step is a uniform choice among the neighbours from which the rest of the steps can be walked; those
    are known before (``_depths``), so that nothing has to be tried.
    """
    from nodecensus.operators.graph import adjacency

    spark, arcs = n.sparkSession, arcs or store_arcs(a)
    deg = stored(degrees(spark, arcs), "degrees")
    dead = targets(spark, arcs).join(deg.select(F.col("node").alias("id")), "id", "left_anti")
    depth = None if dead.isEmpty() else _depths(a, steps)
    live = deg.select(F.col("node").alias("id")) if depth is None else stored(depth.where(F.col("depth") >= steps).select("id"), "live")
    at = _starts(n, live, runs, cap // DRAW, f"{seed}|{group}")
    for k in range(1, steps + 1):
        pick = draw(F.col("key"), F.concat(F.col("i"), F.lit(f".{k}")))
        if depth is None:
            at = at.join(deg, "node").withColumn("arc", F.col("first") + pick % F.col("degree"))
            at = arc_ends(at.select("run", "i", "key", "arc"), arcs, "dst").select("run", "i", "key", "node")
        else:
            left = steps - k
            on = a if left == 0 else a.join(depth.where(F.col("depth") >= left).select(F.col("id").alias("dst")), "dst", "left_semi")
            lists = adjacency(n, on).where("deg > 0")
            at = at.join(lists.select(F.col("id").alias("node"), "deg", "nbrs"), "node").withColumn("node", F.element_at("nbrs", (pick % F.col("deg") + 1).cast("int"))).drop("deg", "nbrs")
    order = Window.partitionBy("run").orderBy("i")
    ends = at.withColumn("idx", F.row_number().over(order).cast("long") - 1).where((F.col("idx") + 1) * DRAW <= cap)
    return ends.join(deg.drop("first"), "node", "left").select("run", "idx", "node", F.coalesce("degree", F.lit(0)).cast("int").alias("degree"), F.col("idx").alias("step"), F.lit(0).alias("walk"), ((F.col("idx") + 1) * DRAW).alias("cum_cost"))


class StoredArcs:
    """Neighbours of nodes, read from files of sorted arcs in the shared folder; a worker holds a bounded number of files.

    ``files`` are (path, first source, last source, arcs) in order; a node with very many arcs may lie in several of them.
    ``counts`` is the folder with a node's arcs in each file.
    """

    def __init__(self, files: list[tuple[str, int, int, int]], counts: str, held: int = 32) -> None:
        self.files, self.counts, self.held = files, counts, held
        self.last = [x[2] for x in files]
        #: The place of each file's first arc among all, and how many arcs there are.
        *self.starts, self.size = [0, *accumulate(x[3] for x in files)]
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.near: dict[int, array] = {}
        self.near_arcs = 0

    def _part(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sources and targets of a file, both sorted by source, then target."""
        if k in self.open:
            self.open[k] = self.open.pop(k)  # the least recently used comes first
        else:
            while len(self.open) >= self.held:
                del self.open[next(iter(self.open))]
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(self.files[k][0])
            with system.open_input_stream(path, compression=None) as f:
                both = np.frombuffer(f.read(), np.int64)
            self.open[k] = both[: len(both) // 2], both[len(both) // 2 :]
        return self.open[k]

    def __getitem__(self, u: int) -> array | Near:
        got = self.near.get(u)
        if got is not None:
            return got
        spans, k = [], bisect.bisect_left(self.last, u)
        while k < len(self.files) and self.files[k][1] <= u:
            src, _ = self._part(k)
            a, b = (int(np.searchsorted(src, u, side)) for side in ("left", "right"))
            if b > a:
                spans.append((k, a, b))
            k += 1
        near = Near(self, spans)
        if len(near) > NEAR_LIST:
            return near
        own = array("q", b"".join(self._part(k)[1][a:b].tobytes() for k, a, b in spans))
        cost = len(own) + 16  # the list's own bytes too
        if self.near_arcs + cost > NEAR_ARCS:
            self.near.clear()
            self.near_arcs = 0
        self.near[u] = own
        self.near_arcs += cost
        return own


class Near:
    """The neighbours of a node in ascending order, without holding them."""

    def __init__(self, arcs: StoredArcs, spans: list[tuple[int, int, int]]) -> None:
        self.arcs, self.spans, self.size = arcs, spans, sum(b - a for _, a, b in spans)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> int:
        for k, a, b in self.spans:
            if i < b - a:
                return int(self.arcs._part(k)[1][a + i])
            i -= b - a
        raise IndexError(i)


def nth_other(near, i: int, but: int) -> int:
    """The i-th of sorted neighbours that aren't ``but``."""
    at = bisect.bisect_left(near, but)
    return int(near[i + (at < len(near) and near[at] == but and i >= at)])


def others(near, but: int) -> int:
    """How many of sorted neighbours aren't ``but``."""
    at = bisect.bisect_left(near, but)
    return len(near) - (at < len(near) and near[at] == but)


def store_arcs(a: DataFrame, file_arcs: int = FILE_ARCS, distinct: bool = False) -> StoredArcs:
    """Writes arcs, sorted over the cluster, as files that walks and draws read from; what the driver gets is one row a file.
    ``distinct`` drops repeated arcs, which the sort has put side by side."""
    spark = a.sparkSession
    folder, counts = new_path(spark, "arcs"), new_path(spark, "arc-counts")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{os.path.abspath(folder)}"

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        task, src, dst = TaskContext.get(), [], []

        def flush(k: int) -> pa.RecordBatch:
            system, base = fs.FileSystem.from_uri(folder)
            system.create_dir(base, recursive=True)
            s, d = np.concatenate(src), np.concatenate(dst)
            with system.open_output_stream(f"{base}/{arc_file(task.partitionId(), k, task.taskAttemptId())}", compression=None) as f:
                f.write(s.tobytes())
                f.write(d.tobytes())
            src.clear()
            dst.clear()
            node, at, n = np.unique(s, return_index=True, return_counts=True)
            same = [pa.array(np.full(len(node), x, t)) for x, t in ((task.partitionId(), np.int32), (k, np.int32), (task.taskAttemptId(), np.int64))]
            return pa.RecordBatch.from_arrays([*same, *(pa.array(x.astype(np.int64)) for x in (node, at, n))], ["part", "k", "attempt", "node", "at", "n"])

        made, last = 0, None
        for batch in batches:
            s, d = (batch.column(x).to_numpy() for x in (0, 1))
            if distinct and len(s):
                new = np.append(last != (s[0], d[0]), (s[1:] != s[:-1]) | (d[1:] != d[:-1]))
                last = s[-1], d[-1]
                s, d = s[new], d[new]
            for at in range(0, len(s), file_arcs):
                src.append(s[at : at + file_arcs])
                dst.append(d[at : at + file_arcs])
                if sum(map(len, src)) >= file_arcs:
                    yield flush(made)
                    made += 1
        if sum(map(len, src)):
            yield flush(made)

    a.select("src", "dst").orderBy("src", "dst").mapInArrow(write, COUNTS).write.parquet(counts)
    files = spark.read.schema(COUNTS).parquet(counts).groupBy("part", "k", "attempt").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.sum("n").alias("arcs")).orderBy("part", "k").collect()
    return StoredArcs([(f"{folder}/{arc_file(r['part'], r['k'], r['attempt'])}", r["first"], r["last"], r["arcs"]) for r in files], counts)


def arc_file(part: int, k: int, attempt: int) -> str:
    return f"part-{part:06d}-{k:06d}-{attempt}"


def degrees(spark: SparkSession, arcs: StoredArcs) -> DataFrame:
    """node, degree and first, the place of the node's first arc among all; only nodes with arcs."""
    counts = spark.read.schema(COUNTS).parquet(arcs.counts)
    starts = spark.createDataFrame([(x[0].rpartition("/")[2], at) for x, at in zip(arcs.files, arcs.starts, strict=True)], "file string, start long")
    file = F.format_string("part-%06d-%06d-%d", "part", "k", "attempt")
    return counts.join(F.broadcast(starts), file == F.col("file")).groupBy("node").agg(F.sum("n").alias("degree"), F.min(F.col("start") + F.col("at")).alias("first"))


def arc_ends(rows: DataFrame, arcs: StoredArcs, end: str) -> DataFrame:
    """Rows with ``node``, the src or dst of the arc at the place ``arc`` among all.  Rows are dealt by file, so that a task reads its
    files one after the other and arcs themselves don't move."""
    starts, side = np.array(arcs.starts, np.int64), ("src", "dst").index(end)

    def placed(batches):
        for b in batches:
            yield b.append_column("file", pa.array(np.searchsorted(starts, b.column("arc").to_numpy(), "right") - 1))

    def read(batches):
        graph = StoredArcs(arcs.files, arcs.counts, held=1)
        for b in batches:
            arc, file = (b.column(x).to_numpy() for x in ("arc", "file"))
            node = np.zeros(len(arc), np.int64)
            for k in np.unique(file).tolist():
                here = file == k
                node[here] = graph._part(k)[side][arc[here] - starts[k]]
            yield b.append_column("node", pa.array(node))

    schema = T.StructType([*rows.schema.fields, T.StructField("file", T.LongType())])
    dealt = rows.mapInArrow(placed, schema).repartition("file").sortWithinPartitions("file")
    return dealt.mapInArrow(read, T.StructType([*schema.fields, T.StructField("node", T.LongType())])).drop("file")


def targets(spark: SparkSession, arcs: StoredArcs) -> DataFrame:
    """id: all nodes that arcs lead to, each once a file."""

    def read(batches):
        graph = StoredArcs(arcs.files, arcs.counts, held=1)
        for b in batches:
            for k in b.column(0).to_pylist():
                found = pa.array(np.unique(graph._part(k)[1]))
                for at in range(0, len(found), 1 << 16):
                    yield pa.RecordBatch.from_arrays([found.slice(at, 1 << 16)], ["id"])

    return spark.range(len(arcs.files), numPartitions=max(1, len(arcs.files))).mapInArrow(read, "id long")


def walk_lots(graph, seeds: list[int], key: str, cap: int, dead_end: str = "restart", n_walks: int = 1, n_seeds: int = 1, restart_prob: float = 0.0, burn_in: int = 0, size: int = 0, allow_self_loops: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """What a budgeted random walk pays for, in lots of LOT charges: kind, node, cum_cost of each charge, whether it made a sample,
    and of the samples degree, step and walk.

    Draws are indexed by the step t over all walks: ``key|t`` for the neighbour, with suffixes for restarts, backtracking and
    history.  A charge that doesn't fit the budget ends everything.  Without seeds, walks start at uniform draws from ``size`` nodes.
    A step that hits the node itself is drawn again among the others, unless ``allow_self_loops`` (views have no loops, so this
    matters for graphs of one's own).
    """
    if dead_end not in DEAD_ENDS:
        raise ValueError(f"no dead-end strategy {dead_end!r}")
    if not seeds and not size:
        return
    lot = tuple(array(t) for t in "bqqbqqq")
    kinds, nodes, costs, made, degrees, steps, of_walk = lot
    cached: set[int] = set()
    # Only what a strategy looks back at is kept.
    path, own = array("q"), array("q")
    back_on, own_on = dead_end == "backtrack", dead_end == "history"
    lots, numbers, place = running_lots(key), [], 0
    # Lists of neighbours that are at hand.
    at_hand = graph.near if isinstance(graph, StoredArcs) else graph
    cum = t = 0

    def paid(kind: int, node: int) -> bool:
        nonlocal cum
        if cum + PRICES[kind] > cap:
            return False
        cum += PRICES[kind]
        kinds.append(kind)
        nodes.append(node)
        costs.append(cum)
        made.append(0)
        return True

    def fetched(u: int) -> bool:
        if u in cached:
            return paid(2, u)
        if not paid(1, u):
            return False
        cached.add(u)
        return True

    def strides(u: int, w: int, step: int, until: float) -> tuple[int, int]:
        """Steps from u on that meet no dead end and that the budget pays for in any case, with all they add to the lot; where to
        go on, and how many there were."""
        nonlocal cum, t, place
        room = int(min(cap, until) - cum) // FETCH
        if restart_prob or step < burn_in or room <= 0:
            return u, 0
        ahead = numbers[place : place + min(room, max(1, LOT - len(kinds)))]
        seen, out, fetch = [], [], []
        for number in ahead:
            near = at_hand.get(u)
            if near is None:
                near = graph[u]
            degree = len(near)
            if not degree:
                break
            nxt = near[number % degree]
            if nxt == u and not allow_self_loops:
                break
            if u in cached:
                fetch.append(2)
            else:
                cached.add(u)
                fetch.append(1)
            seen.append(u)
            out.append(degree)
            u = nxt
        if n := len(seen):
            paid_up = cum + np.cumsum(np.array(PRICES, np.int64)[fetch])
            kinds.extend(fetch)
            nodes.extend(seen)
            costs.frombytes(paid_up.tobytes())
            made.frombytes(b"\1" * n)
            degrees.extend(out)
            steps.extend(range(step, step + n))
            of_walk.extend([w] * n)
            if own_on:
                own.extend(seen)
            if back_on:
                path.extend(seen[1:])
                path.append(u)
            cum, t, place = int(paid_up[-1]), t + n, place + n
        return u, n

    def handed() -> tuple[np.ndarray, ...]:
        out = tuple(np.array(x, x.typecode) for x in lot)
        for x in lot:
            del x[:]
        return out

    def visits() -> Iterator[None]:
        nonlocal t, numbers, place
        for w in range(n_walks):
            start = None
            for k in range(n_seeds):
                number = draw_python(key, f"seed.{w}.{k}")
                s = seeds[number % len(seeds)] if seeds else number % size
                if not paid(0, s):
                    return
                start = s if start is None else start
            u, step = start, 0
            del path[:], own[:]
            path.append(u)
            until = cap if w == n_walks - 1 else cap * (w + 1) / n_walks
            while w == n_walks - 1 or cum < until:
                if place == len(numbers):
                    numbers, place = next(lots), 0
                u, taken = strides(u, w, step, until)
                if taken:
                    step += taken
                    if len(kinds) >= LOT:
                        yield
                    continue
                if not fetched(u):
                    return
                near = graph[u]
                degree = len(near)
                if step >= burn_in:
                    made[-1] = 1
                    degrees.append(degree)
                    steps.append(step)
                    of_walk.append(w)
                    if own_on:
                        own.append(u)
                step += 1
                number, place = numbers[place], place + 1
                if degree:
                    nxt = int(near[number % degree])
                    if nxt == u and not allow_self_loops and (rest := others(near, u)):
                        nxt = nth_other(near, draw_python(key, f"{t}.l") % rest, u)
                    if restart_prob and draw_python(key, f"{t}.r") < restart_prob * 2**BITS:
                        del path[:]
                        nxt = start
                elif dead_end == "restart":
                    nxt = start
                elif dead_end == "history":
                    nxt = own[number % len(own)] if own else start
                else:
                    nxt, child, j = None, path.pop() if path else u, 0
                    while path and nxt is None:
                        before = path[-1]
                        if not fetched(before):
                            return
                        back = graph[before]
                        if rest := others(back, child):
                            nxt = nth_other(back, draw_python(key, f"{t}.{j}") % rest, child)
                        else:
                            child = path.pop()
                        j += 1
                    if nxt is None:
                        nxt = start
                u = nxt
                if back_on:
                    path.append(u)
                t += 1
                if len(kinds) >= LOT:
                    yield

    for _ in visits():
        yield handed()
    if kinds:
        yield handed()


def walk(graph, seeds: list[int], key: str, cap: int, dead_end: str = "restart", **how) -> tuple[list[tuple], list[tuple]]:
    """Samples (idx, node, degree, step, walk, cum_cost) and charges (seq, kind, node, cost, cum_cost) of ``walk_lots``."""
    samples: list[tuple] = []
    charges: list[tuple] = []
    for kind, node, cum, made, *of in walk_lots(graph, seeds, key, cap, dead_end, **how):
        paid = list(zip(kind.tolist(), node.tolist(), cum.tolist(), strict=True))
        own = zip(*(x.tolist() for x in of), strict=True)
        for (k, u, c), is_sample in zip(paid, made.tolist(), strict=True):
            charges.append((len(charges), KINDS[k], u, PRICES[k], c))
            if is_sample:
                samples.append((len(samples), u, *next(own), c))
    return samples, charges


def walk_log(n: DataFrame, a: DataFrame, seeds: list[int], runs: int, cap: int, seed: int = 42, group: str = "walk", arcs: StoredArcs | None = None, **how) -> DataFrame:
    """LOG of ``runs`` walks, one task a run (a walk is sequential).  ``arcs`` are those of ``a`` where they are stored already;
    ``how``: see ``walk_lots``."""
    spark = n.sparkSession
    graph, size = arcs or store_arcs(a), n.count()

    def run(batches):
        for batch in batches:
            for r in batch.column(0).to_pylist():
                seq = idx = 0
                for kind, node, cum, made, degree, step, of_walk in walk_lots(graph, seeds, f"{seed}|{group}|{r}", cap, size=size, **how):
                    none = made == 0
                    # The place of each charge's sample among the samples of the lot.
                    at = np.cumsum(made, dtype=np.int64) - 1

                    def sampled(x, kind, at=at, none=none):
                        return pa.array((x[np.maximum(at, 0)] if len(x) else np.zeros(len(at), np.int64)).astype(kind), mask=none)

                    columns = [pa.array(np.full(len(kind), r, np.int32)), pa.array(np.arange(seq, seq + len(kind))), pa.array(KINDS).take(pa.array(kind)), pa.array(node), pa.array(np.array(PRICES, np.int64)[kind]), pa.array(cum)]
                    columns += [pa.array(at + idx, mask=none), sampled(degree, np.int32), sampled(step, np.int64), sampled(of_walk, np.int32)]
                    whole = pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in LOG.split(", ")])
                    seq, idx = seq + len(kind), idx + int(made.sum())
                    for k in range(0, len(kind), 1 << 16):
                        yield whole.slice(k, 1 << 16)

    return spark.range(runs, numPartitions=max(1, min(runs, 2 * spark.sparkContext.defaultParallelism))).select(F.col("id").cast("int").alias("run")).mapInArrow(run, LOG)


def walks(n: DataFrame, a: DataFrame, seeds: list[int], runs: int, cap: int, seed: int = 42, group: str = "walk", charges: bool = False, **how) -> DataFrame:
    """TRACE (or CHARGES) of ``runs`` walks."""
    log = walk_log(n, a, seeds, runs, cap, seed, group, **how)
    return charges_of(log) if charges else trace_of(log)
