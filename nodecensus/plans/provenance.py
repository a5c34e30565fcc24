"""Where results come from: a fingerprint of the code, its revision, and a text about stored results; archiving of old ones."""

from __future__ import annotations

import hashlib
import subprocess
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodecensus.operators import results
from nodecensus.sources import files

PACKAGE = Path(__file__).resolve().parents[1]


def fingerprint(folder: Path = PACKAGE) -> str:
    """12 digits that change with any source file of the package."""
    said = hashlib.sha256()
    for p in sorted(folder.rglob("*.py")):
        data = p.read_bytes()
        said.update(f"{p.relative_to(folder).as_posix()}\0{len(data)}\0".encode() + data)
    return said.hexdigest()[:12]


def revision(folder: Path = PACKAGE) -> str | None:
    """The commit of the package's repository, marked where files differ from it; None outside of one."""

    def git(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", str(folder), *args], capture_output=True, text=True, timeout=10, check=False)
        except (OSError, subprocess.SubprocessError):
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    head = git("rev-parse", "--short", "HEAD")
    return head and head + ("-dirty" if git("status", "--porcelain", "--", str(folder)) else "")


def archive(spark: SparkSession, path: str, reason: str = "") -> str | None:
    """Moves stored results aside, to deprecated/<time>__<fingerprint> beside them, with the reason in a text; None if there are none."""
    if not files.exists(spark, path):
        return None
    folder, _, name = path.rstrip("/").rpartition("/")
    to = files.unique_path(spark, f"{folder}/deprecated/{time.strftime('%Y%m%d-%H%M%S')}__{fingerprint()}")
    files.move(spark, path, f"{to}/{name}")
    files.write_text(spark, f"{to}/REASON.txt", f"{reason or 'no reason given'}\nrevision: {revision()}\n")
    return to


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a stored table, which Parquet's footers tell without reading any."""
    return spark.read.parquet(path).count() if files.exists(spark, path) else 0


def missing_columns(stored: DataFrame) -> list[str]:
    """Columns of results written today that stored ones lack."""
    return [c for c in results.ESTIMATES.names if c not in stored.columns]


def readme(stored: DataFrame) -> str:
    """A text about stored results as they were read, one part a condition, with a warning where columns are lacking."""
    lost, df = missing_columns(stored), results.backfilled(stored)
    out = [f"# Results\n\nCode {fingerprint()}, revision {revision()}.\n"]
    if lost:
        out.append(f"**Outdated**: written before these columns were: {', '.join(lost)}.\n")
    facts = df.groupBy("graph", "seed", "start_node").agg(
        F.count("*").alias("rows"), F.max("true_size").alias("size"), F.countDistinct("run").alias("runs"), *(F.array_sort(F.collect_set(c)).alias(c) for c in ("view", "estimator", "budget_rel", "stopped_by"))
    )
    for r in facts.orderBy("graph", "seed", "start_node").collect():  # a row a condition
        out.append(f"## {r['graph']}, seed {r['seed']}, start {r['start_node'] or '(first)'}\n\n{r['rows']} rows, {r['size']} nodes, {r['runs']} runs a point.\n")
        out += [f"* {label}: {', '.join(f'{x:g}' if isinstance(x, float) else x for x in r[c])}" for label, c in (("views", "view"), ("budgets", "budget_rel"), ("estimators", "estimator"), ("stopped by", "stopped_by"))]
        if set(r["stopped_by"]) - {"budget"}:
            out.append("* **some runs did not end by their budget**")
    return "\n".join(out) + "\n"
