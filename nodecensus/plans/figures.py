"""What figures show, as tables: selections of results with colours, panels, points and tick texts, for any plotting tool."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodecensus.operators import results

#: Colours of the series of a panel; there are no more, and none is used twice.
PALETTE = ("#1f4e9c", "#d1495b", "#2e8b57", "#e09f3e", "#7b4fa3", "#3aa6b9", "#8c564b", "#5c677d")
STYLE = {"surface": "#ffffff", "ink": "#111111", "grid": "#dddddd", "label_size": 9, "spines": ("left", "bottom")}


@dataclass(frozen=True)
class Figure:
    name: str
    estimators: tuple[str, ...]
    views: tuple[str, ...]
    title: str


_UNIFORM, _KATZIR, _PLAIN = "uniform-collision", "wis-katzir", "rw-plain"
# Names and selections of the five figures.
FIGURES = (
    Figure("wis_indep__undirected", (_UNIFORM, f"{_KATZIR}__indep"), ("undirected",), "Weighted estimate from independent draws by degree, undirected"),
    Figure("wis_indep__directed", (_UNIFORM, f"{_KATZIR}__indep"), ("directed",), "Weighted estimate from independent draws by degree, directed"),
    Figure("wis_rw__undirected", (_UNIFORM, f"{_KATZIR}__rw-restart", f"{_KATZIR}__rw-backtrack", f"{_KATZIR}__rw-history"), ("undirected",), "Weighted estimates from random walks, undirected"),
    Figure("wis_rw_history__views", (_UNIFORM, f"{_KATZIR}__rw-history"), ("directed", "undirected"), "Weighted estimate from a walk by history, both views"),
    Figure("deadend_uis__directed", (_UNIFORM, f"{_PLAIN}__restart__none", f"{_PLAIN}__backtrack__none", f"{_PLAIN}__history__none"), ("directed",), "Collisions of walks by how they leave dead ends, directed"),
)


def color(index: int) -> str:
    if index >= len(PALETTE):
        raise ValueError(f"a panel has {len(PALETTE)} colours, not {index + 1}; choose fewer estimators")
    return PALETTE[index]


def comparison(stored: DataFrame, estimators: list[str], views: list[str], colors: dict[str, str] | None = None) -> DataFrame:
    """Points of a comparison: results.range_points of the selection, with a panel a view, a series an estimator, and its colour."""
    if len(estimators) < 2:
        raise ValueError("a comparison needs two estimators")
    of = colors or {e: color(k) for k, e in enumerate(estimators)}
    used = [of[e] for e in estimators]
    if len(set(used)) < len(used):
        raise ValueError(f"estimators share a colour: {sorted({c for c in used if used.count(c) > 1})}")
    points = results.range_points(results.rows(stored, estimators=estimators, views=views))
    series, panel = F.create_map(*(F.lit(x) for e in enumerate(estimators) for x in (e[1], e[0]))), F.create_map(*(F.lit(x) for v in enumerate(views) for x in (v[1], v[0])))
    paint = F.create_map(*(F.lit(x) for e in estimators for x in (e, of[e])))
    return points.withColumns({"panel": panel[F.col("view")], "series": series[F.col("estimator")], "color": paint[F.col("estimator")]})


def figures(stored: DataFrame) -> dict[str, DataFrame]:
    """The points of each figure for which results of two of its estimators are there, by name."""
    have = {(r["view"], r["estimator"]) for r in stored.select("view", "estimator").distinct().collect()}  # at most views x estimators
    out = {}
    for f in FIGURES:
        there = [e for e in f.estimators if any((v, e) in have for v in f.views)]
        if len(there) >= 2:
            out[f.name] = comparison(stored, there, list(f.views), {e: color(k) for k, e in enumerate(f.estimators)})
    return out


def note(stored: DataFrame, seed: int, start_node: str | None) -> str:
    """The line under a figure: its condition, and whether points of a row depend on each other."""
    own = results.rows(stored, seed=seed, start_node=start_node)
    nested = not own.where("nested").isEmpty()
    return "  |  ".join([f"seed {seed}", *([f"start: {start_node}"] if start_node else []), *(["nested budgets"] if nested else []), "shared walks"])
