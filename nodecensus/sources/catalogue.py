"""Stored adjacency: a folder with one table (pos, key, nbrs) a graph; node types; conversion of pickled dictionaries."""

from __future__ import annotations

import io
import pickle

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodecensus.operators import graph
from nodecensus.sources import files

ADJACENCY = "pos long, key string, nbrs array<string>"


class Catalogue:
    """Graphs of a folder.  One built graph is kept at a time; loading another removes its stored tables."""

    def __init__(self, spark: SparkSession, folder: str, aliases: dict[str, str] | None = None) -> None:
        self.spark, self.folder, self.aliases = spark, folder.rstrip("/"), aliases or {}
        self.kept: tuple[str, DataFrame, DataFrame] | None = None

    def available(self) -> list[str]:
        return files.folders(self.spark, self.folder)

    def resolve(self, name: str) -> str:
        """A graph's name from itself or an alias."""
        name = self.aliases.get(name, name)
        if name not in self.available():
            raise ValueError(f"no graph {name!r}; there are {', '.join(self.available())}")
        return name

    def adjacency(self, name: str) -> DataFrame:
        return self.spark.read.schema(ADJACENCY).parquet(f"{self.folder}/{self.resolve(name)}")

    def edges(self, name: str) -> DataFrame:
        return graph.raw_edges(self.adjacency(name))

    def load(self, name: str) -> tuple[DataFrame, DataFrame]:
        """Nodes and arcs of a graph, built once as long as no other is loaded."""
        name = self.resolve(name)
        if self.kept is None or self.kept[0] != name:
            self.clear()
            self.kept = (name, *graph.build(self.edges(name)))
        return self.kept[1:]

    def clear(self) -> None:
        """Forgets the kept graph and removes what was stored for it."""
        for df in self.kept[1:] if self.kept else ():
            for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
                files.remove(self.spark, folder)
        self.kept = None

    def save(self, adjacency: DataFrame, name: str, force: bool = False) -> None:
        """Stores adjacency; refuses to overwrite a graph unless forced."""
        path = f"{self.folder}/{name}"
        if files.exists(self.spark, path) and not force:
            raise FileExistsError(f"{path} is there already; force overwrites it")
        adjacency.select(F.col("pos").cast("long"), F.col("key").cast("string"), F.col("nbrs").cast("array<string>")).write.mode("overwrite").parquet(path)

    def save_instances(self, name: str, types: DataFrame, out: str, force: bool = False) -> None:
        """A graph's adjacency among the instances of ``types`` (name, type), under another name; keys keep their places, and one
        that loses all neighbours stays."""
        keep = instance_names(types)
        lists = self.adjacency(name).join(keep.select(F.col("name").alias("key")), "key", "left_semi")
        each = lists.select("pos", "key", F.posexplode("nbrs").alias("at", "d")).join(keep.select(F.col("name").alias("d")), "d", "left_semi")
        own = each.groupBy(F.col("pos").alias("_pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda x: x["d"]).alias("_nbrs"))
        self.save(lists.join(own, F.col("pos") == F.col("_pos"), "left").select("pos", "key", F.coalesce("_nbrs", F.array().cast("array<string>")).alias("nbrs")), out, force)


def instance_names(types: DataFrame) -> DataFrame:
    """Names of the nodes whose type is instance."""
    return types.where(F.col("type") == "instance").select("name").distinct()


def type_counts(types: DataFrame) -> DataFrame:
    return types.groupBy("type").agg(F.count("*").alias("n"))


class _Plain(pickle.Unpickler):
    """Reads plain values; a pickle that names any class or function is refused."""

    def find_class(self, module: str, name: str):
        raise pickle.UnpicklingError(f"{module}.{name} isn't plain data")


def convert_pickle(spark: SparkSession, source: str, catalogue: Catalogue, name: str, force: bool = False, rows: int = 100_000) -> None:
    """Stores a pickled dictionary of key -> list of neighbours (on the driver's disk) as adjacency.  A pickle can only be read
    whole, by one process; its rows go on in slices."""
    with open(source, "rb") as f:
        said = _Plain(io.BufferedReader(f)).load()
    if not isinstance(said, dict):
        raise ValueError(f"{source} holds no dictionary")
    path, items, mode = f"{catalogue.folder}/{name}", list(said.items()), "overwrite"
    if files.exists(spark, path) and not force:
        raise FileExistsError(f"{path} is there already; force overwrites it")
    for at in range(0, max(1, len(items)), rows):
        part = [(at + k, str(key), [str(x) for x in near]) for k, (key, near) in enumerate(items[at : at + rows])]
        spark.createDataFrame(part, ADJACENCY).write.mode(mode).parquet(path)
        mode = "append"
