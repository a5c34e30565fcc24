"""Files in any store that Spark reaches, by its own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def store(spark: SparkSession, path: str):
    """(file system, path) of the store that a path lies in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = store(spark, path)
    return fs.exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none where it isn't there."""
    fs, at = store(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> bool:
    fs, at = store(spark, path)
    return fs.delete(at, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    fs, at = store(spark, path)
    _, target = store(spark, to)
    fs.mkdirs(target.getParent())
    if not fs.rename(at, target):
        raise OSError(f"{path} could not be moved to {to}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = store(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def unique_path(spark: SparkSession, path: str) -> str:
    """path if nothing is there, else the first of path-2, path-3, ... (before the suffix of the last name) that is free."""
    if not exists(spark, path):
        return path
    folder, slash, name = path.rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    stem, suffix = (stem, dot + suffix) if stem else (name, "")
    k = 2
    while exists(spark, other := f"{folder}{slash}{stem}-{k}{suffix}"):
        k += 1
    return other
