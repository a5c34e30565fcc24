"""The folder that driver and executors share, and tables stored in it."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodecensus.session import importable


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only in a local session where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or os.path.join(tempfile.gettempdir(), "checkpoints")).rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """What this application stores is here, so that ``clear`` can remove it."""
    return f"{shared_dir(spark)}/nodecensus/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def new_table(spark: SparkSession, name: str) -> str:
    """Name of a table of this application in the warehouse."""
    return f"{_prefix(spark)}{name}_{uuid.uuid4().hex}"


def _prefix(spark: SparkSession) -> str:
    return f"nodecensus_{re.sub('[^0-9a-z]', '', spark.sparkContext.applicationId.lower())}_"


def clear(spark: SparkSession) -> None:
    """Removes all that this application has stored between stages.  DataFrames that read from it end with it: write results first."""
    for t in spark.catalog.listTables():
        if t.name.startswith(_prefix(spark)):
            spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, codec: str = "zstd", block: int = 128 << 20) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage so that a lost executor costs no earlier stage.  ``block`` is how
    many bytes of a file are read by one task at least."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).option("parquet.block.size", block).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def dense_ids(df: DataFrame, order: list, name: str = "id") -> DataFrame:
    """df with 0, 1, 2, ... in the order of ``order``, without gathering rows in one task: a range sort, stored, then the number
    of rows before each partition, a table with a row for each partition."""
    rows = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ids")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n")).agg(F.array_sort(F.collect_list(F.struct("_part", "_n"))).alias("s"))
    before = sizes.select(F.posexplode("s").alias("k", "x"), "s").select(F.col("x._part").alias("_p"), F.aggregate(F.slice("s", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda a, y: a + y["_n"]).alias("_before"))
    return rows.join(before, F.col("_part") == F.col("_p")).withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_p", "_before")
