"""A corpus pipeline of the training-data operators: quality rules, near-dedup, substring dedup, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns of
``documents``.  ``run`` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodecensus.llm import minhash, packing, pii, quality, substrings
from nodecensus.llm.common import stored, table


def _counted(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars (if there) of the new text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, 80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(docs, substrings.dedup_documents(docs, 20, 5))


#: Key of the pseudonyms unless the session names one in spark.nodecensus.pii.key.
EXAMPLE_KEY = "example key, for examples only"


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(docs, pii.pseudonymise(docs, spark.conf.get("spark.nodecensus.pii.key", EXAMPLE_KEY)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("pii", pseudonyms), ("packing", packed)]

#: None: components over set similarities and vocabularies are no SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
