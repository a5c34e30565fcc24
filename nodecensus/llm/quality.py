"""Operator 10: quality rules with adaptive thresholds.

Instead of fixed cutoffs, each measure's limit follows from how that measure is spread among the documents of the same
language and source that pass the base rules.  The spread is held in *mergeable quantile sketches*: histograms with a fixed number
of bins (0 to ``BINS`` thousandths for shares, tenths of a code point for word length, the last bin also for all above), added up by
language and source, by language and over everything.  Adding counts is associative, so partial sketches merge in any order with
one result, whatever the partitions; a sketch has at most ``BINS`` + 1 rows whatever the number of documents.  Quantiles
read from it have no rank error; their values are exact to one bin.

A group's own limit is ``max(q[level], q75 + FENCE * (q75 - q25))``: the upper quantile at the measure's ``LEVELS`` (for measures that
are 0 in most documents), or the fence where the measure is spread more widely than that.  No constant of the measures' own scale
enters.  Limits of small groups are pulled towards those of the wider ones, language and all, with the weight of ``PRIOR``
documents: ``(n * own + PRIOR * wider) / (n + PRIOR)``, for every group alike.

All work is DataFrame functions.  The per-document measures are written once to the shared folder; sketches and the joined
filtering both read that table.  The limits table is written too, so that its size is known from its files and Spark
broadcasts it only if it is below the broadcast threshold.

Cases: a null or text without words has no words and fails the base rules; what fails them takes no part in the sketches; null languages
and sources form groups of their own (null-safe join); empty input gives an empty result; repeated rows stay; very long texts
are taken whole (work per document is n log n); other columns are passed through by ``filter_documents`` and can't clash, for
the measures live in one struct column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodecensus.llm.common import SPACE, stored, table

BINS = 1000
FENCE = 3
PRIOR = 200
#: For each measure the percentage of documents that its upper quantile leaves in.
LEVELS = {"symbols": 95, "dup_lines": 99, "repeats": 99, "word_length": 97}
WHITE = " \t\n\x0b\x0c\r"


def let(value: Column, f) -> Column:
    """f(value) with value computed once for the row."""
    return F.element_at(F.transform(F.array(value), f), 1)


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words in windows of ``width`` words found twice or more: sort the windows' digests, keep those equal to a neighbour."""

    def covered(starts: Column) -> Column:
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(F.sort_array(starts), F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")), step, lambda acc: acc["n"])

    def twice(found: Column) -> Column:
        same = lambda x, y: (x["h"] == y["h"]) & (x["g"] == y["g"])
        near = lambda x, j: F.coalesce(same(x, F.get(found, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(found, j + 1)), F.lit(False))
        return covered(F.transform(F.filter(found, near), lambda x: x["i"]))

    def windows(w: Column) -> Column:
        # By index: slice() would copy the whole array for each window.
        def one(i: Column) -> Column:
            own = [F.get(w, i + k) for k in range(width)]
            return F.struct(F.xxhash64(*own).alias("h"), F.hash(*own).alias("g"), i.alias("i"))

        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - width), one))

    return let(words, lambda w: F.when(F.size(w) < width, F.lit(0)).otherwise(let(windows(w), twice))).cast("long")


def measures(text: Column) -> Column:
    """Struct of the base measures of a text; see the module's text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, WHITE, "") != "")

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return F.struct(
        let(words, of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.length(F.translate(t, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )


def measured(docs: DataFrame) -> DataFrame:
    """docs with a struct column ``_quality``: base measures, base_failed and the measures in bins."""
    df = docs.withColumn("_m", measures(F.col("text")))
    m = {k: F.col(c) for k, c in {"n_words": "_m.w.n_words", "n_repeat_words": "_m.w.n_repeat_words", "n_lines": "_m.l.n_lines", "n_dup_lines": "_m.l.n_dup_lines", "word_chars": "_m.word_chars", "n_symbols": "_m.n_symbols"}.items()}
    share = lambda a, b, by=1000: F.least(F.lit(BINS), F.floor(a * by / F.greatest(b, F.lit(1)))).cast("int")
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    bins = {"symbols": share(m["n_symbols"], m["word_chars"]), "dup_lines": share(m["n_dup_lines"], m["n_lines"]), "repeats": share(m["n_repeat_words"], m["n_words"]), "word_length": share(m["word_chars"], m["n_words"], 10)}
    return df.withColumn("_quality", F.struct(*(c.alias(k) for k, c in m.items()), failed.alias("base_failed"), *(c.alias(k) for k, c in bins.items()))).drop("_m")


def limits(rows: DataFrame) -> DataFrame:
    """Per language and source the upper limit of each measure, from merged sketches of rows (lang, source, measures in bins)."""
    cells = F.array(*(F.struct(F.lit(k).alias("measure"), F.col(k).alias("bin"), F.lit(v).alias("at")) for k, v in LEVELS.items()))
    sketch = rows.select("lang", "source", F.explode(cells).alias("c")).groupBy("lang", "source", "c.measure", "c.bin", "c.at").agg(F.count("*").alias("n"))
    levels = F.array(F.struct(F.lit(0).alias("level"), F.col("lang").alias("l"), F.col("source").alias("s")), F.struct(F.lit(1).alias("level"), F.col("lang").alias("l"), F.lit(None).cast("string").alias("s")), F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("l"), F.lit(None).cast("string").alias("s")))
    merged = sketch.select(F.explode(levels).alias("v"), "measure", "bin", "at", "n").groupBy("v.level", "v.l", "v.s", "measure", "at", "bin").agg(F.sum("n").alias("n"))
    # A group has at most BINS + 1 rows for each measure, so its quantiles are read from one sorted array.
    quantile = lambda q: F.aggregate(F.col("hist"), F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("at")), lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.when((acc["at"] < 0) & ((acc["seen"] + x["n"]) * 100 >= F.col("docs") * q), x["bin"]).otherwise(acc["at"]).alias("at")), lambda acc: acc["at"])
    read = merged.groupBy("level", "l", "s", "measure", "at").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("hist"), F.sum("n").alias("docs")).select("level", "l", "s", "measure", "docs", quantile(25).alias("q25"), quantile(75).alias("q75"), quantile(F.col("at")).alias("top"))
    at = read.withColumn("own", F.greatest(F.col("top"), F.col("q75") + FENCE * (F.col("q75") - F.col("q25"))).cast("long"))
    at = stored(at, "quality-sketches")
    pulled = lambda docs, own, wider: F.floor((F.col(docs) * F.col(own) + PRIOR * F.col(wider)) / (F.col(docs) + PRIOR))
    own, lang, all_ = (at.where(F.col("level") == k) for k in (0, 1, 2))
    best = (
        own.select(F.col("l").alias("lang"), F.col("s").alias("source"), "measure", "docs", "own")
        .join(lang.select("l", F.col("measure").alias("m1"), F.col("docs").alias("d1"), F.col("own").alias("u1")), F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m1")))
        .join(all_.select(F.col("measure").alias("m2"), F.col("own").alias("u2")), F.col("measure") == F.col("m2"))
        .withColumn("wider", pulled("d1", "u1", "u2"))
        .withColumn("limit", pulled("docs", "own", "wider"))
    )
    return best.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == k, F.col("limit"))).alias(f"max_{k}") for k in LEVELS))


def verdicts(rows: DataFrame) -> DataFrame:
    """Adds the boolean ``_kept`` to a stored table with ``_quality``, lang and source: fit sketches, then filter by a join."""
    fit = rows.where(~F.col("_quality.base_failed")).select("lang", "source", *(F.col(f"_quality.{k}").alias(k) for k in LEVELS))
    edge = stored(limits(fit), "quality-limits").select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(F.col(f"max_{k}").alias(f"_max_{k}") for k in LEVELS))
    joined = rows.join(edge, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    within = F.lit(True)
    for k in LEVELS:
        within &= F.coalesce(F.col(f"_quality.{k}") <= F.col(f"_max_{k}"), F.lit(False))
    return joined.withColumn("_kept", ~F.col("_quality.base_failed") & within).drop("_lang", "_source", *(f"_max_{k}" for k in LEVELS))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents kept, with their own columns.  The stored table holds them whole, for reading texts beats a second join."""
    return verdicts(stored(measured(docs), "quality-measures")).where("_kept").select(*docs.columns)


def score(docs: DataFrame) -> DataFrame:
    """Per document the base measures and the verdict."""
    rows = verdicts(stored(measured(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-measures"))
    return rows.select("doc_id", *(F.col(f"_quality.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), F.col("_kept").alias("kept"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
