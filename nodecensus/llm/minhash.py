"""Operator 2: near-duplicates by fast similarity sketches, banding and exact verification.

*Sketch.*  A document's set (distinct ``SHINGLE``-word shingles as 64-bit digests, mixed by doubling, so that patterns in words or
texts don't collide; sets count as equal by 128 bits from two independent digests) gets ``BINS`` coordinates.  In rounds
0 .. BINS-1 every element is hashed to a bin with a value; in rounds BINS .. 2*BINS-1 every element goes to bin round - BINS, so every
coordinate is filled at the latest then.  A bin keeps the least (round, value); a document is through once all its bins are filled,
mostly after a few rounds.  The share of equal coordinates concentrates about the sets' similarity.

*Banding.*  Bands of a few coordinates (see ``LAYOUTS``); sets as similar as asked miss all bands with a probability under 1e-10.
Documents with equal sets are one class before that, so groups of copies are one row.

*Verification.*  In a bucket no pairs are listed.  In each round 1, 32, 1024, ... leaders of each bucket (chosen by hashes within an
aggregation) are compared with the members of *other* components, then leave the bucket; buckets with a single component are done.
This goes on until no bucket is left, so no link between different components is lost, while groups of copies take one round.
The join of leaders and members itself drops pairs whose sizes differ too much or whose odd sketches do: of ``PARITY`` bits, each the
parity of the elements hashed to it, those that differ are never more than the sets' symmetric difference, so that no link is lost by
it; it keeps large groups of texts that are alike, but less than asked for, from being paired.
A pair that is left is verified on full sets; if both are too long for odd sketches to tell (over ``LONG`` shingles), only if at least
so many of the coordinates are equal as ``LAYOUTS`` says (a similar pair falls below with a probability under 1e-10).  New links are contracted to the labels of their ends and joined to components by least labels with jumps.  All steps are joins and aggregations;
nothing is collected and nothing broadcast but what Spark knows to be small.

Cases: null and empty texts have empty sets and stay alone; shorter texts have one shingle, their words; rows with one doc_id count
as one document; rows without doc_id stay alone (component null, kept); very long texts are taken whole; ties go to the
smallest doc_id; empty tables give no rows; other columns aren't read, and ``keep_one`` returns them unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodecensus.llm.common import batches_of_texts, join_texts, mix, new_table, partitions, stored, strings_of, table, text_of, utf8, word_bounds, word_digests

SHINGLE, BINS, PARITY, LONG = 5, 128, 512, 1500
#: From which percentage on: bands, coordinates of a band, and coordinates of a similar pair that are equal at least.
LAYOUTS = {85: (32, 4, 77), 80: (34, 3, 71)}
SKETCH = "doc_id long, n_shingles long, fp1 long, fp2 long, sketch binary, bands array<long>, odd array<long>"
SETS = "doc_id long, shingles array<long>"
_salts = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: list[bytes], width: int = SHINGLE, halves: int = 1) -> tuple[np.ndarray, ...]:
    """Text number and digest of the distinct shingles of each text, sorted by text and digest; with two halves also the other half
    of their digests (of one of the shingles, should 64 bits ever be equal for several)."""
    data, bounds = join_texts(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    start, end, first = word_bounds(data, bounds)
    count = np.diff(first)
    own = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(start))
    size = np.minimum(count, width)[own]
    good = at + size <= first[own + 1] if len(at) else np.zeros(0, bool)
    good &= (count[own] >= width) | (at == first[own])
    at, own, size = at[good], own[good], size[good]
    out = []
    for half in range(halves):
        digests = word_digests(data, start, end, half)
        h = np.empty(len(at), np.uint64)
        for k in np.unique(size).tolist():
            hit = size == k
            h[hit] = strings_of(digests, k, half)[at[hit]]
        out.append(h)
    order = np.argsort(out[0])
    order = order[np.argsort(own[order].astype(np.uint16), kind="stable")] if len(texts) <= 1 << 16 else np.lexsort((out[0], own))
    own, out = own[order], [h[order] for h in out]
    new = np.append(True, (out[0][1:] != out[0][:-1]) | (own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
    return own[new], *(h[new] for h in out)


def sketches(n: int, own: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Fast similarity sketches of n sets: an n by BINS array of (round, value) as one number."""
    out = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    empty = np.iinfo(np.uint64).max
    for i in range(2 * BINS):
        if not len(h):
            break
        x = mix(h ^ _salts[i])
        bin_ = (x & np.uint64(BINS - 1)).astype(np.int64) if i < BINS else np.full(len(h), i - BINS)
        np.minimum.at(out, own * BINS + bin_, (np.uint64(i) << np.uint64(55)) | (x >> np.uint64(9)))
        open_ = (out.reshape(n, BINS) == empty).any(1)
        if not open_.all():
            alive = open_[own]
            own, h = own[alive], h[alive]
    return out.reshape(n, BINS)


def odd_sketches(n: int, own: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of n sets, the parity of the elements hashed to each of PARITY bits: an n by PARITY / 64 array of words."""
    words = PARITY // 64
    out = np.zeros(n * words, np.uint64)
    x = mix(h ^ np.uint64(0x3C3C3C3C3C3C3C3C))
    np.bitwise_xor.at(out, own * words + ((x >> np.uint64(6)) % np.uint64(words)).astype(np.int64), np.uint64(1) << (x & np.uint64(63)))
    return out.reshape(n, words)


def _each_block(batches, limit: int = 512 << 10):
    for batch in batches:
        for at, to in batches_of_texts(batch, limit):
            yield batch.column("doc_id").slice(at, to - at), utf8(batch.column("text"), at, to)


def layout(percent: int) -> tuple[int, int, int]:
    for least, x in LAYOUTS.items():
        if least <= percent <= 100:
            return x
    raise ValueError(f"bands and agreement are laid out for similarities of {min(LAYOUTS)} % and more")


def sketched(docs: DataFrame, bands_: int, rows: int) -> DataFrame:
    """SKETCH of every row."""

    def run(batches):
        for ids, texts in _each_block(batches):
            own, h, g = shingle_sets(texts, halves=2)
            n = len(texts)
            count = np.bincount(own, minlength=n)
            a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            np.add.at(a, own, mix(h))
            np.add.at(b, own, mix(g))
            s = sketches(n, own, h)
            keys = np.zeros((n, bands_), np.uint64)
            for k in range(rows):
                keys = mix(keys + s[:, k::rows][:, :bands_] + np.uint64(k + 1))
            keys = mix(keys ^ (np.arange(bands_, dtype=np.uint64) << np.uint64(40))[None, :])
            small = (mix(s) & np.uint64(255)).astype(np.uint8)
            bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(count > 0, bands_, 0))), pa.int32()), pa.array(keys[count > 0].reshape(-1).astype(np.int64)))
            odd = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (PARITY // 64), pa.int32()), pa.array(odd_sketches(n, own, h).reshape(-1).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(count, pa.int64()), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array([x.tobytes() for x in small], pa.binary()), bands, odd], ["doc_id", "n_shingles", "fp1", "fp2", "sketch", "bands", "odd"])

    return text_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        for ids, texts in _each_block(batches):
            own, h = shingle_sets(texts)
            at = np.searchsorted(own, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.astype(np.int64)))], ["doc_id", "shingles"])

    return text_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, SETS)


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of each component of the links (a, b), for nodes that have links."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = stored(lower.join(jump, F.col("new") == F.col("via"), "left").select("node", F.least("new", F.coalesce("far", F.col("new"))).alias("label"), F.col("label").alias("old")), "labels")
        labels = step.select("node", "label")
        if step.where(F.col("label") < F.col("old")).isEmpty():
            return labels


def _agreeing(pairs: DataFrame, agree: int) -> DataFrame:
    """Pairs (a, b, sketch_a, sketch_b) of which ``agree`` coordinates are equal; a sketch that is null agrees with all."""

    def run(batches):
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            told = np.flatnonzero(np.asarray(batch.column("sketch_a").is_valid()) & np.asarray(batch.column("sketch_b").is_valid()))
            a, b = (np.frombuffer(b"".join(batch.column(c).take(pa.array(told)).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sketch_a", "sketch_b"))
            good[told] = (a == b).sum(1) >= agree
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.  Links are 100 * intersection >= percent * union; see the module's text."""
    n_bands, of_band, agree = layout(percent)
    spark = docs.sparkSession
    rows = stored(sketched(docs, n_bands, of_band), "minhash-sketches")
    full = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stored(full.groupBy("fp1", "fp2", "n_shingles").agg(F.min(F.struct("doc_id", "sketch", "bands", "odd")).alias("x")).select("fp1", "fp2", F.col("n_shingles").alias("n"), F.col("x.doc_id").alias("rep"), F.col("x.sketch").alias("sketch"), F.col("x.bands").alias("bands"), F.col("x.odd").alias("odd")), "minhash-classes")
    dealt = classes.select(F.explode("bands").alias("key"), "rep", "n")  # a large bucket counts as one row a task, and its join can be split
    several = stored(dealt.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key"), "minhash-several")  # stored, so that the join with them can be split
    buckets = stored(dealt.join(several, "key", "left_semi"), "minhash-buckets")
    members = stored(buckets.join(classes.select("rep", "odd", F.when(F.col("n") > LONG, F.col("sketch")).alias("sketch")), "rep"), "minhash-members")
    labels = stored(members.select("rep").distinct().select("rep", F.col("rep").alias("label")), "minhash-labels")
    nodes = labels.select("rep")  # stored, so that Spark knows its size before it deals out texts for the join
    # The full sets of documents in buckets, bucketed by document (one file each, as texts are dealt so): rounds then move pairs only.
    name = new_table(spark, "sets")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(nodes.withColumnRenamed("rep", "_rep"), F.col("doc_id") == F.col("_rep"), "left_semi")
    full_sets(texts.repartition(partitions(spark), "doc_id")).write.bucketBy(partitions(spark), "doc_id").saveAsTable(name)
    sets = spark.table(name)

    apart = sum(F.bit_count(F.col("odd")[i].bitwiseXOR(F.col("lead_odd")[i])) for i in range(PARITY // 64))
    alike = (100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")) & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("lead_n")))
    width = 1
    while not members.isEmpty():
        known = members.join(labels, "rep")
        open_ = stored(known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"), "minhash-open")
        live = stored(known.join(open_, "key", "left_semi"), "minhash-live")
        slot = F.pmod(F.xxhash64("rep"), F.lit(width))
        leaders = stored(live.groupBy("key", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("rep", F.lit(1)).alias("o"), "rep", "n", "label", "odd", "sketch")).alias("l")).select("key", F.col("l.rep").alias("lead"), F.col("l.n").alias("lead_n"), F.col("l.label").alias("lead_label"), F.col("l.odd").alias("lead_odd"), F.col("l.sketch").alias("lead_sketch")), "minhash-leaders")
        met = live.join(leaders, "key").where((F.col("label") != F.col("lead_label")) & alike)
        drawn = met.select(F.col("rep").alias("a"), F.col("lead").alias("b"), F.col("sketch").alias("sketch_a"), F.col("lead_sketch").alias("sketch_b"))
        # Dealt as the sets are, so that this is the only shuffle before them, and by the member: a leader has as many pairs as its
        # buckets have members, a member only as many as its buckets have leaders.
        likely = _agreeing(drawn, agree).repartition("a").distinct()
        of_a = likely.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
        of_b = of_a.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
        common = of_b.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("common"), (F.size("set_a") + F.size("set_b")).alias("both"))
        new = stored(common.where(100 * F.col("common") >= percent * (F.col("both") - F.col("common"))).select("a", "b"), "minhash-links")
        if not new.isEmpty():
            ends = new.join(labels.select(F.col("rep").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("rep").alias("b"), F.col("label").alias("lb")), "b")
            found = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))).withColumnRenamed("label", "lower")
            labels = stored(labels.join(found, F.col("label") == F.col("node"), "left").select("rep", F.coalesce("lower", "label").alias("label")), "minhash-labels")
        members = stored(live.select("key", "rep", "n", "odd", "sketch").join(leaders.select("key", F.col("lead").alias("rep")), ["key", "rep"], "left_anti"), "minhash-buckets")
        width *= 32

    of_class = classes.select(F.col("fp1").alias("_f1"), F.col("fp2").alias("_f2"), F.col("n").alias("_n"), "rep")
    out = rows.select("doc_id", "n_shingles", "fp1", "fp2").join(of_class, (F.col("fp1") == F.col("_f1")) & (F.col("fp2") == F.col("_f2")) & (F.col("n_shingles") == F.col("_n")), "left")
    out = out.join(labels.select(F.col("rep").alias("_rep"), "label"), F.col("rep") == F.col("_rep"), "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.coalesce("label", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs without the near-duplicates of a smaller doc_id; rows of one kept doc_id all stay."""
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(stored(gone, "minhash-gone"), F.col("doc_id") == F.col("_gone"), "left_anti")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85)
