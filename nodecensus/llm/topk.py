"""Operator 3: exact top-k inner products by MaxScore.

A query's terms are the dimensions; a shard's postings for a dimension are its candidates' components.  From a shard's least and
greatest component the contribution of a term lies between a low and a high bound.  Terms are ordered by the width between
the two; the widest, which are *essential*, are traversed for all candidates of a block, and the others are probed one after
the other only while a candidate's partial score plus the high bounds still to come reaches the query's k-th best score so
far.  Each shard yields at most k rows a query, and shards are merged by rank.

Candidates are dealt to shards by a hash of their id (about ``SHARD`` each), queries to blocks of about ``BLOCK``.  The blocks, a
stated set, are stored once in the shared folder (a file system that pyarrow knows); each task reads them one by one for every
``GROUP`` of its shards and hands on k rows a query and group, so neither blocks nor pairs of vectors are moved, joined or held
by the JVM, and nothing is broadcast.

Cases: vectors that are null or hold null or non-finite components take no part; vectors of other lengths count as padded
with zeros; ties go to the smaller vec_id; of repeated rows with a query's id the smallest vector asks, and no row with the
query's id answers; fewer than k others give fewer rows; empty tables give none; components so large that a score might leave 64 bits raise; only vec_id and embedding are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodecensus.llm.common import partitions, stored, table

SHARD, BLOCK, STEP = 4096, 1024, 1024
#: Shards of a task that meet the blocks together.
GROUP = 16
PACKED = "part int, ids binary, width int, data binary"
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and q: floor(256 * x) of every component, for the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    usable = F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & usable).select("vec_id", F.transform("e", lambda x: F.floor(F.lit(256.0) * x).cast("long")).alias("q"))


def packed(rows: DataFrame, parts: int) -> DataFrame:
    """One row for each part: ids and components as packed 64-bit numbers."""

    def pack(t: pa.Table) -> pa.Table:
        vectors = t.column("q").to_pylist()
        width = max(map(len, vectors), default=0)
        data = np.zeros((len(vectors), width), np.int64)
        for k, v in enumerate(vectors):
            data[k, : len(v)] = v
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "ids": [np.asarray(t.column("vec_id")).astype(np.int64).tobytes()], "width": pa.array([width], pa.int32()), "data": [data.tobytes()]})

    # Repeated ids would follow each other into one shard, so the components choose the shard with the id.
    return rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "q"), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(pack, PACKED)


def max_score(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, vec id, score) of the k best of a shard for each query."""
    out: list[tuple[int, int, int]] = []
    if not len(ids):
        return out
    low_c, high_c = data.min(0), data.max(0)
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, data.shape[1])
    if reach >= 2.0**62:
        raise OverflowError("components are so large that scores may leave 64 bits")
    kind = np.float64 if reach < 2.0**52 else np.int64  # whole numbers below 2**53 are exact as floats
    columns = np.ascontiguousarray(data.T.astype(kind))
    for me, q in zip(own.tolist(), queries, strict=True):
        a, b = q * low_c, q * high_c
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.argsort(low - high, kind="stable")
        q, high = q[order].astype(kind), high[order].astype(kind)
        # rest[j]: what terms j, j + 1, ... can add at most.
        rest = np.append(np.cumsum(high[::-1])[::-1], 0)
        # Shifted to start at 0, the widths left after the first terms; essential are those before the rest falls below the need.
        widths = (high - low[order]).astype(kind)
        left = np.append(np.cumsum(widths[::-1])[::-1], 0)
        floor_ = low.sum()
        best_ids, best, bar = np.empty(0, np.int64), np.empty(0, np.int64), None
        for at in range(0, len(ids), STEP):
            part = columns[:, at : at + STEP]
            if bar is None:
                essential = len(q)
            else:
                essential = int(np.searchsorted(-left, -(bar - floor_), "right"))
            essential = min(max(1, essential), len(q)) if len(q) else 0
            lanes = np.arange(part.shape[1])
            score = q[:essential] @ part[order[:essential]] if essential else np.zeros(part.shape[1], kind)
            for j in range(essential, len(q)):
                alive = score + rest[j] >= bar
                if not alive.all():
                    lanes, score = lanes[alive], score[alive]
                if not len(lanes):
                    break
                score = score + q[j] * part[order[j], lanes]
            if bar is not None:
                alive = score >= bar
                lanes, score = lanes[alive], score[alive]
            names = ids[at + lanes]
            other = names != me
            all_ids, all_scores = np.concatenate([best_ids, names[other]]), np.concatenate([best, score[other].astype(np.int64)])
            top = np.lexsort((all_ids, -all_scores))[:k]
            best_ids, best = all_ids[top], all_scores[top]
            if len(best) == k:
                bar = best[-1]
        out += zip([me] * len(best), best_ids.tolist(), best.tolist(), strict=True)
    return out


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a packed row."""
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["data"], np.int64).reshape(len(ids), row["width"])


def padded(vectors: np.ndarray, width: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def stored_blocks(files: list[str]):
    """The stored blocks of queries, one at a time."""
    from pyarrow import fs, parquet

    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            for batch in parquet.ParquetFile(f).iter_batches(1):
                yield from map(unpacked, batch.to_pylist())


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` for each of ``queries`` (both vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = quantised(vectors)
    asked = quantised(queries).groupBy("vec_id").agg(F.min("q").alias("q"))
    n, asking = rows.count(), asked.count()
    shards = max(1, -(-n // SHARD), min(partitions(spark), -(-n // 256)))
    blocks = max(1, -(-asking // BLOCK))
    files = stored(packed(asked, blocks), "queries").inputFiles()

    def run(batches):
        def met(group: list[tuple[np.ndarray, np.ndarray]]):
            for own, q in stored_blocks(files):
                found = []
                for ids, data in group:
                    width = max(data.shape[1], q.shape[1])
                    found += max_score(padded(q, width), own, ids, padded(data, width), k)
                me, vec, score = (np.array(c, np.int64) for c in (zip(*found, strict=True) if found else [[]] * 3))
                best = np.lexsort((vec, -score, me))
                me, vec, score = me[best], vec[best], score[best]
                # The place of each row among those of its query.
                keep = np.arange(len(me)) - np.searchsorted(me, me) < k
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (me, vec, score)], ["query_id", "vec_id", "score"])

        group = []
        for batch in batches:
            for x in batch.to_pylist():
                group.append(unpacked(x))
                if len(group) == GROUP:
                    yield from met(group)
                    group = []
        if group:
            yield from met(group)

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return packed(rows, shards).mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)
