"""Texts in chunks, and questions that chunks ask of the whole corpus.

Passage operators need to know which short strings of a chunk occur elsewhere.  Texts are dealt once into chunks of about
``CHUNK_BYTES`` (compressed, stored as a table bucketed by chunk, so that later joins by chunk move only the answers).  A chunk
asks by sending each *distinct* key once to the key's bucket; the bucket sees every chunk's question and answers with one bit per
key and chunk.  A key that a third of all documents share is thus sent once per chunk, not once per document, whatever the
size of the group; buckets hold hashed keys, so none grows beyond its share.  Answers come back packed, one row per chunk.

A chunk recomputes its keys when the answer arrives; it is a pure function of the stored chunk, so lost tasks are run again
with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodecensus.llm.common import new_table, partitions, text_of, utf8

CHUNK_BYTES = 2 << 20
#: Bytes of questions that one bucket is meant to hold.
BUCKET_BYTES = 24 << 20
NO_ID = np.iinfo(np.int64).max
TABLE = "chunk long, texts long, raw long, data binary, aux binary"
ASKED = "bucket long, chunk long, n long, data binary"
ANSWERED = "chunk long, bucket long, bits binary"


def pack_texts(ids: list[int | None], texts: list[bytes]) -> bytes:
    """Ids, lengths and texts as one compressed string; a missing id is NO_ID."""
    head = np.array([len(ids), *(NO_ID if x is None else x for x in ids), *map(len, texts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(3).compress(head + b"".join(texts))


def unpack_texts(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, sizes = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(2, n)
    ends = 8 + 16 * n + np.cumsum(sizes)
    return ids, [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def text_blocks(data: bytes, limit: int = 512 << 10):
    """(number of the first text, ids, texts) of runs of texts with about ``limit`` bytes; a longer text stays whole."""
    ids, texts = unpack_texts(data)
    at = size = 0
    for k, x in enumerate(texts):
        size += len(x)
        if size >= limit or k == len(texts) - 1:
            yield at, ids[at : k + 1], texts[at : k + 1]
            at, size = k + 1, 0


class Chunks:
    """A corpus dealt into chunks."""

    def __init__(self, docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, aux=None) -> None:
        """``aux`` may make further bytes of a packed chunk, so that later passes needn't work them out again."""
        spark = self.spark = docs.sparkSession

        def deal(batches):
            base, made, ids, texts, size = TaskContext.get().partitionId() << 33, 0, [], [], 0

            def row() -> pa.RecordBatch:
                data = pack_texts(ids, texts)
                return pa.RecordBatch.from_pydict({"chunk": pa.array([base + made], pa.int64()), "texts": pa.array([len(ids)], pa.int64()), "raw": pa.array([size], pa.int64()), "data": pa.array([data], pa.binary()), "aux": pa.array([aux(data) if aux else None], pa.binary())})

            for batch in batches:
                own = batch.column("doc_id").to_pylist()
                for at in range(0, len(own), 256):
                    for k, x in zip(own[at : at + 256], utf8(batch.column("text"), at, min(at + 256, len(own))), strict=True):
                        if ids and size + len(x) > chunk_bytes:
                            yield row()
                            made, ids, texts, size = made + 1, [], [], 0
                        ids.append(k)
                        texts.append(x)
                        size += len(x)
            if ids:
                yield row()

        rows = text_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(deal, TABLE)
        self.buckets = partitions(spark)
        self.name = new_table(spark, "chunks")
        rows.write.option("compression", "uncompressed").bucketBy(self.buckets, "chunk").saveAsTable(self.name)
        self.rows = spark.table(self.name)
        self.aux = aux is not None
        self.raw = int(self.rows.agg(F.sum("raw")).first()[0] or 0)

    def key_buckets(self, bytes_per_raw: float) -> int:
        """Buckets of keys for questions that take so many bytes for each byte of text."""
        return max(self.buckets, int(self.raw * bytes_per_raw / BUCKET_BYTES) + 1)

    def with_answers(self, *answers: DataFrame) -> DataFrame:
        """chunk, data and an array of answers (bucket, bits) for each of ``answers``: only these are moved."""
        out = self.rows.select("chunk", "data", *(["aux"] if self.aux else []))
        for k, x in enumerate(answers):
            own = x.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(f"answers{k}")).withColumnRenamed("chunk", f"chunk{k}")
            out = out.join(own.hint("shuffle_hash"), F.col("chunk") == F.col(f"chunk{k}"), "left").drop(f"chunk{k}")
        return out


def deal_keys(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For keys: order by bucket (stable), the buckets that occur, and where each starts (with an end)."""
    own = (keys >> np.uint64(33)).astype(np.int64) % buckets
    order = np.argsort(own.astype(np.uint16) if buckets <= 1 << 16 else own, kind="stable")  # short numbers are sorted by digits
    present, starts = np.unique(own[order], return_index=True)
    return order, present, np.append(starts, len(keys))


def pack_columns(*columns: np.ndarray) -> bytes:
    """Columns of a question: digests as they are, the others as compressed differences."""
    parts = []
    for c in columns:
        raw = c.tobytes() if c.dtype == np.uint64 else zstandard.ZstdCompressor(1).compress(np.diff(c, prepend=c.dtype.type(0)).tobytes())
        parts += [np.array([len(raw)], np.int64).tobytes(), raw]
    return b"".join(parts)


def unpack_columns(data: bytes, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int(np.frombuffer(data, np.int64, 1, at)[0])
        raw = data[at + 8 : at + 8 + n]
        at += 8 + n
        if kind == np.uint64:
            out.append(np.frombuffer(raw, kind))
        else:
            out.append(np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind), dtype=kind))
    return out


def each_row(batches):
    """The rows of Arrow batches, one at a time, so that a batch of large rows isn't held twice."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def asked_rows(chunk: int, keys: np.ndarray, columns: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """ASKED rows of one chunk: for each bucket that its keys fall into, the columns of those keys."""
    order, present, starts = deal_keys(keys, buckets)
    parts = [order[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return pa.RecordBatch.from_pydict({"bucket": pa.array(present, pa.int64()), "chunk": pa.array([chunk] * len(parts), pa.int64()), "n": pa.array([len(p) for p in parts], pa.int64()), "data": pa.array([pack_columns(*(c[p] for c in columns)) for p in parts], pa.binary())})


def answer(asked: DataFrame, decide, kinds: tuple) -> DataFrame:
    """ANSWERED: ``decide(columns)`` gets the questions of a bucket, one after the other, and returns a boolean or a small number for each key.
    Questions with nothing but zeros for an answer have none."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.select(["chunk", "n", "data"]).to_pylist()
        columns = [np.concatenate(c) for c in zip(*(unpack_columns(x["data"], *kinds) for x in rows), strict=True)]
        said = decide(*columns)
        ends = np.cumsum([x["n"] for x in rows])
        bits = [np.packbits(said[e - x["n"] : e]).tobytes() if said.dtype == bool else said[e - x["n"] : e].tobytes() for x, e in zip(rows, ends.tolist(), strict=True)]
        some = np.array([x.count(0) < len(x) for x in bits], bool)
        return pa.table({"chunk": t.column("chunk").cast(pa.int64()), "bucket": t.column("bucket").cast(pa.int64()), "bits": pa.array(bits, pa.binary())}).filter(pa.array(some))

    return asked.groupBy("bucket").applyInArrow(run, ANSWERED)


def told(keys: np.ndarray, answers: list[dict] | None, buckets: int, kind=bool) -> np.ndarray:
    """The answers, one for each of the keys that a chunk asked, in the order in which it asked them."""
    out = np.zeros(len(keys), kind)
    by = {x["bucket"]: x["bits"] for x in answers or []}
    order, present, starts = deal_keys(keys, buckets)
    for b, a, e in zip(present.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b not in by:
            continue
        raw = np.frombuffer(by[b], np.uint8)
        out[order[a:e]] = np.unpackbits(raw, count=e - a).astype(bool) if kind is bool else raw
    return out


def same_pairs(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal (h, g) are together, and where each of them begins in it."""
    order = np.argsort(h)
    x, y = h[order], g[order]
    begins, other = x[1:] != x[:-1], y[1:] != y[:-1]
    if (other & ~begins).any():  # one half is equal, the other isn't
        order = np.lexsort((g, h))
        x, y = h[order], g[order]
        begins, other = x[1:] != x[:-1], y[1:] != y[:-1]
    return order, np.append(True, begins | other)[: len(h)]


def repeated(keys: np.ndarray, several: np.ndarray) -> np.ndarray:
    """True for keys that more than one question holds, or that one holds several times."""
    order = np.argsort(keys)
    k = keys[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(np.append(first, len(k)))
    many = np.add.reduceat(several[order].astype(np.int64), first) > 0 if len(k) else np.zeros(0, bool)
    out = np.empty(len(k), bool)
    out[order] = np.repeat((size > 1) | many, size)
    return out


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value (leftmost if equal in the upper bits) of each window of ``width`` values."""
    n = len(values)
    if n < width:
        return np.empty(0, np.int64)
    bits = max(24, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    best = (values & ~low) | np.arange(n, dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: n - width + 1], best[width - size : width - size + n - width + 1])
    return (best & low).astype(np.int64)


