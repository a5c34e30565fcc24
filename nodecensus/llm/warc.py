"""Operator 8: WARC archives from a chunked record table.

Payloads travel as rows (record_id, chunk_no, data) of at most ``CHUNK`` bytes, so no step holds a whole oversized record: the
digest of a record is carried from chunk to chunk while the table is written, and the writer copies chunk after chunk into the
archive.  Archives are gzip members, one a record, in the shared folder; the manifest (path, offset) names only files of tasks
that ended well, so a task that is run again leaves no trace in results.  Reading seeks to a record, inflates it piece by piece
and takes the digest again; a record whose payload differs from its header's digest raises.

Of records with equal payloads of at least ``least_bytes`` bytes that with the smallest page_id (then record_id) is a response,
the others are revisits that hold no payload.

Cases: null html counts as empty; a null page_id or url leaves its header out, and sorts after all others; repeated rows are
records of their own, so all but one are revisits; equal payloads shared by a third of all rows meet only as (digest, smallest
page_id) after partial aggregation; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodecensus.llm.common import new_path, new_table, partitions, stored, table

CHUNK = 64 << 10
CHUNKS = "record_id long, page_id long, url string, chunk_no int, last boolean, payload_bytes long, digest string, data binary"
MANIFEST = "path string, at long, size long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def chunk_table(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of CHUNKS; the last chunk of a record carries its length and base32 SHA-1."""
    data = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.monotonically_increasing_id().alias("record_id"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), data.alias("data"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / chunk)).cast("int")
    cut = rows.withColumn("n", count).select("record_id", "page_id", "url", "n", "data", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk_no"))
    cut = cut.select("record_id", "page_id", "url", "chunk_no", (F.col("chunk_no") == F.col("n") - 1).alias("last"), F.substring("data", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("data"))

    def digest(batches):
        sha, size = hashlib.sha1(), 0
        for batch in batches:
            lengths, digests = [], []
            for last, part in zip(batch.column("last").to_pylist(), batch.column("data"), strict=True):
                part = part.as_buffer()
                sha.update(part)
                size += len(part)
                lengths.append(size if last else None)
                digests.append(base64.b32encode(sha.digest()).decode() if last else None)
                if last:
                    sha, size = hashlib.sha1(), 0
            columns = {c: batch.column(c) for c in ("record_id", "page_id", "url", "chunk_no", "last")}
            columns |= {"payload_bytes": pa.array(lengths, pa.int64()), "digest": pa.array(digests, pa.string()), "data": batch.column("data")}
            yield pa.RecordBatch.from_pydict(columns)

    return cut.mapInArrow(digest, CHUNKS)


def kinds(chunks: DataFrame, least_bytes: int = 0) -> DataFrame:
    """record_id with its digest, length and, for revisits, the record it refers to."""
    heads = chunks.where("last").select("record_id", "page_id", "url", "payload_bytes", "digest")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "url")
    first = heads.where(F.col("payload_bytes") >= least_bytes).groupBy("digest", "payload_bytes").agg(F.min(order).alias("first"))
    both = heads.join(first.withColumnsRenamed({"digest": "_digest", "payload_bytes": "_bytes"}), (F.col("digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    again = F.col("first").isNotNull() & (F.col("first.record_id") != F.col("record_id"))
    return both.select(F.col("record_id").alias("_id"), F.col("payload_bytes").alias("all_bytes"), F.col("digest").alias("all_digest"), again.alias("revisit"), F.when(again, F.col("first.page_id")).alias("refers_to"), F.when(again, F.col("first.url")).alias("refers_url"))


def _line(name: str, value) -> bytes:
    """A header line; control characters of a value are percent-encoded."""
    if value is None:
        return b""
    text = "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in str(value))
    return f"{name}: {text}\r\n".encode()


def _header(row: dict) -> bytes:
    return b"".join(
        [
            b"WARC/1.1\r\n",
            _line("WARC-Type", "revisit" if row["revisit"] else "response"),
            _line("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(int=row['record_id'])}>"),
            _line("WARC-Date", "1970-01-01T00:00:00Z"),
            _line("WARC-Target-URI", row["url"]),
            _line("WARC-Payload-Digest", f"sha1:{row['all_digest']}"),
            _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if row["revisit"] else None),
            _line("WARC-Refers-To-Target-URI", row["refers_url"]),
            _line("X-Page-Id", row["page_id"]),
            _line("X-Refers-To-Page-Id", row["refers_to"]),
            _line("X-Payload-Length", row["all_bytes"]),
            _line("Content-Type", "text/html; charset=utf-8"),
            _line("Content-Length", 0 if row["revisit"] else row["all_bytes"]),
            b"\r\n",
        ]
    )


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(chunks: DataFrame, of: DataFrame, folder: str) -> DataFrame:
    """Writes the records and returns the manifest (MANIFEST), one row a record.  ``folder`` is a path that all executors share.

    ``chunks`` and ``of`` are dealt by part alike, so payloads are written where they are read; only ``of`` has been moved."""
    joined = chunks.join(of.hint("shuffle_hash"), (F.col("part") == F.col("_part")) & (F.col("record_id") == F.col("_id"))).where(~F.col("revisit") | (F.col("chunk_no") == 0))
    rows = joined.withColumn("data", F.when(~F.col("revisit"), F.col("data"))).drop("part", "_part").sortWithinPartitions("record_id", "chunk_no")

    def write(batches):
        task = TaskContext.get()
        own, base = _filesystem(folder)
        path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, at, packer, current, spans = None, 0, None, None, []

        def put(data) -> None:
            nonlocal at
            out.write(data)
            at += len(data)

        def close() -> None:
            put(packer.compress(b"\r\n\r\n"))
            put(packer.flush())
            spans.append((spans.pop(), at))

        for batch in batches:
            names = [c for c in batch.schema.names if c != "data"]
            for head, part in zip(batch.select(names).to_pylist(), batch.column("data"), strict=True):
                if head["record_id"] != current:
                    if current is not None:
                        close()
                    if out is None:
                        own.create_dir(base, recursive=True)
                        out = own.open_output_stream(path, compression=None)
                    current, packer = head["record_id"], zlib.compressobj(1, zlib.DEFLATED, 31)
                    spans.append(at)
                    put(packer.compress(_header(head)))
                if part.is_valid:
                    put(packer.compress(part.as_buffer()))
            if len(spans) > 10_000:
                done, spans = [x for x in spans if isinstance(x, tuple)], [x for x in spans if not isinstance(x, tuple)]
                yield _manifest(f"{folder}/{path.rpartition('/')[2]}", done)
        if out is not None:
            close()
            out.close()
            yield _manifest(f"{folder}/{path.rpartition('/')[2]}", spans)

    return rows.mapInArrow(write, MANIFEST)


def _manifest(path: str, spans: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": pa.array([path] * len(spans)), "at": pa.array([a for a, _ in spans], pa.int64()), "size": pa.array([b - a for a, b in spans], pa.int64())})


def _read_record(stream, at: int, size: int) -> dict:
    """Headers and the checked payload digest of the record at a place of an archive."""
    stream.seek(at)
    left, unpacker, head, sha, payload, want = size, zlib.decompressobj(31), b"", hashlib.sha1(), 0, None
    fields: dict[str, str] = {}
    while left:
        raw = stream.read(min(left, CHUNK))
        left -= len(raw)
        if not raw:
            raise ValueError("an archive ends inside a record")
        data = unpacker.decompress(raw)
        if want is None:
            head += data
            cut = head.find(b"\r\n\r\n")
            if cut < 0:
                continue
            for line in head[:cut].decode().split("\r\n")[1:]:
                name, _, value = line.partition(": ")
                fields[name] = value
            want, data = int(fields["Content-Length"]), head[cut + 4 :]
        data = data[: want - payload]
        sha.update(data)
        payload += len(data)
    if payload != want:
        raise ValueError("a record is shorter than its header says")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and base64.b32encode(sha.digest()).decode() != digest:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} differs from its digest")
    return fields


def read_archives(manifest: DataFrame) -> DataFrame:
    """RECORDS of the records that a manifest names."""

    def read(batches):
        opened: dict[str, object] = {}
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if x["path"] not in opened:
                    for f in opened.values():
                        f.close()
                    own, base = _filesystem(x["path"])
                    opened = {x["path"]: own.open_input_file(base)}
                f = _read_record(opened[x["path"]], x["at"], x["size"])
                number = lambda k: int(f[k]) if k in f else None  # noqa: E731, B023
                rows.append((number("X-Page-Id"), f.get("WARC-Target-URI"), number("X-Payload-Length"), f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"], number("X-Refers-To-Page-Id")))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return manifest.mapInArrow(read, RECORDS)


#: Lets a join by part and record use tables that are dealt by part alone.
BY_PART = "spark.sql.requireAllClusterKeysForCoPartition"


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes pages to archives and returns the stored manifest."""
    spark = pages.sparkSession
    n = partitions(spark)
    # A part is a partition that was read, so each task writes one file of one bucket: dealing payloads moves nothing.
    rows, name = chunk_table(pages.select("page_id", "url", "html")).withColumn("part", F.shiftright("record_id", 33)), new_table(spark, "chunks")
    rows.write.option("compression", "zstd").bucketBy(n, "part").saveAsTable(name)
    chunks, name = spark.table(name), new_table(spark, "kinds")
    kinds(chunks, least_bytes).withColumn("_part", F.shiftright("_id", 33)).repartition(n, "_part").write.option("compression", "zstd").bucketBy(n, "_part").saveAsTable(name)
    before = spark.conf.get(BY_PART)
    spark.conf.set(BY_PART, "false")
    try:
        return stored(write_archives(chunks, spark.table(name), folder or new_path(spark, "warc")), "warc-manifest")
    finally:
        spark.conf.set(BY_PART, before)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_archives(archive(table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
