"""Operator 1: suffix-array deduplication with the difference-cover algorithm.

Each byte covered by a ``window``-byte string that also starts anywhere else is removed; windows don't cross texts.

*Ranges of suffixes.*  Suffixes have to be compared only where their first ``window`` bytes may be equal.  In each window the
``GRAM``-byte string with the least digest (its anchor) is chosen; equal windows choose equal anchors at equal places.  The
windows with one anchor form a segment; its key is the anchor with ``SIDE`` more bytes on the side where all those windows have
them.  Equal windows thus lie in segments with equal keys, so the suffixes are sorted key by key, in parallel.

*Copies.*  Equal segments are told apart from single ones first, by 128-bit digests (see ``chunks``): each chunk sends each
distinct segment once.  A segment that occurs again is removed whole; only its first occurrence goes on, and only if other
segments share its key.

*Suffix arrays.*  The segments that share keys with different ones are shipped to their keys' buckets, and there their suffixes are
sorted by difference covers: the triples at two of three places are sorted and named, the names' own suffixes are ranked by
recursion (three times the length at each level, no further than the window), the remaining suffixes are merged by their
first symbols and the ranks behind, and then neighbours in the sorted order are compared over ``window`` bytes.  The segments of a key
with very many different ones are shipped in parts of ``PART`` windows with keys of ``window - PART + 1`` bytes, so that they are
dealt over many buckets.

Cases: null texts count as empty; texts shorter than a window lose nothing; overlaps and repeats within a document count;
repeated rows are occurrences of their own (both lose their bytes); very long texts are taken whole, a chunk each;
ties need no rule, since all occurrences go; empty tables give no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodecensus.llm.chunks import ASKED, NO_ID, Chunks, answer, asked_rows, each_row, same_pairs, text_blocks, told, window_minima
from nodecensus.llm.common import BYTE_VALUES, ODD, Rolling, chained, join_texts, mix, partitions, stored, table

GRAM = 32
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SHIPPED = "bucket long, chunk long, data binary"
FOUND = "chunk long, number binary, bits binary"
#: Bytes of text whose suffixes are sorted at once (more only where one key has more).
SORT_BYTES = 1 << 20
COPY, SHIP, HOT = 1, 2, 4
#: Different segments of a key from which on they are shipped in parts of up to PART windows, with longer keys.
MANY, PART = 2048, 16
_rolling = Rolling(11)  # chooses anchors; digests of segments are ``Bytes.digests``


def ranks(t: np.ndarray, reach: int, span: int = 1) -> np.ndarray:
    """Rank of every suffix of t (symbols of at least 1), equal only for suffixes equal over at least ``reach`` characters.

    ``span`` is the number of characters that a symbol stands for.
    """
    n = len(t)
    if n < 3:
        order = sorted(range(n), key=lambda i: t[i:].tolist())
        out = np.empty(n, np.int64)
        out[order] = np.arange(1, n + 1)
        return out
    s = np.concatenate([t, np.zeros(3, np.int64)])
    # Sort the sampled triples and name them.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    pair = dense(s[sample] << 32 | s[sample + 1])
    names = dense(pair << 32 | s[sample + 2]) + 1
    rank = np.zeros(n + 3, np.int64)
    if int(names.max()) < len(names) and span * 3 < reach:
        names = ranks(names, reach, span * 3)
    rank[sample] = names
    rank[n:] = 0
    # Merge the remaining suffixes: by symbol and the rank behind, or by two symbols and the rank behind.
    rest, one, two = np.arange(0, n, 3), one[one < n], two
    by_one = lambda at: s[at] << 32 | rank[at + 1]
    both = np.concatenate([rest, two])
    by_two = dense(s[both] << 32 | s[both + 1]) << 32 | rank[both + 2]
    of_rest, of_one, of_two = in_order(by_one(rest)), in_order(by_one(one)), in_order(by_two[len(rest) :])
    rest_two, sampled = in_order(by_two[: len(rest)]), np.sort(rank[np.concatenate([one, two])])
    out = np.empty(n, np.int64)
    out[rest] = below(of_rest[1], of_rest) + below(of_one[1], of_rest) + below(of_two[1], rest_two)
    out[one] = below(sampled, in_order(rank[one])) + below(of_rest[1], of_one)
    out[two] = below(sampled, in_order(rank[two])) + below(rest_two[1], of_two)
    return out + 1


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, and the keys in it."""
    order = np.argsort(keys)
    return order, keys[order]


def below(among: np.ndarray, asked: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of the sorted ``among`` are less than each of the keys asked about: searched in their order, which is many times
    faster than by chance."""
    out = np.empty(len(asked[0]), np.int64)
    out[asked[0]] = np.searchsorted(among, asked[1], "left")
    return out


def dense(keys: np.ndarray) -> np.ndarray:
    """Each key's place among the distinct keys."""
    order, k = in_order(keys)
    out = np.empty(len(k), np.int64)
    out[order] = np.cumsum(np.append(False, k[1:] != k[:-1]))
    return out


def repeated_windows(segments: list[bytes], copies: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment, which of its windows also start elsewhere; ``copies`` marks segments that occur more than once."""
    t = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 2
    ends = np.cumsum([len(x) for x in segments])
    starts = np.append(0, ends[:-1])
    text = np.insert(t, ends[:-1], 1) if len(ends) > 1 else t  # 1 parts the segments
    starts = starts + np.arange(len(segments))
    rank = ranks(text, window)
    begin = np.zeros(len(text), bool)
    size = np.array([len(x) - window + 1 for x in segments])
    own = np.repeat(np.arange(len(segments)), size)
    at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + starts[own]
    begin[at] = True
    order = np.argsort(rank)
    order = order[begin[order]]
    # Compare the prefixes of neighbours.
    same = equal_prefixes(text, order[:-1], order[1:], window) if len(order) > 1 else np.zeros(0, bool)
    again = np.append(False, same) | np.append(same, False)
    group = np.cumsum(np.append(False, ~same)) if len(order) else np.zeros(0, np.int64)
    twice = np.zeros(len(text), bool)
    marked = np.zeros(len(text), bool)
    marked[at] = copies[own]
    some = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
    np.logical_or.at(some, group, marked[order])
    twice[order] = again | some[group]
    return [twice[a : a + n] for a, n in zip(starts.tolist(), size.tolist(), strict=True)]


def equal_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether text[a:a+length] equals text[b:b+length]: eight bytes at a time, only for pairs still equal."""
    words = np.zeros(len(text) + 8, np.uint64)
    for k in range(8):
        words[: len(text) - k] |= (text[k:].astype(np.uint64) - np.uint64(2) & np.uint64(255)) << np.uint64(8 * k)
    out = np.ones(len(a), bool)
    alive = np.arange(len(a))
    for k in [*range(0, length - 7, 8), length - 8]:
        hit = words[a[alive] + k] == words[b[alive] + k]
        out[alive[~hit]] = False
        alive = alive[hit]
    return out


class Bytes:
    """A block of texts as bytes, and the number that each eight of them make."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data, self.bounds = join_texts(texts)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        self.words = np.ndarray((len(self.data),), "<u8", padded, strides=(1,))

    def digests(self, at: np.ndarray, length: int) -> np.ndarray:
        """Digests of the ``length`` bytes (8 at least) from each place on."""
        return self._chained(at, length)[0]

    def _chained(self, at: np.ndarray, length: int, halves: int = 1) -> list[np.ndarray]:
        """Both halves of digests: eight bytes after the other, each step mixed."""
        odd = [x + 2 * length for x in ODD[:halves]]
        out = [np.full(len(at), x, np.uint64) for x in odd]
        for k in [*range(0, length - 8, 8), length - 8]:
            word = self.words[at + k]
            out = [chained(x, word, o) for x, o in zip(out, odd, strict=True)]
        return out

    def segments(self, first: np.ndarray, count: np.ndarray, window: int) -> list[np.ndarray]:
        """Both halves of the digests of segments of ``count`` windows: that of the first window, then what follows it."""
        out = [chained(x, count.astype(np.uint64), o) for x, o in zip(self._chained(first, window, 2), ODD, strict=True)]
        end = first + count + window - 1
        at, open_ = first + window, np.flatnonzero(count > 1)
        while len(open_):
            word = self.words[np.minimum(at[open_], end[open_] - 8)]
            for x, odd in zip(out, ODD, strict=True):
                x[open_] = chained(x[open_], word, odd)
            at[open_] += 8
            open_ = open_[at[open_] < end[open_]]
        return out


def segments_of(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and key's start of each segment of a block."""
    data, bounds = join_texts(texts)
    n, side = len(data), (window - GRAM) // 2
    empty = np.empty(0, np.int64)
    if n < window:
        return empty, empty, empty
    sums = _rolling.sums(BYTE_VALUES[data])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * _rolling.inverses[: n - GRAM + 1])
    anchor = window_minima(grams, window - GRAM + 1)
    at = np.arange(len(anchor))
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))[: len(anchor)]
    inside = at + window < bounds[text + 1]
    at, anchor, text = at[inside], anchor[inside], text[inside]
    if not len(at):
        return empty, empty, empty
    left = anchor - at >= side
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    key = np.where(left[first], anchor[first] - side, anchor[first])
    return at[first], np.diff(np.append(first, len(at))), key


def _aux(window: int):
    def make(data: bytes) -> bytes:
        out = []
        for _, _, texts in text_blocks(data):
            first, count, key = segments_of(texts, window)
            out.append((np.diff(first, prepend=0).astype(np.int32), count.astype(np.uint16 if window < 60_000 else np.int64), (key - first).astype(np.int16 if window < 30_000 else np.int64)))
        return zstandard.ZstdCompressor(3).compress(pickle.dumps(out))

    return make


class Asked:
    """A chunk's distinct segments, in the order in which they are asked: sorted by key, then digest."""

    def __init__(self, data: bytes, aux: bytes, window: int) -> None:
        stored_segments = pickle.loads(zstandard.ZstdDecompressor().decompress(aux))  # noqa: S301  written by this module
        self.window, self.blocks, self.ids, own, first, count = window, [], [], [], [], []
        key, h, g, at_key = [], [], [], []
        width = GRAM + (window - GRAM) // 2
        for k, ((_, ids, texts), (d, c, o)) in enumerate(zip(text_blocks(data), stored_segments, strict=True)):
            b = Bytes(texts)
            a = np.cumsum(d, dtype=np.int64)
            c, at = c.astype(np.int64), a + o
            self.blocks.append(b)
            self.ids.append(ids)
            own.append(np.full(len(a), k))
            first.append(a)
            count.append(c)
            key.append(b.digests(at, width))
            of = b.segments(a, c, window)
            h.append(of[0])
            g.append(of[1])
            at_key.append(at)
        self.block, self.first, self.count, self.at_key = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (own, first, count, at_key))
        key, h, g = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (key, h, g))
        # A segment's digest tells its key too, so the first half sorts and the second is only looked at where the first is equal.
        order, new = same_pairs(h, g)
        self.lead = order[np.flatnonzero(new)]
        self.group = np.empty(len(key), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.key, self.h, self.g = key[self.lead], h[self.lead], g[self.lead]
        self.several = np.bincount(self.group, minlength=len(self.lead)) > 1 if len(key) else np.zeros(0, bool)

    def parts(self, number: int, hot: bool) -> list[tuple[int, int, bytes]]:
        """(key, number of the first window, bytes) of a segment, whole or, if its key is hot, in parts.

        A part has the windows that start from PART * c to PART * c + PART - 1 bytes before the key's place.  The bytes that they
        all have, window - PART + 1 of them, are its key; equal windows lie in parts with equal keys.
        """
        k = self.lead[number]
        b, a, n, at = self.blocks[int(self.block[k])], int(self.first[k]), int(self.count[k]), int(self.at_key[k])
        if not hot:
            return [(int(self.key[number]), 0, b.data[a : a + n + self.window - 1].tobytes())]
        out, to = [], n
        while to > 0:  # from the last window, which is the nearest to the key's place
            c = (at - (a + to - 1)) // PART
            start = max(0, at - PART * c - PART + 1 - a)
            key = int(b.digests(np.array([at - PART * c]), self.window - PART + 1)[0])
            out.append((int(mix(np.array([key + c], np.uint64))[0]), start, b.data[a + start : a + to + self.window - 1].tobytes()))
            to = start
        return out


def _decide(key: np.ndarray, h: np.ndarray, g: np.ndarray, several: np.ndarray, many: int = MANY) -> np.ndarray:
    """COPY for segments that occur more than once; SHIP for the first question about a segment whose key has others, and HOT if it
    has very many."""
    order, new = same_pairs(h, g)
    group, lead = np.cumsum(new) - 1, order[np.flatnonzero(new)]
    times = np.bincount(group, minlength=len(lead)) > 1
    copies = times | (np.bincount(group, weights=several[order], minlength=len(lead)) > 0)
    _, which, kinds = np.unique(key[lead], return_inverse=True, return_counts=True)
    of_key = kinds[which]
    out = np.zeros(len(key), np.uint8)
    out[order] = copies[group] * COPY
    out[lead] += ((of_key > 1) * SHIP + (of_key >= many) * HOT).astype(np.uint8)
    return out


def dedup(docs: DataFrame, window: int = 200, many: int = MANY) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.  See the module's text."""
    if window < GRAM + 8:
        raise ValueError(f"windows need at least {GRAM + 8} bytes")
    chunks = Chunks(docs, aux=_aux(window))
    n = chunks.key_buckets(0.5)
    m = chunks.key_buckets(1.0)

    def ask(batches):
        for x in each_row(batches):
            q = Asked(x["data"], x["aux"], window)
            yield asked_rows(x["chunk"], q.key, [q.key, q.h, q.g, q.several.astype(np.uint8)], n)

    first = stored(answer(chunks.with_answers().mapInArrow(ask, ASKED), lambda *c: _decide(*c, many), (np.uint64, np.uint64, np.uint64, np.uint8)), "suffixes-segments")

    def ship(batches):
        for x in each_row(batches):
            q = Asked(x["data"], x["aux"], window)
            said = told(q.key, x["answers0"], n, np.uint8)
            rows = [(number, start, key, bool(said[number] & COPY), part) for number in np.flatnonzero(said & SHIP).tolist() for key, start, part in q.parts(number, bool(said[number] & HOT))]
            if not rows:
                continue
            number, start, key, copy = (np.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[:4], (np.int64, np.int64, np.uint64, bool), strict=True))
            bucket = (key >> np.uint64(20)).astype(np.int64) % m
            order = np.argsort(bucket, kind="stable")
            present, starts = np.unique(bucket[order], return_index=True)
            data = []
            for a, e in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
                part = order[a:e]
                data.append(zstandard.ZstdCompressor(3).compress(pickle.dumps((number[part], start[part], key[part], copy[part], [rows[k][4] for k in part.tolist()]))))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(present, pa.int64()), "chunk": pa.array([x["chunk"]] * len(data), pa.int64()), "data": pa.array(data, pa.binary())})

    def sort(t: pa.Table) -> pa.Table:
        rows = t.select(["chunk", "data"]).to_pylist()
        loaded = [pickle.loads(zstandard.ZstdDecompressor().decompress(x["data"])) for x in rows]  # noqa: S301  written above
        key, copies = (np.concatenate([x[k] for x in loaded]) for k in (2, 3))
        texts = [s for x in loaded for s in x[4]]
        order = np.argsort(key, kind="stable")
        sizes = np.array([len(s) for s in texts])[order]
        bits: list = [None] * len(texts)
        heads = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        at = 0
        while at < len(order):
            # Whole keys with about SORT_BYTES together.
            far = at + int(np.searchsorted(np.cumsum(sizes[at:]), SORT_BYTES)) + 1
            to = int(heads[np.searchsorted(heads, far)]) if far <= heads[-1] else len(order)
            part = order[at:to]
            for k, x in zip(part.tolist(), repeated_windows([texts[k] for k in part.tolist()], copies[part], window), strict=True):
                bits[k] = np.packbits(x).tobytes()
            at = to
        out, at = [], 0
        for x, (numbers, start, _, own, _) in zip(rows, loaded, strict=True):
            single = [(i, a, b) for i, a, c, b in zip(numbers.tolist(), start.tolist(), own.tolist(), bits[at : at + len(numbers)], strict=True) if not c and b.count(0) < len(b)]
            at += len(numbers)
            if single:
                out.append((x["chunk"], np.array([y[:2] for y in single], np.int64).tobytes(), pickle.dumps([b for _, _, b in single])))
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["chunk", "number", "bits"])

    # Few bytes make much work here, so buckets are dealt over all tasks whatever their bytes.
    shipped = chunks.with_answers(first).mapInArrow(ship, SHIPPED).repartition(partitions(docs.sparkSession), "bucket")
    second = stored(shipped.groupBy("bucket").applyInArrow(sort, FOUND), "suffixes-windows").select("chunk", F.col("number").alias("bucket"), "bits")

    def remove(batches):
        for x in each_row(batches):
            q = Asked(x["data"], x["aux"], window)
            said = told(q.key, x["answers0"], n, np.uint8)
            covers = [np.zeros(len(b.data) + 1, np.int32) for b in q.blocks]
            whole = (said[q.group] & COPY) > 0 if len(q.group) else np.zeros(0, bool)
            for k, cover in enumerate(covers):
                hit = whole & (q.block == k)
                np.add.at(cover, q.first[hit], 1)
                np.subtract.at(cover, q.first[hit] + q.count[hit] + window - 1, 1)
            for found in x["answers1"] or []:
                for (number, start), bits in zip(np.frombuffer(found["bucket"], np.int64).reshape(-1, 2).tolist(), pickle.loads(found["bits"]), strict=True):  # noqa: S301
                    k = q.lead[number]
                    at = int(q.first[k]) + start + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))
                    cover = covers[int(q.block[k])]
                    np.add.at(cover, at, 1)
                    np.subtract.at(cover, at + window, 1)
            for b, ids, cover in zip(q.blocks, q.ids, covers, strict=True):
                yield _kept(b, ids, np.cumsum(cover[:-1]) > 0)

    return chunks.with_answers(first, second).mapInArrow(remove, SCHEMA)


def _kept(b: Bytes, ids: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    """Result rows of a block from the bytes removed; the byte behind each text is no part of it."""
    keep = ~gone
    keep[b.bounds[1:] - 1] = False
    kept = b.data[keep].tobytes()
    at = np.append(0, np.cumsum(keep))[b.bounds]
    gone[b.bounds[1:] - 1] = False
    runs = np.append(0, np.cumsum(gone & ~np.append(False, gone[:-1])))[b.bounds]
    removed = np.append(0, np.cumsum(gone))[b.bounds]
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64()),
            "n_bytes": pa.array(np.diff(b.bounds) - 1, pa.int64()),
            "n_removed": pa.array(np.diff(removed), pa.int64()),
            "n_spans": pa.array(np.diff(runs), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]),
        }
    )


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), 200)
