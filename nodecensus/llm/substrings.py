"""Operator 9: substring deduplication by level-wise doubling.

A window of ``window`` words is removed wherever its word sequence also starts earlier (smaller doc_id, or the same document and
an earlier start).  Whether a window repeats is asked level by level: first for strings of ``base`` words; only windows whose
string occurs again anywhere are asked anew with a string of twice its length, and so on until the window's length is reached or
no candidate is left.  At the lower levels not every string is asked: within each window the string with the least
digest stands for it, chosen anew at each level (equal windows choose equal strings at equal places, so no repeat is lost), which
leaves about one in eight.  At the last level all windows still alive are asked, and the answer is which chunk holds the first
occurrence.

Strings are known by digests built by doubling too: the digest of a string mixes those of its two halves.  Nothing in it is a
polynomial, so that texts made of patterns don't collide; the last level, which decides, uses 128 bits in two independent halves.

Questions and answers go by chunk (see ``chunks``): a passage that a third of all documents share costs one key per chunk.

Cases: null texts have no words; texts shorter than a window lose nothing; a document's repeats of its own windows count, the
first stays; rows that repeat a doc_id count as one place (same doc_id and start is not earlier), so equal rows get equal
results; a null doc_id comes after all others; very long texts are taken whole (some 25 bytes of memory a byte); empty tables give no rows; other columns aren't
read, and ``dedup_documents`` returns them unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodecensus.llm.chunks import ASKED, NO_ID, Chunks, answer, asked_rows, each_row, repeated, same_pairs, text_blocks, told, window_minima
from nodecensus.llm.common import join_texts, stored, strings_of, table, word_bounds, word_digests

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
TEXTS = "doc_id long, text string, n_words long, n_removed long, digest string"


class Words:
    """The words of a block of texts: bounds, and digests of word strings by doubling."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data, self.bounds = join_texts(texts)
        self.start, self.end, self.first = word_bounds(self.data, self.bounds)
        self.count = np.diff(self.first)
        self.made: dict[tuple[int, int], np.ndarray] = {}

    def strings(self, length: int, half: int = 0) -> np.ndarray:
        """Digests of the ``length`` words from each word on; those that cross texts mean nothing."""
        if (1, half) not in self.made:
            self.made[1, half] = word_digests(self.data, self.start, self.end, half)
        if (length, half) not in self.made:
            self.made[length, half] = strings_of(self.made[1, half], length, half)
        return self.made[length, half]

    def windows(self, length: int) -> np.ndarray:
        """Start (word number in the block) of every window that lies within one text."""
        n = len(self.start)
        own = np.repeat(np.arange(len(self.count)), self.count)
        at = np.arange(max(0, n - length + 1))
        return at[at + length <= self.first[own[at] + 1]] if len(at) else at


def _anchors(w: Words, alive: np.ndarray, window: int, length: int) -> np.ndarray:
    """For each of the windows the start of the string of ``length`` words within it that stands for it."""
    return window_minima(w.strings(length), window - length + 1)[alive] if len(alive) else alive


def _level(blocks: list[Words], window: int, lengths: list[int], answers: list, buckets: list[int], upto: int):
    """Windows per block that survive the levels before ``upto``, and that level's questions: the sorted distinct digests of their
    anchors, whether each occurs several times, and which of them is whose."""
    alive = [w.windows(window) for w in blocks]
    for level, length in enumerate(lengths[: upto + 1]):
        own, which = [], []
        for w, at in zip(blocks, alive, strict=True):
            anchors = _anchors(w, at, window, length)  # they never go back
            new = np.append(True, anchors[1:] != anchors[:-1])[: len(anchors)]
            which.append(np.cumsum(new) - 1)
            own.append(w.strings(length)[anchors[new]] if len(at) else np.empty(0, np.uint64))
        keys, inverse, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *own]), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(x) for x in own])
        which = [inverse[e - len(x) : e][k] for x, e, k in zip(own, ends.tolist(), which, strict=True)]
        if level == upto:
            return alive, which, keys, counts > 1
        good = told(keys, answers[level], buckets[level])
        alive = [at[good[k]] for at, k in zip(alive, which, strict=True)]
    raise AssertionError


class Places:
    """All surviving windows of a chunk: digests, and places (text and start as one number, in the order of doc_ids)."""

    def __init__(self, blocks: list[Words], ids: list[np.ndarray], window: int, alive: list[np.ndarray]) -> None:
        all_ids = np.concatenate([np.empty(0, np.int64), *ids])
        self.ids, rank = np.unique(all_ids, return_inverse=True)
        h, g, place, at_text = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        for w, own, at in zip(blocks, ids, alive, strict=True):
            if len(at):
                text = np.searchsorted(w.first, at, "right") - 1
                h.append(w.strings(window)[at])
                g.append(w.strings(window, 1)[at])
                place.append(rank[at_text + text] << 32 | (at - w.first[text]))
            at_text += len(own)
        h, g, self.place = np.concatenate(h), np.concatenate(g), np.concatenate(place)
        order, new = same_pairs(h, g)
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(self.place[order], first) if len(first) else self.place
        # Distinct windows in the order of their first places, where ids and starts have small differences.
        rank = np.argsort(least)
        back = np.empty(len(rank), np.int64)
        back[rank] = np.arange(len(rank))
        self.group = np.empty(len(h), np.int64)
        self.group[order] = back[np.cumsum(new) - 1]
        lead = order[first[rank]]
        self.h, self.g, self.first = h[lead], g[lead], least[rank]

    def columns(self) -> list[np.ndarray]:
        return [self.h, self.g, self.ids[self.first >> 32], self.first & np.int64((1 << 32) - 1)]


def _is_first(h: np.ndarray, g: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True for the questions of a bucket that hold the first place of their digest."""
    order, new = same_pairs(h, g)
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    out = np.empty(len(h), bool)
    if len(h):
        d, s = doc[order], start[order]
        early = d == np.minimum.reduceat(d, first)[group]
        out[order] = early & (s == np.minimum.reduceat(np.where(early, s, NO_ID), first)[group])
    return out


def _load(data: bytes):
    blocks, ids = [], []
    for _, own, texts in text_blocks(data):
        blocks.append(Words(texts))
        ids.append(own)
    return blocks, ids


def _levels(window: int, base: int) -> list[int]:
    """Lengths below the window's, each twice the one before."""
    if not 0 < base < window:
        raise ValueError("base has to be shorter than the window")
    out = [base]
    while out[-1] * 2 < window:
        out.append(out[-1] * 2)
    return out


def _run(docs: DataFrame, window: int, base: int, with_text: bool) -> DataFrame:
    chunks, lengths = Chunks(docs), _levels(window, base)
    buckets, answers = [], []
    schema = TEXTS if with_text else SCHEMA

    for level in range(len(lengths)):
        n = chunks.key_buckets(0.25)

        def ask(rows, level=level, n=n, buckets=tuple(buckets)):
            for x in each_row(rows):
                blocks, _ = _load(x["data"])
                _, _, keys, several = _level(blocks, window, lengths, [x[f"answers{k}"] for k in range(level)], buckets, level)
                yield asked_rows(x["chunk"], keys, [keys, several.astype(np.uint8)], n)

        asked = chunks.with_answers(*answers).mapInArrow(ask, ASKED)
        answers.append(stored(answer(asked, repeated, (np.uint64, np.uint8)), f"substrings-level{level}"))
        buckets.append(n)
        if answers[-1].isEmpty():  # no string of this length occurs again

            def untouched(rows):
                for x in each_row(rows):
                    for w, own in zip(*_load(x["data"]), strict=True):
                        yield _kept(w, own, np.empty(0, np.int64), window, with_text)

            return chunks.with_answers().mapInArrow(untouched, schema)

    n, lower = chunks.key_buckets(0.5), tuple(buckets)

    def survivors(x):
        blocks, ids = _load(x["data"])
        said, last = [x[f"answers{k}"] for k in range(len(lengths))], len(lengths) - 1
        alive, which, keys, _ = _level(blocks, window, lengths, said, lower, last)
        good = told(keys, said[last], lower[last])
        alive = [at[good[k]] for at, k in zip(alive, which, strict=True)]
        for w in blocks:  # only the digests of windows are needed from here on
            w.made.clear()
        return blocks, ids, alive

    def ask_last(rows):
        for x in each_row(rows):
            blocks, ids, alive = survivors(x)
            p = Places(blocks, ids, window, alive)
            yield asked_rows(x["chunk"], p.h, p.columns(), n)

    asked = chunks.with_answers(*answers).mapInArrow(ask_last, ASKED)
    answers.append(stored(answer(asked, _is_first, (np.uint64, np.uint64, np.int64, np.int64)), "substrings-last"))

    def remove(rows):
        for x in each_row(rows):
            blocks, ids, alive = survivors(x)
            p = Places(blocks, ids, window, alive)
            said = told(p.h, x[f"answers{len(lengths)}"], n)
            gone = ~(said[p.group] & (p.place == p.first[p.group]))
            at = 0
            for w, own, windows in zip(blocks, ids, alive, strict=True):
                yield _kept(w, own, windows[gone[at : at + len(windows)]], window, with_text)
                at += len(windows)

    return chunks.with_answers(*answers).mapInArrow(remove, schema)


def _kept(w: Words, ids: np.ndarray, windows: np.ndarray, window: int, with_text: bool) -> pa.RecordBatch:
    """Result rows of a block after the windows (start words) are gone."""
    n = len(w.start)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, windows, 1)
    np.add.at(cover, windows + window, -1)
    keep = np.cumsum(cover[:-1]) == 0
    # Each kept word with the byte behind it, which becomes the space between words.
    edge = np.zeros(len(w.data) + 1, np.int32)
    edge[w.start[keep]] += 1
    edge[w.end[keep] + 1] -= 1
    take = np.cumsum(edge[:-1]) > 0
    data = w.data.copy()
    data[w.end] = 0x20
    out = data[take].tobytes()
    size = np.append(0, np.cumsum(take))[w.bounds]
    texts = [out[a : max(a, b - 1)] for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
    removed = np.add.reduceat(np.append(~keep, False).astype(np.int64), w.first[:-1]) * (w.count > 0)
    doc = pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64())
    counts = {"n_words": pa.array(w.count, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
    if with_text:
        # Of the texts that lose words, so that their rows are found again by more than a doc_id.
        before = [hashlib.sha256(w.data[a : b - 1].tobytes()).hexdigest() if k else None for a, b, k in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), removed.tolist(), strict=True)]
        return pa.RecordBatch.from_pydict({"doc_id": doc, "text": pa.array([t.decode() for t in texts])} | counts | {"digest": pa.array(before, pa.string())})
    return pa.RecordBatch.from_pydict({"doc_id": doc} | counts | {"kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts])})


def dedup(docs: DataFrame, window: int = 20, base: int = 5) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256.  See the module's text."""
    return _run(docs, window, base, False)


def dedup_documents(docs: DataFrame, window: int = 20, base: int = 5) -> DataFrame:
    """docs with ``text`` replaced by the kept words joined by one space where words were removed; other columns as they are.

    What a row keeps depends on its doc_id and text alone, so rows are found again by both: others with the same doc_id, or
    without any, keep their own texts.
    """
    changed = _run(docs, window, base, True).where(F.col("n_removed") > 0).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("text").alias("_text")).dropDuplicates(["_id", "_digest"])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.sha2(F.col("text").cast("string").cast("binary"), 256) == F.col("_digest"))
    joined = docs.join(stored(changed, "substrings-texts"), same, "left")
    return joined.withColumn("text", F.coalesce("_text", F.col("text"))).select(*docs.columns)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), 20, 5)
