"""Operator 7: packing by power-of-two decomposition.

Each document's ids (with a closing id 0) are cut into pieces whose lengths are the powers of two of its length's binary form,
the longest ``max_tokens`` (itself a power of two) as often as it fits, longest first.  A piece is a sequence of its own: pieces
of equal length form a bucket whose batches hold no padding, and no sequence crosses documents.  ``sequence_id`` holds the task
in its upper bits and a running number below; ``offset`` is 0 throughout.

The work is one narrow pass: no shuffle, nothing gathered, so neither hot sources nor groups of copies matter.  Ids are those of
the ``tokenizers`` library.  Where its vocabulary is one of merge ranks over bytes, whole texts are encoded by those ranks, which
takes a third of the time; texts with the string of a special token, or with a very long run of white space (which the ranks'
pattern can't take), and all other vocabularies, go to the library itself.  The tests hold all ids against the library.

Cases: a null or empty text has the one id 0, hence one piece of length 1; very long texts give more pieces of ``max_tokens``;
repeated rows are packed each for itself with sequence ids of their own; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodecensus.llm.common import batches_of_texts, table, text_of

END_ID = 0
#: Runs of white space that are left to the library.
LONG_SPACE = re.compile(r"\s{4096}")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class RankTokenizer:
    """Ids of whole texts, by merge ranks where the tokenizer file's vocabulary is made so."""

    def __init__(self, path: str) -> None:
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.ranked = self.by_rank(path)

    @staticmethod
    def by_rank(path: str):
        """The same vocabulary as a table of ranks; None where ids aren't merge ranks."""
        import public_tokenizers
        import tiktoken

        said = json.loads(Path(path).read_text())
        model, pre = said["model"], said.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or said.get("normalizer"):
            return None
        # The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        ranks = {bytes(byte_of[c] for c in x): i for x, i in model["vocab"].items() if x not in {t["content"] for t in said.get("added_tokens", [])}}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.ranked and not any(x in text for x in self.special) and not LONG_SPACE.search(text):
            return self.ranked.encode_to_numpy(text, disallowed_special=())
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_tokenizers: dict[str, RankTokenizer] = {}


def tokenizer(path: str) -> RankTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = RankTokenizer(path)
    return _tokenizers[path]


def pieces(n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the pieces of a document of n ids, longest first."""
    bits = [1 << k for k in range(most.bit_length() - 2, -1, -1) if n >> k & 1]
    length = np.array([most] * (n // most) + bits, np.int64)
    return np.cumsum(length) - length, length


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves (array<long>).  See the module's text."""
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens has to be a power of two")

    def run(batches):
        t, made = tokenizer(tokenizer_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids_of = batch.column("doc_id")
            for at, to in batches_of_texts(batch, 1 << 20):
                own, starts, lengths, sums, totals = [], [], [], [], []
                for text in batch.column("text").slice(at, to - at).to_pylist():
                    ids = np.append(t.encode(text or ""), np.uint32(END_ID))
                    raw, (start, length) = memoryview(ids.astype("<u4", copy=False)).cast("B"), pieces(len(ids), max_tokens)
                    sums += [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(start.tolist(), length.tolist(), strict=True)]
                    starts.append(start)
                    lengths.append(length)
                    totals.append(len(ids))
                    if with_ids:
                        own.append(ids.astype(np.int64))
                count = np.array(list(map(len, starts)))
                length = np.concatenate(lengths)
                n = len(length)
                columns = [ids_of.slice(at, to - at).take(pa.array(np.repeat(np.arange(to - at), count))), np.concatenate(starts), length, np.array(sums, np.int64), np.repeat(np.array(totals, np.int64), count), made + np.arange(n), np.zeros(n, np.int64)]
                made += n
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(np.concatenate(own))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names)

    rows = text_of(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, SCHEMA + (", ids array<long>" if with_ids else ""))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)
