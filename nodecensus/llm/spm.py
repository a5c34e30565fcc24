"""Operator 6: SentencePiece encoding and decoding of merge-type vocabularies.

Encoding keeps a *score-ordered agenda* of adjacent symbol pairs: the pair whose merged piece has the best score (ties:
leftmost) is merged first; its new neighbours join the agenda; entries whose symbols have since been merged are stale and
skipped.  Symbols that are no piece become byte pieces.

No piece of such a vocabulary has a word mark after another character (checked when the model is loaded; if one has, whole
text is encoded as one unit), so merges never cross from one word into the next and words are encoded apart.  Each
worker remembers the words it has encoded (bounded; see ``CACHE_WORDS``), and every newly encoded word is compared with the
library's answer in the same Arrow batch; a difference raises.  Decoding is the library's ``decode``.

Cases: a null text counts as empty; an empty text has no tokens and decodes to ""; texts of any length are taken whole; rows
repeat in the result as they do in the input; only ``doc_id`` and ``text`` are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nodecensus.llm.common import batches_of_texts, table, text_of

MARK = "▁"
#: Words a worker remembers at most; the older half goes when full, which changes no result.
CACHE_WORDS = 1_000_000
#: Symbols up to which units are merged together, a matrix holding their agendas; beyond, each has a heap.
SHORT, NEVER, NO_PAIR = 48, float("inf"), 1 << 40
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


RUNS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


def is_identity(path: str) -> bool:
    from sentencepiece import sentencepiece_model_pb2

    said = sentencepiece_model_pb2.ModelProto()
    said.ParseFromString(Path(path).read_bytes())
    spec = said.normalizer_spec
    return not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not said.trainer_spec.treat_whitespace_as_suffix


class MergeModel(dict):
    """A loaded model: pieces with scores, the library's processor, and as a dictionary the ids of the words met so far."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        self.pieces, self.bytes = {}, {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.pieces[piece] = (lib.get_score(i), i)
        self.unknown = lib.unk_id()
        self.costs = {x: -score for x, (score, _) in self.pieces.items()}
        self.by_word = not any("\n" in x or re.search(f"[^{MARK}]{MARK}", x) for x in self.pieces)
        self.unchecked: dict[str, str] = {}
        self.width = self.library.get_piece_size()
        self.written = [f"{i}," for i in range(self.width)]
        rank = {c: k for k, c in enumerate(sorted(set(self.costs.values())))}
        pairs = sorted((self.pieces[x[:k]][1] * self.width + self.pieces[x[k:]][1], rank[-score], i) for x, (score, i) in self.pieces.items() for k in range(1, len(x)) if x[:k] in self.pieces and x[k:] in self.pieces)
        self.pair_keys, self.pair_ranks, self.pair_ids = np.array(pairs or [(-2, 0, 0)], np.int64).T.copy()
        #: True where normalising only marks spaces: then it needn't be asked for each text.
        self.identity = is_identity(path)

    def merge(self, text: str) -> list[int]:
        """Ids of a normalised text by the agenda: the best pair first, ties leftmost."""
        symbols = list(text)
        ids: list[int] = []
        for x in self.merge_symbols(symbols):
            if (found := self.pieces.get(x)) is not None:
                ids.append(found[1])
            elif self.bytes:
                ids += [self.bytes[v] for v in x.encode()]
            else:
                ids.append(self.unknown)
        return ids

    def merge_symbols(self, symbols: list[str]) -> list[str]:
        costs, n = self.costs, len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (found := costs.get(both := symbols[a] + symbols[b])) is not None:
                heapq.heappush(agenda, (found, a, b, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, both = heapq.heappop(agenda)
            if right[a] != b or not symbols[a] or symbols[a] + symbols[b] != both:
                continue
            symbols[a], symbols[b] = both, ""
            right[a] = after = right[b]
            if after >= 0:
                left[after] = a
            offer(left[a], a)
            offer(a, after)
        return [x for x in symbols if x]

    def learn(self, units: set[str]) -> None:
        """Encode the units that are new: short ones together, step by step, longer ones alone."""
        new = list(units - self.keys())
        if len(self) + len(new) > CACHE_WORDS:
            for w in list(islice(self, len(self) // 2)):
                del self[w]
            new = list(units - self.keys())
        normal = [u if u == "\n" else u[1:] if u[0] == "\n" else MARK + u for u in new]
        short = [k for k, x in enumerate(normal) if len(x) <= SHORT and "\0" not in x]
        short.sort(key=lambda k: len(normal[k]))
        joined = {k: "".join(f"{i}," for i in self.merge(normal[k])) for k in set(range(len(new))) - set(short)}
        for at in range(0, len(short), 4096):
            part = short[at : at + 4096]
            joined.update(zip(part, self.merge_together([normal[k] for k in part]), strict=True))
        for k, unit in enumerate(new):
            self[unit] = joined[k]
            if normal[k] != MARK:
                self.unchecked[normal[k]] = joined[k]

    def merge_together(self, texts: list[str]) -> list[str]:
        """Ids (decimal, a comma after each) of texts of like length: a matrix of symbols with an agenda in each row."""
        width = len(texts[-1])
        chars = np.frombuffer("".join(x.ljust(width, "\0") for x in texts).encode("utf-32-le"), np.uint32).reshape(len(texts), width)
        distinct, which = np.unique(chars, return_inverse=True)
        # Symbols: ids of pieces; -1 past the end; below that, characters that are no piece.
        own = [-1 if not c else self.pieces[chr(c)][1] if chr(c) in self.pieces else -2 - int(c) for c in distinct]
        symbols = np.array(own, np.int64)[which.reshape(chars.shape)]
        agenda, _ = self.pair(symbols[:, :-1], symbols[:, 1:])
        rows, done = np.arange(len(texts)), [None] * len(texts)
        columns = np.arange(width)
        while len(rows):
            best = agenda.argmin(1) if agenda.shape[1] else np.zeros(len(rows), np.int64)
            open_ = agenda[np.arange(len(rows)), best] < NO_PAIR if agenda.shape[1] else np.zeros(len(rows), bool)
            for k in np.flatnonzero(~open_).tolist():
                done[rows[k]] = symbols[k]
            rows, symbols, agenda, best = rows[open_], symbols[open_], agenda[open_], best[open_]
            if not len(rows):
                break
            r = np.arange(len(rows))
            _, merged = self.pair(symbols[r, best], symbols[r, best + 1])
            take = np.minimum(columns[None, :] + (columns[None, :] > best[:, None]), width - 1)
            symbols = np.take_along_axis(symbols, take, 1)
            symbols[:, -1] = -1
            symbols[r, best] = merged
            agenda = np.take_along_axis(agenda, take[:, : width - 1].clip(max=width - 2), 1)
            agenda[:, -1] = NO_PAIR
            before, after = np.maximum(best - 1, 0), np.minimum(best + 1, width - 1)
            agenda[r, best.clip(max=width - 2)] = self.pair(symbols[r, best], np.where(best + 1 < width, symbols[r, after], -1))[0]
            agenda[r[best > 0], before[best > 0]] = self.pair(symbols[r, before], symbols[r, best])[0][best > 0]
        write, bytes_of = self.written, lambda s: "".join(f"{self.bytes[v]}," for v in chr(-2 - s).encode()) if self.bytes else f"{self.unknown},"
        return ["".join([write[s] if s >= 0 else bytes_of(s) for s in row[row != -1].tolist()]) for row in done]

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the piece that each pair of symbols makes (NO_PAIR if none), and its id."""
        key = np.where((a >= 0) & (b >= 0), a * self.width + b, -1)
        at = np.searchsorted(self.pair_keys, key).clip(max=len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], NO_PAIR), self.pair_ids[at]

    def check(self) -> None:
        """Hold the units met since the last check against the library."""
        if self.by_word:
            # The library puts a word mark before every text; behind a line's end, which no piece holds, it shows the bare word.
            bare = [w[0] != MARK for w in self.unchecked]
            said = self.library.encode(["\n" + w if b else w[1:].replace(MARK, " ") for w, b in zip(self.unchecked, bare, strict=True)], num_threads=1)
            for (word, ours), b, theirs in zip(self.unchecked.items(), bare, said, strict=True):
                if ours != ",".join(map(str, theirs[2:] if b else theirs)) + ",":
                    raise ValueError(f"agenda and library differ on {word!r}")
        self.unchecked.clear()

    def split(self, text: str) -> list[str]:
        """Units that no piece crosses.  A word behind a space or at the text's start stands for itself with a word mark."""
        if not self.by_word:
            return [f"\n{self.library.normalize(text)}"] if text else []
        if not self.identity and (normal := self.library.normalize(text)):
            text = normal[1:].replace(MARK, " ")
        if not text:
            return []
        if MARK in text:
            return [f"\n{x}" for x in RUNS.findall(MARK + text.replace(" ", MARK))]
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            parts = line.split(" ")
            if "" in parts:
                marked = (MARK if not k else "") + line.replace(" ", MARK)
                parts = [f"\n{x}" for x in RUNS.findall(marked)]
            elif k:
                parts[0] = f"\n{parts[0]}"
            if k:
                out.append("\n")
            out += parts
        return out


_models: dict[str, MergeModel] = {}


def model(path: str) -> MergeModel:
    if path not in _models:
        _models[path] = MergeModel(path)
    return _models[path]


def encode_texts(m: MergeModel, texts: list[str]) -> list[tuple[np.ndarray, str]]:
    """Ids of each text, and the same as decimal numbers joined by commas."""
    split, out, get = [m.split(x) for x in texts], [], m.__getitem__
    m.learn(set().union(*split))
    for units in split:
        joined = "".join(map(get, units))[:-1]
        out.append((np.fromstring(joined, np.int32, sep=",") if joined else np.empty(0, np.int32), joined))
    m.check()
    return out


def tokenize(docs: DataFrame, model_path: str, batch_bytes: int = 1 << 20) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the library's decoding of them.  See the module's text."""

    def run(batches):
        m = model(model_path)
        for batch in batches:
            for at, to in batches_of_texts(batch, batch_bytes):
                texts = [x or "" for x in batch.column("text").slice(at, to - at).to_pylist()]
                coded = encode_texts(m, texts)
                back = [m.library.decode(ids) if len(ids) else "" for ids, _ in coded]
                digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, to - at),
                        pa.array([len(ids) for ids, _ in coded], pa.int64()),
                        pa.array([digest(s) for _, s in coded]),
                        pa.array([digest(x) for x in back]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return text_of(docs).mapInArrow(run, SCHEMA)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """The ids themselves: doc_id, ids array<int>, decoded string."""

    def run(batches):
        m = model(model_path)
        for batch in batches:
            for at, to in batches_of_texts(batch, 1 << 20):
                ids = [x for x, _ in encode_texts(m, [x or "" for x in batch.column("text").slice(at, to - at).to_pylist()])]
                back = [m.library.decode(x) if len(x) else "" for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array(ids, pa.list_(pa.int32())), pa.array(back)], ["doc_id", "ids", "decoded"])

    return text_of(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
