"""What the operators share: the shared folder, stored tables, words and vectorised rolling digests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodecensus.sources.scratch import new_path, new_table, shared_dir, stored, table  # noqa: F401  part of this module's interface

#: Java and Python pattern of a word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (Stafford's variant 13)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chained(a: np.ndarray, b: np.ndarray, odd: int) -> np.ndarray:
    """Digest of the pair (a, b), element by element.  Not a polynomial: every step is mixed, so that no pattern of symbols makes
    different strings equal; two odd numbers give two independent digests, 128 bits together."""
    return mix(a * np.uint64(odd) + b)


#: Multipliers of the two halves of a digest.
ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Places in a word whose byte values come from a table; those behind are made one by one.
PLACES = 64
#: Bytes of words that are digested at once, whatever the length of a text.
SLAB = 1 << 20
_place_values: dict[int, np.ndarray] = {}


def word_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, half: int) -> np.ndarray:
    """64-bit digests of the words data[start:end]: a random value for each (place, byte), added up and mixed.

    Words that differ anywhere get sums that differ by independent random numbers, whatever pattern their bytes have.
    """
    odd = np.uint64(ODD[half])
    if half not in _place_values:
        _place_values[half] = mix((np.arange(PLACES << 8, dtype=np.uint64) + np.uint64(1)) * odd)
    values, size = _place_values[half], (end - start).astype(np.int64)
    out, ends, at = np.empty(len(start), np.uint64), np.cumsum(size), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLAB, "right")))
        n = size[at:to]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
        key = (place << 8) | data[place + np.repeat(start[at:to], n)]
        far = place >= PLACES
        if far.any():
            x = np.where(far, mix((key.astype(np.uint64) + np.uint64(1)) * odd), values[np.where(far, 0, key)])
        else:
            x = values[key]
        out[at:to] = mix(np.add.reduceat(x, first) + n.astype(np.uint64) * odd)
        at = to
    return out


def strings_of(words: np.ndarray, length: int, half: int) -> np.ndarray:
    """Digests of the ``length`` words from each word on, by doubling: two strings of the largest power of two below make one, one
    from the start and one up to the end."""
    if length == 1:
        return words
    part = 1 << (length - 1).bit_length() - 1
    x, n = strings_of(words, part, half), max(0, len(words) - length + 1)
    return chained(x[:n], x[length - part :][:n], ODD[half] + 2 * length)


class Rolling:
    """Digests of slices of a sequence of 64-bit values: sum of value * base**position, modulo 2**64, shifted home.

    Patterns such as Thue-Morse words collide here, so these digests only *choose* (anchors); they never decide equality.
    ``base`` is odd, so that it has an inverse.  ``seed`` chooses base and finaliser.
    """

    def __init__(self, seed: int) -> None:
        state = mix(np.arange(1, 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 7919))
        self.base = int(state[0]) | 5
        self.salt = state[1]
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) <= n:
            size = max(n + 1, 1 << 16)
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(size, base & ((1 << 64) - 1), np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sums(self, values: np.ndarray) -> np.ndarray:
        self.grow(len(values) + 1)
        out = np.empty(len(values) + 1, np.uint64)
        out[0] = 0
        np.cumsum(values * self.powers[: len(values)], out=out[1:])
        return out

    def slices(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Digest of values[start:end], for arrays of bounds; equal slices have equal digests wherever they lie."""
        return mix((sums[end] - sums[start]) * self.inverses[start] + self.salt * (end - start).astype(np.uint64))


#: For each byte a random odd value, so that words are not read as small numbers.
BYTE_VALUES = mix(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77)) | np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, one space after each; and the bounds of each text's slot (n + 1 entries)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=bounds[1:])
    return data, bounds


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the number of the first word (n + 1 entries)."""
    inside = ~IS_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, end, np.searchsorted(start, bounds)


def batches_of_texts(batch, limit: int):
    """Slices (from, to) of an Arrow batch whose texts have about ``limit`` bytes together; a longer text stays whole."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64)
    at = 0
    while at < len(sizes):
        ends = np.cumsum(sizes[at:])
        to = at + max(1, int(np.searchsorted(ends, limit, "right")))
        yield at, min(to, len(sizes))
        at = to


def utf8(column, at: int, to: int) -> list[bytes]:
    """Texts of an Arrow string column as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.slice(at, to - at).cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def text_of(df: DataFrame, *more: str) -> DataFrame:
    """The columns an operator reads, so that clashing names among the others cannot matter."""
    return df.select("doc_id", F.col("text").cast("string").alias("text"), *more)
