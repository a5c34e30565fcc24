"""A random generator that is the same in Spark, in SQL and in Python: the first 60 bits of MD5 of key and counter."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


BITS = 60


def draw(key: Column, at: Column) -> Column:
    """A number from 0 to 2**60 - 1 for (key, at)."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit("|"), at.cast("string"))), 1, 15), 16, 10).cast("long")


def draw_python(key: str, at: object) -> int:
    return int(hashlib.md5(f"{key}|{at}".encode(), usedforsecurity=False).hexdigest()[:15], 16)


def _md5(words: list[np.ndarray | int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of n messages of one block each; a word that is the same in all may be a number."""
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(n, x, np.uint32) for x in start)
    for i in range(64):
        kind = i // 16
        f = d ^ (b & (c ^ d)) if kind == 0 else c ^ (d & (b ^ c)) if kind == 1 else b ^ c ^ d if kind == 2 else c ^ (b | ~d)
        w, sine = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16], int(abs(math.sin(i + 1)) * 2**32)
        f = f + a + (np.uint32((w + sine) & 0xFFFFFFFF) if isinstance(w, int) else w + np.uint32(sine))
        turn = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[kind][i % 4]
        a, d, c, b = d, c, b, b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn)))
    return a + np.uint32(start[0]), b + np.uint32(start[1])


def draws_python(key: str, at: int, n: int) -> list[int]:
    """draw_python(key, i) for the n whole numbers from ``at`` on, all at once where a message fits one block of MD5."""
    head, out = f"{key}|".encode(), []
    while n > 0:
        digits = len(str(at))
        k, size = min(n, 10**digits - at), len(head) + digits
        if size > 55:
            out += [draw_python(key, i) for i in range(at, at + k)]
        else:
            text = np.zeros((k, 64), np.uint8)
            text[:, : len(head)] = np.frombuffer(head, np.uint8)
            number = np.arange(at, at + k)
            for j in range(size - 1, len(head) - 1, -1):
                text[:, j] = 48 + number % 10
                number //= 10
            text[:, size] = 0x80
            text[:, 56] = 8 * size & 0xFF
            text[:, 57] = 8 * size >> 8
            words = text.view("<u4")
            moved = range(len(head) // 4, (size - 1) // 4 + 1)
            a, b = _md5([np.ascontiguousarray(words[:, j]) if j in moved else int(words[0, j]) for j in range(16)], k)
            out += (((a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()) >> np.uint64(64 - BITS)).tolist()
        at, n = at + k, n - k
    return out


def running_lots(key: str, most: int = 1 << 14) -> Iterator[list[int]]:
    """draw_python(key, 0), draw_python(key, 1), ..., in ever larger lots."""
    at, lot = 0, 64
    while True:
        yield draws_python(key, at, lot)
        at, lot = at + lot, min(2 * lot, most)


def draw_sql(key: str, at: str) -> str:
    return f"CAST('0x' || substr(md5({key} || '|' || {at}), 1, 15) AS BIGINT)"
