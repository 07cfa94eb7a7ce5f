"""Keyed hashes used in place of random numbers.

A value depends on the seed and the row's key only, so a result is the same for any
partitioning and for any retry of a task.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_hash(seed: int | str, *keys: Column | str) -> Column:
    """Hex md5 of ``seed:key1:key2...``."""
    return F.md5(hash_text(seed, *keys))


def hash_text(seed: int | str, *keys: Column | str) -> Column:
    """The text that is hashed; a longer key may be appended behind another ``:``."""
    return F.concat_ws(":", F.lit(str(seed)), *[_text(k) for k in keys])


def hash_int(digest: Column) -> Column:
    """First 60 bits of a hex digest as a non-negative bigint."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def unit_float(digest: Column) -> Column:
    """First 32 bits of a hex digest mapped to [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _text(key: Column | str) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("string")


# Longest text of one block of md5, and texts that are hashed together so that they stay in the cache.
BLOCK_BYTES = 55
HASHED_ROWS = 1 << 14
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [[np.uint32(x) for x in r] for r in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))]


def numbered_md5(texts: list[bytes], row: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the md5 of ``texts[row]`` with ``number`` written behind, as whole numbers that sort like hex text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    shown = np.array([str(i).encode() for i in range(int(number.max(initial=0)) + 1)])
    digits = np.char.str_len(shown)
    width = shown.dtype.itemsize
    if sizes.max(initial=0) + width > BLOCK_BYTES:
        full = [hashlib.md5(texts[r] + b"%d" % i).digest() for r, i in zip(row.tolist(), number.tolist())]
        halves = np.frombuffer(b"".join(full), ">u8").astype(np.uint64).reshape(-1, 2)
        return halves[:, 0], halves[:, 1]
    shown = shown.view(np.uint8).reshape(-1, width)
    table = np.zeros((len(texts), 64), np.uint8)
    for k, text in enumerate(texts):
        table[k, : len(text)] = np.frombuffer(text, np.uint8)
    found = np.empty((2, len(row)), np.uint64)
    for low in range(0, len(row), HASHED_ROWS):
        own, n = row[low : low + HASHED_ROWS], number[low : low + HASHED_ROWS]
        blocks, at, each = table[own], sizes[own], np.arange(len(own))
        for k in range(width):
            blocks[each, at + k] = shown[n, k]  # zero behind the last digit
        ends = at + digits[n]
        blocks[each, ends] = 0x80
        words = blocks.view("<u4")
        words[:, 14] = 8 * ends
        found[:, low : low + HASHED_ROWS] = _one_block(np.ascontiguousarray(words.T))
    return found[0], found[1]


def _one_block(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """md5 of padded texts of one block each: 16 rows of words, a column for each text."""
    start = [np.full(words.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = start
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _SINES[i]
        f += words[g]
        turn = _TURNS[i // 16][i % 4]
        a, d, c, b = d, c, b, b + ((f << turn) | (f >> np.uint32(32 - turn)))
    parts = [(x + y).byteswap().astype(np.uint64) for x, y in zip(start, (a, b, c, d))]
    return (parts[0] << np.uint64(32)) | parts[1], (parts[2] << np.uint64(32)) | parts[3]
