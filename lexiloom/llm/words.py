"""Word and shingle hashes of whole Arrow batches, as numpy arrays.

A batch is worked through in slices of a few hundred kilobytes, so the memory of a task is
bounded by the slice and by the number of words of its longest text, not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 512 << 10

# The two word rules, as the bytes that separate words.
SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM_BYTES = np.zeros(256, dtype=bool)
NOT_ALNUM_BYTES[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

_RNG = np.random.Generator(np.random.PCG64(20240917))
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_CASED_CODE = _BYTE_CODE.copy()
_BYTE_CODE[65:91] = _BYTE_CODE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if "base" not in _POWERS or len(_POWERS["base"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, value in (("base", _BASE), ("inverse", _BASE_INVERSE)):
            row = np.full(size, U64(value))
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["base"], _POWERS["inverse"]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every output bit depends on every input bit."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _spans(data: np.ndarray, borders: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word; no word reaches over a border."""
    n = len(data)
    inside = ~separators[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[borders[:-1][borders[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = borders[1:] - 1
    after[last[last >= 0]] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = _BYTE_CODE) -> np.ndarray:
    n = len(data)
    base, inverse = _powers(n + 1)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(code[data] * base[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


def _hash_slice(data: np.ndarray, borders: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ``borders``, and the number of words of each part."""
    if len(data) == 0:
        return np.empty(0, U64), np.zeros(len(borders) - 1, np.int64)
    starts, ends = _spans(data, borders, separators)
    return _span_hashes(data, starts, ends), np.diff(np.searchsorted(starts, borders))


def _word_cuts(data: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of one long text, cut between words."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + SLICE_BYTES)
        while end < n:  # move on to a separator; a longer word makes a longer slice
            gap = np.flatnonzero(separators[data[end : end + SLICE_BYTES]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(n, end + SLICE_BYTES)
        yield at, end
        at = end


def _long_text(data: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Word hashes of one text longer than a slice, cut between words."""
    parts = [_hash_slice(data[a:b], np.array([0, b - a]), separators)[0] for a, b in _word_cuts(data, separators)]
    return np.concatenate(parts) if parts else np.empty(0, U64)


def row_slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``size`` bytes; a longer row is a run of its own."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(rows, max(end, at + 1))
        yield at, end
        at = end


def word_table(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, ...]:
    """First byte, end and hash (by case) of every word of the rows, and the number of words of each row."""
    found = []
    for low, high in row_slices(offsets, SLICE_BYTES):
        first, last = int(offsets[low]), int(offsets[high])
        whole = [(first, last, offsets[low : high + 1] - first)]
        if last - first > SLICE_BYTES:
            whole = [(first + a, first + b, np.array([0, b - a])) for a, b in _word_cuts(data[first:last], separators)]
        for a, b, borders in whole:
            if b > a:
                starts, ends = _spans(data[a:b], borders, separators)
                found.append((starts + a, ends + a, _span_hashes(data[a:b], starts, ends, _CASED_CODE)))
    starts, ends, hashes = (
        np.concatenate([np.empty(0, kind), *column])
        for kind, column in zip((np.int64, np.int64, U64), zip(*found) if found else ([], [], []))
    )
    return starts, ends, hashes, np.diff(np.searchsorted(starts, offsets))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its rows; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array, separators: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a batch: first row, word hashes in order, words per row."""
    data, offsets = text_bytes(texts)
    for at, end in row_slices(offsets, SLICE_BYTES):
        piece = data[offsets[at] : offsets[end]]
        if end == at + 1 and len(piece) > SLICE_BYTES:
            words = _long_text(piece, separators)
            yield at, words, np.array([len(words)])
        else:
            yield at, *_hash_slice(piece, offsets[at : end + 1] - offsets[at], separators)


_PLACE_CODE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words; one fewer for each place beyond the first."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    total = np.full(n, U64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    for j in range(k):
        total += words[j : j + n] * _PLACE_CODE[j]
    return mix(total)
