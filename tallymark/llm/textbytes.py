"""UTF-8 texts of Arrow batches as numpy byte arrays: words, shingles and byte windows, hashed without Python loops.

Hashes only find candidates or name sets in 64 bits; operators that must be exact compare the bytes afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; temporary arrays take about sixty times as much.
PIECE = 1 << 17

_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """Lookup table that is True for the bytes in the given inclusive spans."""
    table = np.zeros(256, bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


#: Runs of digits, a-z and anything beyond ASCII.
ALNUM_WORDS = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACED_WORDS = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits (one to one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, PIECE + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each row starts, with the end at last; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    kind = np.int32 if pa.types.is_string(column.type) else np.int64
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def chunks(bounds: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes together; a longer row is a run of its own."""
    row, n = 0, len(bounds) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + size, side="right")) - 1)
        yield row, min(end, n)
        row = end


def _words_of_piece(data: np.ndarray, inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fresh = inside & ~np.concatenate(([False], inside[:-1]))
    fresh |= inside & first
    last = inside & ~np.concatenate((inside[1:], [False]))
    last[:-1] |= inside[:-1] & first[1:]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * _power(_BASE, len(data)), dtype=np.uint64)))
    hashes = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts]
    return starts, ends, mix(hashes + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows that lie one after another: starts, ends, hashes, and each row's first word with the count at last.

    ASCII capitals count as small. Long stretches are cut at a byte outside of words, so memory follows the longest word.
    """
    data = LOWER[data]
    first = np.zeros(len(data), bool)
    first[bounds[:-1][bounds[:-1] < len(data)]] = True
    inside = table[data]
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and inside[end] and not first[end]:
            gaps = np.flatnonzero(~inside[end : end + PIECE] | first[end : end + PIECE])
            end = end + int(gaps[0]) if len(gaps) else min(len(data), end + PIECE)
        s, e, h = _words_of_piece(data[at:end], inside[at:end], first[at:end])
        found.append((s + at, e + at, h))
        at = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    starts, ends, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    return starts, ends, hashes, np.searchsorted(starts, bounds)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, over the whole array; the caller leaves out runs over a row's end."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total = total * np.uint64(_BASE) + hashes[k : k + m]
    return mix(total)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of one whole sequence, equal to ``shingles(hashes, len(hashes))[0]``."""
    powers = _power(_BASE, len(hashes))[::-1]
    return mix(np.array([np.sum(hashes * powers, dtype=np.uint64)], np.uint64))[0]


def windows(data: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of n bytes, by doubling."""
    out, width, left, at = None, 1, n, 0
    power = _VALUE[data] ^ np.uint64(seed)
    while left:
        if left & 1:
            part = power[at:]
            m = len(data) - at - width + 1
            if m <= 0:
                return np.zeros(0, np.uint64)
            out = part[:m] if out is None else mix(out[:m] * np.uint64(_BASE)) + part[:m]
            at += width
        left >>= 1
        if left:
            if len(power) <= width:
                return np.zeros(0, np.uint64)
            power = mix(power[:-width] * np.uint64(_BASE)) + power[width:]
            width *= 2
    return mix(out)
