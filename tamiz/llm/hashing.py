"""Hashes of the words of whole Arrow text columns, without a Python loop over
words. Works on the UTF-8 bytes; texts of any length are cut into pieces
between words, so memory stays a few times the piece."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at a time: their 64-bit values stay in the processor's cache.
PIECE = 1 << 17

# Bytes that end a word, and the case fold of A-Z alone.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_ROLES = (np.random.default_rng(5).integers(1, 1 << 62, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        offsets = np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        _powers[:] = [
            np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64))])
            for base in (_BASE, _BASE_INVERSE)
        ]
    return _powers[0][:n], _powers[1][:n]


def _pieces(data: np.ndarray, lo: int, hi: int, breaks: np.ndarray):
    """Ranges of about PIECE bytes that end between words."""
    while lo < hi:
        end = min(hi, lo + PIECE)
        step = 4096
        while end < hi:
            gap = np.flatnonzero(breaks[data[end : min(hi, end + step)]])
            if len(gap):
                end += int(gap[0])
                break
            end, step = min(hi, end + step), step * 2
        yield lo, end
        lo = end


def _mapped(raw: bytes, table: np.ndarray) -> np.ndarray:
    """``table[b]`` of each byte b; many times faster than indexing."""
    return np.frombuffer(raw.translate(table.tobytes()), table.dtype)


def word_hashes(column: pa.Array, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word (a run of bytes not in ``breaks``, A-Z folded)
    of each row, and offsets of the rows in the list of words."""
    data, offsets = text_bytes(column)
    hashes, starts, _ = byte_runs(data, offsets, breaks)
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def byte_runs(
    data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray, parts: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of all rows. With ``parts``, two
    sets of bytes, a word also ends between a byte of one and one of the other."""
    hashes, starts_at, ends_at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows = offsets[:-1]
    for lo, hi in _pieces(data, int(offsets[0]), int(offsets[-1]), breaks):
        raw = data[lo:hi].tobytes().translate(FOLD.tobytes())
        b = np.frombuffer(raw, np.uint8)
        inside = _mapped(raw, ~breaks)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = rows[np.searchsorted(rows, lo) : np.searchsorted(rows, hi)] - lo
        first[cut] = inside[cut]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        if parts is not None:
            one, other = _mapped(raw, parts[0]), _mapped(raw, parts[1])
            between = (one[1:] & other[:-1]) | (other[1:] & one[:-1])
            first[1:] |= between
            last[:-1] |= between
        cut = cut[cut > 0] - 1
        last[cut] = inside[cut]
        start, end = np.flatnonzero(first), np.flatnonzero(last)
        power, inverse = _power_tables(hi - lo)
        value = (b.astype(np.uint64) + np.uint64(1)) * power
        total = np.cumsum(value)
        word = (total[end] - total[start] + value[start]) * inverse[start]
        hashes.append(mix(word + (end - start).astype(np.uint64) * _ROLES[0]))
        starts_at.append(start + lo)
        ends_at.append(end + (lo + 1))
    return np.concatenate(hashes), np.concatenate(starts_at), np.concatenate(ends_at)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words of each row, in order, with offsets.
    A row of fewer words, but not none, has its whole sequence as one."""
    n = np.diff(offsets)
    runs = max(0, len(words) - size + 1)
    full = np.zeros(runs, np.uint64)
    for k in range(size):
        full += words[k : k + runs] * _ROLES[1 + k]
    full = mix(full)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    source = np.arange(out_at[-1]) - out_at[row] + offsets[row]
    out = np.zeros(out_at[-1], np.uint64)
    long = n[row] >= size
    out[long] = full[source[long]]
    for r in np.flatnonzero((n > 0) & (n < size)):
        w = words[offsets[r] : offsets[r + 1]]
        out[out_at[r]] = mix(np.sum(w * _ROLES[1 : 1 + len(w)], keepdims=True) + np.uint64(len(w)))[0]
    return out, out_at


def row_groups(offsets: np.ndarray, size: int):
    """Consecutive ranges of rows with about ``size`` items together, one row
    at least."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi
