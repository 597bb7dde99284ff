"""Whole batches of texts as numpy arrays: words, hashes of any substring.

Hashes are differences of one running polynomial (wrapping 64-bit
arithmetic), so the hash of every word, n-gram or window of a batch costs a
few array operations and no loop over texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(int(BASE), -1, 2**64))
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_cache: dict[str, np.ndarray] = {}


def _powers(n: int, inverse: bool) -> np.ndarray:
    name = "inv" if inverse else "pow"
    have = _cache.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), BASE_INV if inverse else BASE, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 1 << 23:
            _cache[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word (a 64-bit finalizer)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(29)
    x = x * U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(32)
    return x


def running(data: np.ndarray) -> np.ndarray:
    """Running polynomial of a byte array; length n + 1."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _powers(len(data), False), out=out[1:])
    return out


def slice_hash(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for every pair; equal bytes, equal hash."""
    inv = _powers(len(run), True)
    return mix((run[end] - run[start]) * inv[start] + (end - start).astype(np.uint64))


def batches(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of at most about
    ``limit`` bytes (one longer text makes a run of its own); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offs, body = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(off, off[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, raw[off[first]:off[end]], off[first:end + 1] - off[first]
        first = end


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text number) of the words: runs of bytes that are not white space."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~WHITE[data]
    before = np.zeros(n, bool)
    before[1:] = ink[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = ink[1:]
    ends = off[1:][off[1:] > 0] - 1
    after[ends] = False
    start = np.flatnonzero(ink & ~before)
    end = np.flatnonzero(ink & ~after) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word in order."""
    start, end, doc = words(data, off)
    return slice_hash(running(data), start, end), doc


_SHINGLE_BASE = [U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                                0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xC2B2AE3D27D4EB4F)]


def shingles(word: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, first word's index) of every run of ``k`` words
    inside a text; a shorter text with words gives one shingle of them all."""
    n = len(word)
    full = np.zeros(0, np.uint64)
    at = np.zeros(0, np.int64)
    if n >= k:
        total = word[:n - k + 1] * _SHINGLE_BASE[0]
        for j in range(1, k):
            total = total + word[j:n - k + 1 + j] * _SHINGLE_BASE[j]
        at = np.flatnonzero(doc[:n - k + 1] == doc[k - 1:])
        full = mix(total[at])
    if n:
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        count = np.diff(np.r_[first, n])
        for c in range(1, k):
            short = first[count == c]
            if len(short):
                total = np.full(len(short), U(c))
                for j in range(c):
                    total = total + word[short + j] * _SHINGLE_BASE[j]
                full, at = np.r_[full, mix(total)], np.r_[at, short]
    order = np.argsort(at, kind="stable") if len(at) and (np.diff(at) < 0).any() else slice(None)
    full, at = full[order], at[order]
    return full, doc[at], at


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours (length n - w + 1), by block prefix and suffix minima."""
    n = len(h)
    if n < w:
        return h[:0]
    if w == 1:
        return h
    pad = -n % w
    top = np.concatenate([h, np.full(pad, np.iinfo(h.dtype).max, h.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(top, axis=1).ravel()
    right = np.minimum.accumulate(top[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])
