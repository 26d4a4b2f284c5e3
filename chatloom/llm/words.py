"""Vectorised word and shingle hashes over Arrow text columns.

A word's 64-bit hash is a polynomial over its (case-folded) bytes, mixed at the end. Texts
are taken in slices of about SLICE bytes, so temporary arrays stay small whatever the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shared import clear_after_task

SLICE = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def byte_values(separators: bytes, fold: bool = True) -> np.ndarray:
    """Value of each byte in the polynomial: 0 for separators, A-Z as a-z if fold."""
    v = mix(np.arange(1, 257, dtype=np.uint64)) | _U(1)
    if fold:
        v[65:91] = v[97:123]
    v[list(separators)] = 0
    return v


#: Words are what white space leaves: [^\x20\x09-\x0D]+
SPACE_WORDS = byte_values(bytes([32, *range(9, 14)]))
#: Words of ASCII letters, digits and all non-ASCII characters.
ALNUM_WORDS = byte_values(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)))

_powers: list[np.ndarray] = []
clear_after_task(_powers.clear)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size, inv = max(n, SLICE), pow(_MULT, -1, 2**64)
        tables = []
        for base in (_MULT, inv):
            t = np.empty(size, np.uint64)
            t[0] = 1
            t[1:] = base
            np.multiply.accumulate(t, out=t)
            tables.append(t)
        _powers[:] = tables
    return _powers[0], _powers[1]


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of about `size` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _hash_piece(buf: np.ndarray, begins: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = values[buf]
    on = v != 0
    first = on.copy()
    first[1:] &= ~on[:-1]
    b = begins[begins < len(buf)]
    first[b] = on[b]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    up, down = _power_tables(len(buf))
    v *= up[: len(buf)]
    return mix(np.add.reduceat(v, starts) * down[starts]), starts


def word_hashes(buf: np.ndarray, offsets: np.ndarray, values: np.ndarray = SPACE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, word offsets) of some texts: text i has the words of [offsets[i], offsets[i + 1])."""
    n = len(offsets) - 1
    base = buf[offsets[0] : offsets[-1]]
    if n == 1 and len(base) > 4 * SLICE:  # one very long text: in pieces cut before a separator
        parts, at = [], 0
        while at < len(base):
            end = min(len(base), at + 2 * SLICE)
            while end < len(base):
                gap = np.flatnonzero(values[base[end : end + SLICE]] == 0)
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(len(base), end + SLICE)
            parts.append(_hash_piece(base[at:end], np.zeros(1, np.int64), values)[0])
            at = end
        h = np.concatenate(parts)
        return h, np.array([0, len(h)], np.int64)
    h, starts = _hash_piece(base, offsets[:-1] - offsets[0], values)
    return h, np.searchsorted(starts, offsets - offsets[0]).astype(np.int64)


_COEF = mix(np.arange(1001, 1101, dtype=np.uint64)) | _U(1)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words in a row (it pays no heed to text boundaries)."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * _COEF[i % 100] * _U(2 * (i // 100) + 1)
    return mix(out)


def shingle_sets(h: np.ndarray, woffs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's sorted distinct k-word shingles; a shorter text is one shingle."""
    counts = np.diff(woffs)
    wins = window_hashes(h, k)
    doc = np.repeat(np.arange(len(counts)), counts)
    if len(wins):
        ok = doc[: len(wins)] == doc[k - 1 :]
        vals, docs = wins[ok], doc[: len(wins)][ok]
    else:
        vals, docs = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        vals = np.concatenate([vals, [window_hashes(h[woffs[i] : woffs[i + 1]], int(counts[i]))[0] for i in short]]).astype(np.uint64)
        docs = np.concatenate([docs, short])
    order = np.lexsort((vals, docs))
    vals, docs = vals[order], docs[order]
    keep = np.ones(len(vals), bool)
    keep[1:] = (vals[1:] != vals[:-1]) | (docs[1:] != docs[:-1])
    vals, docs = vals[keep], docs[keep]
    return vals, np.searchsorted(docs, np.arange(len(counts) + 1)).astype(np.int64)
