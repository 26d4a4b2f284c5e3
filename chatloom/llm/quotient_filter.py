"""Counting quotient filters without loss, over keys of one or two words of up to 64 bits.

A key is the pair (left, right) of given widths. An unbalanced Feistel network permutes keys invertibly, so that
they lie evenly whatever they stand for. The permuted key's leading bits are its quotient; the rest, its
remainder, is kept in full, so a key comes back exactly. A filter is a byte string of keys in order: how many keys each
quotient has (in unary, one bit a key and one a quotient), the remainders, a bit for each key that
counts more than once, and those keys' counts. Filters of equal widths merge by their order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

from .words import mix

ROUNDS = 4
_U = np.uint64
_KEYS = mix(np.arange(7001, 7001 + ROUNDS, dtype=np.uint64))
_HEAD = struct.Struct("<4B3Q")


def mask(bits: int) -> np.uint64:
    return _U((1 << bits) - 1)


def permute(left: np.ndarray, right: np.ndarray, widths: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    for i in range(ROUNDS):
        if i % 2:
            right = right ^ (mix(left + _KEYS[i]) & mask(widths[1]))
        else:
            left = left ^ (mix(right + _KEYS[i]) & mask(widths[0]))
    return left, right


def restore(left: np.ndarray, right: np.ndarray, widths: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    for i in reversed(range(ROUNDS)):
        if i % 2:
            right = right ^ (mix(left + _KEYS[i]) & mask(widths[1]))
        else:
            left = left ^ (mix(right + _KEYS[i]) & mask(widths[0]))
    return left, right


def sum_equal(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None, widths: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Permuted keys in order, each once, with the sum of its counts (1 each if counts is None)."""
    n = len(left)
    if sum(widths) <= 64:
        key = left << _U(widths[1]) | right if widths[1] < 64 else right
        if counts is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")  # sorted runs merge
            key, counts = key[order], counts[order]
        begin = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), key[1:] != key[:-1]]))
        key = key[begin]
        left, right = (key >> _U(widths[1]), key & mask(widths[1])) if widths[1] < 64 else (np.zeros(len(key), _U), key)
    else:
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        counts = None if counts is None else counts[order]
        begin = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        left, right = left[begin], right[begin]
    if not n:
        return left, right, np.empty(0, np.int64)
    sums = np.diff(np.append(begin, n)) if counts is None else np.add.reduceat(counts, begin)
    return left, right, sums.astype(np.int64)


def _bytes(values: np.ndarray, bits: int) -> bytes:
    """Low bytes of values, as many as the bits need, one plane after the other."""
    planes = values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    return b"".join(planes[:, i].tobytes() for i in range(-(-bits // 8)))


def _values(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    for i in range(-(-bits // 8)):
        out[:, i] = data[i * n : (i + 1) * n]
    return out.view("<u8").reshape(n)


def pack(left: np.ndarray, right: np.ndarray, counts: np.ndarray, widths: tuple[int, int]) -> bytes:
    """Filter of permuted keys that come in order, each once, with counts of 1 and more."""
    n = len(left)
    quotient_bits = min(widths[0], max(1, n.bit_length()))
    shift = widths[0] - quotient_bits
    quotients = (left >> _U(shift)).astype(np.int64)
    first = int(quotients[0]) if n else 0
    last = int(quotients[-1]) if n else -1
    # unary: quotient by quotient, a 1 for each key and then a 0
    unary = np.zeros(n + last - first + 1, np.uint8)
    unary[np.arange(n) + quotients - first] = 1
    more = counts > 1
    parts = [np.packbits(unary).tobytes(), _bytes(left & mask(shift), shift), _bytes(right, widths[1]), np.packbits(more).tobytes(), counts[more].astype("<i8").tobytes()]
    return _HEAD.pack(widths[0], widths[1], quotient_bits, 0, n, first, len(unary)) + b"".join(parts)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, counts) of a filter: its permuted keys in order."""
    a, b, quotient_bits, _, n, first, length = _HEAD.unpack_from(data)
    shift, buf = a - quotient_bits, np.frombuffer(data, np.uint8, offset=_HEAD.size)

    def take(size: int) -> np.ndarray:
        nonlocal buf
        out, buf = buf[:size], buf[size:]
        return out

    unary = np.unpackbits(take(-(-length // 8)), count=length)
    quotients = np.flatnonzero(unary) - np.arange(n) + first
    left = quotients.astype(np.uint64) << _U(shift) | _values(take(n * -(-shift // 8)), n, shift)
    right = _values(take(n * -(-b // 8)), n, b)
    more = np.unpackbits(take(-(-n // 8)), count=n).astype(bool)
    counts = np.ones(n, np.int64)
    counts[more] = np.frombuffer(buf.tobytes(), "<i8")
    return left, right, counts


def merge(filters: Iterable[bytes], widths: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, counts) of all filters together, in order."""
    found = [unpack(f) for f in filters]
    return sum_equal(*(np.concatenate(x) for x in zip(*found, strict=True)), widths)
