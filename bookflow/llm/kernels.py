"""Vectorised helpers over the UTF-8 bytes of a batch of texts.

Every helper works on one Arrow batch inside a task. Texts stay where Arrow put
them: a text is a slice of the batch's byte buffer, so no Python string is made.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Odd multipliers of the polynomial hash and of its finaliser.
BASE = np.uint64(0x9E3779B97F4A7C15)
SECOND_BASE = np.uint64(0xD6E8FEB86659FD93)
MIX_A = np.uint64(0xFF51AFD7ED558CCD)
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)
MASK64 = (1 << 64) - 1

#: Bytes of text that one pass of a kernel handles; a longer text is a pass of its own.
PASS_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, so that any part of them is a fair hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(29))
    x = x * MIX_B
    return x ^ (x >> np.uint64(32))


#: A 64-bit value for each byte, from a rule.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
SECOND_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * SECOND_BASE)
#: Bytes with A-Z in lower case.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Space and the control characters from tab to carriage return.
IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)], dtype=bool)

_powers: dict[int, list[np.ndarray]] = {}


def powers(n: int, base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse modulo 2**64."""
    held = _powers.setdefault(int(base), [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    if len(held[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        for k, factor in enumerate((base, inverse)):
            seq = np.full(size, factor, np.uint64)
            seq[0] = 1
            held[k] = np.cumprod(seq, dtype=np.uint64)
    return held[0][:n], held[1][:n]


class RangeHash:
    """Hashes of byte ranges of one buffer, each in constant time.

    Equal byte ranges have equal hashes wherever they stand. A second hash, with
    another base and other values of bytes, is independent of the first.
    """

    def __init__(self, data: np.ndarray, second: bool = False):
        self.second = second
        power, self.inverse = powers(len(data) + 1, SECOND_BASE if second else BASE)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((SECOND_VALUE if second else BYTE_VALUE)[data] * power[:-1], dtype=np.uint64, out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix(value + (end - start).astype(np.uint64) * MIX_B)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow text or binary column, and the n + 1 bounds of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def passes(bounds: np.ndarray, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Cut the rows of a batch into runs of about `most` bytes: pairs of first and last + 1."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_ranges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words end at white space and at the end of a text."""
    if len(data) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~IS_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    opens[edge] = inside[edge]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = bounds[1:][bounds[1:] > 0] - 1
    closes[last] = inside[last]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(bounds, start, side="right") - 1
