"""Vectorised word hashes over byte buffers (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACES = np.zeros(256, dtype=bool)  # the separators of shingles
SPACES[[0x20, *range(0x09, 0x0E)]] = True
MARKS = np.zeros(256, dtype=bool)  # the separators of plain words, after lower-casing
MARKS[:0x80] = True
MARKS[0x30:0x3A] = MARKS[0x61:0x7B] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE * 2, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            both = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                table = np.full(size, base, dtype=np.uint64)
                table[0] = 1
                both.append(np.multiply.accumulate(table))
        _POWERS[size] = tuple(both)
    return _POWERS[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with A-Z in lower case, a line feed after each; and the starts."""
    parts = [(v.as_buffer() if v.is_valid else b"") for v in texts.cast(pa.large_binary())]
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    data = np.frombuffer(b"\n".join([*map(memoryview, parts), b""]), dtype=np.uint8)
    return LOWER[data], starts


def runs(texts: pa.Array, at_once: int) -> Iterator[pa.Array]:
    """Slices of about ``at_once`` bytes, so memory follows the longest text and not the batch."""
    size, a, held = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 0, 0
    for b in range(len(texts)):
        held += int(size[b])
        if held >= at_once or b == len(texts) - 1:
            yield texts.slice(a, b + 1 - a)
            a, held = b + 1, 0


def pieces(data: np.ndarray, separator: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that end behind a separator, so no word is cut."""
    a, n = 0, len(data)
    while a < n:
        b = min(a + size, n)
        while b < n and not separator[data[b - 1]]:
            step = separator[data[b : b + 4096]]
            found = int(step.argmax()) if step.any() else len(step) - 1
            b += found + 1
        yield a, b
        a = b


def word_hashes(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of ``data``, which ends behind a separator."""
    inside = ~separator[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * down[starts])
