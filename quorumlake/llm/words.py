"""Word sequences of many texts at once, as arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers of the polynomial hashes, modulo 2**64.
BYTE_BASE, BASE, OTHER_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Texts are worked on together up to so many bytes.
SLAB = 1 << 21


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BYTE_BASE**i and its inverse, modulo 2**64, for i below a size that holds n."""
    size = max(SLAB, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        tables = []
        for base in (BYTE_BASE, np.uint64(pow(int(BYTE_BASE), -1, 1 << 64))):
            x = np.full(size + 1, base, dtype=np.uint64)
            x[0] = 1
            tables.append(np.multiply.accumulate(x))
        _powers[size] = tables[0], tables[1]
    return _powers[size]


def slabs(texts: pa.Array, size: int = SLAB) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: the first one's index, their UTF-8 bytes, and where each begins and the last ends."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a slab's texts in order, and the number of words before each text and in all."""
    full = ~SPACE[data]
    opens, closes = full.copy(), full.copy()
    opens[1:] &= ~full[:-1]
    closes[:-1] &= ~full[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner] = full[inner]
    closes[inner - 1] = full[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power, inverse = _power_table(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTES[data] * power[: len(data)], out=sums[1:])
    hashes = mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, offsets)


def rolling(h: np.ndarray, length: int, base: np.uint64 = BASE) -> np.ndarray:
    """Hashes of all runs of ``length`` words: the sum of h[i+j] * base**(length-1-j) modulo 2**64."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done = np.zeros(n, dtype=np.uint64), 0
    run, size, factor, left = h, 1, base, length
    while left:  # runs of 1, 2, 4, ... words are put together
        if left & 1:
            out = out * factor + run[done : done + n]
            done += size
        left >>= 1
        if left:
            run = run[: len(run) - size] * factor + run[size:]
            size, factor = 2 * size, np.uint64(int(factor) ** 2 % (1 << 64))
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    run, size = x, 1
    while size * 2 <= width:
        run = np.minimum(run[:-size], run[size:])
        size *= 2
    return np.minimum(run[:n], run[width - size : width - size + n])


def windows_within(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``length`` words that lie in one text, and their texts; ``offsets`` counts words."""
    counts = np.maximum(0, np.diff(offsets) - length + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return offsets[:-1][text] + within, text
