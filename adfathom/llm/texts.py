"""Whole texts as numpy arrays inside a task: words, rolling hashes and sliding minima.

All functions take the bytes of several texts laid end to end with the offset of each text, so
one numpy call covers many documents. Hashes are 64-bit polynomials modulo 2**64 with an odd base,
finished by a mixing step; equal byte strings or word sequences always have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xD6E8FEB86659FD93 | 1
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 16, 0 if known is None else 2 * len(known))
        known = np.full(size, base, np.uint64)
        known[0] = 1
        _powers[base] = known = np.cumprod(known)
    return known[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits; one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with about `limit` bytes; a null is empty.

    A single longer text is a slice of its own: texts are never cut.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        last = max(row + 1, min(last, len(texts)))
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


class Prefix:
    """Prefix sums of a sequence of values, for the hash of any stretch in constant time."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])
        self.back = powers(inverse(base), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64) if isinstance(end, np.ndarray) else np.uint64(end)
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + length)


def byte_prefix(data: np.ndarray) -> Prefix:
    return Prefix(data.astype(np.uint64) + np.uint64(1), BASE)


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words before each text (one more entry).

    `apart` flags the byte values that separate words: white space, if nothing else is said.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~apart[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | fresh[1:-1]
    last = inside
    last[:-1] &= ~last[1:] | fresh[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return byte_prefix(data).of(start, end)


def window_starts(before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First element of every window of `size` elements inside one text, and the text of each.

    `before` counts the elements ahead of each text; a shorter text has no window.
    """
    counts = np.maximum(np.diff(before) - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    shift = np.cumsum(counts) - counts
    return np.arange(len(text)) + (before[:-1] - shift)[text], text


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values (one entry per full window)."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size : width - size + n])


def spans(flags: np.ndarray) -> np.ndarray:
    """Maximal runs of true flags as rows (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges.reshape(-1, 2)


def covered(starts: np.ndarray, width: int, length: int) -> np.ndarray:
    """Flags of `length` elements: inside a window of `width` that begins at one of `starts`."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, length), -1)
    return np.cumsum(change[:-1]) > 0


def signed(hashes: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return hashes.view(np.int64)
