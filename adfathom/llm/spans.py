"""Byte spans of a text inside a task: hashes of many spans at once, and comparison byte for byte.

A span is read eight bytes at a time. What lies beyond the first `LONG` bytes of a span is hashed and compared by
itself, so one very long span does not make the others wait.
"""

from __future__ import annotations

import hashlib

import numpy as np

from adfathom.llm.texts import mixed

LONG = 64
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: What is left of an 8-byte load of which only the first n bytes belong to the span.
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Spans:
    """Bytes of some texts; spans of them are given by start and end."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate((data, np.zeros(8, np.uint8)))
        self.loads = np.ndarray((len(data) + 1,), "<u8", self.data, strides=(1,))

    def part(self, start: np.ndarray, length: np.ndarray, at: int) -> np.ndarray:
        """Bytes at .. at + 8 of each span, zeros where it has ended."""
        return self.loads[start + at] & _KEPT[np.minimum(length - at, 8)]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - start
        found = length.astype(np.uint64) * _SPREAD
        rows = np.flatnonzero(length)
        for at in range(0, LONG, 8):
            if at:
                rows = rows[length[rows] > at]
            if not len(rows):
                return found
            found[rows] = mixed(found[rows] ^ self.part(start[rows], length[rows], at))
        for i in rows[length[rows] > LONG].tolist():
            rest = hashlib.blake2b(self.data[start[i] + LONG : end[i]], digest_size=8).digest()
            found[i] ^= np.uint64(int.from_bytes(rest, "little"))
        return found

    def equal(self, start: np.ndarray, other: Spans, where: np.ndarray, length: np.ndarray) -> np.ndarray:
        """True where the span at `start` holds the same `length` bytes as the one of `other` at `where`."""
        same = np.ones(len(start), bool)
        rows = np.flatnonzero(length)
        for at in range(0, LONG, 8):
            if at:
                rows = rows[length[rows] > at]
            if not len(rows):
                return same
            same[rows] &= self.part(start[rows], length[rows], at) == other.part(where[rows], length[rows], at)
        for i in rows[(length[rows] > LONG) & same[rows]].tolist():
            one = self.data[start[i] + LONG : start[i] + length[i]]
            same[i] = np.array_equal(one, other.data[where[i] + LONG : where[i] + length[i]])
        return same


def same_spans(spans: Spans, start: np.ndarray, end: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
    """For each span the number of the span that stands for all equal ones (of the same owner).

    An open-addressed hash table of positions. A slot's holder counts as equal only if its owner, its
    length and every byte agree; otherwise the span moves on to the next slot.
    """
    n, length = len(start), end - start
    keys = spans.hashes(start, end)
    if owner is not None:
        keys = mixed(keys + owner.astype(np.uint64) * _SPREAD)
    size = 1 << max(4, (2 * n).bit_length())
    slots = np.full(size, -1, np.int64)
    at = (keys & np.uint64(size - 1)).astype(np.int64)
    found, todo = np.arange(n), np.arange(n)
    while len(todo):
        slot = at[todo]
        free = slots[slot] < 0
        slots[slot[free]] = todo[free]
        holder = slots[slot]
        done = holder == todo
        like = np.flatnonzero(~done & (keys[holder] == keys[todo]))
        a, b = todo[like], holder[like]
        alike = length[a] == length[b]
        if owner is not None:
            alike &= owner[a] == owner[b]
        like, a, b = like[alike], a[alike], b[alike]
        equal = spans.equal(start[a], spans, start[b], length[a])
        found[a[equal]] = b[equal]
        done[like[equal]] = True
        todo = todo[~done]
        at[todo] = (at[todo] + 1) & (size - 1)
    return found


def stretches(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first .. first + size of every stretch, one stretch after the other."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))
