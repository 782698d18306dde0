"""Suffix order, Burrows-Wheeler transform and interval expansion of one block of bytes."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, reach: int) -> np.ndarray:
    """Starts of the suffixes of `text` (symbols below 512, the last one smallest and single), sorted.

    Suffixes are told apart by prefix doubling; no two of them may agree in more than `reach` symbols.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(6, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(6):
        key = key << 9 | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank = np.empty(n, np.int64)
    heads = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = heads
    size = 6
    while size <= reach:
        alone = fresh & np.concatenate((fresh[1:], [True]))
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        at = order[open_]
        after = at + size
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        turn = np.lexsort((second, heads[open_]))
        at, second, group = at[turn], second[turn], heads[open_][turn]
        order[open_] = at
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        fresh[open_] = new
        heads = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[order] = heads
        size *= 2
    return order


def short_prefixes(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """True for each suffix that shares at least `least` symbols with the one before it in `order`.

    Breadth first: the interval of all suffixes is the one string of length 0. Every interval is extended
    backwards through the transform by each symbol that occurs in it; the end of a new interval of strings
    of length l + 1 is a place where neighbours share l symbols, unless a shorter one was found there.
    Values come by increasing length, and the search stops at `least`: what is open then shares that much.
    """
    n = len(text)
    transform = text[order - 1]
    by_symbol = np.argsort(transform, kind="stable")
    forward = np.empty(n, np.int64)
    forward[by_symbol] = np.arange(n)
    same = np.concatenate(([False], transform[by_symbol][1:] == transform[by_symbol][:-1]))
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[by_symbol[same]] = by_symbol[np.flatnonzero(same) - 1]
    after[by_symbol[np.flatnonzero(same) - 1]] = by_symbol[same]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(least):
        if not len(low):
            break
        sizes = high - low
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(ends[-1]) + np.repeat(low - (ends - sizes), sizes)
        first = before[at] < low[owner]
        last = after[at] >= high[owner]
        start, stop = forward[at[first]], forward[at[last]]
        # intervals of different strings of one length are disjoint, so sorting pairs ends with starts
        start.sort()
        stop.sort()
        stop += 1
        new = ~known[stop]
        low, high = start[new], stop[new]
        known[high] = True
    return ~known[:n]
