"""Adaptive context-mixing range coder for token ids, many blocks in step.

A block is coded on its own: its contexts start empty, so any block can be decoded without the others.
An id's distribution mixes three orders. Order 0 has the ids' shares in the frame, which its head lists; orders
1 and 2 remember the id that last followed the previous one or two ids, and how often in a row it has done so. The range
is dealt to order 2's id, then order 1's, then by shares to all ids. How much a prediction gets is learned in each block, by
that confidence: a running mean of how often such a prediction has held.

All blocks of a group advance one id at a time; every numpy call covers one step of all of them, and
the encoder and the decoder share the model code. The range is held in doubles, which are exact below 2**53: products are
cut to whole numbers at once, so that both sides, on any machine, deal the same range.
"""

from __future__ import annotations

import numpy as np

BLOCK = 2048
DIGITS = 4
CONTEXTS = 1024
#: Share of a step that the mean of a prediction's successes moves by.
RATE = 1 / 32

#: A range has up to 48 bits; below 32 bits the next word of 16 bits is settled.
_FULL, _LEAST, _WORD = 2.0**48, 2.0**32, 2.0**16


def shares(counts: np.ndarray, digits: int) -> np.ndarray:
    """Whole numbers above 0 near the proportion of `counts` whose sum is 16**digits."""
    room = 16**digits - len(counts)
    found = 1 + counts * room // max(int(counts.sum()), 1)
    found[np.argmax(found)] += 16**digits - found.sum()
    return found


class _Models:
    """The adaptive state of `lanes` blocks; `parts` are the shares of each frame, `frame` the frame of each block."""

    def __init__(self, lanes: int, digits: int, parts: list[np.ndarray], frame: np.ndarray):
        sizes = np.array([len(p) for p in parts], np.int64)
        # a prediction leaves enough of the range that every share of what two of them leave has some of it
        self.most = 1 - 2.0 ** -min(6, (28 - 4 * digits) // 2)
        self.unit = 16.0**-digits
        self.first = (np.cumsum(sizes) - sizes)[frame]
        self.part = np.concatenate(parts).astype(np.float64)
        self.below = np.concatenate([np.cumsum(p) - p for p in parts]).astype(np.float64)
        lane = np.arange(2 * lanes).reshape(2, lanes)  # a row for order 1, one for order 2
        self.home, self.seat = lane * CONTEXTS, lane * 4
        #: The id last seen in a context (plus 1), times 4, plus its confidence of 1 to 3; 0: none yet.
        self.kind = np.uint16 if sizes.max(initial=0) < 16_000 else np.int32
        self.seen = np.zeros(2 * lanes * CONTEXTS, self.kind)
        self.mean = np.tile([0.0, 0.1, 0.3, 0.5], 2 * lanes)
        self.last, self.trace = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def open(self, k: int, width: np.ndarray) -> tuple[np.ndarray, ...]:
        """(id of order 2, its range, id of order 1, its range, range of one share of the rest) of the first k blocks."""
        last = self.last[:k]
        mark = last * 2654435761
        self.at = np.stack([last, (mark ^ self.trace[:k]) >> 13])
        self.at &= CONTEXTS - 1
        self.at += self.home[:, :k]
        self.trace[:k] = mark >> 5
        self.held = self.seen.take(self.at, mode="clip")
        held = self.held.astype(np.int64)
        self.row = held & 3
        held >>= 2
        held -= 1
        # what order 2 has said already is not said again
        self.row[0] *= held[0] != held[1]
        self.row += self.seat[:, :k]
        self.chance = self.mean.take(self.row, mode="clip")
        two_range = np.floor(width * self.chance[1])
        rest = width - two_range
        one_range = np.floor(rest * self.chance[0])
        rest -= one_range
        rest *= self.unit
        return held[1], two_range, held[0], one_range, np.floor(rest)

    def learn(self, ids: np.ndarray, one_held: np.ndarray, two_held: np.ndarray) -> None:
        step = np.stack([one_held, two_held]) * self.most
        step -= self.chance
        step *= RATE
        step[0] *= ~two_held
        step += self.chance
        self.mean[self.row] = step
        fresh = (ids + 1 << 2).astype(self.kind)
        again = (self.held ^ fresh) < 4
        self.seen[self.at] = np.where(again, np.minimum(self.held + 1, fresh + 3), fresh + 1)
        self.last[: len(ids)] = ids


def _turned(rows: np.ndarray) -> np.ndarray:
    """The transpose, laid out anew tile by tile."""
    found = np.empty(rows.shape[::-1], rows.dtype)
    for first in range(0, len(rows), 64):
        for start in range(0, rows.shape[1], 64):
            found[start : start + 64, first : first + 64] = rows[first : first + 64, start : start + 64].T
    return found


def _grid(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of blocks by falling length, their lengths, number of blocks longer than t for each t)."""
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    return order, lengths, np.searchsorted(-lengths, -np.arange(steps), "left")


def _frames(count: int, digits: int, parts: list[np.ndarray] | None, frame: list[int] | None) -> tuple[list, np.ndarray]:
    if parts is None:
        return [np.ones(16**digits, np.int64)], np.zeros(count, np.int64)
    return parts, np.array(frame, np.int64)


def encode_blocks(
    blocks: list[np.ndarray], digits: int = DIGITS, parts: list[np.ndarray] | None = None, frame: list[int] | None = None
) -> list[bytes]:
    """Code words of each block of ids (each below 16**digits).

    parts: the shares of the ids of each frame, 16**digits in all; frame: the frame of each block. Without them all ids
    have equal shares.
    """
    if not blocks:
        return []
    order, lengths, active = _grid(np.array([len(b) for b in blocks], np.int64))
    lanes = len(blocks)
    parts, frame = _frames(lanes, digits, parts, frame)
    ids = np.zeros((lanes, len(active)), np.int32)
    for lane, i in enumerate(order):
        ids[lane, : lengths[lane]] = blocks[i]
    ids = _turned(ids)
    models = _Models(lanes, digits, parts, frame[order])
    low, width = np.zeros(lanes), np.full(lanes, _FULL)
    # words with their carry in bit 16, one row for each place
    out = np.zeros((len(active) // 2 + 64, lanes), np.uint32)
    flat, filled = out.reshape(-1), np.arange(lanes)

    def settle(at: np.ndarray) -> None:
        part = low[at]
        word = np.floor(part * (1 / _LEAST))
        place = filled[at]
        flat[place] = word
        filled[at] = place + lanes
        low[at] = (part - word * _LEAST) * _WORD

    for t, k in enumerate(active.tolist()):
        if t % 2 == 0 and filled.max() + 8 * lanes > len(flat):
            out = np.concatenate([out, np.zeros_like(out)])
            flat = out.reshape(-1)
        now = ids[t, :k].astype(np.int64)
        two_id, two_range, one_id, one_range, unit = models.open(k, width[:k])
        two_held = (two_id == now) & (two_range >= 1)
        one_held = (one_id == now) & (one_range >= 1) & ~two_held
        at = models.first[:k] + now
        shift = two_range + one_range + unit * models.below.take(at, mode="clip")
        size = unit * models.part.take(at, mode="clip")
        shift = np.where(one_held, two_range, shift)
        shift[two_held] = 0
        low[:k] += shift
        width[:k] = np.where(two_held, two_range, np.where(one_held, one_range, size))
        models.learn(now, one_held, two_held)
        small = np.flatnonzero(width[:k] < _LEAST)
        while len(small):
            settle(small)
            wider = width[small] * _WORD
            width[small] = wider
            small = small[wider < _LEAST]
    for _ in range(3):
        if filled.max() + lanes > len(flat):
            out = np.concatenate([out, np.zeros_like(out)])
            flat = out.reshape(-1)
        settle(np.arange(lanes))
    for place in range(int(filled.max()) // lanes - 1, 0, -1):
        out[place - 1] += out[place] >> 16
    columns = _turned(out.astype(">u2"))
    result = [b""] * lanes
    for lane, i in enumerate(order):
        result[i] = columns[lane, : filled[lane] // lanes].tobytes()
    return result


def decode_blocks(
    codes: list[bytes],
    sizes: list[int],
    digits: int = DIGITS,
    parts: list[np.ndarray] | None = None,
    frame: list[int] | None = None,
) -> list[np.ndarray]:
    """The ids of each block, given its code words, number of ids and what the encoder was given."""
    if not codes:
        return []
    order, lengths, active = _grid(np.array(sizes, np.int64))
    lanes = len(codes)
    parts, frame = _frames(lanes, digits, parts, frame)
    models = _Models(lanes, digits, parts, frame[order])
    owner = np.concatenate([np.repeat(np.arange(len(p), dtype=np.int32), p) for p in parts])
    top = 16**digits - 1
    shelf = frame[order] * 16**digits
    words = np.zeros((lanes, max(map(len, codes), default=0) // 2 + 4), np.uint16)
    for lane, i in enumerate(order):
        part = np.frombuffer(codes[i], ">u2", len(codes[i]) // 2)
        words[lane, : len(part)] = part
    words = _turned(words).astype(np.float64)
    words = words.reshape(-1)
    code, width = np.zeros(lanes), np.full(lanes, _FULL)
    for place in range(3):
        code = code * _WORD + words[place * lanes : (place + 1) * lanes]
    taken = np.arange(lanes) + 3 * lanes
    ids = np.zeros((len(active), lanes), np.int32)
    for t, k in enumerate(active.tolist()):
        two_id, two_range, one_id, one_range, unit = models.open(k, width[:k])
        here = code[:k]
        two_held = here < two_range
        after = here - two_range
        one_held = (after < one_range) & ~two_held
        left = after - one_range
        slot = np.maximum(np.minimum(left / unit, top), 0).astype(np.int64)
        found = owner.take(slot + shelf[:k], mode="clip")
        at = models.first[:k] + found
        left -= unit * models.below.take(at, mode="clip")
        now = np.where(two_held, two_id, np.where(one_held, one_id, found)).astype(np.int64)
        size = unit * models.part.take(at, mode="clip")
        code[:k] = np.where(two_held, here, np.where(one_held, after, left))
        width[:k] = np.where(two_held, two_range, np.where(one_held, one_range, size))
        ids[t, :k] = now
        models.learn(now, one_held, two_held)
        small = np.flatnonzero(width[:k] < _LEAST)
        while len(small):
            place = taken[small]
            code[small] = code[small] * _WORD + words.take(place, mode="clip")
            taken[small] = place + lanes
            wider = width[small] * _WORD
            width[small] = wider
            small = small[wider < _LEAST]
    result = [np.zeros(0, np.uint32)] * lanes
    columns = _turned(ids)
    for lane, i in enumerate(order):
        result[i] = columns[lane, : lengths[lane]].astype("<u4")
    return result
