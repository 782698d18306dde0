"""Byte-level BPE from a file of ranks: ids as the tiktoken library gives them, and back.

A text is cut into pre-tokens. A pre-token that is a vocabulary entry is found by a minimal perfect hash: one slot for each
entry and none more, so a slot's entry is compared with the pre-token byte for byte. The others are merged: their bytes
form a linked list, a heap hands out the neighbours of the lowest rank, leftmost first, until no two neighbours
join to an entry. The heaps of many short pre-tokens advance in step, as rows of one array; a longer one has a heap of its
own. Equal pre-tokens of some megabytes of text are merged once; nothing is kept from one such slice to the next.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from adfathom.llm import texts
from adfathom.llm.pieces import Table
from adfathom.llm.spans import Spans, same_spans, stretches
from adfathom.llm.texts import mixed

SLICE = 2 << 20
IN_STEP = 32
ROWS = 1 << 13
SPACE, LETTER, NUMBER, OTHER = range(4)
# Endings that are pre-tokens of their own after an apostrophe; fixed values of the pattern.
ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def code_point_kinds() -> np.ndarray:
    """Kind of every code point, told by the library's own pattern engine, whose Unicode tables count."""
    import tiktoken

    kinds = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        engine = tiktoken.Encoding(f"kind-{kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        matched = bytes(engine.encode_ordinary(every)).decode()
        kinds[np.frombuffer(matched.encode("utf-32-le"), "<u4")] = kind
    return kinds


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: n keys, n slots.

    Keys are dealt into buckets. From the fullest bucket on, each bucket tries displacements until all of its keys fall on
    free slots; a bucket of one key names its slot.
    """

    TRIES = 256

    def __init__(self, keys: np.ndarray):
        self.n, self.buckets = len(keys), max(1, len(keys) // 2)
        if len(np.unique(keys)) != self.n:
            raise ValueError("two entries share a hash")
        self.shift = np.zeros(self.buckets, np.int64)
        owner = self._bucket(keys)
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(self.buckets + 1))
        free = np.ones(self.n, bool)
        alone = []
        for bucket in np.argsort(-np.diff(cut), kind="stable").tolist():
            own = keys[order[cut[bucket] : cut[bucket + 1]]]
            if len(own) < 2:
                alone += [bucket] * len(own)
                continue
            first = 0
            while True:
                shifts = np.arange(first, first + self.TRIES)
                slots = self._slot(own[None, :], shifts[:, None])
                lined = np.sort(slots, axis=1)
                good = np.flatnonzero(free[slots].all(axis=1) & (lined[:, 1:] != lined[:, :-1]).all(axis=1))
                if len(good):
                    self.shift[bucket] = shifts[good[0]]
                    free[slots[good[0]]] = False
                    break
                first += self.TRIES
        self.shift[alone] = -1 - np.flatnonzero(free)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def _slot(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        spread = mixed(keys ^ (shift.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        return ((spread >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; a key that was not given has some slot, too."""
        shift = self.shift[self._bucket(keys)]
        return np.where(shift < 0, -1 - shift, self._slot(keys, shift))


class Vocabulary:
    """Entries of a rank file with both tiers of the lookup. Its size is that of the file and 1.1 million kinds."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        entries = sorted(self.ranks.items(), key=lambda e: e[1])
        self.ids = np.array([rank for _, rank in entries], np.int64)
        self.blob = Spans(np.frombuffer(b"".join(entry for entry, _ in entries), np.uint8))
        self.size = np.array([len(entry) for entry, _ in entries], np.int64)
        self.first = np.cumsum(self.size) - self.size
        keys = self.blob.hashes(self.first, self.first + self.size)
        self.perfect = PerfectHash(keys)
        self.entry = np.zeros(len(entries), np.int64)  # of each slot
        self.entry[self.perfect.slots(keys)] = np.arange(len(entries))
        self.kinds = code_point_kinds()
        self.pairs = [self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.pair_ranks = np.array(self.pairs, np.int64)
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        known = self.ranks
        halves = [
            (known[entry[:cut]] << 32 | known[entry[cut:]], rank)
            for entry, rank in entries
            for cut in range(1, len(entry))
            if entry[:cut] in known and entry[cut:] in known
        ]
        self.joins = Table(*np.array(halves, np.int64).reshape(-1, 2).T.copy())
        # by id, for decoding: ids may have gaps
        self.place = np.full(int(self.ids.max(initial=-1)) + 1, -1, np.int64)
        self.place[self.ids] = np.arange(len(entries))

    def __getstate__(self) -> dict:
        blob = self.blob.data[: len(self.blob.loads) - 1].copy()
        return {k: v for k, v in self.__dict__.items() if k != "blob"} | {"bytes": blob}

    def __setstate__(self, state: dict) -> None:
        self.blob = Spans(state.pop("bytes"))
        self.__dict__.update(state)

    def whole(self, spans: Spans, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The id of each span that is an entry, -1 for the others."""
        length = end - start
        entry = self.entry[self.perfect.slots(spans.hashes(start, end))]
        found = np.full(len(start), -1, np.int64)
        rows = np.flatnonzero(self.size[entry] == length)
        rows = rows[spans.equal(start[rows], self.blob, self.first[entry[rows]], length[rows])]
        found[rows] = self.ids[entry[rows]]
        return found

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no entry: a heap of neighbours over linked bytes."""
        get, pairs, n = self.ranks.get, self.pairs, len(piece)
        bits = n.bit_length()
        low = (1 << bits) - 1
        after, before = list(range(1, n + 2)), list(range(-1, n + 1))
        rank_at = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]
        heap = [r << bits | i for i, r in enumerate(rank_at) if r >= 0]
        rank_at += [-1, -1]
        heapify(heap)
        while heap:
            item = heappop(heap)
            i = item & low
            if rank_at[i] != item >> bits:
                continue  # one of the two has been joined to something else
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            rank_at[j] = -1
            if k < n:
                found = rank_at[i] = get(piece[i : after[k]], -1)
                if found >= 0:
                    heappush(heap, found << bits | i)
            else:
                rank_at[i] = -1
            i = before[i]
            if i >= 0:
                found = rank_at[i] = get(piece[i:k], -1)
                if found >= 0:
                    heappush(heap, found << bits | i)
        ids, i = [], 0
        while i < n:
            j = after[i]
            ids.append(self.ranks[piece[i:j]])
            i = j
        return ids


    def merged_in_step(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens, number of each): as `merged`, for pre-tokens of at most `IN_STEP` bytes.

        Each row has a heap of its own: a tree whose nodes hold the least of what is below them, with a leaf for each pair
        of neighbours. A step takes every row's least pair and mends the paths above the three leaves that change.
        """
        width = 1 << max(1, int(length.max() - 1).bit_length())
        column = np.arange(width)
        inside = column < length[:, None]
        signs = data[np.minimum(start[:, None] + column, len(data) - 1)].astype(np.int64)
        if (self.single[signs[inside]] < 0).any():
            raise KeyError("the vocabulary lacks a byte")
        none = np.int64(1) << 62
        rank = np.full(signs.shape, -1, np.int64)
        rank[:, :-1] = np.where(inside[:, 1:], self.pair_ranks[signs[:, :-1] << 8 | signs[:, 1:]], -1)
        tree = np.empty((len(start), 2 * width), np.int64)
        tree[:, width:] = np.where(rank >= 0, rank << 6 | column, none)
        half = width // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        part = self.single[signs].ravel()
        whole = inside.copy().ravel()
        after = np.minimum(column + 1, length[:, None]).ravel()
        before = np.tile(np.arange(-1, width), len(start))
        tree, row = tree.ravel(), np.arange(len(start))
        while True:
            least = tree[row * (2 * width) + 1]
            row = row[least < none]
            if not len(row):
                break
            least = least[least < none]
            at, top, end = row * width, row * (2 * width), length[row]
            i = least & 63
            j = after[at + i]
            k = np.where(j < end, after[at + np.minimum(j, width - 1)], end)
            part[at + i], whole[at + j] = least >> 6, False
            after[at + i], before[row * (width + 1) + k] = k, i
            p = before[row * (width + 1) + i]
            joined = np.full((2, len(row)), -1, np.int64)
            right, left = np.flatnonzero(k < end), np.flatnonzero(p >= 0)
            joined[0, right] = self.joins.find(part[(at + i)[right]] << 32 | part[(at + k)[right]])
            joined[1, left] = self.joins.find(part[(at + p)[left]] << 32 | part[(at + i)[left]])
            tree[top + width + j] = none
            tree[top + width + i] = np.where(joined[0] >= 0, joined[0] << 6 | i, none)
            tree[(top + width + p)[left]] = np.where(joined[1] >= 0, joined[1] << 6 | p, none)[left]
            for leaf in (j, i, np.maximum(p, 0)):
                node = (width + leaf) >> 1
                for _ in range(width.bit_length() - 1):
                    below = top + 2 * node
                    tree[top + node] = np.minimum(tree[below], tree[below + 1])
                    node >>= 1
        return part[whole], whole.reshape(-1, width).sum(axis=1)


def pre_tokens(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Byte at which each pre-token begins; pre-tokens fill the texts, which lie end to end, without gaps.

    A pre-token is a run of letters, of numbers or of other signs, with one blank before it if there is one; the
    remaining white space; or an apostrophe with one of `ENDINGS`.
    """
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(begin)
    if not n:
        return begin
    points = data[begin].astype(np.int64)
    wide = np.flatnonzero(points >= 0xC0)
    if len(wide):
        lead, at = points[wide], begin[wide]
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        value = lead & (0xFF >> (size + 1))
        for more in range(1, 4):
            there = size > more
            value[there] = value[there] << 6 | (data[at[there] + more] & 0x3F)
        points[wide] = value
    kind = kinds[points]
    edge = np.zeros(n + 1, bool)  # a text begins (or the last one ends)
    edge[np.searchsorted(begin, offsets)] = True
    starts = edge.copy()
    starts[1:-1] |= kind[1:] != kind[:-1]
    # the last white space before something else goes apart, and a blank goes with what follows
    follows = np.flatnonzero(starts[1:-1] & ~edge[1:-1] & (kind[:-1] == SPACE)) + 1
    starts[follows - 1] = True
    starts[follows[points[follows - 1] == 0x20]] = False
    # apostrophes: a run of other signs of length one without a blank, and letters behind it
    quote = np.flatnonzero((points[:-1] == 0x27) & starts[:-2] & (kind[1:] == LETTER) & ~edge[1:-1])
    if len(quote):
        tail = data[np.minimum(begin[quote][:, None] + [1, 2], len(data) - 1)]
        inside = quote + 2 < n
        inside[inside] &= ~edge[quote[inside] + 2]
        taken = np.zeros(len(quote), np.int64)
        for ending in ENDINGS:
            fits = (taken == 0) & (tail[:, 0] == ending[0])
            if len(ending) == 2:
                fits &= inside & (tail[:, 1] == ending[1])
            taken[fits] = len(ending)
        quote, taken = quote[taken > 0], taken[taken > 0]
        starts[quote + 1] = False
        starts[quote + 1 + taken] = True
    return begin[starts[:-1]]


def merge_all(vocabulary: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pre-tokens, number of each) of pre-tokens that are no entries."""
    length = end - start
    order, pools, counts = [], [np.zeros(0, np.int64)], []
    for low, high in ((1, 8), (9, 16), (17, IN_STEP)):
        short = np.flatnonzero((length >= low) & (length <= high))
        for first in range(0, len(short), ROWS):
            rows = short[first : first + ROWS]
            ids, size = vocabulary.merged_in_step(data, start[rows], length[rows])
            order.append(rows)
            pools.append(ids)
            counts.append(size)
    for row in np.flatnonzero(length > IN_STEP).tolist():
        ids = vocabulary.merged(data[start[row] : end[row]].tobytes())
        order.append([row])
        pools.append(np.array(ids, np.int64))
        counts.append([len(ids)])
    pool = np.concatenate(pools)
    if not order:
        return pool, np.zeros(0, np.int64)
    order, size = np.concatenate(order).astype(np.int64), np.zeros(len(start), np.int64)
    size[order] = np.concatenate(counts)
    first = np.zeros(len(start), np.int64)
    first[order] = np.cumsum(size[order]) - size[order]
    return pool[stretches(first, size)], size


def encode_slice(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offset of each); the texts lie end to end."""
    start = pre_tokens(data, offsets, vocabulary.kinds)
    end = np.append(start[1:], len(data))[: len(start)]
    spans = Spans(data)
    found = vocabulary.whole(spans, start, end)
    size = np.ones(len(start), np.int64)
    missed = np.flatnonzero(found < 0)
    same = same_spans(spans, start[missed], end[missed])
    heads = np.flatnonzero(same == np.arange(len(same)))
    pool, sizes = merge_all(vocabulary, data, start[missed[heads]], end[missed[heads]])
    number = np.zeros(len(missed), np.int64)
    number[heads] = np.arange(len(heads))
    number = number[same]
    size[missed] = sizes[number]
    ends = np.concatenate(([0], np.cumsum(size)))
    ids = np.empty(ends[-1], np.int64)
    known = np.flatnonzero(found >= 0)
    ids[ends[known]] = found[known]
    first = (np.cumsum(sizes) - sizes)[number]
    ids[stretches(ends[missed], size[missed])] = pool[stretches(first, size[missed])]
    return ids, ends[np.searchsorted(start, offsets)]


@lru_cache(maxsize=2)
def _digits(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits and a blank of every number of so many bits, and their lengths."""
    digits = [b"%d " % i for i in range(1 << bits)]
    width = max(map(len, digits))
    table = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in digits), np.uint8).reshape(-1, width)
    return table, np.array([len(d) for d in digits], np.int64)


def decimal_digests(ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """SHA-256 of each list's decimal ids joined by one space."""
    table, sizes = _digits(int(ids.max(initial=0)).bit_length())
    listed = table[ids]
    raw = memoryview(listed[listed > 0])
    ends = np.concatenate(([0], np.cumsum(sizes[ids])))[bounds].tolist()
    return [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1], ends[1:])]


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids.astype(np.int32)))


def encode_documents(
    docs: DataFrame, path: str, column: str = "text", out: str = "ids", digest: bool = False
) -> DataFrame:
    """All rows and columns of `docs` plus an array of ids; null and empty texts get an empty array.

    Each whole text is encoded by itself; nothing is shuffled, and repeated rows give equal rows. Special tokens are
    ordinary text. With `digest`, n_tokens and ids_sha256 (of the decimal ids joined by one space) are
    added. Columns that already have these names are replaced.
    """
    added = [StructField(out, ArrayType(IntegerType()))]
    if digest:
        added += [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType())]
    docs = docs.drop(*(f.name for f in added))
    names, text = [*docs.columns, *(f.name for f in added)], docs.columns.index(column)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in texts.text_slices(batch.column(text), SLICE):
                ids, bounds = encode_slice(shared.value, data, offsets)
                columns = [_lists(ids, bounds)]
                if digest:
                    columns += [pa.array(np.diff(bounds)), pa.array(decimal_digests(ids, bounds), pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.slice(row, len(offsets) - 1).columns, *columns], names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def decode_column(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes that each list of ids stands for; an id without an entry raises ValueError."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(vocabulary.place) or (vocabulary.place[ids] < 0).any()):
        raise ValueError("an id is not in the vocabulary")
    entry = vocabulary.place[ids]
    size = vocabulary.size[entry]
    raw = vocabulary.blob.data[stretches(vocabulary.first[entry], size)]
    ends = np.concatenate(([0], np.cumsum(size)))[bounds].astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def decode_documents(rows: DataFrame, path: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """All rows and columns plus the bytes that the ids stand for; a null or empty list gives none.

    A null id inside a list, or one that the vocabulary lacks, ends the query. A column that already has the name
    is replaced.
    """
    rows = rows.drop(out)
    at, names = rows.columns.index(column), [*rows.columns, out]
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at).fill_null([])
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            first = 0
            while first < len(lists):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE // 4, "right")) - 1)
                part = lists.slice(first, last - first)
                values = part.flatten()
                if values.null_count:
                    raise ValueError("a list holds a null in place of an id")
                raw = decode_column(shared.value, values.to_numpy().astype(np.int64), ends[first : last + 1] - ends[first])
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, raw.cast(pa.binary())], names)
                first = last

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, BinaryType())]))


def decoded_digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and the SHA-256 of the decoded bytes."""
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
