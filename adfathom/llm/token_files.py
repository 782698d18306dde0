"""Token ids of whole documents in a compact binary file format, written and read in parallel.

Documents are ordered by doc_id and encoded task by task. Ids are laid end to end and packed into
frames of whole documents; a frame lists its documents and its distinct ids with their shares, followed by blocks of
at most BLOCK ids, coded by `coder` as places in that list. Every block starts with empty contexts and
carries its own length and checksum; the frame's head has a checksum too. Frames are the rows of the
files, so Spark commits them and a lost task leaves nothing behind.
"""

from __future__ import annotations

import functools
import itertools
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adfathom.llm import texts
from adfathom.llm.coder import BLOCK, decode_blocks, encode_blocks, shares

FRAME = 1024 * BLOCK
LANES = 6144
MAGIC = b"TID2"
HEAD = struct.Struct("<4sIIIBI")  # magic, documents, distinct ids, blocks, digits, checksum of what the head lists
BLOCK_HEAD = struct.Struct("<III")  # ids, bytes, checksum of the ids
SLICE = 12 << 20
#: Most that the words met before, with their ids, may take; longer words than LONG bytes are then forgotten first.
KNOWN_BYTES, LONG = 64 << 20, 64
#: New words that the library encodes as one text.
TOGETHER = 256
#: A frame counts as so many blocks at least, as each needs a table of its shares to be read.
LEAST = 64
FRAMES = "part int, place long, ahead long, n_tokens long, frame binary"

#: Kind of a byte: ASCII letter, digit or sign; 0 for all others.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
#: White space of ASCII; bytes with which white space may begin; its last bytes beyond ASCII, and what may stand before them.
_BLANK, _CLOSES, _INSIDE = np.zeros((3, 256), bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_OPENS = _BLANK.copy()
_OPENS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_CLOSES[[*range(0x80, 0x8F), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_INSIDE[[0xC2, 0x80, 0x81, 0x9A, 0xA0]] = True


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flags of the bytes of texts laid end to end (and of their end) at which a byte-level tokenizer begins a new word.

    Those are the starts of texts, single spaces with other signs than white space on both sides, and changes between
    ASCII letters, digits and signs, except behind an apostrophe, which some endings take along. Where white space of
    Unicode may be near, no start is flagged.
    """
    flags = np.zeros(len(data) + 1, bool)
    flags[offsets] = True
    if not len(data):
        return flags
    space = np.flatnonzero(data == 0x20)
    space = space[~flags[space + 1]]
    before = data[space - 1]
    apart = ~(_OPENS[data[space + 1]] | _BLANK[before])
    high = np.flatnonzero(before >= 0x80)
    apart[high] &= ~(_CLOSES[before[high]] & _INSIDE[data[space[high] - 2]])
    flags[space[apart]] = True
    kind = _KIND[data]
    change = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    change &= (data[:-1] != 0x27) | (kind[1:] != 1)
    flags[1:-1] |= change
    return flags


def _laid(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The strings between consecutive offsets; nothing is copied."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class CachedTokenizer:
    """A tokenizer file whose ids of words met before are looked up; the library encodes each new word.

    Texts are cut into words where a byte-level tokenizer cuts them anyway. Texts with a special token's name, and all
    texts of other tokenizers, are encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        rule = self.tokenizer.pre_tokenizer
        named = json.loads(rule.__getstate__()) if rule is not None else {}
        wanted = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.cuts = self.tokenizer.normalizer is None and wanted.items() <= named.items()
        self.spaced = any(" " in name for name in self.special)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes that each id stands for: a byte-level vocabulary has one sign for each byte.
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(word) for word in vocabulary]
        for i, token in added.items():
            self.bytes[i] = len(token.content.encode())
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, column: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offset of each); a null is empty."""
        column = pc.fill_null(pa.array(column, pa.string()) if isinstance(column, list) else column, "").cast(pa.large_string())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.uint32), offsets
        flags = word_starts(data, offsets)
        for i in np.flatnonzero(self._named(column)) if self.cuts else range(len(column)):
            flags[offsets[i] + 1 : offsets[i + 1]] = False
        cuts = np.flatnonzero(flags)
        coded = pa.chunked_array([self.known, _laid(data, cuts)]).dictionary_encode()
        coded = coded.chunk(coded.num_chunks - 1)
        self._learn(coded.dictionary[len(self.known) :])
        self.known = coded.dictionary
        found = pa.LargeListArray.from_arrays(pa.array(self.ends), pa.array(self.ids)).take(coded.indices)
        ends = np.asarray(found.offsets)
        if self.known.nbytes + self.ids.nbytes + self.ends.nbytes > KNOWN_BYTES:
            self._keep(np.flatnonzero(np.bincount(np.asarray(coded.indices), minlength=len(self.known))))
        return np.asarray(found.values)[ends[0] : ends[-1]], (ends - ends[0])[np.searchsorted(cuts, offsets)]

    def _named(self, column: pa.Array) -> np.ndarray:
        named = np.zeros(len(column), bool)
        for name in self.special:
            named |= np.asarray(pc.match_substring(column, name))
        return named

    def _learn(self, fresh: pa.Array) -> None:
        """Adds the ids of new words. Those that begin with a space are encoded many at a time, end to end."""
        if not len(fresh):
            return
        read = fresh.cast(pa.large_string())
        spaced = np.asarray(pc.starts_with(read, " ")) & ~self._named(read)
        spaced &= self.cuts and not self.spaced
        order = np.argsort(spaced, kind="stable")
        alone = len(fresh) - int(spaced.sum())
        laid = fresh.take(pa.array(order))
        offsets = np.asarray(pc.binary_length(laid)).cumsum()
        offsets = np.concatenate(([0], offsets)).astype(np.int64)
        data = np.frombuffer(laid.buffers()[2], np.uint8)[: offsets[-1]]
        first = np.ones(len(fresh) + 1, bool)
        first[alone:] = ~word_starts(data, offsets[[0, alone, -1]])[offsets[alone:]]
        first[alone::TOGETHER] = True
        first[-1] = True
        flat, ends = self._library(_laid(data, offsets[first]))
        if alone < len(fresh):
            reach = np.concatenate(([0], np.cumsum(self.bytes[flat])))
            ends = np.minimum(np.searchsorted(reach, offsets), len(flat))
            if reach[-1] != offsets[-1] or (reach[ends] != offsets).any():  # a vocabulary that lacks some bytes
                flat, ends = self._library(laid)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        found = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat)).take(pa.array(back))
        self._add(found)

    def _library(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast(words.cast(pa.large_string()).to_pylist(), add_special_tokens=False)
        found = [e.ids for e in encoded]
        ends = np.cumsum([0, *map(len, found)])
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(ends[-1])), ends

    def _add(self, found: pa.Array) -> None:
        ends = np.asarray(found.offsets)
        self.ids = np.concatenate([self.ids, np.asarray(found.values)[ends[0] : ends[-1]]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends[1:] - ends[0]])

    def _keep(self, met: np.ndarray) -> None:
        """Forgets all words but the short ones among `met`."""
        short = np.asarray(pc.binary_length(self.known))[met] <= LONG
        met = pa.array(met[short])
        known, ids = self.known.take(met), pa.LargeListArray.from_arrays(pa.array(self.ends), pa.array(self.ids)).take(met)
        self.forget()
        if known.nbytes + ids.nbytes <= KNOWN_BYTES:
            self.known = known
            self._add(ids)


@functools.cache
def _tokenizer(path: str) -> CachedTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return CachedTokenizer(path)


def _listed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct ids, place of each id among them, how often each comes)."""
    if ids.max(initial=0) >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    distinct = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int32)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[ids], counts[distinct]


def pack_frames(frames: list[tuple[list[int | None], np.ndarray, np.ndarray]]) -> list[bytes]:
    """Frames from (doc ids, ids per document, ids of all documents) entries; their blocks are coded together."""
    heads, blocks, parts = [], [], []
    for at, (docs, sizes, ids) in enumerate(frames):
        distinct, place, counts = _listed(ids)
        wide = 1
        while 16**wide < 2 * len(distinct) or wide < 4 and 16**wide < len(ids):
            wide += 1
        parts.append(shares(counts, wide) if len(ids) else counts)
        listed = b"".join(
            [
                np.array([d is not None for d in docs], np.uint8).tobytes(),
                np.array([d or 0 for d in docs], "<i8").tobytes(),
                sizes.astype("<u4").tobytes(),
                distinct.astype("<u4").tobytes(),
                parts[-1].astype("<u4").tobytes(),
            ]
        )
        # blocks of about the same length, so that few steps have idle lanes
        edges = np.linspace(0, len(ids), -(-len(ids) // BLOCK) + 1).astype(np.int64).tolist()
        heads.append([HEAD.pack(MAGIC, len(docs), len(distinct), len(edges) - 1, wide, zlib.crc32(listed)), listed])
        blocks += [(at, wide, place[a:b], ids[a:b]) for a, b in itertools.pairwise(edges)]
    coded: list[bytes] = [b""] * len(blocks)
    for lanes, wide, used, frame in _groups([b[:2] for b in blocks]):
        found = encode_blocks([blocks[i][2] for i in lanes], wide, [parts[f] for f in used], frame)
        for i, code in zip(lanes, found):
            coded[i] = code
    for (owner, _, _, plain), code in zip(blocks, coded):
        heads[owner].append(BLOCK_HEAD.pack(len(plain), len(code), zlib.crc32(plain.astype("<u4").tobytes())) + code)
    return [b"".join(h) for h in heads]


def _groups(blocks: list[tuple[int, int]]) -> Iterator[tuple[list[int], int, list[int], list[int]]]:
    """Blocks to code in step, of (frame, digits) each: (their numbers, digits, frames in use, place of each one's frame)."""
    for wide in sorted({w for _, w in blocks}):
        same = [i for i, (_, w) in enumerate(blocks) if w == wide]
        for first in range(0, len(same), LANES):
            lanes = same[first : first + LANES]
            used, frame = np.unique([blocks[i][0] for i in lanes], return_inverse=True)
            yield lanes, wide, used.tolist(), frame.tolist()


def unpack_frames(frames: list[bytes]) -> list[tuple[list[int | None], list[np.ndarray]]]:
    """(doc ids, ids of each document) of each frame; a damaged frame raises ValueError."""
    layouts, parts, codes = [], [], []
    for at, raw in enumerate(frames):
        magic, n_docs, n_distinct, n_blocks, wide, check = HEAD.unpack_from(raw)
        size = 13 * n_docs + 8 * n_distinct
        listed = raw[HEAD.size : HEAD.size + size]
        if magic != MAGIC or zlib.crc32(listed) != check:
            raise ValueError("not a frame of token ids, or its head is damaged")
        named = np.frombuffer(listed, np.uint8, n_docs)
        docs = np.frombuffer(listed, "<i8", n_docs, n_docs)
        sizes = np.frombuffer(listed, "<u4", n_docs, 9 * n_docs)
        distinct = np.frombuffer(listed, "<u4", n_distinct, 13 * n_docs)
        parts.append(np.frombuffer(listed, "<u4", n_distinct, 13 * n_docs + 4 * n_distinct).astype(np.int64))
        if n_blocks and parts[-1].sum() != 16**wide:
            raise ValueError("the head of a frame of token ids is damaged")
        layouts.append(([int(d) if n else None for d, n in zip(docs, named)], sizes, []))
        place = HEAD.size + size
        for _ in range(n_blocks):
            count, length, check = BLOCK_HEAD.unpack_from(raw, place)
            place += BLOCK_HEAD.size
            codes.append((at, wide, distinct, count, check, raw[place : place + length]))
            place += length
    decoded: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(codes)
    for lanes, wide, used, frame in _groups([c[:2] for c in codes]):
        given = [codes[i][5] for i in lanes], [codes[i][3] for i in lanes]
        for i, places in zip(lanes, decode_blocks(*given, wide, [parts[f] for f in used], frame)):
            decoded[i] = codes[i][2][places].astype("<u4")
            if zlib.crc32(decoded[i].tobytes()) != codes[i][4]:
                raise ValueError("a block of token ids is damaged")
    for (at, *_), ids in zip(codes, decoded):
        layouts[at][2].append(ids)
    result = []
    for docs, sizes, found in layouts:
        flat = np.concatenate(found) if found else np.zeros(0, "<u4")
        result.append((docs, np.split(flat, np.cumsum(sizes)[:-1]) if len(docs) else []))
    return result


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int | None = None) -> None:
    """Writes the ids of every text to `folder` in ascending doc_id order (null first, ties by text).

    docs: doc_id (long), text; other columns are ignored. Texts are encoded whole with the tokenizer file, a null as the
    empty text, and `end` is appended to each. Repeated rows are written as often as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ahead, place = TaskContext.get().partitionId(), 0, 0
        coder = _tokenizer(tokenizer)
        waiting: list[tuple[list[int | None], np.ndarray, np.ndarray]] = []
        docs: list[int | None] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = blocks = 0

        def shut() -> None:
            nonlocal docs, sizes, ids, held, blocks
            if docs:
                waiting.append((docs, np.concatenate(sizes), np.concatenate(ids)))
                blocks += -(-held // BLOCK)
            docs, sizes, ids, held = [], [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal ahead, place, blocks
            counts = [len(w[2]) for w in waiting]
            starts = ahead + np.cumsum([0, *counts])
            columns = [
                pa.array([part] * len(waiting), pa.int32()),
                pa.array(range(place, place + len(waiting)), pa.int64()),
                pa.array(starts[:-1], pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array(pack_frames(waiting), pa.binary()),
            ]
            ahead, place, blocks = int(starts[-1]), place + len(waiting), 0
            waiting.clear()
            return pa.RecordBatch.from_arrays(columns, ["part", "place", "ahead", "n_tokens", "frame"])

        for batch in batches:
            for row, _, offsets in texts.text_slices(batch.column(1), SLICE):
                n = len(offsets) - 1
                flat, bounds = coder.encode(batch.column(1).slice(row, n))
                names = batch.column(0).slice(row, n).to_pylist()
                if end is not None:
                    flat, bounds = np.insert(flat, bounds[1:], end), bounds + np.arange(n + 1)
                first = 0
                while first < n:
                    last = int(np.searchsorted(bounds, bounds[first] + FRAME - held))
                    last = min(max(last, first + 1), n)
                    docs += names[first:last]
                    sizes.append(np.diff(bounds[first : last + 1]))
                    ids.append(flat[bounds[first] : bounds[last]].astype(np.uint32))
                    held += len(ids[-1])
                    first = last
                    if held >= FRAME:
                        shut()
                        if blocks >= LANES - FRAME // BLOCK:
                            yield packed()
        shut()
        if waiting:
            yield packed()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FRAMES).write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document in the files.

    With `digest`, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) takes the place of ids.
    Every checksum is verified; damaged files raise an error.
    """
    frames = spark.read.schema(FRAMES).parquet(folder)
    totals = sorted((r["part"], r["n"]) for r in frames.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts = dict(zip([p for p, _ in totals], itertools.accumulate([0, *[n for _, n in totals]])))
    shared = spark.sparkContext.broadcast(starts)

    def table(part: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        docs, first, counts, last = [], [], [], []
        for (number, ahead, _), (names, ids) in zip(part, unpack_frames([p[2] for p in part])):
            sizes = np.array([len(i) for i in ids], np.int64)
            docs += names
            counts.append(sizes)
            first.append(shared.value[number] + ahead + np.cumsum(sizes) - sizes)
            last += [zlib.crc32(i.tobytes()) for i in ids] if digest else ids
        kind = pa.int64() if digest else pa.list_(pa.int32())
        if not digest:
            last = [i.astype(np.int32) for i in last]
        return pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(np.concatenate(first)), pa.array(np.concatenate(counts)), pa.array(last, kind)],
            ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, int, bytes]] = []
        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                waiting.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(3)[i].as_py()))
                held += max(LEAST, -(-batch.column(2)[i].as_py() // BLOCK))
                if held >= LANES - FRAME // BLOCK:
                    yield table(waiting)
                    waiting, held = [], 0
        if waiting:
            yield table(waiting)

    kind = "ids_crc32 long" if digest else "ids array<int>"
    return frames.select("part", "ahead", "n_tokens", "frame").mapInArrow(run, f"doc_id long, start long, n_tokens long, {kind}")
