"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search keeps, for every boundary of the text, its one best path: the piece that ends there and
the boundary before it. Only boundaries less than the longest piece away can start a further piece;
as soon as the paths of all of them run through one boundary, everything before it is committed and
forgotten.

What makes a path best depends on the model. In a unigram model it is the sum of piece scores. A
byte-pair model has no path scores: there a path is admissible if merging, applied to any two
neighbouring pieces, leaves them as they are, and each boundary has one admissible path, which is the
result of merging the whole text. Characters outside the vocabulary become byte pieces.

No piece of the usual models holds a space after another character, so all paths meet in front of
each word. `encode_column` uses that: the distinct words of a batch are searched once.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from adfathom.llm import texts

SPACE = "▁"
#: What an unknown character costs beyond the worst piece of a unigram model.
UNKNOWN_PENALTY = 10.0
KNOWN_WORDS = 250_000
#: Longest word that is searched together with others.
LOCKSTEP = 48
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, raw[at : at + size]
            at += size


class Table:
    """Whole numbers looked up many at a time; -1 where a key is missing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        multiplier = np.uint64(texts.BASE)
        keys, values = keys.astype(np.int64), values.astype(np.int32)
        while len(keys):
            shift = np.uint64(64 - max(8, int(len(keys) * 6).bit_length()))
            slot = (keys.view(np.uint64) * multiplier) >> shift
            held = np.full(1 << (64 - int(shift)), -1, np.int64)
            held[slot] = keys
            value = np.full(len(held), -1, np.int32)
            won = held[slot] == keys
            value[slot[won]] = values[won]
            self.levels.append((multiplier, shift, held, value))
            keys, values = keys[~won], values[~won]
            multiplier = np.uint64((int(multiplier) * texts.WORD_BASE) % (1 << 64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int32)
        for multiplier, shift, held, value in self.levels:
            slot = (keys.view(np.uint64) * multiplier) >> shift
            found = np.where(held[slot] == keys, value[slot], found)
        return found


class PieceModel:
    """Vocabulary and rules of a .model file."""

    def __init__(self, path: str):
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        self.unknown, self.kind, prefix = 0, UNIGRAM, True
        with open(path, "rb") as file:
            raw = file.read()
        for field, value in _fields(raw):
            if field == 1:
                part = dict(_fields(value))
                piece = part.get(1, b"").decode()
                kind = part.get(3, NORMAL)
                number = len(self.surface)
                self.surface.append(piece.replace(SPACE, " ").encode() if kind in (NORMAL, USER_DEFINED) else b"")
                if kind in (NORMAL, USER_DEFINED):
                    self.ids[piece] = number
                    self.scores[piece] = struct.unpack("<f", part.get(2, b"\0\0\0\0"))[0]
                elif kind == BYTE:
                    self.byte_ids[int(piece[1:-1], 16)] = number
                    self.surface[-1] = bytes([int(piece[1:-1], 16)])
                elif kind == UNKNOWN:
                    self.unknown = number
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                rules = dict(_fields(value))
                if rules.get(2) or rules.get(4, 1):
                    raise ValueError("only models that leave the text as it is are supported")
                prefix = bool(rules.get(3, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models are supported")
        self.prefix = SPACE if prefix else ""
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        #: True if all paths meet wherever a space follows another character.
        self.words_close = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.pieces = {number: piece for piece, number in self.ids.items()}
        self._stays: dict[tuple[str, str], bool] = {}
        self._grow_tree()
        self._pairs, self._recent = [np.zeros((2, 0), np.int64)] * 2
        self._pair_tables = [Table(*self._pairs), Table(*self._recent)]
        self.forget()

    def forget(self) -> None:
        """Empties the store of searched words."""
        self.known: dict[str, int] = {}
        self.pool, self.first, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _grow_tree(self) -> None:
        """Prefix tree of the pieces: (node, character) to node, and the piece that ends at a node."""
        step: dict[int, int] = {}
        piece_at = [-1]
        for piece, number in self.ids.items():
            node = 0
            for char in piece:
                key = node << 21 | ord(char)
                if key not in step:
                    step[key] = len(piece_at)
                    piece_at.append(-1)
                node = step[key]
            piece_at[node] = number
        self.tree = Table(np.array(list(step), np.int64), np.array(list(step.values()), np.int32))
        self.piece_at = np.array(piece_at, np.int32)

    def stay_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`stays` for many pairs of piece numbers; a left of -1 stands for a start or an unknown character."""
        keys = (left.astype(np.int64) + 1) << 32 | right
        found = np.maximum(self._pair_tables[0].find(keys), self._pair_tables[1].find(keys))
        if (found < 0).any():
            fresh = np.unique(keys[found < 0])
            answers = [
                self.stays(self.pieces[(k >> 32) - 1] if k >> 32 else "", self.pieces[k & 0xFFFFFFFF])
                for k in fresh.tolist()
            ]
            self._recent = np.hstack([self._recent, np.array([fresh, answers], np.int64)])
            if self._recent.shape[1] > 4096:
                self._pairs = np.hstack([self._pairs, self._recent])
                self._recent = self._recent[:, :0]
                self._pair_tables[0] = Table(*self._pairs)
            self._pair_tables[1] = Table(*self._recent)
            return self.stay_all(left, right)
        return found > 0

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: best-scored neighbours first, then the leftmost."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, i)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def stays(self, left: str, right: str) -> bool:
        """True if merging leaves the two neighbours apart and whole."""
        known = self._stays.get((left, right))
        if known is None:
            known = self.merged(left + right) == ([left, right] if left else [right])
            if len(self._stays) >= KNOWN_WORDS:
                self._stays.clear()
            self._stays[left, right] = known
        return known

    def numbers(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.byte_ids[b] or self.unknown for b in piece.encode()]

    def learn(self, words: list[str]) -> None:
        """Searches the words, at whose ends all paths meet, and appends their ids to the store."""
        for at in range(0, len(words), 1 << 15):
            part = words[at : at + (1 << 15)]
            ids, size = search_words(self, part)
            self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.pool = np.concatenate([self.pool, ids])


def search_words(model: PieceModel, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of ids of each): the same search for many short words in step.

    Words longer than LOCKSTEP go through `StreamingViterbi` one by one.
    """
    results: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
    order = sorted((i for i, w in enumerate(words) if 0 < len(w) <= LOCKSTEP), key=lambda i: -len(words[i]))
    for i, word in enumerate(words):
        if len(word) > LOCKSTEP:
            search = StreamingViterbi(model)
            results[i] = np.array(search.push(word) + search.finish(), np.int32)
    sizes = np.array([len(r) for r in results], np.int64)
    lengths = np.array([len(words[i]) for i in order], np.int64)
    chars = np.frombuffer("".join(words[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    total = len(chars)
    start = np.cumsum(lengths) - lengths
    left = np.repeat(start + lengths, lengths) - np.arange(total)
    ending = np.full((model.longest + 1, total + 1), -1, np.int32)
    at, node = np.arange(total), np.zeros(total, np.int64)
    for size in range(1, model.longest + 1):
        node = model.tree.find(node << 21 | chars[at + size - 1]).astype(np.int64)
        alive = node >= 0
        at, node = at[alive], node[alive]
        ending[size, at + size] = model.piece_at[node]
        more = left[at] > size
        at, node = at[more], node[more]
    # boundaries of a word are numbered from its first character's place in `chars`; a piece's data
    # stand at its end, which for the last one is the next word's start, so starts are kept apart
    back, last = np.ones(total + 1, np.int64), np.full(total + 1, -1, np.int32)
    score = np.zeros(total + 1)
    own_score = np.full(len(model.surface) + 1, model.worst)
    own_score[list(model.pieces)] = [model.scores[p] for p in model.pieces.values()]
    for k in range(1, int(lengths[0]) + 1 if len(order) else 0):
        begin = start[: int(np.searchsorted(-lengths, -k, "right"))]
        end = begin + k
        best_size, best_piece, best_score = np.ones(len(end), np.int64), ending[1, end], np.full(len(end), -np.inf)
        open_ = np.arange(len(end))
        for size in range(min(k, model.longest), 0, -1):
            piece = ending[size, end[open_]]
            usable = np.flatnonzero((piece >= 0) | (size == 1))
            rows, piece = open_[usable], piece[usable]
            before = end[rows] - size
            if model.kind == BPE:
                if size == 1:
                    break
                fine = model.stay_all(np.where(before == begin[rows], -1, last[before]), piece)
                best_size[rows[fine]], best_piece[rows[fine]] = size, piece[fine]
                open_ = np.delete(open_, usable[fine])
            else:
                value = np.where(before == begin[rows], 0.0, score[before]) + own_score[piece]
                fine = value > best_score[rows]
                rows = rows[fine]
                best_size[rows], best_piece[rows], best_score[rows] = size, piece[fine], value[fine]
        back[end], last[end], score[end] = best_size, best_piece, best_score
    chosen, end, begin = np.zeros(total + 1, bool), start + lengths, start
    counts = np.zeros(len(order), np.int64)
    live = np.arange(len(order))
    while len(live):
        chosen[end] = True
        counts[live] += 1
        end = end - back[end]
        going = end > begin
        live, end, begin = live[going], end[going], begin[going]
    ends = np.flatnonzero(chosen)
    ids = last[ends]
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        strange = [model.numbers(chr(chars[ends[i] - 1])) for i in odd.tolist()]
        width = np.ones(len(ids), np.int64)
        width[odd] = [len(x) for x in strange]
        word = np.repeat(np.arange(len(order)), counts)
        counts = np.bincount(word, weights=width, minlength=len(order)).astype(np.int64)
        place = np.cumsum(width) - width
        ids = np.repeat(ids, width)
        for i, numbers in zip(odd.tolist(), strange):
            ids[place[i] : place[i] + len(numbers)] = numbers
    sizes[order] = counts
    if all(len(r) == 0 for r in results):
        source = np.zeros(len(words), np.int64)
        source[order] = np.cumsum(counts) - counts
        return ids[_stretches(source, sizes)], sizes
    for i, part in zip(order, np.split(ids, np.cumsum(counts)[:-1]) if len(order) else []):
        results[i] = part
    return np.concatenate(results), sizes


def _stretches(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + size[0] - 1, first[1] .., end to end."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


class StreamingViterbi:
    """Takes text in chunks of any size and returns ids as soon as they are certain.

    `text` holds what is not committed. For each boundary in it, `back` has the length of the piece that ends
    there on the best path, `last` the piece and `score` the path's score; all are cut at every commit.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.text = ""
        self.back, self.last, self.score = [0], [""], [0.0]

    def push(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for at in range(0, len(chunk), 2 * self.model.longest):
            self._extend(chunk[at : at + 2 * self.model.longest])
            if len(self.text) > 2 * self.model.longest:
                ids += self._commit(self._meeting())
        return ids

    def finish(self) -> list[int]:
        return self._commit(len(self.text))

    def _extend(self, chunk: str) -> None:
        model, first = self.model, len(self.text)
        self.text += chunk
        step = self._merged_step if model.kind == BPE else self._scored_step
        for end in range(first + 1, len(self.text) + 1):
            size, piece, score = step(end)
            self.back.append(size)
            self.last.append(piece)
            self.score.append(score)

    def _scored_step(self, end: int) -> tuple[int, str, float]:
        scores, best = self.model.scores, None
        for size in range(min(end, self.model.longest), 0, -1):
            piece = self.text[end - size : end]
            own = scores.get(piece)
            if own is None and size == 1:
                own = self.model.worst
            if own is not None and (best is None or self.score[end - size] + own > best[2]):
                best = (size, piece, self.score[end - size] + own)
        return best

    def _merged_step(self, end: int) -> tuple[int, str, float]:
        ids, last = self.model.ids, self.last
        for size in range(min(end, self.model.longest), 1, -1):
            piece = self.text[end - size : end]
            if piece in ids and self.model.stays(last[end - size], piece):
                return size, piece, 0.0
        return 1, self.text[end - 1], 0.0

    def _meeting(self) -> int:
        """The last boundary that every path still to be extended runs through."""
        n = len(self.text)
        live = set(range(n + 1 - self.model.longest, n + 1))
        while len(live) > 1:
            end = max(live)
            live.remove(end)
            live.add(end - self.back[end])
        return live.pop()

    def _commit(self, upto: int) -> list[int]:
        pieces, end = [], upto
        while end > 0:
            pieces.append(self.last[end])
            end -= self.back[end]
        if not upto:
            return []
        self.text = self.text[upto:]
        self.back, self.last, self.score = ([0] + self.back[upto + 1 :], self.last[upto:], self.score[upto:])
        base = self.score[0]
        self.score = [s - base for s in self.score]
        return [i for piece in reversed(pieces) for i in self.model.numbers(piece)]


@functools.cache
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(model: PieceModel, text: str | None) -> list[int]:
    """Ids of one text; null and empty texts have none."""
    if not text:
        return []
    search = StreamingViterbi(model)
    return search.push(model.prefix + text.replace(" ", SPACE)) + search.finish()


def decode(model: PieceModel, ids: list[int]) -> str:
    raw = b"".join(model.surface[i] for i in ids)
    return (raw[1:] if model.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


_stretch = re.compile(r" *[^ ]+| +")


def encode_column(model: PieceModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offset of each text)."""
    column = pc.fill_null(column, "").to_pylist()
    if not model.words_close:
        lists = [encode(model, t) for t in column]
        flat = np.array([i for ids in lists for i in ids], np.int32)
        return flat, np.cumsum([0, *map(len, lists)])
    if len(model.known) > KNOWN_WORDS:
        model.forget()
    known, before = model.known, len(model.known)
    parts: list[int] = []
    counts = []
    front = model.prefix.replace(SPACE, " ")
    for text in column:
        # the sign that stands for a space in pieces is one in texts, too
        words = _stretch.findall(front + text.replace(SPACE, " ")) if text else []
        counts.append(len(words))
        parts += [known.setdefault(w, len(known)) for w in words]
    model.learn([w.replace(" ", SPACE) for w in itertools.islice(known, before, None)])
    which = np.array(parts, np.int64)
    lengths = model.size[which]
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return model.pool[_stretches(model.first[which], lengths)], ends[np.cumsum([0, *counts])]


def decode_column(model: PieceModel, column: pa.Array) -> list[bytes]:
    """UTF-8 text of each list of ids."""
    flat = column.flatten()
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    ends = np.cumsum(np.concatenate(([0], lengths)))
    surface = pa.array(model.surface, pa.large_binary()).take(flat)
    offsets = np.frombuffer(surface.buffers()[1], np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    raw = bytes(surface.buffers()[2] or b"") if len(flat) else b""
    at = offsets[ends]
    skip = 1 if model.prefix else 0
    return [raw[a + (skip if raw[a : a + 1] == b" " and a < b else 0) : b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _small(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about a million bytes of text each."""
    for row, _, offsets in texts.text_slices(batch.column(text)):
        yield batch.slice(row, len(offsets) - 1)


def _encoder(path: str, text: int, names: list[str], digest: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        try:
            for batch in batches:
                for part in _small(batch, text):
                    ids, bounds = encode_column(model, part.column(text))
                    columns = [pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids, pa.int32()))]
                    if digest:
                        raw, ends = memoryview(ids.astype("<u4")).cast("B"), (4 * bounds).tolist()
                        columns.append(pa.array(np.diff(bounds).astype(np.int64)))
                        columns.append(pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64()))
                    yield pa.RecordBatch.from_arrays([*part.columns, *columns], names)
        finally:
            # a worker that waits for its next task holds no words
            model.forget()

    return run


def encode_documents(
    docs: DataFrame, path: str, column: str = "text", out: str = "ids", digest: bool = False
) -> DataFrame:
    """All rows and columns of `docs` plus an array of ids; null and empty texts get an empty array.

    Each text is encoded whole, by itself; nothing is shuffled, and repeated rows give equal rows. With `digest`,
    n_ids and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) are added. Columns
    that already have these names are replaced.
    """
    added = [StructField(out, ArrayType(IntegerType()))]
    if digest:
        added += [StructField("n_ids", LongType()), StructField("ids_crc32", LongType())]
    docs = docs.drop(*(f.name for f in added))
    names = [*docs.columns, *(f.name for f in added)]
    run = _encoder(path, docs.columns.index(column), names, digest)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def decode_documents(rows: DataFrame, path: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """All rows and columns plus the text that the ids stand for; a null list gives the empty text.

    A column that already has the name is replaced.
    """
    rows = rows.drop(out)
    at, names = rows.columns.index(column), [*rows.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                raw = [t.decode("utf-8", "replace") for t in decode_column(model, part.column(at))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.string())], names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, StringType())]))
