"""Benchmark decontamination by latent semantic retrieval with checks of word order and answer.

1. One pass over the texts keeps the benchmark words of every passage (overlapping runs of words) in order and counts in
   how many passages each of them occurs. Rare words weigh more.
2. The TF-IDF vectors of all passages over all benchmark words are factored by a distributed randomised singular value
   decomposition; the items stand in the same matrix with enough weight to span the space.
3. A last pass places every passage in that space and takes the items whose cosine reaches a floor as candidates. The
   floor of an item and a passage is the least cosine at which step 4 is possible at all, less what the space leaves out
   of the item, so nothing that step 4 would pass is lost. Candidates must share the needed weight.
4. A passage holds a candidate if the longest common subsequence, weighted by rarity, covers most of the item, or
   enough of it together with the answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfathom.llm import texts
from adfathom.llm.pieces import Table
from adfathom.llm.shared import Scratch

#: Items (parts of long items) that are looked for in one go; a longer benchmark takes several.
ITEM_BLOCK = 256
#: Longest stretch of an item that is looked for as a whole. Longer items are cut into equal parts, of half as many
#: words or more; one of them is at least as fully held as the whole item is.
ITEM_WORDS = 128
EXTRA_RANK = 32
#: Share of an item's weight that must come in order, alone or together with the answer.
ALONE, WITH_ANSWER, ANSWER = 0.75, 0.5, 0.9
MERGE_ROWS = 64
#: A word in more than one of OFTEN passages has a column in a dense matrix, MOST_OFTEN words at most; others are sparse.
OFTEN, MOST_OFTEN = 50, 1024
#: What a cosine in single precision may be off.
ROUNDING = 1e-4
#: Most numbers of a dense matrix inside a task.
DENSE = 1 << 23

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

PASSAGES = "doc_id long, start int, words array<int>"
CANDIDATES = PASSAGES + ", items array<int>, cosines array<float>"


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts and their offsets without case: a text and its capitals become equal in every alphabet."""
    high = np.concatenate(([0], np.cumsum(data >= 128)))[offsets]
    odd = np.flatnonzero(np.diff(high))
    data = texts.LOWER[data]
    if not len(odd):
        return data, offsets
    parts, lengths, done = [], np.diff(offsets), 0
    for i in odd.tolist():
        raw = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "surrogateescape")
        # a dotless i is the only letter that its capital does not fold to
        plain = raw.casefold().replace("\u0131", "i").encode("utf-8", "surrogateescape")
        parts += [data[done : offsets[i]], np.frombuffer(plain, np.uint8)]
        done, lengths[i] = offsets[i + 1], len(plain)
    return np.concatenate([*parts, data[done:]]), np.concatenate(([0], np.cumsum(lengths)))


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, words before each text): runs of letters and digits, case folded."""
    data, offsets = folded(data, offsets)
    start, end, before = texts.word_bounds(data, offsets, _APART)
    return texts.signed(texts.word_hashes(data, start, end)), before


class Items:
    """Up to ITEM_BLOCK stretches of benchmark items with their words as numbers."""

    def __init__(self, ids: list[int], words: list[np.ndarray], answers: list[np.ndarray]):
        self.ids = ids
        self.vocabulary = np.unique(np.concatenate(words))
        self.table = Table(self.vocabulary, np.arange(len(self.vocabulary)))
        self.words = [np.searchsorted(self.vocabulary, w).astype(np.int32) for w in words]
        self.answers = [np.searchsorted(self.vocabulary, w).astype(np.int32) for w in answers]
        #: Passages are twice as long as their distance, so every stretch lies whole in one of them.
        self.step = max(32, max(map(len, words)))

    def weigh(self, counts: np.ndarray, passages: int) -> None:
        """Rarity of each word, and the weight that a passage must share with each item."""
        self.rarity = np.log((passages + 1) / (counts + 0.5)).clip(0.01)
        # rounding must not lose a passage that is just enough
        need = [WITH_ANSWER if len(a) else ALONE for a in self.answers]
        self.need = np.array([n * self.rarity[w].sum() for n, w in zip(need, self.words)]) * (1 - 1e-9)
        kinds = [np.unique(w, return_counts=True) for w in self.words]
        wide = max(len(word) for word, _ in kinds)
        self.kinds = np.zeros((len(kinds), wide), np.int64)
        self.times = np.zeros((len(kinds), wide), np.int64)
        #: The commonest words of an item may add up to half of what is needed; without them the other half must be there.
        self.rare_need = np.zeros(len(kinds))
        #: Least product of an item's vector, of unit length, with a passage's, not scaled, that shares the needed weight.
        self.least = np.zeros(len(kinds))
        word_of, item_of, weight_of = [], [], []
        for i, (word, times) in enumerate(kinds):
            self.kinds[i, : len(word)], self.times[i, : len(word)] = word, times
            weight = self.rarity[word] * times
            # a word adds to the product at least in proportion to the weight shared in it; the cheapest words come first
            value = self.rarity[word] * (1 + np.log(times))
            cheap = np.argsort(value**2 / weight)
            gained, paid = (np.append(0.0, np.cumsum(x[cheap])) for x in (weight, value**2))
            self.least[i] = np.interp(self.need[i], gained, paid) / np.sqrt(paid[-1])
            order = np.argsort(self.rarity[word], kind="stable")
            summed = np.cumsum(weight[order])
            common = int(np.searchsorted(summed, self.need[i] / 2, "right"))
            self.rare_need[i] = self.need[i] - (summed[common - 1] if common else 0.0)
            rare = order[common:]
            word_of.append(word[rare])
            item_of.append(np.full(len(rare), i))
            weight_of.append(weight[rare])
        word_of, item_of, weight_of = map(np.concatenate, (word_of, item_of, weight_of))
        order = np.argsort(word_of, kind="stable")
        self.listed, self.listed_weight = item_of[order], weight_of[order]
        self.listing = np.searchsorted(word_of[order], np.arange(len(self.vocabulary) + 1))
        often = np.argsort(-counts, kind="stable")[:MOST_OFTEN]
        self.often = often[counts[often] * OFTEN > passages]
        self.column = np.full(len(self.vocabulary), -1, np.int32)
        self.column[self.often] = np.arange(len(self.often))

    def nearest(
        self, passage: np.ndarray, word: np.ndarray, n: int, space: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, cosine in the space) where the cosine reaches the floor of the two, ordered by passage."""
        own = self.dense(self.words)
        placed = own @ space
        slack = np.linalg.norm(own - placed @ space.T, axis=1) + ROUNDING
        row, kind, value, norm = self.weighed(passage, word, n)
        # no cosine is above one
        able = np.flatnonzero((norm > 0) & (norm >= (self.least / (1 + slack)).min()))
        found = []
        step = self.at_once(space.shape[1])
        for lo in range(0, len(able), step):
            part = able[lo : lo + step]
            mine = np.full(n, -1)
            mine[part] = np.arange(len(part))
            inside = np.flatnonzero(mine[row] >= 0)
            vectors = Vectors(self, mine[row[inside]], kind[inside], value[inside], len(part))
            cosine = vectors.times(space) @ placed.T
            p, i = np.nonzero(cosine >= self.least / norm[part][:, None] - slack)
            found.append((part[p], i, cosine[p, i]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        return tuple(np.concatenate(x) for x in zip(*found))

    def possible(self, passage: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) pairs that share the needed weight, from the words of `n` passages, ordered by passage.

        Found without the space, by the rare words alone: what the search is held against.
        """
        size, height = len(self.vocabulary), len(self.words)
        listed = np.diff(self.listing)
        known = listed[word] > 0
        cell = np.unique(passage[known] * size + word[known])
        at, kind = np.divmod(cell, size)
        each = listed[kind]
        place = np.arange(each.sum()) + np.repeat(self.listing[kind] - (np.cumsum(each) - each), each)
        pair = np.repeat(at, each) * height + self.listed[place]
        shared = np.bincount(pair, weights=self.listed_weight[place], minlength=n * height)
        found = np.flatnonzero(shared >= np.tile(self.rare_need, n) * (1 - 1e-9))
        p, i = np.divmod(found, height)
        enough = self.enough(p, i, passage, word, n)
        return p[enough], i[enough]

    def enough(self, p: np.ndarray, i: np.ndarray, passage: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """Whether passage `p` and item `i` share the needed weight: all words, each as often as both sides have it."""
        size = len(self.vocabulary)
        enough = np.zeros(len(p), bool)
        chosen, turn = np.unique(p, return_inverse=True)
        step = max(1, DENSE // size)
        for lo in range(0, len(chosen), step):
            part = chosen[lo : lo + step]
            mine = np.full(n, -1)
            mine[part] = np.arange(len(part))
            inside = mine[passage] >= 0
            times = np.bincount(mine[passage[inside]] * size + word[inside], minlength=len(part) * size).reshape(-1, size)
            these = np.flatnonzero((turn >= lo) & (turn < lo + step))
            for these in np.array_split(these, -(-len(these) * self.kinds.shape[1] // DENSE)):
                kinds = self.kinds[i[these]]
                both = np.minimum(times[mine[p[these]][:, None], kinds], self.times[i[these]])
                enough[these] = (both * self.rarity[kinds]).sum(axis=1) >= self.need[i[these]]
        return enough

    def weighed(self, passage: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """TF-IDF of `n` passages as (row, word, value) ordered by row, every row of unit length, and the lengths before."""
        size = len(self.vocabulary)
        cell, times = np.unique(passage * size + word, return_counts=True)
        row, kind = np.divmod(cell, size)
        value = (1 + np.log(times)) * self.rarity[kind]
        norm = np.sqrt(np.bincount(row, weights=value**2, minlength=n))
        return row, kind, value / norm[row], norm

    def at_once(self, width: int) -> int:
        """Passages whose dense matrices, one of them of `width` columns, are made in one go."""
        return max(1, DENSE // (len(self.often) + len(self.words) + width))

    def dense(self, sequences: list[np.ndarray]) -> np.ndarray:
        row = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
        row, word, value, _ = self.weighed(row, np.concatenate(sequences).astype(np.int64), len(sequences))
        found = np.zeros((len(sequences), len(self.vocabulary)), np.float32)
        found[row, word] = value
        return found


def added(at: np.ndarray, other: np.ndarray, value: np.ndarray, matrix: np.ndarray, n: int) -> np.ndarray:
    """Sum of value * matrix[other] for each of `n` places `at`, which are in order: the first cell of each, the second, ..."""
    counts = np.bincount(at, minlength=n)
    longest = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[longest]
    left = np.cumsum(np.bincount(counts)[::-1])[::-1]  # places with so many cells or more
    total = np.zeros((n, matrix.shape[1]), np.float32)
    for j, size in enumerate(left[1:].tolist()):
        cell = first[:size] + j
        part = matrix[other[cell]]
        part *= value[cell, None]
        total[:size] += part
    found = np.empty_like(total)
    found[longest] = total
    return found


class Vectors:
    """TF-IDF vectors of `n` passages, from cells ordered by row: frequent words in a dense matrix, the others as cells."""

    def __init__(self, items: Items, row: np.ndarray, word: np.ndarray, value: np.ndarray, n: int):
        column = items.column[word]
        often, seldom = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
        self.items, self.n = items, n
        self.dense = np.zeros((n, len(items.often)), np.float32)
        self.dense[row[often], column[often]] = value[often]
        self.row, self.word, self.value = row[seldom], word[seldom], value[seldom].astype(np.float32)

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """The vectors' products with a matrix of a row for each word."""
        return added(self.row, self.word, self.value, matrix, self.n) + self.dense @ matrix[self.items.often]

    def turned(self, matrix: np.ndarray) -> np.ndarray:
        """For each word the sum of its value in each vector times that vector's row of a matrix."""
        order = np.argsort(self.word, kind="stable")
        found = added(self.word[order], self.row[order], self.value[order], matrix, len(self.items.vocabulary))
        found[self.items.often] += self.dense.T @ matrix
        return found


def read_items(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark block by block; only the words of one block are on the driver at a time.

    benchmark: item_id, text and, if there is one, answer. Without an answer the last line of an item with several
    lines stands for it, else its last third. Null and wordless items are never found; repeated rows count once.
    """
    columns = ["item_id", "text"] + (["answer"] if "answer" in benchmark.columns else [])
    rows = benchmark.select(*columns).where("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy(*columns)
    parts: list[tuple[int, np.ndarray, np.ndarray]] = []
    for item in rows.toLocalIterator():
        said = [item["text"], item["answer"] if len(columns) > 2 and item["answer"] else item["text"].rsplit("\n", 1)[-1]]
        found, before = plain_words(*next(iter(texts.text_slices(pa.array(["\n".join(said)]))))[1:])
        whole, _ = plain_words(*next(iter(texts.text_slices(pa.array(said[:1]))))[1:])
        answer = found[len(whole) :]
        if len(columns) == 2 and "\n" not in item["text"]:
            answer = whole[len(whole) * 2 // 3 :]
        cuts = -(-len(whole) // ITEM_WORDS)
        for part in np.array_split(whole, cuts) if cuts else ():
            parts.append((item["item_id"], part, answer[np.isin(answer, part)] if len(answer) else part))
        if len(parts) >= ITEM_BLOCK:
            yield Items(*map(list, zip(*parts)))
            parts = []
    if parts:
        yield Items(*map(list, zip(*parts)))


def _passages(batch: pa.RecordBatch, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each stretch of documents: (first row, benchmark word or -1 of each word, passage starts, their documents)."""
    for row, data, offsets in texts.text_slices(batch.column(1)):
        hashed, before = plain_words(data, offsets)
        known = items.table.find(hashed)
        counts = np.maximum(-(-np.diff(before) // items.step) - 1, (np.diff(before) > 0).astype(np.int64))
        owner = np.repeat(np.arange(len(counts)), counts)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = before[owner] + turn * items.step
        yield row, known, np.stack([start, np.minimum(start + 2 * items.step, before[owner + 1])]), owner


def _cells(known: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, word) of every benchmark word in every passage, in order."""
    place = np.flatnonzero(known >= 0)
    lo, hi = np.searchsorted(place, bounds[0]), np.searchsorted(place, bounds[1])
    passage = np.repeat(np.arange(len(lo)), hi - lo)
    at = np.arange(len(passage)) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
    return passage, known[place[at]]


def _reader(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for row, known, bounds, owner in _passages(batch, items):
                passage, word = _cells(known, bounds)
                turn = np.arange(len(owner)) - np.searchsorted(owner, owner)
                ends = np.searchsorted(passage, np.arange(len(owner) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row + owner)),
                        pa.array((turn * items.step).astype(np.int32)),
                        pa.ListArray.from_arrays(ends, pa.array(word.astype(np.int32))),
                    ],
                    ["doc_id", "start", "words"],
                )

    return run


def _flat(batch: pa.RecordBatch, column: int, step: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row and word of each word in order) of lists of words, `step` rows at a time."""
    for at in range(0, batch.num_rows, step):
        part = batch.column(column).slice(at, step)
        row = np.repeat(np.arange(len(part)), np.diff(np.asarray(part.offsets)))
        yield at, len(part), row, np.asarray(part.flatten()).astype(np.int64)


def _counter(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value.vocabulary)
        counts, total = np.zeros(size, np.int64), 0
        for batch in batches:
            for _, n, passage, word in _flat(batch, 0, max(1, batch.num_rows)):
                cell, _ = np.unique(passage * size + word, return_counts=True)  # by sorting: a tenth of the time of hashing
                counts += np.bincount(cell % size, minlength=size)
                total += n
        word = np.append(np.flatnonzero(counts), -1)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.append(counts[word[:-1]], total))], ["word", "n"])

    return run


def _searcher(shared, spread) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, space = shared.value, spread.value
        for batch in batches:
            for at, n, passage, word in _flat(batch, 2, items.at_once(space.shape[1])):
                p, item, cosine = items.nearest(passage, word, n, space)
                enough = items.enough(p, item, passage, word, n)
                p, item, cosine = p[enough], item[enough], cosine[enough]
                good, begins = np.unique(p, return_index=True)
                ends = np.append(begins, len(p)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(column.take(pa.array(at + good)) for column in batch.columns),
                        pa.ListArray.from_arrays(ends, pa.array(item.astype(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array(cosine.astype(np.float32))),
                    ],
                    ["doc_id", "start", "words", "items", "cosines"],
                )

    return run


def _sequences(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Lists of some rows at a time, few enough for a dense matrix of `size` columns."""
    step = max(1, DENSE // size)
    for at in range(0, batch.num_rows, step):
        part = batch.column(column).slice(at, step)
        flat, offsets = np.asarray(part.flatten()), np.asarray(part.offsets)
        yield at, np.split(flat, offsets[1:-1] - offsets[0])


def _summed(passages: DataFrame, shared, basis: np.ndarray, both: bool) -> np.ndarray:
    """Sum over all passages x of x (x basis), or of (x basis)(x basis) with `both`.

    Each task adds up its own passages; the sums are merged piece by piece, and only the merged matrix,
    whose size follows from the benchmark, comes to the driver.
    """
    spread = passages.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, basis = shared.value, spread.value
        total = np.zeros((basis.shape[1] if both else basis.shape[0], basis.shape[1]))
        seen = False
        for batch in batches:
            for _, n, passage, word in _flat(batch, 0, items.at_once(basis.shape[1])):
                seen = True
                vectors = Vectors(items, *items.weighed(passage, word, n)[:3], n)
                latent = vectors.times(basis)
                total += latent.T @ latent if both else vectors.turned(latent)
        for at in range(0, len(total) if seen else 0, MERGE_ROWS):
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), pa.array([total[at : at + MERGE_ROWS].astype(np.float32).tobytes()], pa.binary())], ["at", "rows"]
            )

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(r, np.float32).astype(np.float64) for r in part["rows"])
        return pd.DataFrame({"at": part["at"].iloc[:1], "rows": [total.tobytes()]})

    kind = "at long, rows binary"
    pieces = passages.mapInArrow(run, kind).groupBy("at").applyInPandas(merge, kind).orderBy("at").collect()
    width = basis.shape[1]
    height = width if both else basis.shape[0]
    if not pieces:
        return np.zeros((height, width))
    return np.concatenate([np.frombuffer(p["rows"]).reshape(-1, width) for p in pieces])


def latent_space(passages: DataFrame, items: Items, shared, seed: int = 5) -> np.ndarray:
    """Right singular vectors (benchmark words by rank) of the passages' TF-IDF matrix with the items in it."""
    rng = np.random.default_rng(seed)
    rank = min(len(items.vocabulary), len(items.words) + EXTRA_RANK)
    own = items.dense(items.words).astype(float)
    basis = rng.normal(size=(len(items.vocabulary), rank)).astype(np.float32)
    basis, _ = np.linalg.qr(basis)
    grown = _summed(passages, shared, basis.astype(np.float32), False)
    # the items weigh as much as the strongest direction of the passages, so none of them is cut off
    weight = max(1.0, np.linalg.norm(grown, axis=0).max())
    basis, _ = np.linalg.qr(np.concatenate([own.T, grown + weight * own.T @ (own @ basis)], axis=1))
    basis = basis[:, : min(basis.shape[1], rank + len(items.words))]
    inner = _summed(passages, shared, basis.astype(np.float32), True) + weight * (own @ basis).T @ (own @ basis)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    return basis @ vectors[:, np.argsort(-values)[:rank]]


def common_weight(items: list[np.ndarray], passages: list[np.ndarray], rarity: np.ndarray) -> np.ndarray:
    """Share of each item's weight in its heaviest common subsequence with the passage beside it."""
    n = len(items)
    if not n:
        return np.zeros(0)
    wide = np.full((n, max(map(len, passages), default=0) + 1), -1, np.int64)
    for i, p in enumerate(passages):
        wide[i, : len(p)] = p
    best = np.zeros((n, wide.shape[1] + 1))
    for j in range(max(map(len, items))):
        word = np.array([w[j] if j < len(w) else -2 for w in items])
        step = np.where(wide == word[:, None], best[:, :-1] + np.where(word < 0, 0, rarity[word])[:, None], best[:, 1:])
        best[:, 1:] = np.maximum.accumulate(step, axis=1)
    whole = np.array([rarity[w].sum() for w in items])
    return best[:, -1] / np.maximum(whole, 1e-12)


def _finder(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for at, parts in _sequences(batch, 2, len(items.vocabulary)):
                wanted = batch.column(3).slice(at, len(parts))
                p = np.repeat(np.arange(len(parts)), np.diff(np.asarray(wanted.offsets)))
                q = np.asarray(wanted.flatten())
                cosine = np.asarray(batch.column(4).slice(at, len(parts)).flatten())
                kept = []
                for lo in range(0, len(p), 1024):
                    pp, qq = p[lo : lo + 1024], q[lo : lo + 1024]
                    share = common_weight([items.words[i] for i in qq], [parts[i] for i in pp], items.rarity)
                    answer = common_weight([items.answers[i] for i in qq], [parts[i] for i in pp], items.rarity)
                    found = np.flatnonzero((share >= ALONE) | ((share >= WITH_ANSWER) & (answer >= ANSWER)))
                    kept += [(pp[k], qq[k], share[k], answer[k], cosine[lo + k]) for k in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([at + k[0] for k in kept], pa.int64())),
                        pa.array([items.ids[k[1]] for k in kept], pa.int64()),
                        batch.column(1).take(pa.array([at + k[0] for k in kept], pa.int64())),
                        pa.array([float(k[4]) for k in kept], pa.float64()),
                        pa.array([float(k[2]) for k in kept], pa.float64()),
                        pa.array([float(k[3]) for k in kept], pa.float64()),
                    ],
                    ["doc_id", "item_id", "start", "cosine", "share", "answer_share"],
                )

    return run


FOUND = "doc_id long, item_id long, start int, cosine double, share double, answer_share double"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the best passage for it.

    docs: doc_id (long), text; benchmark: item_id (long), text and perhaps answer; other columns are ignored. Every word
    of every text is looked at. Null, empty and wordless texts hold nothing, an empty benchmark finds nothing, rows
    without a doc_id are not reported, and repeated rows are reported once. Returns doc_id, item_id, start (first
    word of the passage), cosine, share and answer_share (weight of the item and of its answer found in order; of an
    item of more than ITEM_WORDS words, the same of the part that is held best).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    result = spark.createDataFrame([], FOUND)
    for number, items in enumerate(read_items(benchmark)):
        shared = spark.sparkContext.broadcast(items)
        passages = scratch.keep(source.mapInArrow(_reader(shared), PASSAGES), f"passages-{number}")
        lists = passages.select("words")
        counted = lists.mapInArrow(_counter(shared), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(len(items.vocabulary) + 1, np.int64)
        for r in counted:
            counts[r["word"]] = r["n"]
        items.weigh(counts[:-1], int(counts[-1]))
        shared = spark.sparkContext.broadcast(items)
        spread = spark.sparkContext.broadcast(latent_space(lists, items, shared).astype(np.float32))
        candidates = scratch.keep(passages.mapInArrow(_searcher(shared, spread), CANDIDATES), f"candidates-{number}")
        found = scratch.keep(candidates.mapInArrow(_finder(shared), FOUND), f"found-{number}")
        scratch.drop(f"passages-{number}", f"candidates-{number}")
        result = result.union(found)
    best = F.struct("share", "cosine", (-F.col("start")).alias("start"), "answer_share")
    one = result.where("doc_id IS NOT NULL").groupBy("doc_id", "item_id").agg(F.max(best).alias("b"))
    return one.select(
        "doc_id", "item_id", (-F.col("b.start")).cast("int").alias("start"), "b.cosine", "b.share", "b.answer_share"
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all columns; rows without a doc_id stay."""
    lost = contaminated(docs, benchmark).select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lost, docs["doc_id"].cast("long") == lost["_lost"], "left_anti")
