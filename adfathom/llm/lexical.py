"""Ranked lexical search of all documents for each item of a query set, by the NRA algorithm.

Documents are cut into shards. For each term a shard has a list of its documents by falling impact, an impact being what
the term adds to a document's score. An item's lists are read from their tops, all down to the same impact, a
step lower each time; nothing is ever looked up by document. A document seen so far has a lower bound, the impacts read, and
an upper bound, to which each list in which it was not met adds its next unread impact. Reading goes on until no unseen document
can reach the k-th lower bound, every document that can is known, and their two bounds have met: members,
ties and final scores are then certain. A task carries its best k of each item from shard to shard, so later shards stop
sooner, and the tasks' lists are merged. Document frequencies and lengths are counted over all documents before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adfathom.llm import texts
from adfathom.llm.shared import Scratch
from adfathom.llm.spans import stretches

TOP = 50
BLOCK_BYTES = 16 << 20  # item text whose terms are searched in one reading of the documents
SHARD_POSTINGS = 2_000_000
#: Bytes between terms: ASCII signs that are neither digits nor letters.
APART = np.zeros(256, bool)
APART[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(all terms of the texts in order, number of terms before each text and at the end)."""
    start, end, before = texts.word_bounds(data, offsets, APART)
    inside = texts.LOWER[data[~APART[data]]]
    ends = np.concatenate(([0], np.cumsum(end - start)))
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(inside)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), buffers), before


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in texts.text_slices(batch.column(1)):
            words, before = terms_of(data, offsets)
            owner = np.repeat(np.arange(row, row + len(before) - 1), np.diff(before))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), words.cast(pa.binary())], ["item", "term"])


def _postings(terms: pa.Array) -> Callable:
    """(row, doc_id, text) to row, doc_id, number of terms, and numbers and counts of those in `terms`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in texts.text_slices(batch.column(2)):
                words, before = terms_of(data, offsets)
                number = pc.index_in(words, value_set=terms)
                there = number.is_valid().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(before) - 1), np.diff(before))[there]
                number = number.drop_null().to_numpy().astype(np.int64)
                found, counts = np.unique(owner * max(1, len(terms)) + number, return_counts=True)
                cut = np.searchsorted(found, np.arange(len(before)) * max(1, len(terms))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(row, len(before) - 1) for c in batch.columns[:2]),
                        pa.array(np.diff(before).astype(np.int64)),
                        pa.ListArray.from_arrays(cut, pa.array((found % max(1, len(terms))).astype(np.int32))),
                        pa.ListArray.from_arrays(cut, pa.array(counts.astype(np.int64))),
                    ],
                    ["row", "doc_id", "n", "terms", "counts"],
                )

    return run


class Shard:
    """Lists of some documents by term and falling impact, with the places at which reading can pause."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int):
        order = np.lexsort((-impact, term))
        self.doc, self.impact, self.docs = doc[order], impact[order], docs
        self.terms, self.first = np.unique(term[order], return_index=True)
        lengths = np.diff(np.append(self.first, len(order)))
        top, least = int(impact.max(initial=1)), int(impact.min(initial=1))
        # a step reads down to half of the impact before; after the last one every list has ended
        self.levels = [top >> step for step in range((top // max(1, least)).bit_length())] + [0]
        step = np.searchsorted(-np.array(self.levels), -self.impact, "left")
        owner = np.repeat(np.arange(len(self.terms)), lengths)
        counts = np.bincount(owner * len(self.levels) + step, minlength=len(self.terms) * len(self.levels))
        #: of each list, how many entries have been read after a step, and the impact that comes next (0: ended)
        self.read = np.cumsum(counts.reshape(len(self.terms), len(self.levels)), axis=1)
        at = np.minimum(self.first[:, None] + self.read, max(0, len(order) - 1))
        self.next = np.where(self.read < lengths[:, None], self.impact[at], 0) if len(order) else np.zeros((0, 1), np.int64)

    def search(self, terms: np.ndarray, k: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that can belong to the best k, with their final scores. best: scores found elsewhere."""
        none = np.zeros(0, np.int64)
        if not len(self.terms):
            return none, none
        lists = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        lists = lists[self.terms[lists] == terms]
        if not len(lists):
            return none, none
        lower = np.zeros(self.docs, np.int64)
        known: np.ndarray | None = None  # the documents that can still belong to the result, once no other can
        met = np.zeros((0, len(lists)), bool)
        before = np.zeros(len(lists), np.int64)
        for step in range(len(self.levels)):
            read, coming = self.read[lists, step], self.next[lists, step]
            entries = stretches(self.first[lists] + before, read - before)
            which = np.repeat(np.arange(len(lists)), read - before)
            before = read
            docs = self.doc[entries]
            if known is not None:
                place = np.searchsorted(known, docs)
                place[place == len(known)] = 0
                mine = known[place] == docs
                met[place[mine], which[mine]] = True
                docs, entries = docs[mine], entries[mine]
            np.add.at(lower, docs, self.impact[entries])
            seen = np.flatnonzero(lower) if known is None else known
            kth = self._kth(lower[seen], best, k)
            if known is None:
                unseen = int(coming.sum())
                if unseen and unseen >= kth:
                    continue
                entries = stretches(self.first[lists], read)
                known, met = seen, np.zeros((len(seen), len(lists)), bool)
                met[np.searchsorted(seen, self.doc[entries]), np.repeat(np.arange(len(lists)), read)] = True
            if not len(known):
                break
            more = ~met @ coming
            stay = lower[known] + more >= kth
            known, met = known[stay], met[stay]
            if not more[stay].any():
                break
        return known, lower[known]

    @staticmethod
    def _kth(lower: np.ndarray, best: np.ndarray, k: int) -> int:
        """The k-th highest lower bound; 1 if there are fewer, as a score must be above 0."""
        every = np.concatenate((lower, best))
        return int(np.partition(every, len(every) - k)[len(every) - k]) if len(every) >= k else 1


def _search(items: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> Callable:
    """Postings to the best k documents of each item within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # score, missing id, id and row of the best so far
        best = [np.zeros((4, 0), np.int64) for _ in items]
        held: list[pa.RecordBatch] = []

        def search_held() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            lists = rows.column("terms").combine_chunks()
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(size)), size)
            term = lists.flatten().to_numpy().astype(np.int64)
            count = rows.column("counts").combine_chunks().flatten().to_numpy()
            length = rows.column("n").to_numpy()[doc]
            impact = weights[term] * ((1_000_000_000 * count) // (1000 * count + 20 * (50 + (50 * length * n_docs) // max(1, n_terms))))
            real = impact > 0
            shard = Shard(term[real], doc[real], impact[real], len(size))
            names = rows.column("doc_id").combine_chunks()
            facts = np.stack(
                [names.is_null().to_numpy(zero_copy_only=False), names.fill_null(0).to_numpy(), rows.column("row").to_numpy()]
            ).astype(np.int64)
            for i, (_, terms) in enumerate(items):
                docs, scores = shard.search(terms, k, best[i][0])
                if len(docs):
                    every = np.concatenate((best[i], np.vstack((scores, facts[:, docs]))), axis=1)
                    best[i] = every[:, np.lexsort((every[3], every[2], every[1], -every[0]))[:k]]

        for batch in batches:
            first, ends = 0, np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            waiting = sum(len(b.column(3).flatten()) for b in held)
            while first < batch.num_rows:
                gone = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, gone + SHARD_POSTINGS - waiting, "right")))
                held.append(batch.slice(first, last - first))
                first, waiting = last, 0
                if first < batch.num_rows:
                    search_held()
        if held:
            search_held()
        sizes = [b.shape[1] for b in best]
        every = np.concatenate(best, axis=1) if best else np.zeros((4, 0), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([i for i, _ in items], sizes).astype(np.int64)),
                pa.array(every[2], mask=every[1] > 0),
                pa.array(every[3]),
                pa.array(every[0]),
            ],
            ["item", "doc_id", "row", "score"],
        )

    return run


def _blocks(scratch: Scratch, items: DataFrame) -> Iterator[DataFrame]:
    """The items' distinct terms, in blocks of about `BLOCK_BYTES` of text."""
    listed = items.select("item", F.col("text").cast("string").alias("text"))
    size = listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(size) // BLOCK_BYTES
    terms = scratch.keep(listed.mapInArrow(_item_terms, "item long, term binary").distinct(), "terms")
    for block in range(blocks):
        yield terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the k documents with the highest scores above 0 for each item (all, if fewer).

    docs: doc_id (long) and text; items: item_id and text; other columns are ignored. Each row is a document, or an item, of
    its own, also if its id repeats. Null texts and texts without a term find nothing and are not found. Equal
    scores go by doc_id, rows without one last. The items' terms are held in memory in blocks of `BLOCK_BYTES`
    of text; each block reads the documents once.
    """
    scratch = Scratch(docs.sparkSession, "lexical")
    named = items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id())
    named = scratch.keep(named, "items")
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")
    )
    found = None
    for block, chosen in enumerate(_blocks(scratch, named)):
        wanted = chosen.orderBy("term", "item").toArrow()
        column = wanted.column("term").combine_chunks().cast(pa.large_binary())
        terms = pc.unique(column)
        number, owner = pc.index_in(column, value_set=terms).to_numpy(), wanted.column("item").to_numpy()
        order = np.argsort(owner, kind="stable")
        ids, cut = np.unique(owner[order], return_index=True)
        queries = list(zip(ids.tolist(), np.split(number[order].astype(np.int64), cut[1:])))
        postings = source.mapInArrow(
            _postings(terms), "row long, doc_id long, n long, terms array<int>, counts array<long>"
        )
        postings = scratch.keep(postings, f"postings-{block}")
        n_docs, n_terms = postings.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # one number for each term of the block
        df = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
        held = np.zeros(len(terms), np.int64)
        held[df.column("term").to_numpy()] = df.column("df").to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in held.tolist()], np.int64)
        run = _search(queries, weights, n_docs, n_terms, k)
        best = scratch.keep(postings.mapInArrow(run, "item long, doc_id long, row long, score long"), f"best-{block}")
        scratch.drop(f"postings-{block}")
        found = best if found is None else found.union(best)
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
