"""Removal of word passages that already stand in an earlier document, by Rabin-Karp windows.

Every window of `size` consecutive words has a rolling hash. Spark counts, for each window hash, in
which documents it starts; windows that also start in a smaller doc_id are merged into maximal
intervals of words to be removed.

Only windows that can repeat are counted. The anchor of a window is the smallest hash among its
`ANCHOR`-word sub-windows, a function of its content alone: equal windows have equal anchors. So windows whose anchor
stands in one document only are unique, and the counting starts from the others. Copies of a whole
word sequence collapse before anything is counted: all but the smallest doc_id go whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfathom.llm import texts
from adfathom.llm.shared import Scratch

SIZE = 50
ANCHOR = 16
FACTS = "doc_id long, content long, check long, n_words long, kept_sha256 string, anchors array<long>"
WINDOWS = "content long, check2 long, window long, at int"


class Words:
    """The words of some whole texts with the hash of any run of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.start, self.end, self.before = texts.word_bounds(data, offsets)
        self.prefix = texts.Prefix(texts.word_hashes(data, self.start, self.end), texts.WORD_BASE)
        self.second = texts.Prefix(self.prefix.of(np.arange(len(self.start)), 1 + np.arange(len(self.start))), texts.BASE)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each text's word sequence."""
        return tuple(p.of(self.before[:-1], self.before[1:]) for p in (self.prefix, self.second))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, owner and anchor of each window; no window reaches into the next text."""
        at, owner = texts.window_starts(self.before, size)
        small = min(ANCHOR, size)
        first = np.arange(max(len(self.start) - small + 1, 0))
        least = texts.sliding_min(self.prefix.of(first, first + small), size - small + 1)
        return at, owner, least[at]

    def joined(self, text: int, keep: np.ndarray | None = None) -> bytes:
        """The (kept) words of one text, joined by single spaces."""
        lo, hi = self.before[text], self.before[text + 1]
        if lo == hi:
            return b""
        raw = self.data[self.start[lo] : self.end[hi - 1]].tobytes()
        words = raw.split()
        if len(words) != hi - lo:  # other characters that bytes.split would not take apart
            base = self.start[lo]
            words = [raw[s - base : e - base] for s, e in zip(self.start[lo:hi], self.end[lo:hi])]
        return b" ".join(words if keep is None else [w for w, k in zip(words, keep) if k])


def _facts(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in texts.text_slices(batch.column(1)):
                words, n = Words(data, offsets), len(offsets) - 1
                one, two = words.whole()
                _, owner, anchor = words.windows(size)
                cut = np.searchsorted(owner, np.arange(n + 1))
                lists = [np.unique(anchor[cut[i] : cut[i + 1]]) for i in range(n)]
                flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, n),
                        pa.array(texts.signed(one)),
                        pa.array(texts.signed(two)),
                        pa.array(np.diff(words.before).astype(np.int64)),
                        pa.array([hashlib.sha256(words.joined(i)).hexdigest() for i in range(n)]),
                        pa.ListArray.from_arrays(ends, pa.array(texts.signed(flat))),
                    ],
                    ["doc_id", "content", "check", "n_words", "kept_sha256", "anchors"],
                )

    return run


def _windows(size: int) -> Callable:
    """(key, text, shared anchors) rows to the windows whose anchor is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in texts.text_slices(batch.column(1)):
                words = Words(data, offsets)
                at, owner, anchor = words.windows(size)
                cut = np.searchsorted(owner, np.arange(len(offsets)))
                keep = np.zeros(len(at), bool)
                for i in range(len(offsets) - 1):
                    known = np.asarray(batch.column(2)[row + i].values, np.int64)
                    part = slice(cut[i], cut[i + 1])
                    keep[part] = np.isin(texts.signed(anchor[part]), known)
                at, owner = at[keep], owner[keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row + owner)),
                        pa.array(texts.signed(words.second.of(at, at + size))),
                        pa.array(texts.signed(words.prefix.of(at, at + size))),
                        pa.array((at - words.before[owner]).astype(np.int32)),
                    ],
                    ["content", "check2", "window", "at"],
                )

    return run


def _removed(size: int) -> Callable:
    """(key, text, repeated window starts) rows to what is removed and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost, left, kept = [], [], []
            for row, data, offsets in texts.text_slices(batch.column(1)):
                words = Words(data, offsets)
                for i in range(len(offsets) - 1):
                    n = int(words.before[i + 1] - words.before[i])
                    gone = texts.covered(np.asarray(batch.column(2)[row + i].values, np.int64), size, n)
                    lost.append(int(gone.sum()))
                    kept.append(words.joined(i, ~gone))
                    left.append(texts.spans(gone).astype(int).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(lost, pa.int64()),
                    pa.array(left, pa.list_(pa.list_(pa.int32()))),
                    pa.array([k.decode() for k in kept], pa.string()),
                ],
                ["content", "n_removed", "spans", "kept_text"],
            )

    return run


def repeated_windows(docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(facts, repeats): facts has a row per document; repeats a row per text that loses words but keeps its own.

    docs: doc_id (long), text, other columns ignored. Windows that also start in a smaller doc_id count as
    repeated; windows are judged on the input. Null, empty and short texts have no window. Rows of one
    doc_id are one document: they never remove each other. Rows without a doc_id neither lose
    nor remove anything.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = scratch.keep(source.mapInArrow(_facts(size), FACTS), "facts")
    named = facts.where(f"doc_id IS NOT NULL AND n_words >= {size}")
    # equal word sequences collapse to their smallest doc_id
    first = scratch.keep(named.groupBy("content", "check").agg(F.min("doc_id").alias("first")), "first")
    heads = named.join(first.withColumnRenamed("first", "doc_id"), ["content", "check", "doc_id"])
    anchors = heads.select("doc_id", "content", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = scratch.keep(shared.where("low < high").select("anchor"), "shared")
    # the first document of an anchor is needed to tell who is first, so it stays in
    suspects = anchors.join(shared, "anchor").groupBy("content", "doc_id").agg(F.collect_set("anchor").alias("anchors"))
    suspects = scratch.keep(suspects, "suspects")
    bodies = source.join(suspects.select("doc_id", "anchors", "content"), "doc_id").select(
        "doc_id", "text", "anchors"
    )
    windows = bodies.mapInArrow(_windows(size), WINDOWS).withColumnRenamed("content", "doc_id")
    windows = scratch.keep(windows, "windows")
    counted = windows.groupBy("window", "check2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    # written apart, so that the join can split a window that very many documents share
    counted = scratch.keep(counted.where("low < high").select("window", "check2", "low"), "counted")
    hits = windows.join(counted, ["window", "check2"]).where("doc_id > low")
    starts = scratch.keep(hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("at")).alias("starts")), "starts")
    scratch.drop("windows")
    losers = source.join(starts, "doc_id").select("doc_id", "text", "starts")
    repeats = losers.mapInArrow(_removed(size), "content long, n_removed long, spans array<array<int>>, kept_text string")
    repeats = scratch.keep(repeats.withColumnRenamed("content", "doc_id"), "repeats")
    marked = facts.join(first, ["content", "check"], "left").withColumn(
        "copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    )
    marked = scratch.keep(marked.drop("anchors", "first"), "marked")
    scratch.drop("facts")
    return marked, repeats


def dedup_report(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed word intervals of every document."""
    marked, repeats = repeated_windows(docs, size)
    lost = repeats.select(
        "doc_id", "n_removed", "spans", F.sha2(F.col("kept_text").cast("binary"), 256).alias("rest")
    ).dropDuplicates(["doc_id"])
    copy = F.col("copy")
    whole = F.array(F.array(F.lit(0), F.col("n_words").cast("int")))
    return marked.join(lost, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256))
        .otherwise(F.coalesce("rest", "kept_sha256"))
        .alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast("array<array<int>>"))).alias("spans"),
    )


def dedup_texts(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents with repeated passages cut out of their texts; all columns and all rows stay.

    A text that loses words is left with its other words joined by one space; other texts keep
    every character. A whole copy of an earlier document is left with the empty text.
    """
    marked, repeats = repeated_windows(docs, size)
    copies = marked.where("copy").select(F.col("doc_id").alias("_doc"), F.lit("").alias("_text"))
    cut = repeats.select(F.col("doc_id").alias("_doc"), F.col("kept_text").alias("_text"))
    changed = copies.union(cut).dropDuplicates(["_doc"])
    joined = docs.join(changed, docs["doc_id"].cast("long") == changed["_doc"], "left")
    return joined.select(
        *[F.coalesce(changed["_text"], docs["text"]).alias("text") if c == "text" else docs[c] for c in docs.columns]
    )
