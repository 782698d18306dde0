"""How five quality filters interact: what each removes in every order in which they can be applied.

`measure` makes one pass over the bytes of each whole text. The pass is a finite-state machine given by tables: a byte
has a class, the state is whether the byte before it belongs to a word, and state and class say what is counted. The
word spans that it yields go into a hash table of the text's words, in which equal hashes count as equal words only
after their bytes have been compared.

`interactions` needs no more than how many documents fail which filters, so the documents are counted by part
and set of failed filters, and all orders are worked out from these at most 32 counts a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfathom.llm import texts
from adfathom.llm.shared import Scratch
from adfathom.llm.spans import Spans, same_spans

FILTERS = "ABCDE"
MIN_WORDS = 50
SYMBOLS = b"#$%&*|"

# Classes of bytes. A code point begins at every byte that is no continuation byte.
_SPACE, _PLAIN, _CAPITAL, _SYMBOL, _CONTINUED = range(5)
_CLASS = np.full(256, _PLAIN, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[ord("A") : ord("Z") + 1] = _CAPITAL
_CLASS[list(SYMBOLS)] = _SYMBOL
_CLASS[0x80:0xC0] = _CONTINUED
# What a byte of some class does, outside of a word (first row) and inside of one (second row).
_OPENS, _CLOSES, _COUNTS_CAPITAL, _COUNTS_SYMBOL, _NO_POINT = (1 << i for i in range(5))
_EACH = np.array([0, 0, _COUNTS_CAPITAL, _COUNTS_SYMBOL, _NO_POINT], np.uint8)
_ACTIONS = np.stack([_EACH | np.uint8(_OPENS) * (np.arange(5) != _SPACE), _EACH | np.uint8(_CLOSES) * (np.arange(5) == _SPACE)])
_ACTIONS = _ACTIONS.astype(np.uint8).ravel()

MEASURES = "n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long, digest binary"


def byte_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each text; texts lie end to end."""
    kinds = _CLASS[data]
    inside = np.zeros(len(data) + 1, np.uint8)
    inside[1:] = kinds != _SPACE
    last = offsets[1:][np.diff(offsets) > 0]
    open_end = last[inside[last] > 0]  # a word that ends with its text
    inside[offsets] = 0  # each text begins in the state "outside"
    actions = _ACTIONS[inside[:-1] * np.uint8(5) + kinds]

    def places(flag: int) -> np.ndarray:
        return np.flatnonzero(actions & np.uint8(flag))

    def per_text(at: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(at, offsets))

    start = places(_OPENS)
    end = np.sort(np.concatenate((places(_CLOSES), open_end)))
    owner = np.searchsorted(offsets, start, "right") - 1
    first = same_spans(Spans(data), start, end, owner) == np.arange(len(start))
    points = np.diff(offsets) - per_text(places(_NO_POINT))
    return [per_text(start), per_text(start[first]), per_text(places(_COUNTS_CAPITAL)), points, per_text(places(_COUNTS_SYMBOL))]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in texts.text_slices(batch.column(2)):
            raw, cut = memoryview(data), offsets.tolist()
            digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.slice(row, len(offsets) - 1) for c in batch.columns[:2]),
                    *(pa.array(c.astype(np.int64)) for c in byte_counts(data, offsets)),
                    pa.array(digests, pa.binary()),
                ],
                ["doc_id", "part", *(m.split()[0] for m in MEASURES.split(", "))],
            )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, part, counts and SHA-256 of every whole text; a row per row, nothing is shuffled.

    docs: doc_id (long), text and source; other columns are ignored. The part is the source, empty where it is null. A
    null text is empty and has zeros throughout. Words are maximal runs of bytes other than ASCII white space.
    """
    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_measured, f"doc_id long, part string, {MEASURES}")


def failures(measured: DataFrame) -> DataFrame:
    """doc_id, part, digest and the filters of A to D that a document fails, as bits (A is 1, B is 2 and so on)."""
    failed = [
        F.col("n_words") < MIN_WORDS,
        100 * F.col("n_distinct") < 65 * F.col("n_words"),
        100 * F.col("n_capitals") > 5 * F.col("n_points"),
        F.col("n_symbols") > 0,
    ]
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    return measured.select("doc_id", "part", "digest", bits.alias("failed"))


def _weights() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """All (order, step) pairs, and for each figure what a document of each set of failed filters adds to it."""
    steps = [("".join(order), step) for order in permutations(FILTERS) for step in range(1, len(FILTERS) + 1)]
    names = ("kept", "removed", "redundant", "unique_fails", "shapley")
    sets = np.arange(1 << len(FILTERS))
    size = np.array([bin(s).count("1") for s in sets])
    weights = {name: np.zeros((len(sets), len(steps)), np.int64) for name in names}
    for column, (order, step) in enumerate(steps):
        own = 1 << FILTERS.index(order[step - 1])
        earlier = sum(1 << FILTERS.index(f) for f in order[: step - 1])
        fails, gone = (sets & own) > 0, (sets & earlier) > 0
        weights["kept"][:, column] = (sets & (own | earlier)) == 0
        weights["removed"][:, column] = fails & ~gone
        weights["redundant"][:, column] = fails & gone
        weights["unique_fails"][:, column] = sets == own
        # of the orders, each failed filter comes first among the failed ones equally often
        weights["shapley"][:, column] = np.where(fails, len(steps) // len(FILTERS) // np.maximum(size, 1), 0)
    return steps, weights


RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps, weights = _weights()
    orders, numbers = pa.array([s[0] for s in steps]), pa.array([s[1] for s in steps], pa.int32())
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            docs, good, toxic = np.zeros((3, 1 << len(FILTERS)), np.int64)
            for c in counts:
                at = c["failed"]
                docs[at], good[at], toxic[at] = c["docs"], c["good"], c["toxic"]
            figures = [docs @ weights[n] for n in ("kept", "removed", "redundant", "unique_fails")]
            figures += [good @ weights["removed"], toxic @ weights["removed"], docs @ weights["shapley"]]
            named = [f.split()[0] for f in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(steps)), orders, numbers, *(pa.array(f) for f in figures)], names=named
            )


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the five filters and step, with what the step's filter does there.

    A: under 50 words; B: distinct words under 65 % of the words; C: capitals over 5 % of the code points; D: holds any
    of # $ % & * |; E: its text is also that of a smaller doc_id, whether that one is removed or not. labels: doc_id,
    quality, toxic; of several rows of one doc_id any that says 1 counts. Null texts are empty, so they are copies of
    each other. Rows of one doc_id count one by one and are no copies of each other; rows without a doc_id count
    in their part, are never copies, and have no labels. An empty table has no parts and gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "filter-audit")
    rows = failures(measure(docs)).groupBy("digest", "doc_id", "part", "failed").agg(F.count("*").alias("docs"))
    rows = scratch.keep(rows, "rows")
    # the doc_id is part of the key, so a text that very many documents have is spread over all tasks
    lowest = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    rows = rows.join(lowest.withColumn("lowest", F.lit(True)), ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("lowest").isNull()
    rows = rows.select("doc_id", "part", "docs", (F.col("failed") + F.when(copy, 16).otherwise(0)).alias("failed"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")
    )
    rows = rows.join(marks, "doc_id", "left")
    counted = rows.groupBy("part", "failed").agg(
        F.sum("docs").alias("docs"),
        F.sum(F.col("docs") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("docs") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("failed", "docs", "good", "toxic")).alias("counts"))
    return parts.mapInArrow(_orders, RESULT)
