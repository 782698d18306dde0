"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its evidence is a vector of numbers about the line and the lines before
and after it; the chain adds how likely labels follow each other. The field is trained by full-batch
gradient steps in numpy on a bounded sample of labelled documents, each lending its label to all of its
lines. For a new document the forward-backward marginals of its lines, weighted by line length,
give its share of good text, and a logistic curve fitted on the sample turns that into a score.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from adfathom.llm import texts

#: Most labelled documents that a field is trained on, chosen by a hash of the text alone.
TRAINING_TEXTS = 1500
STEPS, RATE, DECAY = 80, 0.2, 1e-4

_UPPER, _SYMBOL, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SYMBOL[33:127] = True
_SYMBOL[[*range(48, 58), *range(65, 91), *range(97, 123), *b".,'-:;()"]] = False
OWN = 12


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line and its neighbours, line lengths, lines before each text); blank lines are left out."""
    cut = data == 10
    inside = ~cut
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | fresh[1:-1]
    last[:-1] &= ~inside[1:] | fresh[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    n = len(start)
    before = np.searchsorted(start, offsets)
    size = (end - start).astype(float)
    if not n:
        return np.zeros((0, 3 * OWN)), size, before

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (sums[end] - sums[start]) / size

    upper = _UPPER[data]
    accents = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))
    upper[accents] = True
    word_start, word_end, _ = texts.word_bounds(data, offsets)
    line = np.searchsorted(start, word_start, "right") - 1
    hashed = texts.word_hashes(data, word_start, word_end)
    words = np.bincount(line, minlength=n).astype(float)
    some = np.maximum(words, 1)
    same = np.zeros(len(line), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (line[1:] == line[:-1])
    distinct = np.unique(texts.mixed(hashed + line.astype(np.uint64) * np.uint64(texts.BASE)) if len(line) else hashed, return_index=True)[1]
    whole = texts.byte_prefix(data).of(start, end)
    owner = np.repeat(np.arange(len(before) - 1), np.diff(before)).astype(np.uint64)
    _, kind, copies = np.unique(texts.mixed(whole + owner * np.uint64(texts.WORD_BASE)), return_inverse=True, return_counts=True)
    own = np.stack(
        [
            np.ones(n),
            np.log1p(size) / 5,
            share(upper),
            np.minimum(3 * share(_SYMBOL[data]), 1),
            share(_DIGIT[data]),
            np.bincount(line, weights=same, minlength=n) / some,
            1 - np.bincount(line[distinct], minlength=n) / some,
            np.bincount(line, weights=word_end - word_start, minlength=n) / some / 10,
            np.log1p(words) / 4,
            (data[end - 1] == ord(".")).astype(float),
            share(data == ord("|")) * 5,
            (copies[kind] > 1).astype(float),
        ],
        axis=1,
    )
    wide = np.zeros((n, 3 * OWN))
    wide[:, :OWN] = own
    inner = np.ones(n + 1, bool)
    inner[before] = False
    wide[1:, OWN : 2 * OWN] = own[:-1] * inner[1:n, None]
    wide[:-1, 2 * OWN :] = own[1:] * inner[1:n, None]
    return wide, size, before


def chain(emission: np.ndarray, before: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chance of good for each line, expected number of each move), by forward-backward over all texts in step.

    `emission` is the evidence for good over bad; `moves[a, b]` scores label b after label a.
    """
    counts = np.diff(before)
    order = np.argsort(-counts, kind="stable")
    counts, start = counts[order], before[:-1][order]
    steps = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(steps), "left") if steps else []
    peak = np.maximum(emission, 0)
    seen = np.stack([np.exp(-peak), np.exp(emission - peak)], axis=1)
    step = np.exp(moves)
    ahead, behind = np.ones((len(emission), 2)), np.ones((len(emission), 2))
    for t in range(steps):
        at = start[: active[t]] + t
        value = seen[at] if t == 0 else seen[at] * (ahead[at - 1] @ step)
        ahead[at] = value / value.sum(axis=1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(steps - 1, 0, -1):
        at = start[: active[t]] + t
        later = seen[at] * behind[at]
        pair = ahead[at - 1][:, :, None] * step * later[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        value = later @ step.T
        behind[at - 1] = value / value.sum(axis=1, keepdims=True)
    both = ahead * behind
    return both[:, 1] / both.sum(axis=1), expected


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclasses.dataclass
class QualityModel:
    weight: np.ndarray
    moves: np.ndarray
    slope: float
    level: float

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length-weighted share of good text, whether the text has a line)."""
        wide, size, before = line_features(data, offsets)
        good, _ = chain(wide @ self.weight, before, self.moves)
        sums = [np.concatenate(([0.0], np.cumsum(x)))[before] for x in (good * size, size)]
        total = np.diff(sums[1])
        return np.diff(sums[0]) / np.maximum(total, 1), total > 0

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        share, any_line = self.shares(data, offsets)
        return np.where(any_line, sigmoid(self.slope * _logit(share) + self.level), 0.0)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(rows: pa.Table) -> QualityModel:
    """Trains on the columns text and quality (0 or 1) of a small table; without rows every score is 0.5."""
    model = QualityModel(np.zeros(3 * OWN), np.zeros((2, 2)), 1.0, 0.0)
    if not rows.num_rows:
        return model
    label = np.array(rows["quality"].to_pylist(), float)
    parts = [line_features(d, o) for _, d, o in texts.text_slices(rows["text"].combine_chunks())]
    wide = np.concatenate([p[0] for p in parts])
    lengths = np.concatenate([np.diff(p[2]) for p in parts])
    before = np.concatenate(([0], np.cumsum(lengths)))
    truth = np.repeat(label, lengths)
    # each document counts once, however many lines it has
    bulk = 1 / np.repeat(np.maximum(lengths, 1), lengths)
    same = np.maximum(lengths - 1, 0)
    seen = np.diag([(same * (1 - label)).sum(), (same * label).sum()])
    slots = [np.zeros((2, 3 * OWN)), np.zeros((2, 2, 2))]
    for turn in range(1, STEPS + 1):
        good, expected = chain(wide @ model.weight, before, model.moves)
        grads = (wide.T @ ((good - truth) * bulk) / len(label) + DECAY * model.weight, (expected - seen) / max(same.sum(), 1))
        for value, grad, (mean, square) in zip((model.weight, model.moves), grads, slots):
            mean += 0.1 * (grad - mean)
            square += 0.01 * (grad**2 - square)
            value -= RATE * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
        np.clip(model.moves, -4, 4, out=model.moves)
    shares = [model.shares(d, o) for _, d, o in texts.text_slices(rows["text"].combine_chunks())]
    x, use = np.concatenate([s for s, _ in shares]), np.concatenate([u for _, u in shares])
    x, y = _logit(x[use]), label[use]
    for _ in range(400):
        error = sigmoid(model.slope * x + model.level) - y
        curve = np.maximum(sigmoid(model.slope * x + model.level) * (1 - sigmoid(model.slope * x + model.level)), 1e-6)
        model.level -= 0.5 * error.mean() / curve.mean()
        model.slope = max(0.05, model.slope - 0.5 * (error * x).mean() / ((curve * x * x).mean() + 1e-9))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_TEXTS) -> pa.Table:
    """At most `limit` labelled rows whose crc32 of doc_id is not 1 modulo 3; half of them of either label.

    The sample is chosen before the texts are fetched, by a hash of doc_id alone.
    """
    usable = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("quality"))
    usable = usable.where(F.crc32(F.col("_id").cast("string")) % 3 != 1)
    picked = None
    for value in (0, 1):
        part = usable.where(F.col("quality") == value).orderBy(F.xxhash64("_id"), "_id").limit(limit // 2)
        picked = part if picked is None else picked.union(part)
    found = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(picked), "_id")
    return found.where("text IS NOT NULL").select("text", "quality").toArrow()


def score_quality(docs: DataFrame, model: QualityModel, out: str = "score") -> DataFrame:
    """All rows and columns of `docs` with a score from 0 (bad) to 1 (good).

    Texts that are null or have no line score 0; repeated rows score alike; nothing but the text is looked at.
    A column that already has the name is replaced.
    """
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index("text"), [*docs.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in texts.text_slices(batch.column(at)):
                part = batch.slice(row, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(data, offsets))], names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))
