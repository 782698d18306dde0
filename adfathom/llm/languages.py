"""Language identification: averaged hashed subword embeddings under a linear softmax.

The subwords are byte 3-grams and 4-grams of the letters of a text, case folded, with a blank wherever
something else stands. Each is hashed to one of BUCKETS embeddings; a text is the mean of its
embeddings, and a linear layer with a softmax tells the language. Both are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled texts. A tenth of that sample is
kept back to fit a temperature, so scores are probabilities, and a rejection threshold between the kept rows
and the same rows with their subwords exchanged for others, which stand for languages that were not learned.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from adfathom.llm import texts

BUCKETS = 1 << 16
WIDTH = 8
#: Most labelled texts that a model is trained on, and those that each language is given before the rest is drawn
#: over all languages together.
TRAINING_TEXTS, LANGUAGE_TEXTS = 2500, 50
EPOCHS, RATE, BATCH = 8, 20.0, 32
#: The threshold rejects at most this share of the rightly named rows kept back, and lets no larger share of texts of
#: no learned language through if that is possible; FOREIGN such texts are made of each row.
LOST, FOREIGN = 0.01, 8
UNDETERMINED = "und"
ADDED = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("accepted", BooleanType())]

_LETTER = np.zeros(256, np.uint8) + 32
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, owners) of the subwords of some texts, for 3-grams and 4-grams."""
    plain = _LETTER[data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    plain[upper] += 32
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    wide = plain.astype(np.uint32)
    for size in (3, 4):
        n = len(data) - size + 1
        if n <= 0:
            continue
        h = np.full(n, 2166136261 + size, np.uint32)
        for j in range(size):
            h = (h ^ wide[j : j + n]) * np.uint32(16777619)
        # a subword has a letter second, so blanks at its ends mark where words begin and end
        use = (owner[:n] == owner[size - 1 :]) & (plain[1 : n + 1] != 32)
        yield ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1))[use], owner[:n][use]


def bags(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares."""
    for _, data, offsets in texts.text_slices(column):
        found = list(grams(data, offsets))
        bucket = np.concatenate([b for b, _ in found]) if found else np.zeros(0, np.uint32)
        owner = np.concatenate([o for _, o in found]) if found else np.zeros(0, np.int32)
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            ids, counts = np.unique(bucket[order[cut[i] : cut[i + 1]]], return_counts=True)
            yield ids, counts / max(counts.sum(), 1)


@dataclasses.dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # what each bucket adds to the logits, with the temperature in it
    bias: np.ndarray
    threshold: float

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total, count = np.zeros((n, len(self.languages))), np.zeros(n)
        for bucket, owner in grams(data, offsets):
            count += np.bincount(owner, minlength=n)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(owner, weights=self.table[bucket, k], minlength=n)
        return softmax(total / np.maximum(count, 1)[:, None] + self.bias)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: pa.Table, seed: int = 3) -> LanguageModel:
    """Trains on the columns text and lang of a small table; without rows nothing is ever accepted."""
    languages = sorted(set(rows["lang"].to_pylist()))
    if not languages:
        return LanguageModel([UNDETERMINED], np.zeros((BUCKETS, 1)), np.zeros(1), 2.0)
    label = np.array([languages.index(x) for x in rows["lang"].to_pylist()])
    sample = list(bags(rows["text"].combine_chunks()))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(sample))
    kept, held = np.split(order, [max(1, len(order) * 9 // 10)])
    held = held if len(held) else kept
    embed = np.zeros((BUCKETS, WIDTH))
    weight, bias = rng.normal(0, 1, (WIDTH, len(languages))), np.zeros(len(languages))

    def flat(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(part)), [len(sample[i][0]) for i in part])
        return owner, np.concatenate([sample[i][0] for i in part]), np.concatenate([sample[i][1] for i in part])

    def means(owner: np.ndarray, ids: np.ndarray, share: np.ndarray, n: int) -> np.ndarray:
        rows = embed[ids] * share[:, None]
        ends = np.searchsorted(owner, np.arange(n + 1))
        sums = np.concatenate([np.zeros((1, WIDTH)), np.cumsum(rows, axis=0)])
        return sums[ends[1:]] - sums[ends[:-1]]

    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(kept), BATCH):
            part = kept[at : at + BATCH]
            owner, ids, share = flat(part)
            mean = means(owner, ids, share, len(part))
            error = softmax(mean @ weight + bias)
            error[np.arange(len(part)), label[part]] -= 1
            error /= len(part)
            back = error @ weight.T
            step = back[owner] * share[:, None]
            touched, place = np.unique(ids, return_inverse=True)
            for k in range(WIDTH):
                embed[touched, k] -= rate * np.bincount(place, weights=step[:, k], minlength=len(touched))
            weight -= rate / 20 * (mean.T @ error)
            bias -= rate / 200 * error.sum(axis=0)
    owner, ids, share = flat(held)
    logits = means(owner, ids, share, len(held)) @ weight + bias
    scales = np.geomspace(0.05, 20, 60)
    losses = [-np.log(np.maximum(softmax(logits * s)[np.arange(len(held)), label[held]], 1e-12)).mean() for s in scales]
    scale = scales[int(np.argmin(losses))]
    sure = softmax(logits * scale)
    # in other buckets the same texts are of no learned language
    other = [means(owner, ids ^ np.uint32(x), share, len(held)) @ weight + bias for x in rng.integers(1, BUCKETS, FOREIGN)]
    foreign = softmax(np.concatenate(other) * scale).max(axis=1)
    right = sure.max(axis=1)[sure.argmax(axis=1) == label[held]]
    # rejects nearly all of those, unless that costs more of the rightly named texts than LOST
    threshold = min(np.quantile(foreign, 1 - LOST), np.quantile(right, LOST) if len(right) else 1.0)
    return LanguageModel(languages, embed @ weight * scale, bias * scale, float(threshold))


def training_rows(docs: DataFrame, limit: int = TRAINING_TEXTS) -> pa.Table:
    """At most `limit` labelled rows whose crc32 of doc_id is not 1 modulo 3.

    The sample is chosen by a hash of doc_id before the texts are fetched: the first LANGUAGE_TEXTS of each language,
    one of each in turn, then the first of all. So a rare language is learned too, as long as there are no more
    languages than `limit`. Texts of the sample are used whole.
    """
    usable = F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").alias("_id"), "text", "lang").where(
        usable & (F.crc32(F.col("_id").cast("string")) % 3 != 1)
    )
    ids = rows.select("_id", "lang").distinct()
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("_id"), "_id"))
    ahead = ids.withColumn("_turn", turn).where(F.col("_turn") <= LANGUAGE_TEXTS)
    picked = ahead.union(ids.withColumn("_turn", F.lit(LANGUAGE_TEXTS + 1))).groupBy("_id").agg(F.min("_turn").alias("_turn"))
    picked = picked.orderBy("_turn", F.xxhash64("_id"), "_id").limit(limit).select("_id")
    found = rows.join(F.broadcast(picked), "_id").groupBy("_id").agg(F.min(F.struct("text", "lang")).alias("row"))
    return found.select("row.text", "row.lang").toArrow()


def identify(docs: DataFrame, model: LanguageModel, prefix: str = "") -> DataFrame:
    """All rows and columns of `docs` with lang_pred, score and accepted, each with `prefix` ahead.

    Texts that are null or have no letter are `und` with score 0 and not accepted; the others get the most
    probable language, accepted where its probability reaches the model's threshold. Repeated rows give
    equal rows. Columns that already have these names are replaced.
    """
    added = [StructField(prefix + f.name, f.dataType) for f in ADDED]
    docs = docs.drop(*(f.name for f in added))
    flag = "_letter"
    while flag in docs.columns:
        flag += "_"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index("text"), [*docs.columns, *(f.name for f in added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for row, data, offsets in texts.text_slices(batch.column(at)):
                part = batch.slice(row, len(offsets) - 1)
                known = np.asarray(part.column(len(part.columns) - 1).to_numpy(zero_copy_only=False), bool)
                p = model.probabilities(data, offsets)
                best = p.argmax(axis=1)
                score = np.where(known, p[np.arange(len(p)), best], 0.0)
                named = [model.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1],
                        pa.array(named, pa.string()),
                        pa.array(score),
                        pa.array(known & (score >= model.threshold)),
                    ],
                    names,
                )

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(flag, letter).mapInArrow(run, StructType([*docs.schema.fields, *added]))
