"""Removal of byte strings that already stand earlier, by interval expansion on a Burrows-Wheeler transform.

Every byte is removed that is covered by a string of `size` bytes which also starts earlier: in a
document with a smaller doc_id, or in the same document. Strings are judged on the input.

1. The anchor of a string is the smallest hash among its GRAM-byte substrings, so equal strings have
   equal anchors. Strings whose anchor occurs once in the whole corpus do not repeat. Whole copies of a
   text collapse first; each but the smallest doc_id goes whole.
2. Runs of strings with one anchor are cut into segments. Equal segments collapse to their first
   occurrence; every later one is removed.
3. The different segments of an anchor are compared in blocks: a block's segments are laid end to
   end, and interval expansion on the transform tells which suffixes share `size` bytes. All but the earliest
   string of such a class are removed.

An anchor with very many different segments (a phrase of a very common line) is dealt out further, by the bytes that
strings with the same place of the anchor have in common. Equal pieces of it collapse like segments, by their bytes. Should
the unlike pieces of a key still be more than a block, their strings are grouped one by one by Spark. So no block is
larger than 2 * BLOCK bytes, however often a line occurs.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfathom.llm import texts
from adfathom.llm.bwt import short_prefixes, suffix_order
from adfathom.llm.shared import Scratch

SIZE = 100
GRAM = 32
#: Most strings in a segment.
SEGMENT = 128
#: Bytes of segments in a block, about.
BLOCK = 1 << 18
#: Different segments from which on an anchor is dealt out further, and the places of an anchor that stay together.
CROWDED, TOGETHER = 1024, 8

FACTS = "doc_id long, content long, check long, n_bytes long, kept_sha256 string, anchors array<long>, again array<long>"
SEGMENTS = "anchor long, digest long, check long, doc_id long, start int, strings int"
PIECES = "key long, doc_id long, start int, body binary, crowded boolean"


class Strings:
    """The strings of `size` bytes of some texts, with the anchor of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int):
        self.data, self.offsets, n = data, offsets, len(data)
        self.prefix = texts.byte_prefix(data)
        gram = min(GRAM, size)
        first = np.arange(max(n - gram + 1, 0))
        self.gram = self.prefix.of(first, first + gram)
        width = size - gram + 1
        self.anchor = texts.sliding_min(self.gram, width)
        end = np.repeat(offsets[1:], np.diff(offsets))
        self.valid = end[: len(self.anchor)] - np.arange(len(self.anchor)) >= size
        self.width = width

    def places(self) -> np.ndarray:
        """Where grams stand that are the anchor of a string around them."""
        if not self.valid.any():
            return np.zeros(0, np.int64)
        edge = np.zeros(self.width - 1, np.uint64)
        padded = np.concatenate([edge, np.where(self.valid, self.anchor, np.uint64(0)), edge])
        inverted = texts.sliding_min(~padded, self.width)
        return np.flatnonzero(~inverted == self.gram)

    def runs(self, wanted: np.ndarray) -> np.ndarray:
        """(start, strings) of maximal runs of wanted strings with one anchor, cut into segments."""
        wanted = wanted & self.valid
        change = np.ones(len(wanted) + 1, bool)
        change[1:-1] = (self.anchor[1:] != self.anchor[:-1]) | (wanted[1:] != wanted[:-1])
        # a run ends with its text
        change[self.offsets[(self.offsets > 0) & (self.offsets < len(wanted))]] = True
        cut = np.flatnonzero(change)
        start, length = cut[:-1], np.diff(cut)
        start, length = start[wanted[start]], length[wanted[start]]
        pieces = -(-length // SEGMENT)
        turn = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(start, pieces) + turn * SEGMENT
        stop = np.minimum(begin + SEGMENT, np.repeat(start + length, pieces))
        return np.stack([begin, stop - begin])


def _facts(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in texts.text_slices(batch.column(1)):
                n = len(offsets) - 1
                strings = Strings(data, offsets, size)
                second = texts.Prefix(data.astype(np.uint64) + np.uint64(257), texts.WORD_BASE)
                place = strings.places()
                value = strings.gram[place]
                cut = np.searchsorted(place, offsets)
                lists, again = [], []
                for i in range(n):
                    found, times = np.unique(value[cut[i] : cut[i + 1]], return_counts=True)
                    lists.append(found)
                    again.append(found[times > 1])
                columns = [
                    batch.column(0).slice(row, n),
                    pa.array(texts.signed(strings.prefix.of(offsets[:-1], offsets[1:]))),
                    pa.array(texts.signed(second.of(offsets[:-1], offsets[1:]))),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]),
                ]
                for parts in (lists, again):
                    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(texts.signed(np.concatenate(parts)))))
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "content", "check", "n_bytes", "kept_sha256", "anchors", "again"]
                )

    return run


def _segments(size: int) -> Callable:
    """(doc_id, text, shared anchors) rows to the segments of strings with a shared anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in texts.text_slices(batch.column(1)):
                strings = Strings(data, offsets, size)
                second = texts.Prefix(data.astype(np.uint64) + np.uint64(257), texts.WORD_BASE)
                wanted = np.zeros(len(strings.anchor), bool)
                for i in range(len(offsets) - 1):
                    part = slice(offsets[i], min(offsets[i + 1], len(wanted)))
                    wanted[part] = np.isin(
                        texts.signed(strings.anchor[part]), np.asarray(batch.column(2)[row + i].values, np.int64)
                    )
                start, count = strings.runs(wanted)
                owner = np.searchsorted(offsets, start, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(texts.signed(strings.anchor[start])),
                        pa.array(texts.signed(strings.prefix.of(start, start + count + size - 1))),
                        pa.array(texts.signed(second.of(start, start + count + size - 1))),
                        batch.column(0).take(pa.array(row + owner)),
                        pa.array((start - offsets[owner]).astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                    ],
                    ["anchor", "digest", "check", "doc_id", "start", "strings"],
                )

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, a few hundred at a time, so that little is held before it is handed on."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)


def _bytes_of(size: int) -> Callable:
    """(doc_id, text, segments wanted) rows to rows of PIECES; crowded anchors are dealt out."""
    gram = min(GRAM, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            key, doc, begin, body, crowded = [], [], [], [], []
            for i in range(batch.num_rows):
                raw = (batch.column(1)[i].as_py() or "").encode()
                number = batch.column(0)[i].as_py()
                strings = None
                for part in batch.column(2)[i].as_py():
                    start, count, anchor = part["start"], part["strings"], part["anchor"]
                    if not part["crowded"]:
                        pieces = [(anchor, start, start + count)]
                    else:
                        if strings is None:
                            data = np.frombuffer(raw, np.uint8)
                            strings = Strings(data, np.array([0, len(data)]), size)
                        pieces = _dealt(strings, anchor, start, count, size, gram)
                    for name, lo, hi in pieces:
                        key.append(name)
                        doc.append(number)
                        begin.append(lo)
                        body.append(raw[lo : hi + size - 1])
                        crowded.append(part["crowded"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key, pa.int64()),
                    pa.array(doc, pa.int64()),
                    pa.array(begin, pa.int32()),
                    pa.array(body, pa.binary()),
                    pa.array(crowded, pa.bool_()),
                ],
                ["key", "doc_id", "start", "body", "crowded"],
            )

    return run


def _dealt(strings: Strings, anchor: int, start: int, count: int, size: int, gram: int) -> list[tuple[int, int, int]]:
    """Pieces (key, first string, end) of a segment; strings that are equal get equal keys."""
    value = np.array([anchor], np.int64).view(np.uint64)[0]
    place = start + np.flatnonzero(strings.gram[start : start + count + size - gram] == value)
    string = np.arange(start, start + count)
    first = place[np.searchsorted(place, string)]
    bucket = (first - string) // TOGETHER
    cut = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (bucket[1:] != bucket[:-1]))))
    # the bytes that all strings of the bucket share
    lo = first[cut] - bucket[cut] * TOGETHER
    hi = first[cut] - bucket[cut] * TOGETHER - (TOGETHER - 1) + size
    keys = texts.signed(texts.mixed(strings.prefix.of(lo, np.maximum(hi, lo)) + bucket[cut].astype(np.uint64)))
    ends = np.append(cut[1:], count)
    return [(int(k), int(start + a), int(start + b)) for k, a, b in zip(keys, cut, ends)]


def later_strings(bodies: list[bytes], docs: np.ndarray, starts: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Runs (doc, first string, end) of strings in the bodies that equal an earlier string of another place."""
    lengths = np.array([len(b) for b in bodies], np.int64)
    # symbols: 0 ends the block, 1 ends a body, bytes follow
    text = np.ones(int(lengths.sum()) + len(bodies) + 1, np.int16)
    text[-1] = 0
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    body = np.repeat(np.arange(len(bodies)), lengths)
    inside = np.arange(len(body)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    text[begin[body] + inside] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int16) + 2
    order = suffix_order(text, len(text))
    joined = short_prefixes(text, order, size)
    group = np.cumsum(~joined)
    owner = np.full(len(text), -1, np.int64)
    owner[begin[body] + inside] = body
    at = np.full(len(text), 0, np.int64)
    at[begin[body] + inside] = inside
    whole = np.zeros(len(text), bool)
    whole[begin[body] + inside] = inside + size <= lengths[body]
    rows = np.flatnonzero(whole[order])
    place, group = order[rows], group[rows]
    owner, at = owner[place], at[place]
    _, doc_rank = np.unique(docs, return_inverse=True)
    age = doc_rank[owner] << 32 | (starts[owner] + at)
    turn = np.lexsort((age, group))
    group, age = group[turn], age[turn]
    first = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool)
    # the same place may come in two bodies; it is not later than itself
    earliest = age[np.maximum.accumulate(np.where(first, np.arange(len(age)), 0))] if len(age) else age
    late = turn[age != earliest]
    spots = np.unique(np.stack([doc_rank[owner[late]], starts[owner[late]] + at[late]], axis=1), axis=0)
    if not len(spots):
        return []
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(spots[:, 0]) != 0) | (np.diff(spots[:, 1]) != 1))))
    stop = np.append(cut[1:], len(spots)) - 1
    named = np.unique(docs)
    return [(int(named[spots[a, 0]]), int(spots[a, 1]), int(spots[b, 1]) + 1) for a, b in zip(cut, stop)]


def _compared(size: int) -> Callable:
    """Rows (key, doc_id, start, body), sorted by key, to the runs of repeated strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        weight, last = 0, None

        def judged() -> pa.RecordBatch:
            runs = later_strings([h[2] for h in held], np.array([h[0] for h in held]), np.array([h[1] for h in held]), size)
            columns = [pa.array([r[i] for r in runs], (pa.int64(), pa.int32(), pa.int32())[i]) for i in range(3)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "stop"])

        for batch in batches:
            for key, doc, start, body in zip(*(c.to_pylist() for c in batch.columns)):
                if weight >= BLOCK and key != last:
                    yield judged()
                    held.clear()
                    weight = 0
                held.append((doc, start, body))
                weight += len(body) + 1
                last = key
        if held:
            yield judged()

    return run


def _removed(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            lost, parts, kept = [], [], []
            for i in range(batch.num_rows):
                raw = np.frombuffer((batch.column(1)[i].as_py() or "").encode(), np.uint8)
                change = np.zeros(len(raw) + 1, np.int64)
                runs = batch.column(2)[i].values
                np.add.at(change, np.asarray(runs.field("start")), 1)
                np.add.at(change, np.asarray(runs.field("stop")) + size - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                lost.append(int(gone.sum()))
                parts.append(texts.spans(gone).tolist())
                kept.append(raw[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(lost, pa.int64()),
                    pa.array(parts, pa.list_(pa.list_(pa.int32()))),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_removed", "spans", "kept"],
            )

    return run


def dedup_bytes(docs: DataFrame, size: int = SIZE, keep_bytes: bool = False) -> DataFrame:
    """n_bytes, n_removed, removed spans and what is left of every document.

    docs: doc_id (long, one row per document), text; other columns are ignored. Null texts are empty; texts shorter than `size` lose
    nothing. Returns doc_id, n_bytes, n_removed, spans (maximal removed runs as from and to), kept_sha256 and, with
    `keep_bytes`, kept (the remaining bytes, null where nothing was removed). Rows that repeat a doc_id count as one
    document, the first of them by content; rows without a doc_id lose nothing and remove nothing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = scratch.keep(source.mapInArrow(_facts(size), FACTS), "facts")
    named = facts.where(f"doc_id IS NOT NULL AND n_bytes >= {size}")
    first = scratch.keep(named.groupBy("content", "check").agg(F.min("doc_id").alias("first")), "first")
    heads = named.join(first.withColumnRenamed("first", "doc_id"), ["content", "check", "doc_id"])
    anchors = heads.select("doc_id", F.explode("anchors").alias("anchor"))
    again = heads.select(F.explode("again").alias("anchor")).distinct().withColumn("n", F.lit(2).cast("long"))
    counted = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.keep(counted.union(again).select("anchor").distinct(), "shared")
    suspects = anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    suspects = scratch.keep(suspects, "suspects")

    # texts that hold a shared anchor are dealt by doc_id once; later joins find them in place
    table = f"repeats_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bodies = source.join(suspects.select("doc_id"), "doc_id")
    bodies.write.bucketBy(buckets, "doc_id").sortBy("doc_id").option("path", f"{scratch.folder}/bodies").saveAsTable(table)
    bodies = spark.table(table)
    cut = bodies.join(suspects, "doc_id").select("doc_id", "text", "anchors").mapInArrow(_segments(size), SEGMENTS)
    segments = scratch.keep(cut, "segments")
    place = F.struct("doc_id", "start")
    alike = ["anchor", "digest", "check", "strings"]
    kinds = segments.groupBy(*alike).agg(F.min(place).alias("place"))
    kinds = scratch.keep(kinds, "kinds")
    inner = shared.join(again.select("anchor"), "anchor", "left_semi").select("anchor")
    many = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))
    many = many.where("kinds > 1").union(inner.withColumn("kinds", F.lit(2).cast("long")))
    many = many.groupBy("anchor").agg(F.max("kinds").alias("kinds"))
    wanted = kinds.join(many, "anchor").groupBy(F.col("place.doc_id").alias("doc_id")).agg(
        F.collect_list(
            F.struct(F.col("place.start").alias("start"), "strings", "anchor", (F.col("kinds") > CROWDED).alias("crowded"))
        ).alias("parts")
    )
    pieces = bodies.join(wanted, "doc_id").select("doc_id", "text", "parts")
    pieces = scratch.keep(pieces.mapInArrow(_bytes_of(size), PIECES), "pieces")

    # pieces of crowded anchors collapse by their bytes; what is still more than a block goes string by string
    dealt = pieces.where("crowded")
    unlike = scratch.keep(dealt.groupBy("key", "body").agg(F.min(place).alias("place")), "unlike")
    heavy = unlike.groupBy("key").agg(F.sum(F.length("body") + 1).alias("weight")).where(f"weight > {BLOCK}").select("key")
    heavy = scratch.keep(heavy, "heavy")
    single = unlike.join(heavy, "key", "left_semi").select(
        "place.doc_id",
        "place.start",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.length("body") - size), lambda i: F.substr("body", i + 1, F.lit(size)))),
    )
    single = single.select("doc_id", (F.col("start") + F.col("pos")).alias("start"), F.col("col").alias("string"))
    earliest = single.groupBy("string").agg(F.min(place).alias("place"))

    light = unlike.join(heavy, "key", "left_anti").select("key", "place.doc_id", "place.start", "body")
    light = light.union(pieces.where("NOT crowded").select("key", "doc_id", "start", "body"))
    light = light.repartition("key").sortWithinPartitions("key")
    later = scratch.keep(light.mapInArrow(_compared(size), "doc_id long, start int, stop int"), "later")

    def after(rows: DataFrame, first: DataFrame, by: list[str], strings: Column) -> DataFrame:
        """The runs of strings of all rows but the first of their kind."""
        found = rows.join(first, by).where(place != F.col("place"))
        return found.select("doc_id", "start", (F.col("start") + strings).cast("int").alias("stop"))

    runs = later.union(after(segments, kinds, alike, F.col("strings")))
    runs = runs.union(after(dealt, unlike, ["key", "body"], F.length("body") - (size - 1)))
    runs = runs.union(after(single, earliest, ["string"], F.lit(1)))
    runs = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    cut = bodies.join(runs, "doc_id").select("doc_id", "text", "runs").mapInArrow(
        _removed(size), "doc_id long, n_removed long, spans array<array<int>>, kept binary"
    )
    if not keep_bytes:
        cut = cut.withColumn("kept", F.sha2("kept", 256))
    lost = scratch.keep(cut.dropDuplicates(["doc_id"]), "lost")
    scratch.drop("segments", "kinds", "later", "suspects", "pieces", "unlike", "heavy")
    spark.sql(f"DROP TABLE {table}")
    scratch.drop("bodies")

    marked = facts.drop("anchors", "again").join(first, ["content", "check"], "left")
    whole = F.array(F.array(F.lit(0), F.col("n_bytes").cast("int")))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    none = F.array().cast("array<array<int>>")
    digest = F.sha2("kept", 256) if keep_bytes else F.col("kept")
    result = marked.join(lost, "doc_id", "left").select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce(digest, "kept_sha256")).alias("kept_sha256"),
        *([F.when(copy, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept")] if keep_bytes else []),
    )
    return result
