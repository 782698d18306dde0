"""MinHash near-duplicates with sequential Bayesian verification.

1. Texts become sets of hashed word shingles; equal sets collapse to one node.
2. Each node gets a MinHash signature. Bands of it give buckets; in a bucket every node meets the
   bucket's hub (its smallest node), not every other node.
3. A pair is judged batch by batch on its signatures: after n compared values with m matches the
   similarity has a Beta(m + 1, n - m + 1) posterior, and the pair is dropped as soon as the chance
   of reaching the threshold falls below MISS. What survives is verified on the full sets.
4. Verified links form components. Where a bucket still holds several, what is outside of its largest component, few
   nodes as a rule, is laid out against the bucket in tiles of bounded size; nodes of the largest component do not meet
   each other. A tile judges its pairs of different components the same way and returns a spanning set of the links,
   never all pairs. So no link is lost to the choice of hubs.

A pair at similarity 0.8 shares no band with chance (1 - 0.8**8)**56 = 3.4e-5; the Bayesian test
drops it with chance of about MISS.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfathom.llm import texts
from adfathom.llm.shared import Scratch

BANDS, ROWS = 56, 8
SIGNATURE = 128
BATCH = 32
MISS = 1e-6
#: Nodes on either side of a tile, about.
TILE = 256

_rng = np.random.default_rng(7)
_FACTORS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = "doc_id long, node long, size int, signature binary, bands array<long>"


def least_matches(compared: int, percent: int, miss: float = MISS) -> int:
    """Fewest matches of `compared` that leave a chance of at least `miss` for the threshold.

    P(similarity >= t) under Beta(m + 1, n - m + 1) is P(Binomial(n + 1, t) <= m).
    """
    t, below = percent / 100, 0.0
    for matches in range(compared + 1):
        below += comb(compared + 1, matches) * t**matches * (1 - t) ** (compared + 1 - matches)
        if below >= miss:
            return matches
    return compared


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes per row); A-Z count as a-z."""
    for row, data, offsets in texts.text_slices(column):
        data = texts.LOWER[data]
        start, end, before = texts.word_bounds(data, offsets)
        hashed = texts.word_hashes(data, start, end)
        prefix = texts.Prefix(hashed, texts.WORD_BASE)
        at, owner = texts.window_starts(before, words)
        grams = prefix.of(at, at + words)
        cut = np.searchsorted(owner, np.arange(len(before)))
        sets = []
        for i in range(len(before) - 1):
            count = before[i + 1] - before[i]
            if 0 < count < words:
                sets.append(prefix.of(before[i : i + 1], before[i + 1 : i + 2]))
            else:
                sets.append(np.unique(grams[cut[i] : cut[i + 1]]))
        yield row, sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest value of each hash function over each set; an empty set has the largest values."""
    least = np.full((len(sets), len(_FACTORS)), np.uint64(0xFFFFFFFFFFFFFFFF))
    filled = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(filled):
        upto, size = at, 0
        while upto < len(filled) and (upto == at or size + len(sets[filled[upto]]) <= 1 << 15):
            size += len(sets[filled[upto]])
            upto += 1
        part = [sets[i] for i in filled[at:upto]]
        flat, starts = np.concatenate(part), np.cumsum([0, *map(len, part[:-1])])
        low = np.stack([np.minimum.reduceat(flat * factor, starts) for factor in _FACTORS], axis=1)
        least[filled[at:upto]] = low
        at = upto
    return least


def set_key(members: np.ndarray) -> int:
    """One 64-bit name for a set."""
    if not len(members):
        return 0
    return int(texts.signed(texts.Prefix(members, texts.WORD_BASE).of(np.array([0]), np.array([len(members)])))[0])


def _signed(words: int) -> Callable:
    """(doc_id, text) rows to the name, size, signature and band keys of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column(1), words):
                least = signatures(sets)
                short = (least[:, :SIGNATURE] >> np.uint64(32)).astype(np.uint32)
                grid = least.reshape(len(sets) * BANDS, ROWS)
                keys = np.tile(np.arange(BANDS, dtype=np.uint64), len(sets))
                for j in range(ROWS):
                    keys = texts.mixed(keys * np.uint64(texts.BASE) + grid[:, j])
                ends = np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(sets)),
                        pa.array([set_key(s) for s in sets], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([s.tobytes() for s in short], pa.binary()),
                        pa.ListArray.from_arrays(ends, pa.array(texts.signed(keys))),
                    ],
                    ["doc_id", "node", "size", "signature", "bands"],
                )

    return run


def _sets(words: int) -> Callable:
    """(node, text) rows to (node, full set); a text whose set is another one, as its doc_id repeats, is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column(1), words):
                names = batch.column(0).slice(row, len(sets)).to_pylist()
                own = [(name, s.tobytes()) for name, s in zip(names, sets) if set_key(s) == name]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, _ in own], pa.int64()), pa.array([s for _, s in own], pa.binary())],
                    ["node", "members"],
                )

    return run


def _plausible(percent: int) -> Callable:
    """Sequential Bayesian test of (a, b, left signature, right signature) rows."""
    needed = [least_matches(n, percent) for n in range(BATCH, SIGNATURE + 1, BATCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SIGNATURE) for c in (2, 3)
            ]
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for step, least in enumerate(needed):
                block = slice(step * BATCH, (step + 1) * BATCH)
                matches[alive] += (sides[0][alive, block] == sides[1][alive, block]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in (0, 1)], ["a", "b"])

    return run


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """True if two sorted sets are at least `percent` similar."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(percent: int) -> Callable:
    """Keeps the pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(m, np.uint64) for m in batch.column(c).to_pylist()] for c in (2, 3)]
            mask = pa.array([reaches(x, y, percent) for x, y in zip(*sides)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in (0, 1)], ["a", "b"])

    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tiles of a partition that is sorted by tile, one at a time."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        keys = [np.asarray(batch.column(c)) for c in range(3)]
        change = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            this = tuple(int(k[lo]) for k in keys)
            if held and this != name:
                yield pa.Table.from_batches(held)
                held = []
            name = this
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _in_tiles(percent: int, exact: bool) -> Callable:
    """Judges the pairs of a tile whose sides are in different components.

    Without `exact`: the rows of nodes that the Bayesian test leaves with a partner. With it: links enough to
    join what the full sets join, at most one less than there are components in the tile.
    """
    needed = [least_matches(n, percent) for n in range(BATCH, SIGNATURE + 1, BATCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            one, block = tile["i"][0].as_py(), np.asarray(tile["block"])
            two = tile["j"][0].as_py()
            node, group, size = (np.asarray(tile[c]) for c in ("node", "group", "size"))
            signs = np.frombuffer(b"".join(tile["signature"].to_pylist()), np.uint32).reshape(-1, SIGNATURE)
            left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
            apart = group[left][:, None] != group[right][None, :]
            if one == two:
                apart = np.triu(apart)
            small = np.minimum(size[left][:, None], size[right][None, :])
            large = np.maximum(size[left][:, None], size[right][None, :])
            x, y = np.nonzero(apart & (small.astype(np.int64) * 100 >= large.astype(np.int64) * percent))
            x, y = left[x], right[y]
            matches = np.zeros(len(x), np.int64)
            for step, least in enumerate(needed):
                part = slice(step * BATCH, (step + 1) * BATCH)
                matches = matches + (signs[x, part] == signs[y, part]).sum(axis=1)
                stay = matches >= least
                x, y, matches = x[stay], y[stay], matches[stay]
            if not exact:
                rows = pa.array(np.unique(np.concatenate([x, y])))
                if len(rows):
                    kept = tile.take(rows).combine_chunks()
                    yield from kept.to_batches()
                continue
            sets = [np.frombuffer(m, np.uint64) for m in tile["members"].to_pylist()]
            root = {g: g for g in group.tolist()}
            links = []
            for k in np.argsort(-matches, kind="stable").tolist():
                a, b = int(x[k]), int(y[k])
                ga, gb = int(group[a]), int(group[b])
                while root[ga] != ga:
                    ga = root[ga]
                while root[gb] != gb:
                    gb = root[gb]
                if ga != gb and reaches(sets[a], sets[b], percent):
                    root[max(ga, gb)] = min(ga, gb)
                    links.append((int(node[a]), int(node[b])))
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in links], pa.int64()), pa.array([p[1] for p in links], pa.int64())], ["a", "b"]
                )

    return run


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, group): the smallest node that links reach from each node that has a link.

    Each round every node takes the smallest group among its neighbours and itself, then jumps to
    the group of its group; rounds double the reach, and each is written to the shared folder.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = scratch.keep(both, f"{label}-edges")
    state = scratch.keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("group")).withColumnRenamed("a", "node"), f"{label}-0")
    turn = 0
    while True:
        turn += 1
        seen = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("group").alias("near")
        )
        lower = state.join(seen, "node").select("node", "group", F.least("group", "near").alias("next"))
        jump = state.select(F.col("node").alias("next"), F.col("group").alias("far"))
        lower = lower.join(jump, "next", "left").select(
            "node", F.col("group").alias("old"), F.least("next", "far").alias("group")
        )
        written = scratch.keep(lower, f"{label}-{turn}")
        scratch.drop(f"{label}-{turn - 1}")
        state = written.select("node", "group")
        if written.where("group <> old").isEmpty():
            return state


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Every document with the size of its shingle set and its group of near-duplicates.

    docs: doc_id (long), text, any other columns (ignored). Two documents are linked when
    100 * |intersection| >= percent * |union| of their sets of distinct `words`-word shingles; a
    shorter text is one shingle. Null, empty and wordless texts have an empty set and no link.
    Returns doc_id, n_shingles, component_id (smallest doc_id that links reach), one row per input
    row; equal rows give equal rows. A row without doc_id keeps a null component_id and lends it to no one.
    """
    scratch = Scratch(docs.sparkSession, "near-dups")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.keep(source.mapInArrow(_signed(words), SIGNED), "rows")
    nodes = rows.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.min("size").alias("size"))
    nodes = scratch.keep(nodes, "nodes")
    signed = rows.where("size > 0").select("node", "size", "signature", "bands").dropDuplicates(["node"])
    signed = scratch.keep(signed, "signed")
    rows = scratch.keep(rows.select("doc_id", "node", "size"), "documents")
    scratch.drop("rows")

    in_band = signed.select(F.explode("bands").alias("band"), "node")
    hubs = in_band.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    shared = scratch.keep(in_band.join(hubs.select("band", "hub"), "band"), "shared")
    signs = signed.select("node", "signature")

    def full_sets(needed: DataFrame, name: str) -> DataFrame:
        """The sets of some nodes, made again from their texts."""
        owners = needed.distinct().join(nodes, "node").select(F.col("first_doc").alias("doc_id"), "node")
        sets = source.join(owners, "doc_id").select("node", "text").mapInArrow(_sets(words), "node long, members binary")
        return scratch.keep(sets.dropDuplicates(["node"]), name)

    stars = shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    near = stars.join(signs.toDF("a", "left"), "a").join(signs.toDF("b", "right"), "b")
    near = near.select("a", "b", "left", "right").mapInArrow(_plausible(percent), "a long, b long")
    near = scratch.keep(near, "stars")
    members = full_sets(near.select(F.explode(F.array("a", "b")).alias("node")), "star-sets")
    full = near.join(members.toDF("a", "left"), "a").join(members.toDF("b", "right"), "b")
    links = full.select("a", "b", "left", "right").mapInArrow(_verified(percent), "a long, b long")
    links = scratch.keep(links, "star-links")
    scratch.drop("star-sets")
    grouped = components(links, scratch, "round1")

    placed = shared.select("band", "node").join(grouped, "node", "left").withColumn("group", F.coalesce("group", "node"))
    mixed = placed.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high")
    placed = scratch.keep(placed.join(mixed.select("band"), "band"), "mixed")
    sizes = placed.groupBy("band", "group").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("band").agg(
        F.max_by("group", F.struct("n", "group")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all")
    )
    # blocks of what is outside of the largest component come first, then its own
    few = F.ceil((F.col("all") - F.col("most")) / TILE).cast("int")
    sizes = sizes.select("band", "main", few.alias("few"), F.ceil(F.col("most") / TILE).cast("int").alias("many"))
    placed = placed.join(sizes, "band").withColumn("inside", F.col("group") == F.col("main"))
    spot = F.xxhash64("node")
    block = F.when(F.col("inside"), F.col("few") + F.pmod(spot, "many")).otherwise(F.pmod(spot, "few")).cast("int")
    last = F.when(F.col("inside"), F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1)
    placed = placed.withColumns({"block": block, "last": last})
    placed = placed.join(signed.select("node", "size", "signature"), "node")
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    spread = spread.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    columns = ["band", "i", "j", "block", "node", "group", "size", "signature"]

    def tiled(rows: DataFrame) -> DataFrame:
        return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")

    ordered = tiled(spread.select(*columns))
    close = scratch.keep(ordered.mapInArrow(_in_tiles(percent, False), ordered.schema), "close")
    members = full_sets(close.select("node"), "close-sets")
    ordered = tiled(close.join(members, "node").select(*columns, "members"))
    more = scratch.keep(ordered.mapInArrow(_in_tiles(percent, True), "a long, b long"), "close-links")
    grouped = components(links.union(more), scratch, "round2")

    named = nodes.join(grouped, "node", "left").withColumn("group", F.coalesce("group", "node"))
    lowest = named.groupBy("group").agg(F.min("first_doc").alias("component_id"))
    named = named.join(lowest, "group").select("node", "component_id")
    result = rows.select("doc_id", "node", "size").join(named, "node", "left").select(
        "doc_id",
        F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
    result = scratch.keep(result, "result")
    scratch.drop("documents", "signed", "shared", "mixed", "close", "close-sets")
    return result


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that are near-duplicates of one with a smaller doc_id.

    All columns stay. Rows without a doc_id stay; of rows that repeat a doc_id, one stays.
    """
    found = near_duplicates(docs, words, percent)
    lost = found.where("doc_id > component_id").select(F.col("doc_id").alias("_id")).distinct()
    again = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id")
    number, out = docs["doc_id"].cast("long"), lost.union(again)
    kept = docs.join(out, number == out["_id"], "left_anti")
    again = again.join(lost, "_id", "left_anti")
    return kept.union(docs.join(again, number == again["_id"], "left_semi").dropDuplicates(["doc_id"]))
