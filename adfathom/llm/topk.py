"""Exact top-k search by inner product: tiled matrix products, partial selection, merged top lists.

Vectors are packed into numbered blocks of rows. A tile is one block of queries against one shard
of candidates; each tile keeps only its own k best per query, and the short lists are merged in
two levels, so no task ever sees all candidates of a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfathom.llm.shared import Scratch

SCALE = 1024
QUERY_BLOCK = 4096
SHARD_ROWS = 8192
#: Integer products stay exact in double precision below this bound.
EXACT = float(2**53)


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """One row per block: ids and components as little-endian bytes, ordered by id."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        return pd.DataFrame(
            {
                "block": part["block"].iloc[:1],
                "dims": part["dims"].iloc[:1],
                "ids": [part["id"].to_numpy(np.int64).tobytes()],
                "rows": [np.stack(part["vector"].to_numpy()).astype(np.float64).tobytes()],
            }
        )

    rows = rows.select("id", "vector", F.size("vector").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    return rows.groupBy("block", "dims").applyInPandas(pack, "block long, dims int, ids binary, rows binary")


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products as 64-bit integers.

    Products of two rows of moderate components are exact in double precision, which is fast; those of rows with
    larger components are made in whole numbers.
    """
    bound = np.sqrt(EXACT / max(1, left.shape[1]))
    large_left, large_right = (np.flatnonzero(np.abs(m).max(axis=1, initial=0) >= bound) for m in (left, right))
    with np.errstate(invalid="ignore"):
        scores = (left @ right.T).astype(np.int64)
    if len(large_left):
        scores[large_left] = left[large_left].astype(np.int64) @ right.T.astype(np.int64)
    if len(large_right):
        scores[:, large_right] = left.astype(np.int64) @ right[large_right].T.astype(np.int64)
    return scores


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best, ties to the smaller id; `ids` ascend."""
    none = np.iinfo(np.int64).min
    scores[own[:, None] == ids[None, :]] = none
    n = scores.shape[1]
    if n > k:
        kth = np.partition(scores, n - k, axis=1)[:, n - k : n - k + 1]
        keep = scores > kth
        # of the candidates equal to the k-th score the first ids fill what is left
        equal = scores == kth
        keep |= equal & (np.cumsum(equal, axis=1) <= k - keep.sum(axis=1, keepdims=True))
    else:
        keep = np.ones_like(scores, bool)
    return np.nonzero(keep & (scores > none))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE) -> DataFrame:
    """The k best candidates of every query by integer inner product.

    vectors, queries: (id long, vector array of numbers). Components become floor(scale * x). Pairs with
    equal ids are left out, ties go to the smaller id, fewer than k candidates give all of them.
    Scores are exact wherever they fit 64 bits. Vectors that are null, or hold null or non-finite components, and rows without an id take no part;
    vectors only meet vectors of their own length. Repeated rows count once; of different vectors of one
    id, the one that sorts first. Empty inputs give no rows. Any further columns are ignored.
    Returns query_id, rank (from 1), id, score.
    """
    scratch = Scratch(vectors.sparkSession, "topk")

    def whole(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("id").cast("long"), F.col("vector").cast("array<double>"))
        rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")) & (F.size("vector") > 0))
        return rows.groupBy("id").agg(
            F.transform(F.min("vector"), lambda x: F.floor(x * scale).cast("double")).alias("vector")
        )

    def numbered(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        rows = scratch.keep(whole(rows), f"{name}-rows")
        blocks = max(1, -(-rows.count() // size))
        return scratch.keep(_packed(rows, blocks), name), blocks

    asked, blocks = numbered(queries, QUERY_BLOCK, "queries")
    shards, _ = numbered(vectors, SHARD_ROWS, "shards")

    def tiles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for tile in part.itertuples():
                own, ids = np.frombuffer(tile.q_ids, np.int64), np.frombuffer(tile.ids, np.int64)
                left = np.frombuffer(tile.q_rows).reshape(len(own), -1)
                right = np.frombuffer(tile.rows).reshape(len(ids), -1)
                step = max(1, (1 << 22) // len(ids))
                for at in range(0, len(own), step):
                    scores = _products(left[at : at + step], right)
                    row, col = _best(scores, ids, own[at : at + step], k)
                    yield pd.DataFrame(
                        {
                            "query_id": own[at : at + step][row],
                            "shard": tile.block,
                            "score": scores[row, col],
                            "id": ids[col],
                        }
                    )

    grid = shards.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    asked = asked.select(
        F.col("block").alias("q_block"), "dims", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows")
    )
    lists = grid.join(asked, ["q_block", "dims"]).mapInPandas(tiles, "query_id long, shard long, score long, id long")

    def merged(lists: DataFrame, *keys: Column) -> DataFrame:
        entry = F.struct((-F.col("score")).alias("score"), "id")
        best = F.slice(F.sort_array(F.collect_list(entry)), 1, k)
        return lists.groupBy("query_id", *keys).agg(best.alias("best"))

    halfway = merged(lists, F.floor(F.col("shard") / 32).alias("branch")).select("query_id", F.inline("best"))
    halfway = halfway.withColumn("score", -F.col("score"))
    return merged(halfway).select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id",
        (F.col("at") + 1).alias("rank"),
        F.col("hit.id").alias("id"),
        (-F.col("hit.score")).alias("score"),
    )
