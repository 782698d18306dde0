"""Global order without a global sort task: running totals and ranks.

Every size has the same plan. The rows are dealt into consecutive ranges of the order by the order key
itself, about `RANGE_ROWS` to a range, and written once with the number of their range, so every
later job sees the same ranges. Exactness comes from sums per range: the totals of the earlier ranges
plus the totals inside the own range. A value shared by many rows is grouped before anything
is ordered, so a hot value is one row, and no range is larger than the others because of it.

A null key is the lowest value: first in ascending and last in descending order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adfathom.staging import stage

#: Rows that one task orders. It sizes the plan and has no part in any result.
RANGE_ROWS = 250_000


def in_ranges(df: DataFrame, order: str, descending: bool = False, range_rows: int | None = None) -> DataFrame:
    """`df`, staged, with ``_range``: the number, from 0, of the consecutive part of the order a row is in."""
    whole = stage(df, "ordered")
    ranges = max(1, -(-whole.count() // (range_rows or RANGE_ROWS)))
    direction = F.desc(order) if descending else F.asc(order)
    return stage(whole.repartitionByRange(ranges, direction).withColumn("_range", F.spark_partition_id()), "ranges")


def running_totals(
    df: DataFrame,
    order: str,
    totals: list[str],
    *,
    descending: bool = False,
    following: list[str] | None = None,
    range_rows: int | None = None,
) -> DataFrame:
    """Add ``run_<c>``, the inclusive running sum of each column in `totals`, and ``total_<c>``.

    `df` holds one row per value of `order`. Each column named in `following` also gets
    ``next_<c>``, its value in the next row of the order (null in the last row).
    """
    following = following or []
    ranged = in_ranges(df, order, descending, range_rows)
    direction = F.desc if descending else F.asc
    first_of = F.max_by if descending else F.min_by

    summary = [F.sum(c).alias(f"_all_{c}") for c in totals]
    if following:
        # min_by passes over null keys, so the key is wrapped
        key = F.struct(F.col(order).isNotNull(), F.col(order))
        summary.append(first_of(F.struct(*following), key).alias("_first"))
    # One row per RANGE_ROWS rows: 10^11 values make 400,000 of them.
    across = Window.orderBy("_range")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    every = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = []
    for c in totals:
        offsets.append(F.coalesce(F.sum(f"_all_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}"))
        offsets.append(F.sum(f"_all_{c}").over(every).alias(f"total_{c}"))
    if following:
        offsets.append(F.lead("_first").over(across).alias("_next_first"))
    per_range = ranged.groupBy("_range").agg(*summary).select("_range", *offsets)

    inside = Window.partitionBy("_range").orderBy(direction(order))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {f"run_{c}": F.sum(c).over(upto) + F.col(f"_off_{c}") for c in totals}
    new |= {f"total_{c}": F.col(f"total_{c}") for c in totals}
    if following:
        ahead = F.coalesce(F.lead(F.struct(*following)).over(inside), F.col("_next_first"))
        new |= {f"next_{c}": ahead[c] for c in following}
    joined = ranged.join(per_range, "_range")
    return joined.select(*df.columns, *[value.alias(name) for name, value in new.items()])
