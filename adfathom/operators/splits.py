"""Exact, repeatable train and test parts."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfathom.operators.cuts import First, first_k
from adfathom.operators.features import TARGET

# The seed and the share held out.
SEED = 42
TEST_SHARE = 0.25


@dataclass(frozen=True)
class SplitPlan:
    """Rows per class, training rows per class when stratified, and whether it is stratified."""

    counts: dict[int, int]
    train: dict[int, int]
    stratified: bool

    @property
    def test(self) -> dict[int, int]:
        return {label: n - self.train[label] for label, n in self.counts.items()}


def class_counts(df: DataFrame) -> dict[int, int]:
    """At most two rows reach the driver."""
    rows = df.groupBy(TARGET).count().collect()
    return {row[TARGET]: row["count"] for row in sorted(rows)}


def can_stratify(counts: dict[int, int], test_share: float = TEST_SHARE) -> bool:
    """Two classes or more, each with two rows or more, and room for each in both parts."""
    if len(counts) < 2 or min(counts.values()) < 2:
        return False
    total = sum(counts.values())
    test = ceil(total * test_share)
    return min(test, total - test) >= len(counts)


def plan_split(counts: dict[int, int], test_share: float = TEST_SHARE) -> SplitPlan:
    """Whole numbers closest to the class shares; what rounding leaves goes to the largest
    remainders, the smaller label first.
    """
    total = sum(counts.values())
    train_total = total - ceil(total * test_share)
    quota = {label: n * train_total // total for label, n in counts.items()}
    by_remainder = sorted(counts, key=lambda label: (-(counts[label] * train_total % total), label))
    for label in by_remainder[: train_total - sum(quota.values())]:
        quota[label] += 1
    return SplitPlan(counts, quota, can_stratify(counts, test_share))


def with_split(df: DataFrame, seed: int = SEED, test_share: float = TEST_SHARE) -> tuple[DataFrame, SplitPlan]:
    """Add `split` (train or test) with exact sizes, drawn by a seeded hash of the row.

    The hash order is cut, not sorted: each class needs one cut value, and those of all classes are found in the
    same passes, so a class holding nearly all rows costs no more than a small one. A column ``_row``, if there is one, tells
    exact copies of a row apart.
    """
    plan = plan_split(class_counts(df), test_share)
    columns = [F.col(c) for c in sorted(df.columns) if c != "_row"]
    keys = [F.xxhash64(F.lit(seed), *columns), F.xxhash64(F.lit(seed + 1), *columns)]
    if "_row" in df.columns:
        keys.append(F.col("_row"))
    if plan.stratified:
        classes = {label: F.col(TARGET) == label for label in plan.train}
        asked = [First(plan.train[label], keys, plan.counts[label], mine) for label, mine in classes.items()]
        train = F.lit(False)
        for mine, first in zip(classes.values(), first_k(df, asked)):
            train = train | (mine & first)
    else:
        total = sum(plan.counts.values())
        quota = total - ceil(total * test_share)
        train = first_k(df, [First(quota, keys, total)])[0]
    return df.withColumn("split", F.when(train, "train").otherwise("test")), plan


def class_distribution(df: DataFrame) -> DataFrame:
    """Rows and share per part (total, train, test) and class; a class a part lacks is absent."""
    counted = df.groupBy("split", TARGET).agg(F.count("*").alias("n"))
    parts = F.array(F.lit("total"), F.col("split"))
    by_part = counted.select(F.explode(parts).alias("part"), TARGET, "n").groupBy("part", TARGET).agg(
        F.sum("n").alias("n")
    )
    sizes = by_part.groupBy("part").agg(
        F.sum("n").alias("size"),
        F.collect_list(F.struct(F.col(TARGET), F.col("n"))).alias("classes"),  # two at most
    )
    share = F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("size").cast("double")), F.lit(0.0))
    return sizes.select("part", "size", F.inline("classes")).select(
        "part", F.col(TARGET).alias("label"), "n", share.alias("share")
    )
