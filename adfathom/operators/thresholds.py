"""Back-test of probability thresholds for profit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfathom.functions.metrics import financials
from adfathom.functions.text import fixed, grouped_money
from adfathom.operators.cuts import First, Selection, select_first
from adfathom.operators.evaluation import rates
from adfathom.schema import MONEY, Assumptions

# 0.05 to 0.95 in steps of 0.05, and the seed of the random baseline.
GRID = [round(0.05 * i, 2) for i in range(1, 20)]
RANDOM_SEED = 42

# Strategy names, in report order.
STRATEGIES = [
    "Model (recommended threshold)",
    "Continue all segments",
    "Random selection (same count)",
    "Most clicks (same count)",
    "Lowest CPC (same count)",
]


def threshold_sweep(
    scored: DataFrame,
    a: Assumptions,
    score: str = "conversion_probability",
    label: str = "converted",
) -> DataFrame:
    """One row per grid value with selection counts, rates and financials.

    Each row of the table is counted once, under how many grid values its score reaches; the
    at most 20 sums of that are then spread over the grid. The fixed cost is charged in full,
    whatever the selection holds.
    """
    # as text: a column for each grid value would be a hundred calls into the session
    reached = F.expr(" + ".join(f"CAST(`{score}` >= {t}D AS INT)" for t in GRID))
    per_level = scored.groupBy(reached.alias("level")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(label) == 1).alias("positives"),
        F.sum("purchases").alias("purchases"),
        F.sum(F.col("spend").cast(MONEY)).alias("spend"),
    )
    grid = ", ".join(f"named_struct('place', {i}, 'threshold', {t}D)" for i, t in enumerate(GRID, 1))
    spread = per_level.selectExpr("*", f"inline(array({grid}))")
    chosen = F.col("level") >= F.col("place")

    def over(condition: Column, value: Column | str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(value) if isinstance(value, str) else value)), F.lit(0))

    negatives = F.col("n") - F.col("positives")
    sums = spread.groupBy("threshold").agg(
        over(chosen, "n").cast("bigint").alias("segments_selected"),
        F.sum("n").alias("n_total"),
        over(chosen, "positives").cast("bigint").alias("true_positives"),
        over(chosen, negatives).cast("bigint").alias("false_positives"),
        over(~chosen, negatives).cast("bigint").alias("true_negatives"),
        over(~chosen, "positives").cast("bigint").alias("false_negatives"),
        over(chosen, "purchases").cast("double").alias("actual_purchases"),
        over(chosen, "spend").cast("double").alias("selected_spend"),
    )
    share = F.coalesce(F.try_divide(F.col("segments_selected").cast("double"), F.col("n_total").cast("double")), F.lit(0.0))
    measured = rates(F.col("true_positives"), F.col("false_positives"), F.col("false_negatives"))
    estimates = financials(a, "actual_purchases", "selected_spend")
    return sums.select(
        "threshold",
        "segments_selected",
        share.alias("pct_segments_selected"),
        "true_positives",
        "false_positives",
        "true_negatives",
        "false_negatives",
        *[value.alias(name) for name, value in measured.items()],
        "actual_purchases",
        "selected_spend",
        *[
            estimates[name].alias(name)
            for name in ("estimated_revenue", "estimated_total_cost", "estimated_profit")
        ],
    ).orderBy("threshold")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The recommended row: most profit, then precision, then fewest rows, then lowest."""
    reason = F.concat(
        F.lit("Threshold "),
        fixed(F.col("threshold"), 2),
        F.lit(" maximises historical estimated profit ("),
        grouped_money(F.col("estimated_profit")),
        F.lit(") on the held-out test set."),
    )
    return (
        sweep.orderBy(
            F.desc("estimated_profit"), F.desc("precision"), F.asc("segments_selected"), F.asc("threshold")
        )
        .limit(1)
        .withColumn("recommended_reason", reason)
    )


def strategy_comparison(
    scored: DataFrame,
    a: Assumptions,
    *,
    best=None,
    score: str = "conversion_probability",
    label: str = "converted",
    row_key: str = "ad_id",
    random_key: Column | None = None,
) -> DataFrame:
    """The recommended selection against four simple ones of the same size.

    The cut values of the three "first k" selections are found in the same passes, and each becomes a predicate, so all
    five are sums in a single pass, however large k is. Ties are settled by `row_key`, if the table has one, then by a
    row hash; rows that agree in everything are interchangeable and taken by their number.
    """
    best = best or best_threshold(threshold_sweep(scored, a, score, label)).head()
    k = best["segments_selected"]
    rows = scored.count()
    row_hash = F.expr(f"xxhash64({', '.join(f'`{c}`' for c in sorted(scored.columns))})")
    named = [F.col(row_key)] if row_key in scored.columns else []
    ties = [*named, row_hash]
    if random_key is None:
        random_key = F.xxhash64(F.lit(RANDOM_SEED), *(named or [row_hash]))
    clicks, spend = F.col("clicks").cast("double"), F.col("spend").cast("double")
    cpc = F.coalesce(F.try_divide(spend, clicks), F.lit(float("inf")))
    chosen = [
        Selection(F.col(score) >= F.lit(best["threshold"]), F.lit(False), 0, 0),
        Selection(F.lit(True), F.lit(False), 0, 0),
        *select_first(scored, [First(k, [key, *ties], rows) for key in (random_key, -clicks, cpc)]),
    ]
    sums = []
    for i, taken in enumerate(chosen):
        sums += [
            (F.count_if(taken.sure) + F.lit(taken.count)).alias(f"n{i}"),
            taken.total(F.col("purchases")).alias(f"p{i}"),
            taken.total(F.col("spend").cast(MONEY)).alias(f"s{i}"),
        ]
    entries = ", ".join(
        f"named_struct('strategy_order', {i + 1}, 'strategy', '{name}', 'segments_selected', n{i}, "
        f"'actual_purchases', coalesce(p{i}, 0D), 'selected_spend', coalesce(s{i}, 0D))"
        for i, name in enumerate(STRATEGIES)
    )
    table = scored.agg(*sums).selectExpr(f"inline(array({entries}))")
    estimates = financials(a, "actual_purchases", "selected_spend")
    empty = F.col("segments_selected") == 0
    return table.select(
        "*",
        *[
            F.when(empty, F.lit(0.0)).otherwise(estimates[name]).alias(name)
            for name in ("estimated_revenue", "estimated_profit")
        ],
    ).orderBy("strategy_order")
