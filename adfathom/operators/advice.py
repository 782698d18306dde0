"""Budget advice for every ad: estimates, rules, reasons, and the summaries over them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfathom.functions.metrics import cac, cpc, ctr, money_sum, purchase_conversion_rate
from adfathom.functions.names import campaign_names, with_campaign_name
from adfathom.functions.text import MISSING, finite, plain_money, whole_percent
from adfathom.operators.insights import lines
from adfathom.operators.cuts import exact_medians
from adfathom.schema import DEFAULT_ASSUMPTIONS, Assumptions
from adfathom.staging import stage

INCREASE = "Increase budget carefully"
CONTINUE = "Continue"
MONITOR = "Monitor"
REDUCE = "Reduce budget"
PAUSE = "Pause"
# The labels in report order.
LABELS = [INCREASE, CONTINUE, MONITOR, REDUCE, PAUSE]
INEFFICIENT = [PAUSE, REDUCE]

# How far below the threshold still counts as near it, and near-zero profit.
NEAR_THRESHOLD = 0.10
NEAR_ZERO_PROFIT = 5.0
DEFAULT_THRESHOLD = 0.5

# Closing texts of the executive summary.
MAIN_LIMITATION = (
    "Recommendations are scenario estimates based on model predictions and financial "
    "assumptions, not guaranteed outcomes."
)
NEXT_ACTION = (
    "Validate top recommendations with domain experts and A/B test budget changes incrementally."
)

SEGMENT_COLUMNS = [
    "ad_id",
    "campaign_id",
    "age",
    "gender",
    "interest",
    "impressions",
    "clicks",
    "spend",
    "actual_purchases",
    "conversion_probability",
    "predicted_class",
    "ctr",
    "cpc",
    "cac",
    "purchase_conversion_rate",
    "estimated_revenue",
    "estimated_profit",
    "recommendation",
    "recommendation_reason",
]


@dataclass(frozen=True)
class Filters:
    """Which ads are listed; an empty value does not filter."""

    campaign: str | None = None
    age: str | None = None
    gender: str | None = None
    interest: str | None = None

    def condition(self) -> Column:
        kept = F.lit(True)
        for column, wanted in [("campaign_id", self.campaign), ("age", self.age), ("interest", self.interest)]:
            if wanted:
                kept = kept & (F.col(column).cast("string") == F.lit(str(wanted)))
        if self.gender:
            kept = kept & (F.lower("gender") == F.lit(self.gender.lower()))
        return kept


NO_FILTERS = Filters()


@dataclass(frozen=True)
class Baseline:
    """Table-wide numbers the rules compare with: row count and three medians."""

    rows: int
    cac: float
    spend: float
    purchase_conversion_rate: float


@dataclass(frozen=True)
class Request:
    assumptions: Assumptions = DEFAULT_ASSUMPTIONS
    threshold: float = DEFAULT_THRESHOLD
    filters: Filters = field(default_factory=Filters)

    def __post_init__(self) -> None:
        if not 0 <= self.threshold <= 1:
            raise ValueError(f"threshold must be between 0 and 1, got {self.threshold}")


def resolve_threshold(given: float | None, metadata: dict | None) -> float:
    """The caller's threshold, else one kept with the model, else 0.5."""
    if given is not None:
        return given
    kept = (metadata or {}).get("recommended_threshold")
    return float(kept) if kept is not None else DEFAULT_THRESHOLD


def segment_baseline(df: DataFrame) -> Baseline:
    """Four scalars, computed once over the unfiltered table."""
    rows = df.count()
    measured = df.select(
        finite(cac()).alias("cac"),
        F.col("spend").alias("spend"),
        purchase_conversion_rate().alias("purchase_conversion_rate"),
    )
    return Baseline(rows, **exact_medians(measured, measured.columns))


def segment_metrics(scored: DataFrame, a: Assumptions, rows: int) -> DataFrame:
    """Add the per-ad ratios and estimates; the fixed cost is shared out over all ads."""
    with_count = scored.withColumn("actual_purchases", F.col("purchases").cast("bigint"))
    p = F.col("actual_purchases").cast("double")
    revenue = p * F.lit(a.average_order_value)
    share = a.fixed_campaign_operating_cost / max(rows, 1)
    return with_count.withColumns(
        {
            "ctr": finite(ctr()),
            "cpc": finite(cpc()),
            "cac": finite(cac(purchases="actual_purchases")),
            "purchase_conversion_rate": finite(purchase_conversion_rate("actual_purchases")),
            "estimated_revenue": revenue,
            "estimated_profit": revenue - F.col("spend") - p * F.lit(a.variable_cost) - F.lit(share),
        }
    )


def recommendation(threshold: float, medians: Baseline) -> Column:
    """The label of an ad; the first rule that holds decides. A null comparison does not hold."""
    p, profit, spend = F.col("conversion_probability"), F.col("estimated_profit"), F.col("spend")
    none_sold = F.col("actual_purchases") == 0
    t, near = F.lit(threshold), F.lit(threshold - NEAR_THRESHOLD)
    below, reached = p < t, p >= t
    gains = reached & (profit > 0)
    around_zero = profit.between(-NEAR_ZERO_PROFIT, NEAR_ZERO_PROFIT)
    strong = (F.col("cac") < F.lit(medians.cac)) & (
        F.col("purchase_conversion_rate") > F.lit(medians.purchase_conversion_rate)
    )
    return (
        F.when((p < near) & (profit < 0) & (spend > 0) & none_sold, PAUSE)
        .when(below & (spend > F.lit(medians.spend)) & (none_sold | (profit <= 0)), REDUCE)
        .when(((p >= near) & below) | (around_zero & below), MONITOR)
        .when(gains & strong, INCREASE)
        .when(gains, CONTINUE)
        .when(reached, MONITOR)
        .otherwise(REDUCE)
    )


def recommendation_reason(threshold: float, medians: Baseline) -> Column:
    """One sentence per label, quoting the numbers its rule looked at."""

    def said(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    probability = whole_percent(F.col("conversion_probability"))
    limit = whole_percent(F.lit(threshold))
    profit, spend = plain_money(F.col("estimated_profit")), plain_money(F.col("spend"))
    label = F.col("recommendation")
    return (
        F.when(
            label == INCREASE,
            said(
                "Recommended for budget increase because conversion probability is ",
                probability,
                " (above ",
                limit,
                " threshold), estimated profit is ",
                profit,
                ", and CAC (",
                F.coalesce(plain_money(F.col("cac")), F.lit(MISSING)),
                ") is below the dataset median (",
                plain_money(F.lit(medians.cac)),
                ").",
            ),
        )
        .when(
            label == CONTINUE,
            said(
                "Recommended for continuation because conversion probability is ",
                probability,
                ", estimated profit is positive (",
                profit,
                "), and performance is near dataset medians.",
            ),
        )
        .when(
            label == MONITOR,
            said(
                "Placed in monitoring because conversion probability (",
                probability,
                ") is near the ",
                limit,
                " threshold and estimated profit is ",
                profit,
                ".",
            ),
        )
        .when(
            label == REDUCE,
            said(
                "Recommended for budget reduction because conversion probability is ",
                probability,
                " (below ",
                limit,
                " threshold), spend is ",
                spend,
                " (above median ",
                plain_money(F.lit(medians.spend)),
                "), and purchases are ",
                F.col("actual_purchases").cast("string"),
                ".",
            ),
        )
        .otherwise(
            said(
                "Recommended to pause because conversion probability is ",
                probability,
                " (well below ",
                limit,
                " threshold), estimated profit is ",
                profit,
                ", and no approved conversions were generated.",
            )
        )
    )


def labelled(scored: DataFrame, request: Request, baseline: Baseline) -> DataFrame:
    """Every ad with estimates and label: one narrow pass, the baseline being literals."""
    rows = segment_metrics(scored, request.assumptions, baseline.rows)
    return rows.withColumn("recommendation", recommendation(request.threshold, baseline))


def segments(scored: DataFrame, request: Request, baseline: Baseline) -> DataFrame:
    """The listed ads. Filters apply last: baseline and labels come from the whole table."""
    rows = labelled(scored, request, baseline).withColumn(
        "recommendation_reason", recommendation_reason(request.threshold, baseline)
    )
    rows = rows.withColumn("ad_id", F.coalesce("ad_id", F.lit(0).cast("bigint")))
    return rows.filter(request.filters.condition()).select(*SEGMENT_COLUMNS)


def advice_cube(scored: DataFrame, request: Request, baseline: Baseline) -> DataFrame:
    """Counts, purchases and spend by dimensions and label; all summaries are rollups of it."""
    rows = labelled(scored, request, baseline)
    return rows.groupBy("campaign_id", "age", "gender", "interest", "recommendation").agg(
        F.count("*").alias("n"),
        F.sum(F.col("actual_purchases").cast("bigint")).alias("purchases"),
        money_sum("spend").alias("spend"),
    )


def _profit(a: Assumptions, rows: int, kept: Column | None = None) -> Column:
    """Summed profit of a group of cube rows, or of those of them that satisfy `kept`."""

    def part(column: str) -> Column:
        return F.col(column) if kept is None else F.when(kept, F.col(column))

    p = F.sum(part("purchases")).cast("double")
    share = F.lit(a.fixed_campaign_operating_cost / max(rows, 1))
    return (
        p * F.lit(a.average_order_value)
        - money_sum(part("spend"))
        - p * F.lit(a.variable_cost)
        - F.sum(part("n")).cast("double") * share
    )


def recommendation_counts(cube: DataFrame, filters: Filters = NO_FILTERS) -> DataFrame:
    """One row per label in report order, zero included: label_order, recommendation, n."""
    counted = cube.agg(
        *[
            F.coalesce(
                F.sum(F.when((F.col("recommendation") == label) & filters.condition(), F.col("n"))),
                F.lit(0),
            ).alias(f"n{i}")
            for i, label in enumerate(LABELS)
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("label_order"),
                F.lit(label).alias("recommendation"),
                F.col(f"n{i}").alias("n"),
            )
            for i, label in enumerate(LABELS)
        ]
    )
    return counted.select(F.inline(rows)).orderBy("label_order")


def nonzero_counts(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("n") > 0)


def inefficient_spend(cube: DataFrame) -> DataFrame:
    """Ads and spend per campaign under the two labels that cut budget, highest spend first."""
    kept = cube.filter(F.col("recommendation").isin(INEFFICIENT) & F.col("campaign_id").isNotNull())
    rows = kept.groupBy("campaign_id").agg(F.sum("n").alias("n"), money_sum("spend").alias("spend"))
    return rows.orderBy(F.desc("spend"), "campaign_id")


def _summary(cube: DataFrame, request: Request, baseline: Baseline) -> DataFrame:
    """All parts of the executive summary as one row, with campaign names beside the ids.

    The cube is grouped by campaign, by age, by interest and as a whole in one pass; a row of
    the result belongs to the grouping whose key is set, and null keys belong to none.
    """
    a, kept = request.assumptions, request.filters.condition()
    keys = ["campaign_id", "age", "interest"]
    wasted = F.when(F.col("recommendation").isin(INEFFICIENT), F.col("spend"))
    counts = [
        F.sum(F.when((F.col("label") == label) & F.col("kept"), F.col("n"))).alias(count_column(label))
        for label in LABELS
    ]
    # Filters and labels are read before grouping, which nulls the keys of other groupings.
    marked = cube.withColumns({"kept": kept, "label": F.col("recommendation"), "wasted": wasted})
    groups = marked.groupingSets(
        [[F.col(k)] for k in keys] + [[]], *[F.col(k) for k in keys]
    ).agg(
        F.grouping_id(*keys).alias("grouping"),
        _profit(a, baseline.rows).alias("profit"),
        F.try_divide(money_sum("spend"), F.sum("purchases").cast("double")).alias("cac"),
        money_sum("wasted").alias("wasted"),
        _profit(a, baseline.rows, F.col("kept")).alias("profit_kept"),
        *counts,
    )
    groups = with_campaign_name(groups, campaign_names(cube))

    def first(order: Column, *shown: str) -> Column:
        return F.min_by(F.struct(*shown), order)

    def ranked(key: str, value: Column) -> Column:
        present = F.col(key).isNotNull() & value.isNotNull()
        return F.when(present, F.struct(value, F.col(key)))

    everything = F.col("grouping") == 7  # no key is grouped by
    campaign = ("campaign_id", "campaign_name")
    picked = groups.agg(
        first(ranked("campaign_id", -F.col("profit")), *campaign).alias("best"),
        first(ranked("campaign_id", F.col("cac")), *campaign).alias("low"),
        first(ranked("campaign_id", -F.col("wasted")), *campaign).alias("waste"),
        first(ranked("age", -F.col("profit")), "age").alias("age"),
        first(ranked("interest", -F.col("profit")), "interest").alias("interest"),
        *[
            F.coalesce(F.max(F.when(everything, F.col(c))), F.lit(0)).alias(c)
            for c in map(count_column, LABELS)
        ],
        F.coalesce(F.max(F.when(everything, F.col("profit_kept"))), F.lit(0.0)).alias("profit_kept"),
    )
    return picked.select(
        F.col("best.campaign_id").cast("string").alias("best_campaign_by_profit"),
        F.col("best.campaign_name").alias("best_campaign_name"),
        F.col("low.campaign_id").cast("string").alias("lowest_cac_campaign"),
        F.col("low.campaign_name").alias("lowest_cac_name"),
        F.col("age.age").alias("best_age_group"),
        F.col("interest.interest").cast("string").alias("best_interest_group"),
        F.col("waste.campaign_name").alias("largest_inefficient_spend_area"),
        *map(count_column, LABELS),
        F.col("profit_kept").alias("estimated_profit_selected"),
        F.lit(MAIN_LIMITATION).alias("main_limitation"),
        F.lit(NEXT_ACTION).alias("recommended_next_action"),
    )


def count_column(label: str) -> str:
    """The summary column that counts a label, such as n_reduce_budget."""
    return "n_" + label.lower().replace(" ", "_")


def executive_summary(scored: DataFrame, request: Request, baseline: Baseline) -> DataFrame:
    """One row: best campaign, age and interest, lowest CAC, wasted spend, counts, profit.

    "Best" looks at the whole table; counts and selected profit at the filtered ads. A null
    key never wins, and equal values go to the smaller key.
    """
    cube = stage(advice_cube(scored, request, baseline), "advice-cube")
    return summary_from(cube, request, baseline)


def summary_from(cube: DataFrame, request: Request, baseline: Baseline) -> DataFrame:
    return _summary(cube, request, baseline).drop("best_campaign_name", "lowest_cac_name")


def findings(scored: DataFrame, request: Request, baseline: Baseline) -> DataFrame:
    """Up to eight sentences as (line, text); one whose value does not exist is left out."""
    cube = stage(advice_cube(scored, request, baseline), "advice-cube")
    return findings_from(cube, request, baseline)


def findings_from(cube: DataFrame, request: Request, baseline: Baseline) -> DataFrame:
    summary = _summary(cube, request, baseline)

    def said(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    def counted(label: str, text: str) -> Column:
        n = F.col(count_column(label))
        return F.when(n > 0, said(n.cast("string"), text))

    return lines(
        summary,
        said(
            F.col("best_campaign_name"),
            " has the highest estimated profit among all campaigns in the current dataset.",
        ),
        said(
            F.col("lowest_cac_name"),
            " achieves the lowest customer acquisition cost (CAC) among campaigns with at least"
            " one purchase.",
        ),
        said("Age group '", F.col("best_age_group"), "' generates the highest estimated profit."),
        said(
            "Interest group ",
            F.col("best_interest_group"),
            " produces the strongest estimated profit.",
        ),
        said(
            F.col("largest_inefficient_spend_area"),
            " represents the largest concentration of spend in segments recommended for budget"
            " reduction or pause.",
        ),
        counted(
            INCREASE,
            " segment(s) meet the criteria for careful budget increase (above-threshold"
            " probability, positive estimated profit, below-median CAC).",
        ),
        counted(
            PAUSE,
            " segment(s) are recommended for pause (substantially below threshold, negative"
            " estimated profit, no conversions).",
        ),
        said(
            "Total estimated profit across all selected segments: ",
            plain_money(F.col("estimated_profit_selected")),
            " (scenario estimate, not guaranteed).",
        ),
    )


def top_segments(advised: DataFrame, limit: int = 5) -> DataFrame:
    """The ads with the highest estimated profit; equal profit goes to the smaller ad_id."""
    return advised.orderBy(F.desc("estimated_profit"), "ad_id").limit(limit)
