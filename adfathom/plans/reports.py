"""Export tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfathom.functions.metrics import cac, cpc, ctr, measure_sums, purchase_conversion_rate
from adfathom.functions.names import campaign_names, with_campaign_name
from adfathom.functions.text import plain_money, report_ratio, rounded, whole_percent
from adfathom.operators import advice
from adfathom.operators.advice import Baseline, Request
from adfathom.schema import Assumptions
from adfathom.staging import stage

# Texts printed under the executive report.
LIMITATIONS = [
    "Recommendations are scenario-based estimates, not guaranteed outcomes.",
    "Financial outputs depend on the provided assumptions (AOV, costs).",
    "The model was trained on historical data without campaign dates.",
    "Segment-level recommendations should be validated by domain experts before action.",
]


def campaign_summary(df: DataFrame, a: Assumptions) -> DataFrame:
    """Fourteen columns per campaign in id order; ads without a campaign are left out.

    The whole fixed cost is charged to every campaign.
    """
    kept = df.filter(F.col("campaign_id").isNotNull())
    sums = stage(kept.groupBy("campaign_id").agg(*measure_sums()), "campaign-sums")
    rows = with_campaign_name(sums, campaign_names(sums))
    p, spend = F.col("purchases"), F.col("spend")
    revenue = p * F.lit(a.average_order_value)
    profit = revenue - spend - p * F.lit(a.variable_cost) - F.lit(a.fixed_campaign_operating_cost)
    return rows.select(
        "campaign_id",
        "campaign_name",
        F.col("impressions").cast("bigint").alias("impressions"),
        F.col("clicks").cast("bigint").alias("clicks"),
        rounded(spend, 2).alias("spend"),
        F.col("leads").cast("bigint").alias("leads"),
        p.cast("bigint").alias("purchases"),
        report_ratio(ctr()).alias("ctr"),
        report_ratio(cpc()).alias("cpc"),
        report_ratio(cac()).alias("cac"),
        report_ratio(purchase_conversion_rate()).alias("purchase_conversion_rate"),
        rounded(revenue, 2).alias("estimated_revenue"),
        rounded(profit, 2).alias("estimated_profit"),
        report_ratio(F.try_divide(revenue, spend)).alias("estimated_roas"),
    ).orderBy("campaign_id")


def recommendations(scored: DataFrame, request: Request, baseline: Baseline) -> DataFrame:
    """Twenty columns per listed ad."""
    rows = advice.segments(scored, request, baseline)
    rows = with_campaign_name(rows, campaign_names(rows))
    shown: dict[str, Column] = {
        "conversion_probability": rounded(F.col("conversion_probability"), 4),
        "estimated_revenue": rounded(F.col("estimated_revenue"), 2),
        "estimated_profit": rounded(F.col("estimated_profit"), 2),
    }
    for c in ("ctr", "cpc", "cac", "purchase_conversion_rate"):
        shown[c] = report_ratio(F.col(c))
    order = ["ad_id", "campaign_id", "campaign_name", *advice.SEGMENT_COLUMNS[2:]]
    return rows.select(*[shown.get(c, F.col(c)).alias(c) for c in order])


def model_metrics(leaderboard: DataFrame) -> DataFrame:
    """The winner's six metrics, one row."""
    metrics = ["accuracy", "precision", "recall", "f1_score", "roc_auc", "average_precision"]
    return leaderboard.filter(F.col("place") == 1).select("model_name", *metrics)


def _entry(section: int, title: str, line: Column, key: Column, value: Column) -> list[Column]:
    return [
        F.lit(section).alias("section_order"),
        F.lit(title).alias("section"),
        line.cast("int").alias("line"),
        key.cast("string").alias("key"),
        value.cast("string").alias("value"),
    ]


def _literal_rows(df: DataFrame, section: int, title: str, pairs: list[tuple[str, Column]]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("line"), F.lit(key).alias("key"), value.alias("value"))
            for i, (key, value) in enumerate(pairs, 1)
        ]
    )
    one = df.sparkSession.range(1).select(F.inline(rows))
    return one.select(*_entry(section, title, F.col("line"), F.col("key"), F.col("value")))


def executive_report(scored: DataFrame, request: Request, baseline: Baseline) -> DataFrame:
    """The executive report as rows: section_order, section, line, key, value."""
    a = request.assumptions
    assumptions = _literal_rows(
        scored,
        1,
        "Financial Assumptions (User-Provided)",
        [
            ("Average order value", plain_money(F.lit(a.average_order_value))),
            ("Fulfilment cost per purchase", plain_money(F.lit(a.fulfilment_cost_per_purchase))),
            ("Transaction cost per purchase", plain_money(F.lit(a.transaction_cost_per_purchase))),
            ("Fixed campaign operating cost", plain_money(F.lit(a.fixed_campaign_operating_cost))),
            ("Probability threshold used", whole_percent(F.lit(request.threshold))),
        ],
    )
    title = "Recommendation Distribution"
    cube = stage(advice.advice_cube(scored, request, baseline), "advice-cube")
    counts = advice.recommendation_counts(cube, request.filters)
    by_label = counts.select(
        *_entry(2, title, F.col("label_order"), F.col("recommendation"), F.col("n"))
    )
    total = counts.agg(F.sum("n").alias("n")).select(
        *_entry(2, title, F.lit(6), F.lit("Total segments analysed"), F.col("n"))
    )
    names = campaign_names(cube.filter(request.filters.condition()))
    top = advice.top_segments(advice.segments(scored, request, baseline))
    top = with_campaign_name(top, names)
    # Five rows at most: placed by one small aggregate, not by a window over the table.
    place = F.sort_array(
        F.collect_list(
            F.struct(
                (-F.col("estimated_profit")).alias("order"), F.col("ad_id"), F.struct(*top.columns).alias("ad")
            )
        )
    )
    ads = top.agg(place.alias("ads")).select(F.posexplode("ads").alias("place", "entry"))
    ad = {c: F.col(f"entry.ad.{c}") for c in top.columns}
    heading = F.concat(
        ad["campaign_name"],
        F.lit(" | Age "),
        ad["age"],
        F.lit(" | "),
        ad["gender"],
        F.lit(" | Interest "),
        ad["interest"].cast("string"),
    )
    details = F.concat_ws(
        "; ",
        F.concat(F.lit("Recommendation: "), ad["recommendation"]),
        F.concat(F.lit("Conversion probability: "), whole_percent(ad["conversion_probability"])),
        F.concat(F.lit("Actual purchases: "), ad["actual_purchases"].cast("string")),
        F.concat(F.lit("Spend: "), plain_money(ad["spend"])),
        F.concat(F.lit("Estimated revenue: "), plain_money(ad["estimated_revenue"])),
        F.concat(F.lit("Estimated profit: "), plain_money(ad["estimated_profit"])),
        F.concat(F.lit("Reason: "), ad["recommendation_reason"]),
    )
    best = ads.select(
        *_entry(
            3,
            "Top Five Recommended Segments (by Estimated Profit)",
            F.col("place") + 1,
            heading,
            details,
        )
    )
    found = advice.findings_from(cube, request, baseline).select(
        *_entry(
            4,
            "Main Findings (Generated from Current Dataset)",
            F.col("line"),
            F.lit(None),
            F.col("text"),
        )
    )
    texts = [*LIMITATIONS, advice.MAIN_LIMITATION]
    limits = _literal_rows(
        scored, 5, "Important Limitations", [(str(i), F.lit(t)) for i, t in enumerate(texts, 1)]
    )
    parts = [assumptions, by_label, total, best, found, limits]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report.orderBy("section_order", "line")
