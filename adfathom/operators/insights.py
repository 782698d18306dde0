"""Sentences drawn from the rollups, as rows of (line, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfathom.functions.metrics import financials, money_sum
from adfathom.functions.text import grouped_money
from adfathom.operators.rollups import (
    audience_rows,
    high_spend_low_conversion,
    named_campaigns,
    segment_cube,
    sensitivity,
)
from adfathom.schema import Assumptions
from adfathom.staging import stage

# Fixed value: the sentence every set of observations opens with.
OPENING = "High engagement does not automatically mean high business value."


def best(metric: str, key: str, chosen: str, lowest: bool = False) -> Column:
    """Aggregate: `chosen` of the row with the highest (or lowest) non-null `metric`.

    Equal metrics go to the higher spend, then to the smaller key.
    """
    value = F.col(metric) if lowest else -F.col(metric)
    order = F.when(F.col(metric).isNotNull(), F.struct(value, -F.col("spend"), F.col(key)))
    return F.min_by(F.col(chosen), order)


def lines(row: DataFrame, *texts: Column | str) -> DataFrame:
    """Turn the columns of a one-row frame into lines; a null text drops its line."""
    entries = [
        F.struct(
            F.lit(i).alias("line"), (F.lit(t) if isinstance(t, str) else t).cast("string").alias("text")
        )
        for i, t in enumerate(texts, 1)
    ]
    return row.select(F.inline(F.array(*entries))).filter(F.col("text").isNotNull())


def _sentence(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def overview_insights(df: DataFrame, a: Assumptions) -> DataFrame:
    campaigns = named_campaigns(df, a)
    picked = campaigns.agg(
        F.coalesce(F.sum("purchases"), F.lit(0.0)).alias("purchases"),
        F.coalesce(money_sum("spend"), F.lit(0.0)).alias("spend"),
        best("estimated_profit", "campaign_id", "campaign_name").alias("top_profit"),
        best("clicks", "campaign_id", "campaign_name").alias("top_clicks"),
    )
    estimates = financials(a)
    revenue, profit = estimates["estimated_revenue"], estimates["estimated_profit"]
    top_profit, top_clicks = F.col("top_profit"), F.col("top_clicks")
    return lines(
        picked,
        OPENING,
        _sentence(
            "The current assumptions estimate revenue at ",
            grouped_money(revenue),
            " and estimated profit at ",
            grouped_money(profit),
            ".",
        ),
        _sentence(top_profit, " has the highest estimated profit in the loaded data."),
        F.when(
            top_clicks != top_profit,
            _sentence(
                top_clicks,
                " has the most clicks, but ",
                top_profit,
                " has the stronger estimated business value.",
            ),
        ),
    )


def campaign_insights(df: DataFrame, a: Assumptions) -> DataFrame:
    picked = named_campaigns(df, a).agg(
        best("ctr", "campaign_id", "campaign_name").alias("top_ctr"),
        best("estimated_profit", "campaign_id", "campaign_name").alias("top_profit"),
        best("cac", "campaign_id", "campaign_name", lowest=True).alias("low_cac"),
    )
    return lines(
        picked,
        OPENING,
        _sentence(F.col("top_ctr"), " has the highest click-through rate."),
        _sentence(F.col("top_profit"), " has the highest estimated profit."),
        _sentence(F.col("low_cac"), " has the lowest CAC among campaigns with purchases."),
    )


def audience_insights(df: DataFrame, a: Assumptions) -> DataFrame:
    cube = stage(segment_cube(df), "segment-cube")

    def top(view: str, metric: str) -> DataFrame:
        return audience_rows(cube, view, a).agg(
            F.lit(view).alias("item"), best(metric, view, "group_value").alias("value")
        )

    flagged = high_spend_low_conversion(cube, a).agg(
        F.lit("flagged").alias("item"),
        F.when(F.count("*") > 0, F.count("*").cast("string")).alias("value"),
    )
    found = (
        top("age", "estimated_profit")
        .unionByName(top("gender", "estimated_profit"))
        .unionByName(top("interest", "purchases"))
        .unionByName(flagged)
        .agg(F.map_from_entries(F.collect_list(F.struct("item", "value"))).alias("found"))
    )
    return lines(
        found,
        OPENING,
        _sentence("Age group ", F.col("found")["age"], " has the highest estimated profit."),
        _sentence("Gender group ", F.col("found")["gender"], " has the highest estimated profit."),
        _sentence("Interest group ", F.col("found")["interest"], " has the most purchases."),
        _sentence(
            F.col("found")["flagged"],
            " high-spend segment(s) show below-median purchase conversion.",
        ),
    )


def sensitivity_insights(df: DataFrame, a: Assumptions) -> DataFrame:
    profitable = F.when(F.col("estimated_profit") >= 0, F.col("average_order_value"))
    found = sensitivity(df, a).agg(F.min(profitable).alias("value"))
    return lines(
        found,
        OPENING,
        F.coalesce(
            _sentence(
                "Estimated profit turns non-negative at an average order value of ",
                grouped_money(F.col("value")),
                ".",
            ),
            F.lit(
                "Estimated profit remains negative across the tested average-order-value scenarios."
            ),
        ),
    )
