"""Grouped KPI rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfathom.functions.metrics import (
    SUMMARY_COLUMNS,
    financials,
    measure_sums,
    ratios,
    with_summary,
    zero_when_empty,
)
from adfathom.functions.names import campaign_names, with_campaign_name
from adfathom.schema import CANONICAL_SCHEMA, DIMENSIONS, Assumptions
from adfathom.staging import stage

# How many groups a listing shows.
GROUP_LIMIT = 20
FLAGGED_LIMIT = 10
# What the average order value is multiplied with in a scenario.
SCENARIO_FACTORS = [0.5, 0.75, 1, 1.25, 1.5, 2]

# The audience views: name, grouping columns, and whether only the top by spend are listed.
AUDIENCE_VIEWS = {
    "age": (["age"], None),
    "gender": (["gender"], None),
    "interest": (["interest"], GROUP_LIMIT),
    "campaign_age": (["campaign_id", "age"], GROUP_LIMIT),
    "campaign_gender": (["campaign_id", "gender"], GROUP_LIMIT),
}


def ad_metrics(df: DataFrame) -> DataFrame:
    """The six ratios of every ad."""
    return df.select("ad_id", *[value.alias(name) for name, value in ratios().items()])


def ad_financials(df: DataFrame, a: Assumptions) -> DataFrame:
    """The six financial estimates of every ad."""
    return df.select("ad_id", *[value.alias(name) for name, value in financials(a).items()])


def totals(df: DataFrame) -> DataFrame:
    """The five sums over the whole table, as one row."""
    return zero_when_empty(df.agg(*measure_sums()))


def overview_totals(df: DataFrame, a: Assumptions) -> DataFrame:
    return with_summary(totals(df), a)


def funnel_stages(df: DataFrame) -> DataFrame:
    """Four rows: stage_order, stage, value."""
    stages = F.array(
        *[
            F.struct(F.lit(i).alias("stage_order"), F.lit(m.title()).alias("stage"), F.col(m).alias("value"))
            for i, m in enumerate(["impressions", "clicks", "leads", "purchases"], 1)
        ]
    )
    return totals(df).select(F.inline(stages))


def funnel_conversion(df: DataFrame) -> DataFrame:
    """Each stage against the one before it; the rate is 0 when the earlier stage is 0."""
    names = ["impressions", "clicks", "leads", "purchases"]
    steps = []
    for i, (before, after) in enumerate(zip(names, names[1:]), 1):
        rate = F.coalesce(F.try_divide(F.col(after), F.col(before)), F.lit(0.0))
        steps.append(
            F.struct(
                F.lit(i).alias("step_order"),
                F.lit(f"{before.title()} to {after.title()}").alias("transition"),
                F.col(before).alias("from_count"),
                F.col(after).alias("to_count"),
                rate.alias("conversion_rate"),
                (rate * F.lit(100.0)).alias("conversion_rate_percent"),
            )
        )
    return totals(df).select(F.inline(F.array(*steps)))


def group_sums(df: DataFrame, keys: list[str]) -> DataFrame:
    """The five sums per key; a null key is a group of its own."""
    return df.groupBy(*keys).agg(*measure_sums())


def by_spend(rows: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Highest spend first, equal spends in key order with null keys last."""
    ordered = rows.orderBy(F.desc("spend"), *[F.asc_nulls_last(k) for k in keys])
    return ordered.limit(limit) if limit else ordered


def campaign_sums(df: DataFrame, a: Assumptions) -> DataFrame:
    return with_summary(group_sums(df, ["campaign_id"]), a)


def campaign_rollup(df: DataFrame, a: Assumptions) -> DataFrame:
    """One row per campaign with its whole metric summary, by spend."""
    return by_spend(campaign_sums(df, a), ["campaign_id"]).select("campaign_id", *SUMMARY_COLUMNS)


def named_campaigns(df: DataFrame, a: Assumptions) -> DataFrame:
    """The campaign rows with display names, in no particular order.

    The sums are staged, so names and summary come from one read of the table.
    """
    sums = stage(group_sums(df, ["campaign_id"]), "campaign-sums")
    rows = with_campaign_name(with_summary(sums, a), campaign_names(sums))
    return rows.select("campaign_id", "campaign_name", *SUMMARY_COLUMNS)


def segment_cube(df: DataFrame) -> DataFrame:
    """Sums at the finest audience grain; every audience view is a rollup of this table."""
    return group_sums(df, DIMENSIONS)


def _labelled(rows: DataFrame, view: str, keys: list[str], sums: DataFrame) -> DataFrame:
    """Add group_type and group_value, the key values joined by `` / ``."""
    parts = [F.expr(f"coalesce(CAST({k} AS STRING), 'N/A')") for k in keys if k != "campaign_id"]
    if "campaign_id" in keys:
        rows = with_campaign_name(rows, campaign_names(sums))
        parts.insert(0, F.col("campaign_name"))
    added = {"group_type": F.lit(view), "group_value": F.concat_ws(" / ", *parts)}
    for d in DIMENSIONS:
        if d not in keys:
            added[d] = F.expr(f"CAST(NULL AS {CANONICAL_SCHEMA[d].dataType.simpleString()})")
    return rows.withColumns(added)


def audience_rows(df: DataFrame, view: str, a: Assumptions) -> DataFrame:
    """The rows of one audience view, cut to the top by spend where the view is a top list."""
    keys, limit = AUDIENCE_VIEWS[view]
    sums = group_sums(df, keys)
    if "campaign_id" in keys:
        sums = stage(sums, f"{view}-sums")  # the names need the campaigns as well
    rows = with_summary(sums, a)
    rows = by_spend(rows, keys, limit) if limit else rows
    labelled = _labelled(rows, view, keys, sums)
    return labelled.select("group_type", "group_value", *DIMENSIONS, *SUMMARY_COLUMNS)


def audience(df: DataFrame, view: str, a: Assumptions) -> DataFrame:
    """One audience view, highest spend first."""
    return by_spend(audience_rows(df, view, a), AUDIENCE_VIEWS[view][0])


def audience_all_sets(df: DataFrame, a: Assumptions) -> DataFrame:
    """Every group of all five audience views from one read of the table.

    The table is first reduced to the segment cube, so only that is expanded five ways.
    """
    cube = segment_cube(df)
    sets = [[F.col(k) for k in keys] for keys, _ in AUDIENCE_VIEWS.values()]
    # A bit per dimension in the order given below: 1 when the set does not group by it.
    names = {}
    for view, (keys, _) in AUDIENCE_VIEWS.items():
        names[sum(1 << (3 - i) for i, d in enumerate(DIMENSIONS) if d not in keys)] = view
    view = F.element_at(
        F.create_map(*[x for bits, v in names.items() for x in (F.lit(bits), F.lit(v))]),
        F.grouping_id(*DIMENSIONS).cast("int"),
    )
    grouped = cube.groupingSets(sets, *[F.col(d) for d in DIMENSIONS]).agg(
        view.alias("group_type"), *measure_sums()
    )
    return with_summary(grouped, a).select("group_type", *DIMENSIONS, *SUMMARY_COLUMNS)


def high_spend_low_conversion(df: DataFrame, a: Assumptions) -> DataFrame:
    """Of the listed campaign-by-age groups, those at or above the middle spend and at or below
    the middle purchase conversion rate; the middle is the upper one of an even count.

    Everything here works on the at most 20 rows of that list.
    """
    rows = audience_rows(df, "campaign_age", a)
    rate = F.coalesce("purchase_conversion_rate", F.lit(0.0))
    listed = rows.agg(
        F.collect_list(F.struct(*rows.columns)).alias("listed"),
        F.sort_array(F.collect_list("spend")).alias("spends"),
        F.sort_array(F.collect_list(rate)).alias("rates"),
    )
    middle = (F.floor(F.size("listed") / 2) + 1).cast("int")
    flagged = (
        listed.filter(F.size("listed") > 0)
        .select(
            F.inline("listed"),
            F.element_at("spends", middle).alias("_spend"),
            F.element_at("rates", middle).alias("_rate"),
        )
        .filter((F.col("spend") >= F.col("_spend")) & (rate <= F.col("_rate")))
        .drop("_spend", "_rate")
    )
    return by_spend(flagged, ["campaign_id", "age"], FLAGGED_LIMIT)


def scenario_values(average_order_value: float) -> list[float]:
    return sorted({round(average_order_value * factor, 2) for factor in SCENARIO_FACTORS})


def sensitivity(df: DataFrame, a: Assumptions) -> DataFrame:
    """The financials of the totals under each order-value scenario, at most six rows."""
    values = F.array(*[F.lit(float(v)) for v in scenario_values(a.average_order_value)])
    rows = totals(df).withColumn("average_order_value", F.explode(values))
    estimates = financials(a, order_value="average_order_value")
    shown = ["estimated_revenue", "estimated_profit", "estimated_roas", "estimated_romi"]
    return rows.select(
        "average_order_value", *[estimates[name].alias(name) for name in shown]
    ).orderBy("average_order_value")


def top_segments_by_profit(rows: DataFrame, limit: int = 15) -> DataFrame:
    """Chart feed: the most profitable rows of an audience view."""
    return rows.orderBy(F.desc("estimated_profit"), "group_value").limit(limit)


def top_interests_by_purchases(df: DataFrame, a: Assumptions, limit: int = 10) -> DataFrame:
    """Chart feed: the interests with most purchases among those listed by spend."""
    listed = audience_rows(df, "interest", a)
    return listed.orderBy(F.desc("purchases"), F.desc("spend"), "interest").limit(limit)


def audience_kpis(df: DataFrame, a: Assumptions) -> DataFrame:
    """How many groups the age, gender and interest views list, and the most purchases of a
    listed interest."""
    cube = stage(segment_cube(df), "segment-cube")
    views = [
        audience_rows(cube, view, a).select("group_type", "purchases")
        for view in ("age", "gender", "interest")
    ]
    rows = views[0].unionByName(views[1]).unionByName(views[2])
    interest = F.when(F.col("group_type") == "interest", F.col("purchases"))
    return rows.agg(
        F.count("*").alias("total_segments"),
        F.coalesce(F.max(interest), F.lit(0.0)).alias("top_interest_purchases"),
    )


