"""Search, filter and sort over result tables, as a listing page asks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfathom.functions.metrics import money_sum
from adfathom.functions.names import default_name


def _holds(column: Column, query: str) -> Column:
    return F.contains(F.lower(column.cast("string")), F.lit(query))


def campaign_view(
    campaigns: DataFrame,
    *,
    campaign: str = "",
    search: str = "",
    sort_by: str = "spend",
    ascending: bool = False,
) -> DataFrame:
    """Named campaign rows with one id picked, a text search over name and id, and any order.

    Ids sort as text; nulls count as smaller than every value.
    """
    rows = campaigns
    query = search.strip().lower()
    if campaign:
        rows = rows.filter(F.col("campaign_id").cast("string") == F.lit(campaign))
    if query:
        rows = rows.filter(
            _holds(F.col("campaign_name"), query) | _holds(F.col("campaign_id"), query)
        )
    key = F.col(sort_by).cast("string") if sort_by == "campaign_id" else F.col(sort_by)
    order = F.asc_nulls_first(key) if ascending else F.desc_nulls_last(key)
    return rows.orderBy(order, F.desc("spend"), F.asc_nulls_last("campaign_id"))


def campaign_view_totals(view: DataFrame) -> DataFrame:
    """The cards above the listing: campaigns shown, their profit and their spend."""
    return view.agg(
        F.count("*").alias("campaigns"),
        F.coalesce(money_sum("estimated_profit"), F.lit(0.0)).alias("estimated_profit"),
        F.coalesce(money_sum("spend"), F.lit(0.0)).alias("spend"),
    )


def campaign_export(view: DataFrame) -> DataFrame:
    """The columns of the downloadable listing."""
    return view.select(
        F.col("campaign_name").alias("Campaign"),
        F.col("spend").alias("Spend"),
        F.col("clicks").alias("Clicks"),
        F.col("purchases").alias("Purchases"),
        F.col("ctr").alias("CTR"),
        F.col("cac").alias("CAC"),
        F.col("estimated_roas").alias("Estimated ROAS"),
        F.col("estimated_profit").alias("Estimated profit"),
    )


def recommendation_view(
    advice: DataFrame,
    *,
    search: str = "",
    sort_by: str = "estimated_profit",
    ascending: bool = False,
) -> DataFrame:
    """Advice rows matching a text search, in any order; a null sorts as zero."""
    rows = advice.withColumn("campaign_name", default_name("campaign_id"))
    if search:
        query = search.lower()
        searched = ["campaign_name", "age", "gender", "recommendation"]
        codes = ["campaign_id", "interest"]
        hit = F.lit(False)
        for c in searched:
            hit = hit | F.coalesce(_holds(F.col(c), query), F.lit(False))
        for c in codes:
            hit = hit | F.coalesce(
                F.contains(F.col(c).cast("string"), F.lit(query)), F.lit(False)
            )
        rows = rows.filter(hit)
    key = F.col(sort_by)
    if dict(rows.dtypes)[sort_by] != "string":
        key = F.coalesce(key, F.lit(0))
    return rows.orderBy(key.asc() if ascending else key.desc(), "ad_id")


def filter_options(df: DataFrame) -> DataFrame:
    """The values each filter offers: option, value, in numeric order where values are numbers."""
    columns = ["campaign_id", "age", "gender", "interest"]
    # Distinct combinations first, so the four-way expansion sees few rows.
    combos = df.select(*columns).distinct()
    offers = F.array(
        *[F.struct(F.lit(c).alias("option"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    rows = combos.select(F.inline(offers)).filter(F.col("value").isNotNull()).distinct()
    return rows.orderBy("option", F.asc_nulls_last(F.col("value").try_cast("bigint")), "value")
