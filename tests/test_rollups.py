import pytest
from pyspark.sql import functions as F

from adfathom.operators import insights, rollups, views
from adfathom.schema import DEFAULT_ASSUMPTIONS as A
from adfathom.schema import Assumptions


def texts(df):
    return [r["text"] for r in df.orderBy("line").collect()]


def test_overview_by_hand(two_ads):
    row = rollups.overview_totals(two_ads, A).head()
    assert (row["estimated_revenue"], row["estimated_profit"]) == (375, 65)
    assert row["ctr"] == 150 / 3000 and row["cac"] == 25


def test_campaigns_come_by_spend(two_ads):
    rows = rollups.campaign_rollup(two_ads, A).collect()
    assert [r["campaign_id"] for r in rows] == [936, 916]
    assert [r["estimated_profit"] for r in rows] == [-37, 102]


def test_fixed_cost_is_charged_to_every_group(two_ads):
    rows = rollups.campaign_rollup(two_ads, Assumptions(fixed_campaign_operating_cost=10)).collect()
    assert [r["estimated_profit"] for r in rows] == [-47, 92]
    assert rollups.overview_totals(two_ads, Assumptions(fixed_campaign_operating_cost=10)).head()["estimated_profit"] == 55


def test_totals_of_no_rows_are_zero(two_ads):
    none = two_ads.filter("ad_id < 0")
    row = rollups.overview_totals(none, A).head()
    assert row["spend"] == 0 and row["estimated_profit"] == 0 and row["ctr"] is None
    assert [r["conversion_rate"] for r in rollups.funnel_conversion(none).collect()] == [0, 0, 0]
    assert rollups.high_spend_low_conversion(none, A).count() == 0


def test_null_keys_are_groups_of_their_own(null_keys):
    rows = rollups.campaign_rollup(null_keys, A).collect()
    assert [(r["campaign_id"], r["spend"]) for r in rows] == [(916, 50), (None, 20), (936, 5)]
    ages = rollups.audience(null_keys, "age", A).collect()
    assert [(r["age"], r["spend"]) for r in ages] == [("30-34", 70), (None, 5)]
    sets = rollups.audience_all_sets(null_keys, A).filter("group_type = 'age'")
    assert {(r["age"], r["spend"]) for r in sets.collect()} == {("30-34", 70), (None, 5)}


def test_equal_spend_keeps_key_order(spark, two_ads):
    same = two_ads.withColumn("spend", F.lit(1.0))
    assert [r["campaign_id"] for r in rollups.campaign_rollup(same, A).collect()] == [916, 936]


def test_every_audience_view_agrees_with_the_one_pass_version(many_ads):
    sets = rollups.audience_all_sets(many_ads, A)
    for view, (keys, limit) in rollups.AUDIENCE_VIEWS.items():
        listed = rollups.audience(many_ads, view, A).select(*keys, "spend", "estimated_profit").collect()
        whole = (
            rollups.by_spend(sets.filter(F.col("group_type") == view), keys, limit)
            .select(*keys, "spend", "estimated_profit")
            .collect()
        )
        assert listed == whole, view


def test_flagged_segments_match_a_plain_loop(many_ads):
    rows = rollups.audience(many_ads, "campaign_age", A).collect()
    spend = sorted(r["spend"] for r in rows)[len(rows) // 2]
    rate = sorted(r["purchase_conversion_rate"] or 0 for r in rows)[len(rows) // 2]
    expected = [
        r["group_value"] for r in rows if r["spend"] >= spend and (r["purchase_conversion_rate"] or 0) <= rate
    ][:10]
    got = [r["group_value"] for r in rollups.high_spend_low_conversion(many_ads, A).collect()]
    assert got == expected and got


def test_funnel(two_ads):
    stages = rollups.funnel_stages(two_ads).orderBy("stage_order").collect()
    assert [(r["stage"], r["value"]) for r in stages] == [
        ("Impressions", 3000), ("Clicks", 150), ("Leads", 15), ("Purchases", 5),
    ]
    steps = rollups.funnel_conversion(two_ads).orderBy("step_order").collect()
    assert [r["transition"] for r in steps] == ["Impressions to Clicks", "Clicks to Leads", "Leads to Purchases"]
    assert [r["conversion_rate"] for r in steps] == [0.05, 0.1, 5 / 15]


def test_sensitivity(two_ads):
    rows = rollups.sensitivity(two_ads, A).collect()
    assert [r["average_order_value"] for r in rows] == [37.5, 56.25, 75, 93.75, 112.5, 150]
    assert [r["estimated_profit"] for r in rows][2] == 65
    assert rollups.scenario_values(0) == [0]
    assert rollups.sensitivity(two_ads, Assumptions(average_order_value=0)).count() == 1


def test_insights_by_hand(two_ads):
    assert texts(insights.overview_insights(two_ads, A)) == [
        "High engagement does not automatically mean high business value.",
        "The current assumptions estimate revenue at $375.00 and estimated profit at $65.00.",
        "Campaign One (916) has the highest estimated profit in the loaded data.",
    ]
    assert texts(insights.campaign_insights(two_ads, A))[1:] == [
        "Campaign One (916) has the highest click-through rate.",
        "Campaign One (916) has the highest estimated profit.",
        "Campaign One (916) has the lowest CAC among campaigns with purchases.",
    ]
    assert texts(insights.audience_insights(two_ads, A))[1:4] == [
        "Age group 30-34 has the highest estimated profit.",
        "Gender group M has the highest estimated profit.",
        "Interest group 15 has the most purchases.",
    ]
    assert texts(insights.sensitivity_insights(two_ads, A))[1].endswith("order value of $75.00.")
    assert "remains negative" in texts(insights.sensitivity_insights(two_ads, Assumptions(average_order_value=1)))[1]


def test_most_clicks_is_told_apart_from_most_profit(two_ads):
    swapped = two_ads.withColumn("clicks", F.when(F.col("campaign_id") == 936, 500).otherwise(100))
    assert texts(insights.overview_insights(swapped, A))[3] == (
        "Campaign Two (936) has the most clicks, but Campaign One (916) has the stronger "
        "estimated business value."
    )


def test_a_campaign_without_purchases_has_no_lowest_cac(two_ads):
    none = two_ads.withColumn("purchases", F.lit(0).cast("bigint"))
    assert len(texts(insights.campaign_insights(none, A))) == 3


def test_campaign_view(many_ads):
    rows = rollups.named_campaigns(many_ads, A)
    ids = lambda df: [r["campaign_id"] for r in df.collect()]
    assert ids(views.campaign_view(rows, campaign="936")) == [936]
    assert ids(views.campaign_view(rows, search=" THREE ")) == [1178]
    assert set(ids(views.campaign_view(rows, search="9"))) == {916, 936}
    assert ids(views.campaign_view(rows, sort_by="campaign_id", ascending=True)) == [1178, 916, 936]
    assert ids(views.campaign_view(rows, search="nothing")) == []
    shown = views.campaign_view_totals(views.campaign_view(rows, campaign="936")).head()
    assert shown["campaigns"] == 1
    assert views.campaign_export(views.campaign_view(rows)).columns[0] == "Campaign"


def test_nulls_sort_as_smallest(null_keys):
    rows = rollups.named_campaigns(null_keys, A)
    up = [r["cac"] for r in views.campaign_view(rows, sort_by="cac", ascending=True).collect()]
    down = [r["cac"] for r in views.campaign_view(rows, sort_by="cac").collect()]
    assert up[0] is None and down[-1] is None


def test_filter_options_are_in_numeric_order(many_ads):
    rows = views.filter_options(many_ads).collect()
    offered = {}
    for r in rows:
        offered.setdefault(r["option"], []).append(r["value"])
    assert offered["campaign_id"] == ["916", "936", "1178"]
    assert offered["age"] == ["30-34", "35-39", "40-44", "45-49"]
    assert offered["interest"] == [str(i) for i in range(10, 30)]


@pytest.mark.parametrize("view", ["age", "campaign_gender"])
def test_chart_feeds_take_the_most_profitable(many_ads, view):
    rows = rollups.audience(many_ads, view, A)
    profits = sorted((r["estimated_profit"] for r in rows.collect()), reverse=True)[:15]
    assert [r["estimated_profit"] for r in rollups.top_segments_by_profit(rows).collect()] == profits
