import statistics

import pytest
from pyspark.sql import functions as F

from adfathom.operators import advice, ordered, views
from adfathom.operators.advice import Baseline, Filters, Request
from adfathom.plans import reports
from adfathom.schema import Assumptions

MEDIANS = Baseline(rows=5, cac=10.0, spend=20.0, purchase_conversion_rate=0.05)
COLUMNS = (
    "conversion_probability double, estimated_profit double, spend double, actual_purchases int, "
    "cac double, purchase_conversion_rate double"
)


def label_and_reason(spark, *row, threshold=0.5):
    df = spark.createDataFrame([row], COLUMNS)
    df = df.withColumn("recommendation", advice.recommendation(threshold, MEDIANS))
    return tuple(df.select("recommendation", advice.recommendation_reason(threshold, MEDIANS)).head())


@pytest.mark.parametrize(
    "row, label",
    [
        ((0.8, 50.0, 10.0, 3, 3.33, 0.1), "Increase budget carefully"),
        ((0.7, 20.0, 10.0, 1, 20.0, 0.02), "Continue"),
        ((0.8, 50.0, 10.0, 3, 3.33, None), "Continue"),
        ((0.45, 2.0, 10.0, 0, None, None), "Monitor"),
        ((0.42, -10.0, 25.0, 0, None, None), "Reduce budget"),
        ((0.1, -30.0, 30.0, 0, None, None), "Pause"),
        ((0.1, 5.0, 1.0, 1, 1.0, 0.1), "Monitor"),
        ((0.9, -1.0, 1.0, 0, None, None), "Monitor"),
        ((0.1, 30.0, 1.0, 1, 1.0, 0.1), "Reduce budget"),
        ((0.4, -30.0, 10.0, 0, None, None), "Monitor"),
    ],
)
def test_rules(spark, row, label):
    assert label_and_reason(spark, *row)[0] == label


def test_reasons(spark):
    assert label_and_reason(spark, 0.8, 50.0, 10.0, 3, 3.33, 0.1)[1] == (
        "Recommended for budget increase because conversion probability is 80% (above 50% "
        "threshold), estimated profit is $50.00, and CAC ($3.33) is below the dataset median ($10.00)."
    )
    assert label_and_reason(spark, 0.1, -30.0, 30.0, 0, None, None)[1] == (
        "Recommended to pause because conversion probability is 10% (well below 50% threshold), "
        "estimated profit is $-30.00, and no approved conversions were generated."
    )
    assert label_and_reason(spark, 0.42, -10.0, 2500.0, 0, None, None)[1] == (
        "Recommended for budget reduction because conversion probability is 42% (below 50% "
        "threshold), spend is $2500.00 (above median $20.00), and purchases are 0."
    )


@pytest.fixture(scope="module")
def scored(many_ads):
    return many_ads.withColumn(
        "conversion_probability", (F.col("ad_id") * 7919 % 1000) / F.lit(1000.0)
    ).withColumn("predicted_class", (F.col("conversion_probability") > 0.5).cast("int"))


@pytest.mark.parametrize("limit", [250_000, 30], ids=["one-range", "ranges"])
def test_baseline(scored, monkeypatch, limit):
    monkeypatch.setattr(ordered, "RANGE_ROWS", limit)
    rows = scored.collect()
    got = advice.segment_baseline(scored)
    assert got.rows == 400
    assert got.cac == statistics.median(r["spend"] / r["purchases"] for r in rows if r["purchases"])
    assert got.spend == statistics.median(r["spend"] for r in rows)
    assert got.purchase_conversion_rate == statistics.median(
        r["purchases"] / r["clicks"] for r in rows if r["clicks"]
    )


def test_baseline_of_no_rows(scored):
    assert advice.segment_baseline(scored.filter("ad_id < 0")) == Baseline(0, 0.0, 0.0, 0.0)


def test_fixed_cost_is_shared_out(scored):
    a = Assumptions(fixed_campaign_operating_cost=800)
    without = advice.segment_metrics(scored, Assumptions(), 400).select("ad_id", "estimated_profit")
    with_cost = advice.segment_metrics(scored, a, 400).select("ad_id", F.col("estimated_profit").alias("p"))
    gaps = without.join(with_cost, "ad_id").select(F.col("estimated_profit") - F.col("p"))
    assert {round(r[0], 9) for r in gaps.collect()} == {2.0}


def plain_profit(rows):
    return sum(r["purchases"] * 75 - r["spend"] - r["purchases"] * 37 for r in rows)


def test_filters_apply_after_the_rules(scored):
    baseline = advice.segment_baseline(scored)
    everything = {r["ad_id"]: r for r in advice.segments(scored, Request(), baseline).collect()}
    some = Request(filters=Filters(campaign="936", age="30-34", gender="m", interest=""))
    listed = advice.segments(scored, some, baseline).collect()
    assert listed and all(everything[r["ad_id"]] == r for r in listed)
    assert {(r["campaign_id"], r["age"], r["gender"]) for r in listed} == {(936, "30-34", "M")}
    cube = advice.advice_cube(scored, some, baseline)
    counts = {r["recommendation"]: r["n"] for r in advice.recommendation_counts(cube, some.filters).collect()}
    assert list(counts) and sum(counts.values()) == len(listed)
    assert [*counts] == advice.LABELS
    summary = advice.executive_summary(scored, some, baseline).head()
    assert summary["estimated_profit_selected"] == pytest.approx(
        plain_profit([r for r in scored.collect() if r["ad_id"] in {x["ad_id"] for x in listed}])
    )


def test_executive_summary_matches_plain_loops(scored):
    baseline = advice.segment_baseline(scored)
    rows = advice.segments(scored, Request(), baseline).collect()

    def group(key, value):
        out = {}
        for r in rows:
            out.setdefault(r[key], []).append(r)
        return {k: value(v) for k, v in out.items()}

    profit = group("campaign_id", lambda v: sum(r["estimated_profit"] for r in v))
    cac = group("campaign_id", lambda v: sum(r["spend"] for r in v) / sum(r["actual_purchases"] for r in v))
    age = group("age", lambda v: sum(r["estimated_profit"] for r in v))
    interest = group("interest", lambda v: sum(r["estimated_profit"] for r in v))
    waste = group("campaign_id", lambda v: sum(r["spend"] for r in v if r["recommendation"] in ("Pause", "Reduce budget")))
    got = advice.executive_summary(scored, Request(), baseline).head()
    assert got["best_campaign_by_profit"] == str(max(profit, key=profit.get))
    assert got["lowest_cac_campaign"] == str(min(cac, key=cac.get))
    assert got["best_age_group"] == max(age, key=age.get)
    assert got["best_interest_group"] == str(max(interest, key=interest.get))
    assert f"({max(waste, key=waste.get)})" in got["largest_inefficient_spend_area"]
    assert got["n_pause"] == sum(r["recommendation"] == "Pause" for r in rows)
    wasted = {r["campaign_id"]: r["spend"] for r in advice.inefficient_spend(advice.advice_cube(scored, Request(), baseline)).collect()}
    assert wasted == pytest.approx({k: v for k, v in waste.items() if v})


def test_summaries_drop_null_keys(null_keys):
    df = null_keys.withColumn("conversion_probability", F.lit(0.2))
    baseline = advice.segment_baseline(df)
    got = advice.executive_summary(df, Request(), baseline).head()
    assert got["best_campaign_by_profit"] == "916" and got["best_age_group"] == "30-34"
    assert got["estimated_profit_selected"] == 5 * 38 - 75


def test_summary_of_no_rows(scored):
    none = scored.filter("ad_id < 0")
    got = advice.executive_summary(none, Request(), advice.segment_baseline(none)).head()
    assert got["best_campaign_by_profit"] is None and got["n_pause"] == 0
    assert got["estimated_profit_selected"] == 0
    lines = advice.findings(none, Request(), advice.segment_baseline(none)).collect()
    assert [r["line"] for r in lines] == [8]


def test_views_and_top(scored):
    baseline = advice.segment_baseline(scored)
    rows = advice.segments(scored, Request(), baseline)
    best = sorted(rows.collect(), key=lambda r: (-r["estimated_profit"], r["ad_id"]))[:5]
    assert advice.top_segments(rows).collect() == best
    found = views.recommendation_view(rows, search="PAUSE", sort_by="cac", ascending=True).collect()
    assert found and {r["recommendation"] for r in found} == {"Pause"}
    by_name = views.recommendation_view(rows, search="campaign two").collect()
    assert {r["campaign_id"] for r in by_name} == {936}


@pytest.mark.parametrize("bad", [-0.1, 1.1])
def test_thresholds_are_probabilities(bad):
    with pytest.raises(ValueError):
        Request(threshold=bad)


def test_threshold_resolution():
    assert advice.resolve_threshold(0.0, {"recommended_threshold": 0.3}) == 0.0
    assert advice.resolve_threshold(None, {"recommended_threshold": 0.3}) == 0.3
    assert advice.resolve_threshold(None, {}) == 0.5
    assert advice.resolve_threshold(None, None) == 0.5


def test_campaign_summary_export(two_ads, null_keys):
    rows = reports.campaign_summary(two_ads, Assumptions(fixed_campaign_operating_cost=10)).collect()
    assert [r["campaign_id"] for r in rows] == [916, 936]
    assert rows[0].asDict() == {
        "campaign_id": 916, "campaign_name": "Campaign One (916)", "impressions": 1000, "clicks": 100,
        "spend": 50.0, "leads": 10, "purchases": 4, "ctr": 0.1, "cpc": 0.5, "cac": 12.5,
        "purchase_conversion_rate": 0.04, "estimated_revenue": 300.0, "estimated_profit": 92.0,
        "estimated_roas": 6.0,
    }
    kept = reports.campaign_summary(null_keys, Assumptions()).collect()
    assert [r["campaign_id"] for r in kept] == [916, 936] and kept[1]["ctr"] is None


def test_recommendation_export(scored):
    table = reports.recommendations(scored, Request(), advice.segment_baseline(scored))
    assert len(table.columns) == 20 and table.columns[:3] == ["ad_id", "campaign_id", "campaign_name"]
    assert table.count() == 400


def test_executive_report_sections(scored):
    rows = reports.executive_report(scored, Request(threshold=0.3), advice.segment_baseline(scored)).collect()
    sections = {}
    for r in rows:
        sections.setdefault(r["section_order"], []).append(r)
    assert [len(sections[i]) for i in (1, 2, 3, 5)] == [5, 6, 5, 5]
    assert sections[1][4]["value"] == "30%" and sections[2][5]["value"] == "400"
    assert [r["line"] for r in sections[3]] == [1, 2, 3, 4, 5]
