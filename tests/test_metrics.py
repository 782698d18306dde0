import pytest
from pyspark.sql import functions as F

from adfathom.functions import metrics, text
from adfathom.functions.names import campaign_names, default_name
from adfathom.schema import Assumptions


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


@pytest.mark.parametrize(
    "ratio, numbers, expected",
    [
        (metrics.ctr, dict(clicks=10, impressions=200), 0.05),
        (metrics.ctr, dict(clicks=10, impressions=0), None),
        (metrics.cpc, dict(spend=30.0, clicks=12), 2.5),
        (metrics.cpc, dict(spend=30.0, clicks=0), None),
        (metrics.lead_conversion_rate, dict(leads=3, clicks=12), 0.25),
        (metrics.purchase_conversion_rate, dict(purchases=3, clicks=12), 0.25),
        (metrics.cost_per_lead, dict(spend=30.0, leads=0), None),
        (metrics.cost_per_lead, dict(spend=30.0, leads=4), 7.5),
        (metrics.cac, dict(spend=30.0, purchases=4), 7.5),
        (metrics.cac, dict(spend=30.0, purchases=0), None),
    ],
)
def test_ratios(spark, ratio, numbers, expected):
    assert one(spark, **numbers).select(ratio().alias("r")).head()["r"] == expected


def test_financials_by_hand(spark):
    a = Assumptions(75, 35, 2, 10)
    row = one(spark, purchases=4, spend=100.0).select(
        *[v.alias(n) for n, v in metrics.financials(a).items()]
    ).head()
    assert row["estimated_revenue"] == 300
    assert row["estimated_variable_cost"] == 148
    assert row["estimated_total_cost"] == 258
    assert row["estimated_profit"] == 42
    assert row["estimated_roas"] == 3
    assert row["estimated_romi"] == pytest.approx(42 / 258)


def test_financials_of_nothing(spark):
    row = one(spark, purchases=0, spend=0.0).select(
        *[v.alias(n) for n, v in metrics.financials(Assumptions()).items()]
    ).head()
    assert row["estimated_profit"] == 0
    assert row["estimated_roas"] is None and row["estimated_romi"] is None


@pytest.mark.parametrize("bad", [-1, float("nan"), float("inf")])
def test_assumptions_must_not_be_negative(bad):
    with pytest.raises(ValueError):
        Assumptions(average_order_value=bad)


def test_text_forms(spark):
    row = one(spark, v=-1234.5, h=0.125, p=0.12345, n=1234567).select(
        text.money(F.col("v")).alias("money"),
        text.plain_money(F.col("v")).alias("plain"),
        text.fixed(F.col("h"), 2).alias("half"),
        text.percent(F.col("p")).alias("percent"),
        text.trimmed_percent(F.col("p")).alias("trimmed"),
        text.ratio(F.col("h")).alias("ratio"),
        text.count_text(F.col("n")).alias("count"),
        text.money(F.lit(None).cast("double")).alias("missing"),
        text.rounded(F.lit(2.675), 2).alias("rounded"),
    ).head()
    assert row.asDict() == {
        "money": "$-1,234.50",
        "plain": "$-1234.50",
        "half": "0.12",
        "percent": "12.3%",
        "trimmed": "12.35%",
        "ratio": "0.12x",
        "count": "1,234,567",
        "missing": "N/A",
        "rounded": 2.67,
    }


def test_trimmed_forms_round_half_away_from_zero(spark):
    expected = {
        0.125: ("0", "0.13", "$0.13", "12.5%", "0.13x"),
        -0.125: ("-0", "-0.13", "-$0.13", "-12.5%", "-0.13x"),
        1.005: ("1", "1.01", "$1.01", "100.5%", "1.01x"),
        2.5: ("3", "2.5", "$2.50", "250%", "2.5x"),
        -2.5: ("-3", "-2.5", "-$2.50", "-250%", "-2.5x"),
        -0.001: ("-0", "-0", "-$0.00", "-0.1%", "-0x"),
        1234567.895: ("1,234,568", "1,234,567.9", "$1,234,567.90", "123,456,789.5%", "1,234,567.9x"),
        0.0: ("0", "0", "$0.00", "0%", "0x"),
        float("inf"): ("∞", "∞", "$∞", "∞%", "∞x"),
        float("nan"): ("n/a",) * 5,
        None: ("n/a",) * 5,
    }
    v = F.col("v")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(expected)], "i int, v double")
    forms = rows.select("i", text.trimmed_number(v), text.trimmed_number(v, 2), text.trimmed_money(v), text.trimmed_percent(v), text.trimmed_ratio(v))
    assert [tuple(r)[1:] for r in forms.orderBy("i").collect()] == list(expected.values())


def test_not_finite_becomes_null(spark):
    rows = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double")
    assert [r[0] for r in rows.select(text.finite(F.col("v"))).collect()] == [1.5, None, None, None, None]


def test_default_names(spark):
    rows = spark.createDataFrame(
        [("916",), ("936",), ("1178",), ("916.0",), (" 936 ",), ("25",), ("ab",), ("1e3",), ("1d",), (None,)], "id string"
    )
    got = [r[0] for r in rows.select(default_name("id")).collect()]
    assert got == [
        "Campaign One (916)",
        "Campaign Two (936)",
        "Campaign Three (1178)",
        "Campaign One (916)",
        "Campaign Two (936)",
        "Campaign Two (25)",
        "Campaign Four (ab)",  # 97 + 98 = 195, which leaves 3 of 12
        "Campaign Five (1000)",
        "Campaign Six (1d)",  # 49 + 100 = 149, which leaves 5 of 12
        "N/A",
    ]


def test_names_follow_the_order_of_the_ids(spark):
    ids = spark.createDataFrame([(300,), (100,), (200,), (100,), (None,)], "campaign_id bigint")
    got = {r["campaign_id"]: r["campaign_name"] for r in campaign_names(ids).collect()}
    assert got == {100: "Campaign One (100)", 200: "Campaign Two (200)", 300: "Campaign Three (300)"}


def test_names_wrap_around_after_twelve(spark):
    got = {r["campaign_id"]: r["campaign_name"] for r in campaign_names(spark.range(30).withColumnRenamed("id", "campaign_id")).collect()}
    assert got[11] == "Campaign Twelve (11)" and got[12] == "Campaign One (12)" and got[29] == "Campaign Six (29)"
