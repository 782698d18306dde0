"""Every query of the campaign engine against its SQL on the smallest test tables."""

import pytest

import __spark_entry__ as entry_point
from adfathom.functions import names
from checks import catalog, oracle
from checks.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert {r["campaign_name"] for r in rows} == {
        "Campaign One (916)", "Campaign Two (936)", "Campaign Three (1178)",
    }


def test_only_fitted_models_lack_sql():
    assert set(QUERIES) - set(SQL) == {
        "leaderboard", "report_model_metrics", "feature_importance", "predictions", "model_threshold_sweep",
    }
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(SQL) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    assert difference(spark, db, QUERIES[name], SQL[name], FOLDER) is None


@pytest.mark.parametrize(
    "name", ["campaign_view", "executive_report", "high_spend_low_conversion", "threshold_sweep", "report_recommendations"]
)
def test_plans_have_no_cross_join_and_no_python(spark, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for step in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert step not in plan


@pytest.mark.parametrize("name", ["recommendations", "recommendation_reason", "segment_metrics", "predictions"])
def test_row_level_plans_do_not_shuffle(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_the_columns_they_need(spark):
    df = QUERIES["filter_options"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("ReadSchema") :]
    assert "campaign_id" in scan and "spend" not in scan and "clicks" not in scan


def test_ads_do_not_meet_by_campaign_to_be_named(spark):
    df = QUERIES["report_recommendations"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(campaign_id" not in plan


def test_a_long_list_of_names_is_joined_by_key_with_the_same_names(spark, monkeypatch):
    rows = spark.createDataFrame([(936,), (916,), (None,), (7,)], "campaign_id bigint")
    listed = names.campaign_names(rows.filter("campaign_id > 7"))
    short = names.with_campaign_name(rows, listed)
    monkeypatch.setattr(names, "SHORT_LIST", 1)
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        long = names.with_campaign_name(rows, listed)
        assert "hashpartitioning(campaign_id" in long._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    expected = {(936, "Campaign Two (936)"), (916, "Campaign One (916)"), (None, "N/A"), (7, "Campaign Eight (7)")}
    assert {tuple(r) for r in short.collect()} == {tuple(r) for r in long.collect()} == expected


def test_the_gradient_of_the_logistic_fit_needs_no_forest(spark, monkeypatch):
    fitted, make = [], catalog.training.classifier
    monkeypatch.setattr(catalog, "_kept", {})
    monkeypatch.setattr(catalog.training, "classifier", lambda name, *rest: fitted.append(name) or make(name, *rest))
    row = QUERIES["logistic_gradient"](spark, FOLDER).head()
    assert fitted == [catalog.training.LOGISTIC]
    assert row["n_rows"] > 0 and row["open_components"] == 0
