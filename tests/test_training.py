import json
import math

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from adfathom.operators import features, ordered, splits, training
from adfathom.plans.engine import Workspace
from adfathom.schema import EngineError, NotFound

SMALL = training.ForestSize(trees=10, depth=5)


@pytest.fixture(scope="module")
def eight(spark):
    rows = [
        (916, "30-34", "M", 15, 1000, 10, 25.0, 2, 1),
        (916, "30-34", "F", 16, 1200, 0, 0.0, 0, 0),
        (936, "35-39", "M", 20, 900, 12, 30.0, 3, 1),
        (936, "35-39", "F", 21, 1500, 15, 45.0, 1, 0),
        (1178, "40-44", "M", 22, 2500, 20, 80.0, 4, 1),
        (1178, "40-44", "F", 23, 3000, 21, 90.0, 2, 0),
        (1178, "45-49", "M", 24, 800, 1, 5.0, 0, 0),
        (916, "45-49", "F", 25, 1100, 2, 7.0, 1, 1),
    ]
    names = "campaign_id bigint, age string, gender string, interest bigint, impressions bigint, clicks bigint, spend double, leads bigint, purchases bigint"
    return spark.createDataFrame(rows, names)


def test_target(spark):
    df = spark.createDataFrame([("2",), ("0",), (None,), ("x",), ("0.5",), ("nan",)], "purchases string")
    got = [r[0] for r in df.select(features.conversion_target(df)).collect()]
    assert got == [1, 0, 0, 0, 1, 0]
    with pytest.raises(features.FeatureError):
        features.conversion_target(df.withColumnRenamed("purchases", "sales"))


def test_leakage_guard():
    features.check_no_leakage(features.FEATURES)
    with pytest.raises(features.LeakageError, match=r"CAC, estimated_ROAS, purchases\."):
        features.check_no_leakage(["campaign_id", "age", "purchases", "estimated_ROAS", "CAC"])


def test_feature_table(eight):
    with pytest.raises(features.FeatureError, match="spend"):
        features.feature_table(eight.drop("spend"))
    table = features.feature_table(eight)
    assert set(eight.columns) < set(table.columns)
    assert dict(table.dtypes)["f_campaign_id"] == "string" and dict(table.dtypes)["f_clicks"] == "double"


@pytest.mark.parametrize("limit", [250_000, 30], ids=["one-range", "ranges"])
def test_preparation_fills_and_scales(spark, monkeypatch, limit):
    monkeypatch.setattr(ordered, "RANGE_ROWS", limit)
    rows = [(i, c, a, "M", 1, x, 5, float(i), 0) for i, (c, a, x) in enumerate([
        (936, "b", 1), (916, "b", 2), (936, "a", 3), (916, "a", 4), (None, None, None)])]
    df = spark.createDataFrame(rows, "ad_id bigint, campaign_id bigint, age string, gender string, interest bigint, impressions bigint, clicks bigint, spend double, purchases bigint")
    table = features.feature_table(df)
    fitted = features.fit_preparation(table)
    assert fitted.medians["impressions"] == 2.5
    assert fitted.modes == {"campaign_id": "916", "age": "a", "gender": "M", "interest": "1"}
    last = features.imputed_features(table, fitted).orderBy("ad_id").collect()[-1]
    assert (last["campaign_id"], last["age"], last["impressions"]) == ("916", "a", 2.5)
    scaled = features.scaled_features(table, fitted).orderBy("ad_id").collect()
    assert [r["clicks"] for r in scaled] == [0.0] * 5
    assert [r["spend"] for r in scaled] == pytest.approx([(i - 2) / math.sqrt(2) for i in range(5)])


def test_quotes_in_categories_survive(spark):
    assert spark.sql(f"SELECT {features._text_literal(chr(39) + chr(92) + 'x')} AS t").head()["t"] == "'\\x"


def test_small_split_keeps_both_classes(eight):
    table, plan = splits.with_split(features.feature_table(eight))
    assert plan.stratified and plan.train == {0: 3, 1: 3} and plan.test == {0: 1, 1: 1}
    got = {(r["part"], r["label"]): (r["n"], r["share"]) for r in splits.class_distribution(table).collect()}
    assert got[("train", 0)] == got[("train", 1)] == (3, 0.5)
    assert got[("test", 1)] == (1, 0.5) and got[("total", 0)] == (4, 0.5)


@pytest.mark.parametrize(
    "counts, possible",
    [({0: 4, 1: 4}, True), ({0: 4}, False), ({0: 9, 1: 1}, False), ({0: 2, 1: 2}, False), ({0: 5, 1: 2}, True)],
)
def test_can_stratify(counts, possible):
    assert splits.can_stratify(counts) is possible


@pytest.mark.parametrize("counts", [{0: 101, 1: 7}, {0: 10, 1: 11}, {0: 3, 1: 990}])
def test_quotas_add_up(counts):
    plan = splits.plan_split(counts)
    total = sum(counts.values())
    assert sum(plan.test.values()) == math.ceil(total * 0.25)
    assert all(abs(plan.train[c] - n * 0.75) < 1.01 for c, n in counts.items())


@pytest.mark.parametrize("limit", [250_000, 30], ids=["one-range", "ranges"])
def test_split_is_exact_repeatable_and_layout_free(many_ads, monkeypatch, limit):
    monkeypatch.setattr(ordered, "RANGE_ROWS", limit)
    table = features.feature_table(many_ads)
    one, plan = splits.with_split(table)
    two, _ = splits.with_split(table.repartition(9))
    pick = lambda df: {r["ad_id"] for r in df.filter("split = 'test'").collect()}
    assert pick(one) == pick(two) and len(pick(one)) == 100
    per_class = {r["converted"]: r["count"] for r in one.filter("split = 'test'").groupBy("converted").count().collect()}
    assert per_class == plan.test


def test_exact_copies_of_a_row_still_split_exactly(spark):
    df = spark.createDataFrame([(916, "a", "M", 1, 10, 1, 1.0, i % 2) for i in range(40)],
        "campaign_id bigint, age string, gender string, interest bigint, impressions bigint, clicks bigint, spend double, purchases bigint")
    numbered = df.coalesce(1).withColumn("_row", F.monotonically_increasing_id())
    table, plan = splits.with_split(features.feature_table(numbered))
    assert table.filter("split = 'test'").count() == 10 and plan.test == {0: 5, 1: 5}


@pytest.fixture(scope="module")
def trained(many_ads):
    return training.train_and_compare(many_ads, forest=SMALL)


def test_both_models_are_ranked(trained):
    board = trained.leaderboard().collect()
    assert {r["model_name"] for r in board} == {"LogisticRegression", "RandomForest"}
    keys = [(r["average_precision"], r["f1_score"], r["roc_auc"]) for r in board]
    assert keys == sorted(keys, reverse=True)
    for r in board:
        assert all(0 <= r[m] <= 1 for m in training.METRIC_COLUMNS)
        assert r["true_positives"] + r["false_negatives"] + r["true_negatives"] + r["false_positives"] == 100
    base = trained.metadata["class_distribution"]["test"]["1"] / 100
    assert board[0]["average_precision"] > base + 0.1


def test_each_fit_reads_even_parts_one_for_each_task(spark, many_ads, monkeypatch):
    made, seen = training.classifier, []

    def watched(*asked):
        fresh = made(*asked)
        fit = fresh.fit

        def counted(inputs):
            seen.append([r["count"] for r in inputs.groupBy(F.spark_partition_id()).count().collect()])
            return fit(inputs)

        fresh.fit = counted
        return fresh

    monkeypatch.setattr(training, "classifier", watched)
    # the staged rows lie in 20 files, of which each is a part of its own
    set_here = {"spark.sql.shuffle.partitions": "20", "spark.sql.files.maxPartitionBytes": "1k"}
    before = {name: spark.conf.get(name) for name in set_here}
    try:
        for name, value in set_here.items():
            spark.conf.set(name, value)
        training.train_and_compare(many_ads, forest=SMALL)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(seen) == 2
    for parts in seen:
        assert len(parts) == spark.sparkContext.defaultParallelism
        assert sum(parts) == 300 and max(parts) < 1.5 * min(parts)


def test_the_forest_keeps_node_ids_and_grows_the_same_trees(spark):
    rows = spark.range(0, 2000, 1, 4).selectExpr(
        "array(id * 37 % 101, id * 53 % 89, id % 7) AS x",
        "CAST(id * 37 % 101 + id * 53 % 89 + id * id % 60 > 120 AS INT) AS converted",
        "1.0D + id % 2 AS class_weight",
    )
    inputs = rows.select(array_to_vector(F.col("x").cast("array<double>")).alias("model_input"), "converted", "class_weight")
    forest = training.classifier(training.FOREST, 2000, 42, training.ForestSize(trees=7, depth=10))
    assert forest.getCacheNodeIds()
    kept = forest.fit(inputs)
    assert kept.totalNumNodes > 100
    assert kept.toDebugString.split("\n")[1:] == forest.setCacheNodeIds(False).fit(inputs).toDebugString.split("\n")[1:]


def test_metadata(trained):
    kept = json.loads(json.dumps(trained.metadata))
    assert kept["dataset_row_count"] == 400 and kept["training_row_count"] == 300 and kept["testing_row_count"] == 100
    assert kept["approved_features"] == features.FEATURES
    assert not set(kept["approved_features"]) & set(kept["excluded_leakage_features"])
    assert "2" in kept["training_timestamp"][:1]


def test_curves_of_the_models(trained):
    for result in trained.results:
        roc = result.roc_curve().collect()
        assert (roc[0]["x"], roc[0]["y"]) == (0, 0) and (roc[-1]["x"], roc[-1]["y"]) == (1, 1)
        pr = result.pr_curve().collect()
        assert (pr[-1]["x"], pr[-1]["y"]) == (0, 1) and pr[0]["x"] == 1


def test_importance(trained, many_ads):
    for result in trained.results:
        rows = training.feature_importance(result.model, many_ads).collect()
        names = [r["feature"] for r in rows]
        assert {"impressions", "clicks", "spend", "age_30-34", "gender_M", "campaign_id_916"} <= set(names)
        values = [r["importance"] for r in rows]
        assert values == sorted(values, reverse=True) and min(values) >= 0
        directions = {r["direction"] for r in rows}
        assert directions <= ({"positive", "negative"} if result.name == training.LOGISTIC else {None})
        assert training.top_features(training.feature_importance(result.model, many_ads)).count() == 15


def test_unknown_levels_and_gaps_can_be_scored(trained, many_ads):
    odd = many_ads.withColumns({"age": F.lit("65+"), "gender": F.lit(None).cast("string"), "impressions": F.lit(None).cast("bigint")})
    rows = training.predictions(trained.selected.model, odd).collect()
    assert len(rows) == 400 and all(0 <= r["conversion_probability"] <= 1 for r in rows)


def test_predictions(trained, many_ads):
    table = training.predictions(trained.selected.model, many_ads)
    assert table.columns == [
        "ad_id", "campaign_id", "age", "gender", "interest", "impressions", "clicks", "spend",
        "actual_converted", "conversion_probability", "predicted_class",
    ]
    assert all((r["conversion_probability"] > 0.5) == (r["predicted_class"] == 1) for r in table.collect())


def test_logistic_regression_solves_the_penalised_problem(trained, many_ads):
    """At the solution the gradient of the class-balanced C = 1 objective is zero."""
    import numpy as np

    result = next(r for r in trained.results if r.name == training.LOGISTIC)
    train = trained.split.filter("split = 'train'")
    shown = train
    for part in result.model.stages[:-1]:
        shown = part.transform(shown)
    rows = shown.select("model_input", "converted").collect()
    x = np.array([r["model_input"].toArray() for r in rows])
    y = np.array([r["converted"] for r in rows])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    fit = result.model.stages[-1]
    w = fit.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + fit.intercept)))
    gradient = np.append(x.T @ (weight * (p - y)) + w, (weight * (p - y)).sum()) / len(y)
    assert np.abs(gradient).max() < 1e-6
    told = training.logistic_gradient(result.model, train).collect()
    assert [r["feature"] for r in told] == [*training.input_names(result.model), "intercept"]
    assert np.allclose([r["gradient"] for r in told], gradient, rtol=0, atol=1e-12)
    assert all(r["n_rows"] == len(y) and abs(r["total_weight"] - weight.sum()) < 1e-6 for r in told)


def test_one_class_cannot_be_trained(many_ads):
    with pytest.raises(EngineError, match="converting"):
        training.train_and_compare(many_ads.withColumn("purchases", F.lit(0)), forest=SMALL)


HEADER = "ad_id,xyz_campaign_id,fb_campaign_id,age,gender,interest,Impressions,Clicks,Spent,Total_Conversion,Approved_Conversion"


def test_workspace_from_csv_to_reports(spark, many_ads, tmp_path):
    default = tmp_path / "default.csv"
    lines = [",".join(str(v) for v in r) for r in many_ads.collect()]
    default.write_text("\n".join([HEADER, *lines]))
    work = Workspace(spark, str(tmp_path / "work"), str(default))
    for ask in (work.feature_importance, work.predictions, work.threshold_analysis, work.recommendations):
        with pytest.raises(NotFound):
            ask()
    assert work.model_status()["model_exists"] is False
    work.datasets.load_default()
    assert work.overview()["funnel"].count() == 4
    assert work.campaigns()["campaigns"].count() == 3
    assert len(work.audiences()) == 7 and work.sensitivity()["scenarios"].count() == 6

    result = work.train(forest=SMALL)
    status = work.model_status()
    assert status["model_exists"] and status["selected_model_name"] == result.selected.name
    before = training.predictions(result.selected.model, work.datasets.current()).orderBy("ad_id").collect()
    assert work.predictions().orderBy("ad_id").collect() == before
    analysis = work.threshold_analysis()
    assert analysis["thresholds"].count() == 19 and analysis["strategies"].count() == 5
    assert analysis["thresholds"].head()["segments_selected"] <= 100
    parts = work.recommendations(threshold=0.4)
    assert parts["segments"].count() == 400 and parts["executive_summary"].count() == 1

    work.export_campaign_summary(str(tmp_path / "summary"))
    work.export_recommendations(str(tmp_path / "advice"))
    work.export_model_metrics(str(tmp_path / "metrics"))
    assert spark.read.csv(str(tmp_path / "summary"), header=True).count() == 3
    advice = spark.read.csv(str(tmp_path / "advice"), header=True)
    assert advice.count() == 400 and len(advice.columns) == 20
    assert spark.read.csv(str(tmp_path / "metrics"), header=True).columns == ["model_name", *training.METRIC_COLUMNS]
