"""Metrics, curves and the threshold back-test against plain loops over small scored tables."""

import random

import pytest
from pyspark.sql import functions as F

from adfathom.operators import evaluation, ordered, thresholds
from adfathom.schema import DEFAULT_ASSUMPTIONS as A
from adfathom.schema import Assumptions


def rows_of(n=300, seed=1, levels=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        label = int(rng.random() < 0.3)
        score = 0.5 if i % 3 == 0 else min(levels - 1, rng.randrange(levels) + 8 * label) / levels
        out.append((i, score, label, float(rng.randrange(0, 9000)) / 100, label * rng.randrange(1, 4), rng.randrange(0, 30)))
    return out


SCHEMA = "ad_id bigint, conversion_probability double, converted int, spend double, purchases bigint, clicks bigint"


@pytest.fixture(scope="module")
def data():
    return rows_of()


@pytest.fixture(scope="module")
def scored(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(5).cache()


def test_confusion(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "converted int, predicted_class int")
    row = evaluation.confusion_metrics(df).head()
    assert (row["true_positives"], row["false_negatives"], row["false_positives"], row["true_negatives"]) == (1, 1, 1, 2)
    assert (row["accuracy"], row["precision"], row["recall"], row["f1_score"]) == (0.6, 0.5, 0.5, 0.5)


def test_confusion_without_positives_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "converted int, predicted_class int")
    row = evaluation.confusion_metrics(df).head()
    assert (row["precision"], row["recall"], row["f1_score"], row["accuracy"]) == (0, 0, 0, 1)


def test_auc_counts_pairs_and_halves_ties(scored, data):
    pos = [r[1] for r in data if r[2]]
    neg = [r[1] for r in data if not r[2]]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    got = evaluation.ranking_metrics(scored).head()
    assert got["roc_auc"] == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)


def steps(data):
    """(threshold, positives, negatives) at or above each distinct score, highest first."""
    for t in sorted({r[1] for r in data}, reverse=True):
        hit = [r[2] for r in data if r[1] >= t]
        yield t, sum(hit), len(hit) - sum(hit)


def test_average_precision_is_the_step_sum(scored, data):
    total, before, area = sum(r[2] for r in data), 0, 0.0
    for _, tp, fp in steps(data):
        area += (tp - before) / total * tp / (tp + fp)
        before = tp
    assert evaluation.ranking_metrics(scored).head()["average_precision"] == pytest.approx(area, abs=1e-12)


def test_one_class_only(scored):
    none = scored.filter("converted = 0")
    row = evaluation.ranking_metrics(none).head()
    assert row["roc_auc"] is None and row["average_precision"] == 0


def test_roc_curve_drops_only_points_on_straight_runs(scored, data):
    total = sum(r[2] for r in data)
    points = [(0, 0)] + [(fp, tp) for _, tp, fp in steps(data)]
    kept = [points[0], points[1]]
    for a, b, c in zip(points[1:], points[2:], points[3:]):
        if (b[0] - a[0], b[1] - a[1]) != (c[0] - b[0], c[1] - b[1]):
            kept.append(b)
    kept.append(points[-1])
    got = evaluation.roc_curve(scored).collect()
    assert [r["point_idx"] for r in got] == list(range(len(kept)))
    assert [(r["x"], r["y"]) for r in got] == [
        (fp / (len(data) - total), tp / total) for fp, tp in kept
    ]


def test_pr_curve_runs_from_the_lowest_threshold_to_0_1(scored, data):
    total = sum(r[2] for r in data)
    expected = [(tp / total, tp / (tp + fp)) for _, tp, fp in reversed(list(steps(data)))] + [(0.0, 1.0)]
    got = evaluation.pr_curve(scored).collect()
    assert [(r["x"], r["y"]) for r in got] == expected
    assert [r["point_idx"] for r in got] == list(range(len(expected)))


def test_shorter_curves_repeat_their_end(spark):
    a = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.0)], "point_idx bigint, x double, y double")
    b = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.2, 0.9), (2, 1.0, 1.0)], "point_idx bigint, x double, y double")
    got = evaluation.aligned_roc_curves({"a": a, "b": b}).collect()
    assert [(r["a_fpr"], r["b_tpr"]) for r in got] == [(0, 0), (1, 0.9), (1, 1)]


# -- thresholds


def plain_sweep(data, a):
    out = []
    for t in [round(0.05 * i, 2) for i in range(1, 20)]:
        hit = [r for r in data if r[1] >= t]
        tp = sum(r[2] for r in hit)
        total = sum(r[2] for r in data)
        purchases, spend = sum(r[4] for r in hit), sum(round(r[3] * 100) for r in hit) / 100
        precision = tp / len(hit) if hit else 0
        profit = purchases * a.average_order_value - (
            spend + purchases * a.variable_cost + a.fixed_campaign_operating_cost
        )
        out.append((t, len(hit), tp, len(hit) - tp, total - tp, precision, tp / total, purchases, spend, profit))
    return out


@pytest.mark.parametrize("a", [A, Assumptions(120, 20, 1, 50)])
def test_sweep_matches_a_plain_loop(scored, data, a):
    got = [
        (r["threshold"], r["segments_selected"], r["true_positives"], r["false_positives"], r["false_negatives"],
         r["precision"], r["recall"], r["actual_purchases"], r["selected_spend"], r["estimated_profit"])
        for r in thresholds.threshold_sweep(scored, a).collect()
    ]
    assert len(got) == 19
    for mine, plain in zip(got, plain_sweep(data, a)):
        assert mine == pytest.approx(plain)
    best = thresholds.best_threshold(thresholds.threshold_sweep(scored, a)).head()
    plain = max(plain_sweep(data, a), key=lambda r: (r[9], r[5], -r[1]))
    assert best["threshold"] == plain[0]
    assert best["recommended_reason"].startswith(f"Threshold {plain[0]:.2f} maximises")


def test_a_score_on_the_grid_is_selected(spark):
    df = spark.createDataFrame([(1, 0.15, 1, 1.0, 1, 1), (2, 0.1 + 0.2, 0, 1.0, 0, 1)], SCHEMA)
    got = {r["threshold"]: r["segments_selected"] for r in thresholds.threshold_sweep(df, A).collect()}
    assert got[0.15] == 2 and got[0.2] == 1 and got[0.3] == 1


def test_empty_selection_still_pays_the_fixed_cost(spark):
    df = spark.createDataFrame([(i, 0.01 * i, 0, 10.0, 0, 1) for i in range(4)], SCHEMA)
    a = Assumptions(fixed_campaign_operating_cost=7)
    rows = thresholds.threshold_sweep(df, a).collect()
    assert {(r["segments_selected"], r["estimated_profit"], r["f1_score"]) for r in rows} == {(0, -7, 0)}
    best = thresholds.best_threshold(thresholds.threshold_sweep(df, a)).head()
    assert best["threshold"] == 0.05
    strategies = thresholds.strategy_comparison(df, a).collect()
    assert [r["segments_selected"] for r in strategies] == [0, 4, 0, 0, 0]
    assert [r["estimated_profit"] for r in strategies] == [0, -47, 0, 0, 0]


@pytest.mark.parametrize("limit", [250_000, 30], ids=["one-range", "ranges"])
def test_strategies_match_sorted_lists(scored, data, monkeypatch, limit):
    monkeypatch.setattr(ordered, "RANGE_ROWS", limit)
    best = thresholds.best_threshold(thresholds.threshold_sweep(scored, A)).head()
    k = best["segments_selected"]
    mixed = (F.col("ad_id") * 7919 + 42) % 1009
    got = thresholds.strategy_comparison(scored, A, random_key=mixed).orderBy("strategy_order").collect()
    order = {
        3: lambda r: ((r[0] * 7919 + 42) % 1009, r[0]),
        4: lambda r: (-r[5], r[0]),
        5: lambda r: (r[3] / r[5] if r[5] else float("inf"), r[0]),
    }
    picks = {1: [r for r in data if r[1] >= best["threshold"]], 2: data}
    picks |= {i: sorted(data, key=key)[:k] for i, key in order.items()}
    for row in got:
        chosen = picks[row["strategy_order"]]
        assert row["segments_selected"] == len(chosen)
        assert row["actual_purchases"] == sum(r[4] for r in chosen)
        assert row["selected_spend"] == pytest.approx(sum(r[3] for r in chosen))


def test_random_strategy_repeats(scored):
    one, two = (thresholds.strategy_comparison(scored, A).collect() for _ in range(2))
    assert one == two and len(one) == 5
    assert one[2]["segments_selected"] == one[0]["segments_selected"]


def test_no_clicks_at_all(spark):
    df = spark.createDataFrame(
        [(1, 0.1, 0, 10.0, 0, 0), (2, 0.9, 1, 20.0, 1, 0), (3, 0.2, 0, 5.0, 0, 0)], SCHEMA
    )
    rows = thresholds.strategy_comparison(df, A).collect()
    assert [r["segments_selected"] for r in rows] == [1, 3, 1, 1, 1]
