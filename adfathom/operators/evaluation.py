"""Exact classification metrics and curves over a scored table.

Rows are first grouped by score; everything after that works on distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfathom.operators.ordered import running_totals


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def _ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(_ratio(numerator, denominator), F.lit(0.0))


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and their harmonic mean; zero where undefined."""
    precision = _ratio_or_zero(tp, tp + fp)
    recall = _ratio_or_zero(tp, tp + fn)
    f1 = F.coalesce(
        F.try_divide(F.lit(2.0) * precision * recall, precision + recall), F.lit(0.0)
    )
    return {"precision": precision, "recall": recall, "f1_score": f1}


def confusion_metrics(df: DataFrame, label: str = "converted", predicted: str = "predicted_class") -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1, as one row."""
    truth, guess = F.col(label) == 1, F.col(predicted) == 1
    counts = df.agg(
        F.count_if(~truth & ~guess).alias("true_negatives"),
        F.count_if(~truth & guess).alias("false_positives"),
        F.count_if(truth & ~guess).alias("false_negatives"),
        F.count_if(truth & guess).alias("true_positives"),
    )
    tn, fp, fn, tp = (F.col(c) for c in counts.columns)
    derived = {"accuracy": _ratio_or_zero(tp + tn, tp + tn + fp + fn), **rates(tp, fp, fn)}
    return counts.select("*", *[value.alias(name) for name, value in derived.items()])


def score_groups(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score with its positives (tp) and negatives (fp)."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("tp"),
        F.count_if(F.col(label) == 0).alias("fp"),
        F.lit(1).alias("one"),
    )


def _from_highest(df: DataFrame, score: str, label: str, **options) -> DataFrame:
    return running_totals(
        score_groups(df, score, label), "score", ["tp", "fp", "one"], descending=True, **options
    )


def ranking_metrics(df: DataFrame, score: str = "conversion_probability", label: str = "converted") -> DataFrame:
    """ROC AUC (trapezoid, ties grouped) and average precision (step sum), as one row.

    A row without a score ranks below every scored row.

    AUC is null when a class is absent; average precision is 0 without positives.
    """
    ranked = _from_highest(df, score, label)

    def wide(value: Column | str) -> Column:
        # Products of counts outgrow 64 bits on large tables.
        return (F.col(value) if isinstance(value, str) else value).cast("decimal(18,0)")

    area = F.sum(wide("fp") * wide(F.lit(2) * F.col("run_tp") - F.col("tp"))).cast("double")
    pairs = F.max("total_tp").cast("double") * F.max("total_fp").cast("double") * F.lit(2.0)
    step = _ratio(F.col("tp"), F.col("total_tp")) * _ratio(
        F.col("run_tp"), F.col("run_tp") + F.col("run_fp")
    )
    return ranked.agg(
        F.try_divide(area, pairs).alias("roc_auc"),
        # Rounding in the sum must not lift a perfect ranking above one.
        F.least(F.coalesce(F.sum(step), F.lit(0.0)), F.lit(1.0)).alias("average_precision"),
    )


def roc_curve(df: DataFrame, score: str = "conversion_probability", label: str = "converted") -> DataFrame:
    """Points (point_idx, x = false positive rate, y = true positive rate) from (0, 0).

    A point in the middle of a straight run is left out; the first and the last stay.
    """
    ranked = _from_highest(df, score, label, following=["tp", "fp"])
    first = F.col("run_one") == 1
    last = F.col("next_tp").isNull()
    bends = (F.col("tp") != F.col("next_tp")) | (F.col("fp") != F.col("next_fp"))
    kept = ranked.filter(first | last | bends).select(
        "score",
        F.lit(1).alias("kept"),
        _ratio(F.col("run_fp"), F.col("total_fp")).alias("x"),
        _ratio(F.col("run_tp"), F.col("total_tp")).alias("y"),
    )
    placed = running_totals(kept, "score", ["kept"], descending=True)
    point = F.struct(F.col("run_kept").alias("point_idx"), "x", "y")
    origin = F.struct(
        F.lit(0).cast("bigint").alias("point_idx"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")
    )
    points = F.when(F.col("run_kept") == 1, F.array(origin, point)).otherwise(F.array(point))
    return placed.select(F.inline(points)).orderBy("point_idx")


def pr_curve(df: DataFrame, score: str = "conversion_probability", label: str = "converted") -> DataFrame:
    """Points (point_idx, x = recall, y = precision), lowest threshold first, ending at (0, 1)."""
    ranked = _from_highest(df, score, label)
    point = F.struct(
        (F.col("total_one") - F.col("run_one")).alias("point_idx"),
        F.coalesce(_ratio(F.col("run_tp"), F.col("total_tp")), F.lit(1.0)).alias("x"),
        _ratio(F.col("run_tp"), F.col("run_tp") + F.col("run_fp")).alias("y"),
    )
    end = F.struct(
        F.col("total_one").alias("point_idx"), F.lit(0.0).alias("x"), F.lit(1.0).alias("y")
    )
    points = F.when(F.col("run_one") == 1, F.array(point, end)).otherwise(F.array(point))
    return ranked.select(F.inline(points)).orderBy("point_idx")


def aligned_roc_curves(curves: dict[str, DataFrame]) -> DataFrame:
    """Several ROC curves side by side by point; a shorter one repeats its end, (1, 1)."""
    joined = None
    for name, curve in curves.items():
        point = F.struct(F.col("x").alias("fpr"), F.col("y").alias("tpr"))
        side = curve.select("point_idx", point.alias(name))
        joined = side if joined is None else joined.join(side, "point_idx", "full")
    # only where a curve has no point any more; a rate that is null in a point stays null
    filled = [
        F.when(F.col(name).isNull(), F.lit(1.0)).otherwise(F.col(name)[rate]).alias(f"{name}_{rate}")
        for name in curves
        for rate in ("fpr", "tpr")
    ]
    return joined.select("point_idx", *filled).orderBy("point_idx")
