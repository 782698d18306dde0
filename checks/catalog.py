"""Every query the driver runs, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adfathom.functions import text
from adfathom.functions.names import campaign_names, default_name
from adfathom.operators import (
    advice,
    evaluation,
    features,
    insights,
    quality,
    rollups,
    splits,
    thresholds,
    training,
    views,
)
from adfathom.operators.advice import Filters, Request
from adfathom.plans import reports
from adfathom.schema import COLUMNS, DEFAULT_ASSUMPTIONS, INTEGER_COLUMNS
from adfathom.sources import csv_scan, datasets
from checks import fixtures

A = DEFAULT_ASSUMPTIONS
REQUEST = Request()
# Decimals kept of results that are not exact in either engine.
DIGITS = 10

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}
_kept: dict[tuple, object] = {}


def query(run: Query) -> Query:
    _found[run.__name__] = run
    return run


def queries() -> dict[str, Query]:
    return dict(_found)


def _once(spark: SparkSession, sf_dir: str, name: str, make):
    """A value several queries share, made once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Drops what queries share, so that the next one pays for it itself."""
    _kept.clear()


def _baseline(spark: SparkSession, sf_dir: str) -> advice.Baseline:
    return _once(
        spark, sf_dir, "baseline", lambda: advice.segment_baseline(fixtures.scored(spark, sf_dir))
    )


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = (F.col("conversion_probability") > 0.5).cast("int")
    return fixtures.scored(spark, sf_dir).withColumn("predicted_class", guess)


def _rounded(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    chosen = columns or [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(c, DIGITS) for c in chosen})


# -- sources and quality gate


def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.distinct_rows(quality.normalised(fixtures.raw(spark, sf_dir)))


@query
def scan_normalized(spark, sf_dir):
    return _typed_cells(quality.normalised(fixtures.raw(spark, sf_dir)))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged ads as they are read from CSV files."""
    raw = csv_scan.read_csv(spark, fixtures.raw_csv(spark, sf_dir))
    return quality.normalised(csv_scan.canonical_text(raw))


def _typed_cells(rows: DataFrame) -> DataFrame:
    values = {c: quality.whole(c) for c in INTEGER_COLUMNS}
    values["spend"] = quality.number("spend")
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in COLUMNS])


@query
def csv_scan_rows(spark, sf_dir):
    return _typed_cells(_scanned(spark, sf_dir))


@query
def csv_quality_report(spark, sf_dir):
    return _flat_report(quality.quality_report(quality.distinct_rows(_scanned(spark, sf_dir))))


@query
def preview(spark, sf_dir):
    return datasets.preview(fixtures.ads(spark, sf_dir))


@query
def dedupe_count(spark, sf_dir):
    return quality.dedupe_counts(quality.normalised(fixtures.raw(spark, sf_dir)))


@query
def quality_counts(spark, sf_dir):
    return quality.quality_counts(_distinct(spark, sf_dir))


def _flat_report(report: DataFrame) -> DataFrame:
    maps = {
        "missing_age": report[quality.MAPS[0]]["age"],
        "invalid_spend": report[quality.MAPS[1]]["spend"],
        "negative_spend": report[quality.MAPS[2]]["spend"],
        "warnings": F.concat_ws(" | ", "warnings"),
    }
    return report.withColumns(maps).drop(*quality.MAPS)


@query
def quality_report(spark, sf_dir):
    return _flat_report(quality.quality_report(_distinct(spark, sf_dir)))


@query
def quality_report_clean(spark, sf_dir):
    as_text = fixtures.ads(spark, sf_dir).select(*[F.col(c).cast("string").alias(c) for c in COLUMNS])
    report = quality.quality_report(quality.distinct_rows(quality.normalised(as_text)))
    return report.select(
        "row_count", "duplicate_count", "ready_for_analysis", F.concat_ws(" | ", "warnings").alias("warnings")
    )


@query
def quality_warnings(spark, sf_dir):
    return quality.quality_warnings(quality.quality_report(_distinct(spark, sf_dir)))


@query
def quality_issue_counts(spark, sf_dir):
    return quality.issue_counts(quality.quality_report(_distinct(spark, sf_dir)))


@query
def quality_issue_totals(spark, sf_dir):
    return quality.issue_totals(quality.quality_report(_distinct(spark, sf_dir)))


@query
def quarantine_rows(spark, sf_dir):
    rows = quality.quarantine_rows(_distinct(spark, sf_dir))
    return rows.select(
        quality.whole("ad_id").alias("ad_id"),
        "copies",
        F.concat_ws(",", "broken_rules").alias("broken_rules"),
    )


@query
def typed_rows(spark, sf_dir):
    return quality.typed_rows(_distinct(spark, sf_dir))


# -- metrics and rollups


@query
def ad_metrics(spark, sf_dir):
    return rollups.ad_metrics(fixtures.ads(spark, sf_dir))


@query
def ad_financials(spark, sf_dir):
    return rollups.ad_financials(fixtures.ads(spark, sf_dir), A)


@query
def campaign_names_by_place(spark, sf_dir):
    """Names over a many-valued id: the ad sets, of which there are more than labels."""
    ids = fixtures.ads(spark, sf_dir).select(F.col("ad_set_id").alias("campaign_id"))
    return campaign_names(ids)


@query
def campaign_names_of_ads(spark, sf_dir):
    """Every ad id as if it were a campaign: the names must hold for as many ids as rows."""
    ids = fixtures.ads(spark, sf_dir).select(F.col("ad_id").alias("campaign_id"))
    return campaign_names(ids)


_found["campaign_names"] = lambda spark, sf_dir: campaign_names(fixtures.ads(spark, sf_dir))


@query
def campaign_default_names(spark, sf_dir):
    rows = fixtures.ads(spark, sf_dir).select("campaign_id", "ad_set_id").distinct()
    return rows.select(
        "campaign_id",
        "ad_set_id",
        default_name("campaign_id").alias("campaign_name"),
        default_name("ad_set_id").alias("ad_set_name"),
    )


@query
def formatted_metrics(spark, sf_dir):
    rows = rollups.campaign_sums(fixtures.ads(spark, sf_dir), A)
    listed = rows.select("campaign_id", "impressions", *text.MONEY_COLUMNS & set(rows.columns),
                         *text.PERCENT_COLUMNS & set(rows.columns), *text.RATIO_COLUMNS)
    return text.format_table(listed).withColumn("impressions", text.count_text(F.col("impressions")))


@query
def ui_number_forms(spark, sf_dir):
    """Trimmed forms of each ad's numbers: many stand half-way, ads of odd id are negative, ratios may be missing."""
    sign = F.when(F.col("ad_id") % 2 == 1, -1.0).otherwise(1.0)
    spend = F.col("spend").cast("double")
    return fixtures.ads(spark, sf_dir).select(
        "ad_id",
        text.trimmed_number(sign * F.col("clicks") / 2).alias("whole_text"),
        text.trimmed_number(sign * F.col("impressions") / 8, 2).alias("number_text"),
        text.trimmed_money(sign * F.col("impressions") / 8).alias("money_text"),
        text.trimmed_percent(sign * F.expr("clicks / nullif(impressions, 0)") / 8).alias("percent_text"),
        text.trimmed_ratio((F.col("purchases") * F.lit(75.0) - spend) / F.nullif(spend, F.lit(0.0))).alias("ratio_text"),
    )


@query
def overview_totals(spark, sf_dir):
    return rollups.overview_totals(fixtures.ads(spark, sf_dir), A)


@query
def funnel_stages(spark, sf_dir):
    return rollups.funnel_stages(fixtures.ads(spark, sf_dir))


@query
def funnel_conversion(spark, sf_dir):
    return rollups.funnel_conversion(fixtures.ads(spark, sf_dir))


@query
def campaign_rollup(spark, sf_dir):
    return rollups.campaign_rollup(fixtures.ads(spark, sf_dir), A)


@query
def audience_all_sets(spark, sf_dir):
    return rollups.audience_all_sets(fixtures.ads(spark, sf_dir), A)


def _audience(view: str) -> Query:
    def run(spark, sf_dir):
        keys, _ = rollups.AUDIENCE_VIEWS[view]
        rows = rollups.audience(fixtures.ads(spark, sf_dir), view, A)
        return rows.drop(*[d for d in rollups.DIMENSIONS if d not in keys])

    return run


_found["audience_by_age"] = _audience("age")
_found["audience_by_gender"] = _audience("gender")
_found["audience_by_interest"] = _audience("interest")
_found["audience_campaign_age"] = _audience("campaign_age")
_found["audience_campaign_gender"] = _audience("campaign_gender")


@query
def audience_kpis(spark, sf_dir):
    return rollups.audience_kpis(fixtures.ads(spark, sf_dir), A)


@query
def high_spend_low_conversion(spark, sf_dir):
    rows = rollups.high_spend_low_conversion(fixtures.ads(spark, sf_dir), A)
    return rows.select("group_value", "campaign_id", "age", "spend", "purchase_conversion_rate", "estimated_profit")


@query
def sensitivity(spark, sf_dir):
    return rollups.sensitivity(fixtures.ads(spark, sf_dir), A)


@query
def insight_overview(spark, sf_dir):
    return insights.overview_insights(fixtures.ads(spark, sf_dir), A)


@query
def insight_campaigns(spark, sf_dir):
    return insights.campaign_insights(fixtures.ads(spark, sf_dir), A)


@query
def insight_audiences(spark, sf_dir):
    return insights.audience_insights(fixtures.ads(spark, sf_dir), A)


@query
def insight_sensitivity(spark, sf_dir):
    return insights.sensitivity_insights(fixtures.ads(spark, sf_dir), A)


@query
def top_segments_profit(spark, sf_dir):
    rows = rollups.audience(fixtures.ads(spark, sf_dir), "interest", A)
    return rollups.top_segments_by_profit(rows).select("group_value", "spend", "estimated_profit")


@query
def top_interests_purchases(spark, sf_dir):
    rows = rollups.top_interests_by_purchases(fixtures.ads(spark, sf_dir), A)
    return rows.select("interest", "spend", "purchases")


# -- views


@query
def campaign_view(spark, sf_dir):
    rows = rollups.named_campaigns(fixtures.ads(spark, sf_dir), A)
    return views.campaign_view(rows, search="  campaign t", sort_by="cac", ascending=True)


@query
def campaign_view_totals(spark, sf_dir):
    rows = rollups.named_campaigns(fixtures.ads(spark, sf_dir), A)
    return views.campaign_view_totals(views.campaign_view(rows, search="9"))


@query
def campaign_export(spark, sf_dir):
    rows = rollups.named_campaigns(fixtures.ads(spark, sf_dir), A)
    return views.campaign_export(views.campaign_view(rows))


@query
def filter_options(spark, sf_dir):
    return views.filter_options(fixtures.ads(spark, sf_dir))


# -- features and split


@query
def conversion_target(spark, sf_dir):
    rows = fixtures.ads(spark, sf_dir)
    return rows.select("ad_id", features.conversion_target(rows).alias("converted"))


@query
def feature_table(spark, sf_dir):
    table = features.feature_table(fixtures.gapped(spark, sf_dir))
    return table.select("ad_id", *[F.col(f"f_{c}").alias(c) for c in features.FEATURES], "converted")


def _prepared(spark, sf_dir):
    table = features.feature_table(fixtures.gapped(spark, sf_dir))
    return table, _once(spark, sf_dir, "preparation", lambda: features.fit_preparation(table))


@query
def imputed_features(spark, sf_dir):
    return features.imputed_features(*_prepared(spark, sf_dir))


@query
def scaled_features(spark, sf_dir):
    scaled = features.scaled_features(*_prepared(spark, sf_dir))
    return scaled.select("ad_id", *[F.round(c, 8).alias(c) for c in features.NUMERIC_FEATURES])


@query
def one_hot_levels(spark, sf_dir):
    return features.one_hot_levels(*_prepared(spark, sf_dir))


def _split(spark, sf_dir):
    def make():
        return splits.with_split(features.feature_table(fixtures.ads(spark, sf_dir)))[0]

    return _once(spark, sf_dir, "split", make)


@query
def split_sizes(spark, sf_dir):
    table = _split(spark, sf_dir)
    return table.groupBy("split", "converted").agg(F.count("*").alias("n"))


@query
def class_distribution(spark, sf_dir):
    return splits.class_distribution(_split(spark, sf_dir))


# -- evaluation of a scored table


@query
def confusion_metrics(spark, sf_dir):
    return evaluation.confusion_metrics(_predicted(spark, sf_dir))


@query
def roc_auc(spark, sf_dir):
    return _rounded(evaluation.ranking_metrics(fixtures.scored(spark, sf_dir)).select("roc_auc"))


@query
def ranking_null_scores(spark, sf_dir):
    """A tenth of the ads has no score and ranks below all others."""
    scored = fixtures.scored(spark, sf_dir)
    gaps = F.when(F.col("ad_id") % 10 != 0, F.col("conversion_probability"))
    return _rounded(evaluation.ranking_metrics(scored.withColumn("conversion_probability", gaps)))


@query
def ranking_distinct_scores(spark, sf_dir):
    """A score for each ad, in whole numbers that no double tells apart."""
    scored = fixtures.scored(spark, sf_dir)
    own = F.lit(2**53 + 1) + F.col("ad_id") * 7919 % 1000003
    return _rounded(evaluation.ranking_metrics(scored.withColumn("own_score", own), score="own_score"))


@query
def average_precision(spark, sf_dir):
    rows = evaluation.ranking_metrics(fixtures.scored(spark, sf_dir))
    return _rounded(rows.select("average_precision"))


@query
def roc_curve(spark, sf_dir):
    return evaluation.roc_curve(fixtures.scored(spark, sf_dir))


@query
def pr_curve(spark, sf_dir):
    return evaluation.pr_curve(fixtures.scored(spark, sf_dir))


@query
def roc_curve_aligned(spark, sf_dir):
    return evaluation.aligned_roc_curves(
        {
            "first": evaluation.roc_curve(fixtures.scored(spark, sf_dir)),
            "second": evaluation.roc_curve(fixtures.rival(spark, sf_dir)),
        }
    )


@query
def threshold_sweep(spark, sf_dir):
    return thresholds.threshold_sweep(fixtures.scored(spark, sf_dir), A)


@query
def best_threshold(spark, sf_dir):
    return thresholds.best_threshold(thresholds.threshold_sweep(fixtures.scored(spark, sf_dir), A))


@query
def strategy_comparison(spark, sf_dir):
    # An integer key for the random baseline, so that SQL can draw the same rows.
    mixed = (F.col("ad_id") * 48271 + thresholds.RANDOM_SEED) % 2147483647
    return thresholds.strategy_comparison(fixtures.scored(spark, sf_dir), A, random_key=mixed)


# -- budget advice


@query
def segment_metrics(spark, sf_dir):
    rows = advice.segment_metrics(
        fixtures.scored(spark, sf_dir), A, _baseline(spark, sf_dir).rows
    )
    return rows.select("ad_id", "actual_purchases", "ctr", "cpc", "cac", "purchase_conversion_rate",
                       "estimated_revenue", "estimated_profit")


@query
def segment_medians(spark, sf_dir):
    baseline = advice.segment_baseline(fixtures.scored(spark, sf_dir))
    row = (baseline.rows, baseline.cac, baseline.spend, baseline.purchase_conversion_rate)
    return spark.createDataFrame(
        [row], "n bigint, cac double, spend double, purchase_conversion_rate double"
    )


def _segments(spark, sf_dir, request: Request = REQUEST) -> DataFrame:
    return advice.segments(_predicted(spark, sf_dir), request, _baseline(spark, sf_dir))


@query
def recommendations(spark, sf_dir):
    return _segments(spark, sf_dir).drop("recommendation_reason")


@query
def recommendation_reason(spark, sf_dir):
    return _segments(spark, sf_dir).select("ad_id", "recommendation", "recommendation_reason")


FILTERED = Request(filters=Filters(campaign="936", gender="m", age="", interest=None))


@query
def recommendations_filtered(spark, sf_dir):
    return _segments(spark, sf_dir, FILTERED).select("ad_id", "campaign_id", "gender", "recommendation")


def _cube(spark, sf_dir) -> DataFrame:
    return advice.advice_cube(fixtures.scored(spark, sf_dir), REQUEST, _baseline(spark, sf_dir))


@query
def recommendation_counts(spark, sf_dir):
    return advice.recommendation_counts(_cube(spark, sf_dir), FILTERED.filters)


@query
def recommendation_nonzero(spark, sf_dir):
    strict = Request(threshold=1.0)
    cube = advice.advice_cube(fixtures.scored(spark, sf_dir), strict, _baseline(spark, sf_dir))
    return advice.nonzero_counts(advice.recommendation_counts(cube))


@query
def recommendation_view(spark, sf_dir):
    rows = views.recommendation_view(_segments(spark, sf_dir), search="30-3", sort_by="cac")
    return rows.select("ad_id", "campaign_name", "age", "gender", "interest", "cac", "recommendation")


@query
def inefficient_spend(spark, sf_dir):
    return advice.inefficient_spend(_cube(spark, sf_dir))


@query
def executive_summary(spark, sf_dir):
    return advice.executive_summary(fixtures.scored(spark, sf_dir), REQUEST, _baseline(spark, sf_dir))


@query
def executive_summary_filtered(spark, sf_dir):
    return advice.executive_summary(fixtures.scored(spark, sf_dir), FILTERED, _baseline(spark, sf_dir))


@query
def top5_segments(spark, sf_dir):
    rows = advice.top_segments(_segments(spark, sf_dir))
    return rows.select("ad_id", "campaign_id", "spend", "estimated_profit", "recommendation")


@query
def findings(spark, sf_dir):
    return advice.findings(fixtures.scored(spark, sf_dir), REQUEST, _baseline(spark, sf_dir))


# -- reports


@query
def executive_report(spark, sf_dir):
    return reports.executive_report(_predicted(spark, sf_dir), REQUEST, _baseline(spark, sf_dir))


@query
def report_campaign_summary(spark, sf_dir):
    return reports.campaign_summary(fixtures.ads(spark, sf_dir), A)


@query
def report_recommendations(spark, sf_dir):
    rows = reports.recommendations(_predicted(spark, sf_dir), REQUEST, _baseline(spark, sf_dir))
    return rows.drop("recommendation_reason")


# -- fitted models (no SQL counterpart)


def _trained(spark, sf_dir) -> training.TrainingResult:
    return _once(
        spark, sf_dir, "trained", lambda: training.train_and_compare(fixtures.ads(spark, sf_dir))
    )


@query
def leaderboard(spark, sf_dir):
    return _trained(spark, sf_dir).leaderboard()


@query
def report_model_metrics(spark, sf_dir):
    return reports.model_metrics(_trained(spark, sf_dir).leaderboard())


@query
def feature_importance(spark, sf_dir):
    trained = _trained(spark, sf_dir)
    return training.feature_importance(trained.selected.model, fixtures.ads(spark, sf_dir))


@query
def predictions(spark, sf_dir):
    return training.predictions(_trained(spark, sf_dir).selected.model, fixtures.ads(spark, sf_dir))


@query
def model_threshold_sweep(spark, sf_dir):
    return thresholds.threshold_sweep(_trained(spark, sf_dir).selected.scored_test, A)


# -- what must hold whatever the fitted models are


@query
def predictions_totals(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    p = F.col("conversion_probability")
    return rows.agg(
        F.count("*").alias("n"),
        F.sum("actual_converted").alias("converted"),
        F.count_if(p.between(0, 1)).alias("in_range"),
        F.count_if((p > 0.5).cast("int") == F.col("predicted_class")).alias("agreed"),
    )


@query
def logistic_gradient(spark, sf_dir):
    """The rows and weight that the logistic fit was made on, and the components of its gradient that are not zero."""
    # the same split, inputs and fit as in `_trained`, without the forest, which has no part in it
    trained = _once(
        spark,
        sf_dir,
        "logistic",
        lambda: training.train_and_compare(fixtures.ads(spark, sf_dir), models=(training.LOGISTIC,)),
    )
    model = trained.selected.model
    return training.logistic_gradient(model, trained.split.filter("split = 'train'")).agg(
        F.max("n_rows").alias("n_rows"),
        F.round(F.max("total_weight")).cast("long").alias("total_weight"),
        F.count_if(F.abs("gradient") >= 1e-6).alias("open_components"),
    )


@query
def leaderboard_totals(spark, sf_dir):
    counts = F.col("true_negatives") + F.col("false_positives") + F.col("false_negatives") + F.col("true_positives")
    return leaderboard(spark, sf_dir).select(
        "model_name", counts.alias("tested"), (F.col("true_positives") + F.col("false_negatives")).alias("positives")
    )


@query
def model_sweep_totals(spark, sf_dir):
    counts = F.col("true_negatives") + F.col("false_positives") + F.col("false_negatives") + F.col("true_positives")
    return model_threshold_sweep(spark, sf_dir).select(
        "threshold", counts.alias("tested"), (F.col("true_positives") + F.col("false_negatives")).alias("positives")
    )
