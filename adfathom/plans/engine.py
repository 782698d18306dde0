"""The front door: one object per workspace folder, one method per question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adfathom.operators import advice, insights, rollups, thresholds, training
from adfathom.operators.advice import Filters, Request, resolve_threshold
from adfathom.plans import reports
from adfathom.schema import DEFAULT_ASSUMPTIONS, Assumptions
from adfathom.sources.datasets import DatasetStore
from adfathom.sources.sinks import write_csv
from adfathom.staging import stage


class Workspace:
    """Stored dataset, trained model and every analysis over them."""

    def __init__(self, spark: SparkSession, folder: str, default_csv: str | None = None) -> None:
        self.spark = spark
        root = folder.rstrip("/")
        self.datasets = DatasetStore(spark, f"{root}/data", default_csv or f"{root}/default.csv")
        self._kept: tuple[str, DataFrame] | None = None
        self.models = training.ModelStore(spark, f"{root}/models")

    # -- analytics

    @property
    def _cube(self) -> DataFrame:
        """The active table summed up by campaign, age, gender and interest, staged once a version.

        Every analytics question is a rollup of it, so the ads are read once per stored table. The default
        file, which may change at any time, is read again for each question.
        """
        version = self.datasets.version()
        if version is None:
            return stage(rollups.segment_cube(self.datasets.active()), "segment-cube")
        if self._kept is None or self._kept[0] != version:
            self._kept = version, stage(rollups.segment_cube(self.datasets.active()), "segment-cube")
        return self._kept[1]

    def overview(self, a: Assumptions = DEFAULT_ASSUMPTIONS) -> dict[str, DataFrame]:
        cube = self._cube
        return {
            "totals": rollups.overview_totals(cube, a),
            "funnel": rollups.funnel_stages(cube),
            "campaigns": rollups.campaign_rollup(cube, a),
            "observations": insights.overview_insights(cube, a),
        }

    def campaigns(self, a: Assumptions = DEFAULT_ASSUMPTIONS) -> dict[str, DataFrame]:
        cube = self._cube
        return {
            "campaigns": rollups.campaign_rollup(cube, a),
            "observations": insights.campaign_insights(cube, a),
        }

    def audiences(self, a: Assumptions = DEFAULT_ASSUMPTIONS) -> dict[str, DataFrame]:
        cube = self._cube
        views = {f"by_{v}": rollups.audience(cube, v, a) for v in rollups.AUDIENCE_VIEWS}
        return views | {
            "high_spend_low_conversion": rollups.high_spend_low_conversion(cube, a),
            "observations": insights.audience_insights(cube, a),
        }

    def sensitivity(self, a: Assumptions = DEFAULT_ASSUMPTIONS) -> dict[str, DataFrame]:
        cube = self._cube
        return {
            "scenarios": rollups.sensitivity(cube, a),
            "observations": insights.sensitivity_insights(cube, a),
        }

    # -- model

    def train(self, **options) -> training.TrainingResult:
        result = training.train_and_compare(self.datasets.current(), **options)
        self.models.save(result)
        return result

    def model_status(self) -> dict:
        return self.models.status()

    def feature_importance(self) -> DataFrame:
        return training.feature_importance(self.models.load(), self.datasets.current())

    def predictions(self) -> DataFrame:
        return training.predictions(self.models.load(), self.datasets.current())

    def threshold_analysis(self, a: Assumptions = DEFAULT_ASSUMPTIONS) -> dict[str, DataFrame]:
        """The back-test on the rows held out when the model was trained."""
        held_out = self.models.held_out()
        sweep = thresholds.threshold_sweep(held_out, a)
        best = thresholds.best_threshold(sweep)
        key = "ad_id" if "ad_id" in held_out.columns else "conversion_probability"
        return {
            "thresholds": sweep,
            "recommended": best,
            "strategies": thresholds.strategy_comparison(held_out, a, best=best.head(), row_key=key),
        }

    # -- advice and reports

    def _request(self, a: Assumptions, threshold: float | None, filters: Filters) -> Request:
        return Request(a, resolve_threshold(threshold, self.models.metadata()), filters)

    def recommendations(
        self,
        a: Assumptions = DEFAULT_ASSUMPTIONS,
        threshold: float | None = None,
        filters: Filters = advice.NO_FILTERS,
    ) -> dict[str, DataFrame]:
        """Scores the current table once; the parts share the written scores."""
        request = self._request(a, threshold, filters)
        scored = stage(training.score(self.models.load(), self.datasets.current()), "scored")
        baseline = advice.segment_baseline(scored)
        cube = stage(advice.advice_cube(scored, request, baseline), "advice-cube")
        return {
            "segments": advice.segments(scored, request, baseline),
            "executive_summary": advice.summary_from(cube, request, baseline),
            "findings": advice.findings_from(cube, request, baseline),
            "report": reports.executive_report(scored, request, baseline),
            "export": reports.recommendations(scored, request, baseline),
        }

    def export_campaign_summary(self, path: str, a: Assumptions = DEFAULT_ASSUMPTIONS) -> None:
        write_csv(reports.campaign_summary(self.datasets.current(), a), path)

    def export_recommendations(
        self, path: str, a: Assumptions = DEFAULT_ASSUMPTIONS, threshold: float | None = None
    ) -> None:
        write_csv(self.recommendations(a, threshold)["export"], path)

    def export_model_metrics(self, path: str) -> None:
        kept = self.models.metadata()
        if kept is None:
            raise training.NotFound("No trained model available. Train a model first.")
        row = [(kept["selected_model_name"], *[kept["evaluation_metrics"][m] for m in training.METRIC_COLUMNS])]
        schema = "model_name string, " + ", ".join(f"{m} double" for m in training.METRIC_COLUMNS)
        write_csv(self.spark.createDataFrame(row, schema), path)
