"""Datasets and reports below one folder: load, gate, store, look up."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adfathom.operators import quality
from adfathom.schema import CANONICAL_SCHEMA, EngineError, NotFound, ValidationFailed
from adfathom.sources.csv_scan import (
    RawTable,
    canonical_text,
    column_map,
    raw_table,
    read_csv,
    read_csv_text,
    row_count,
)
from adfathom.sources.files import path_exists
from adfathom.staging import dealt, stage

# Fixed value: how many rows a preview shows.
PREVIEW_ROWS = 20


@dataclass(frozen=True)
class Validation:
    """A gated table: typed rows (None when the file could not be mapped) and a one-row report."""

    table: DataFrame | None
    report: DataFrame

    def summary(self) -> dict:
        return self.report.head().asDict(recursive=True)


def validate(spark: SparkSession, raw: RawTable, *, must_be_ready: bool = True) -> Validation:
    """Run the gate. The distinct rows are written once and feed the report and the table."""
    result = _validate(spark, raw)
    if must_be_ready:
        report = result.summary()
        if not report["ready_for_analysis"]:
            raise ValidationFailed("Dataset failed validation.", report)
    return result


def _validate(spark: SparkSession, raw: RawTable) -> Validation:
    if raw.rows is None:
        return Validation(None, quality.structural_report(spark, [quality.EMPTY_FILE]))
    width = len(raw.header)
    _, missing, doubled = column_map(raw.header)
    try:
        if raw.rows.isEmpty():
            return Validation(None, quality.structural_report(spark, [quality.NO_ROWS], 0, width))
        if missing or doubled:
            warnings = []
            if missing:
                warnings.append(f"Missing required columns: {', '.join(missing)}.")
            if doubled:
                warnings.append(
                    "Multiple source columns map to the same internal columns: "
                    f"{', '.join(doubled)}."
                )
            return Validation(
                None, quality.structural_report(spark, warnings, row_count(raw), width)
            )
        distinct = quality.distinct_rows(quality.normalised(canonical_text(raw)))
        distinct = stage(dealt(distinct), "distinct-rows")
        report = spark.createDataFrame(
            quality.quality_report(distinct).collect(), quality.REPORT_SCHEMA
        )
    except (PySparkException, Py4JJavaError) as problem:
        if "USER_RAISED_EXCEPTION" in str(problem):
            raise ValidationFailed(
                f"CSV could not be parsed: a row has more than {width} fields."
            ) from problem
        if "CSV header does not conform" in str(problem):
            raise ValidationFailed("CSV could not be parsed: the files have different headers.") from problem
        raise
    return Validation(quality.typed_rows(distinct), report)


def validate_csv_path(spark: SparkSession, path: str, *, must_be_ready: bool = True) -> Validation:
    return validate(spark, read_csv(spark, path), must_be_ready=must_be_ready)


def validate_csv_text(spark: SparkSession, content: str | bytes, *, must_be_ready: bool = True) -> Validation:
    return validate(spark, read_csv_text(spark, content), must_be_ready=must_be_ready)


def validate_dataframe(df: DataFrame, *, must_be_ready: bool = True) -> Validation:
    return validate(df.sparkSession, raw_table(df), must_be_ready=must_be_ready)


def preview(table: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows by ad_id."""
    return table.orderBy("ad_id").limit(limit)


class DatasetStore:
    """The current table, its report and the default file.

    A table passes the gate before it is stored, so reading it back needs no second check. Each is stored
    with its report in a folder of its own; a list of versions, written last, says which is current, so a job that
    fails on the way leaves the table before it in place.
    """

    def __init__(self, spark: SparkSession, folder: str, default_csv: str) -> None:
        self.spark = spark
        self.default_csv = default_csv
        self.folder = folder.rstrip("/")
        self.versions_path = f"{self.folder}/versions"

    # -- storing

    def version(self) -> str | None:
        """The name of the current table, which changes whenever one is stored."""
        if not path_exists(self.spark, self.versions_path):
            return None
        return self.spark.read.text(self.versions_path).agg(F.max("value").alias("value")).head()["value"]

    def _table_path(self, version: str) -> str:
        return f"{self.folder}/tables/{version}/rows"

    def _report_path(self, version: str) -> str:
        return f"{self.folder}/tables/{version}/report"

    def load_default(self) -> Validation:
        return self._store(validate_csv_path(self.spark, self.default_csv))

    def store_csv(self, path: str) -> Validation:
        """Gate and store a CSV file; anything but a .csv name is refused."""
        if not path.lower().endswith(".csv"):
            raise ValidationFailed("Only CSV files can be uploaded.")
        return self.store_path(path)

    def store_path(self, path: str) -> Validation:
        """Gate and store CSV data of any name, such as a folder of files sharing one header."""
        return self._store(validate_csv_path(self.spark, path))

    def store_text(self, content: str | bytes) -> Validation:
        return self._store(validate_csv_text(self.spark, content))

    def _store(self, result: Validation) -> Validation:
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        result.table.write.parquet(self._table_path(version))
        self._write_report(result.report, version)
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("append").text(self.versions_path)
        return Validation(self.current(), result.report)

    def _write_report(self, report: DataFrame, version: str) -> None:
        report.coalesce(1).write.mode("overwrite").json(self._report_path(version))

    # -- reading

    def current(self) -> DataFrame:
        """The stored table, as it is."""
        version = self.version()
        if version is None:
            raise NotFound("No validated dataset is available. Upload a CSV or use the default dataset.")
        return self.spark.read.schema(CANONICAL_SCHEMA).parquet(self._table_path(version))

    def active(self) -> DataFrame:
        """The stored table, else the default file after the gate."""
        if self.version() is not None:
            return self.current()
        if path_exists(self.spark, self.default_csv):
            return validate_csv_path(self.spark, self.default_csv).table
        raise NotFound(
            "No validated dataset is available. Upload a CSV or add the default dataset."
        )

    def saved_report(self) -> DataFrame | None:
        version = self.version()
        if version is None or not path_exists(self.spark, self._report_path(version)):
            return None
        return self.spark.read.schema(quality.REPORT_SCHEMA).json(self._report_path(version))

    def latest_report(self) -> DataFrame:
        """The saved report, else one made from the current table (and saved), else from the
        default file.
        """
        saved = self.saved_report()
        if saved is not None:
            return saved
        version = self.version()
        if version is not None:
            report = validate_dataframe(self.current(), must_be_ready=False).report
            self._write_report(report, version)
            return report
        if path_exists(self.spark, self.default_csv):
            return validate_csv_path(self.spark, self.default_csv, must_be_ready=False).report
        raise NotFound(
            "No data-quality report is available because no dataset has been loaded."
        )

    def preview(self, limit: int = PREVIEW_ROWS) -> tuple[DataFrame, int]:
        table = self.current()
        return preview(table, limit), table.count()

    def status(self) -> dict:
        """Which datasets exist and pass, with the report of the first that has one."""
        default_exists = path_exists(self.spark, self.default_csv)
        current_exists = self.version() is not None
        default = current = None
        if default_exists:
            default = self._summary(lambda: validate_csv_path(self.spark, self.default_csv, must_be_ready=False).report)
        if current_exists:
            current = self._summary(self.latest_report)  # the one saved with the table
        latest = current or default
        warnings = list(latest["warnings"]) if latest else []
        if not default_exists:
            warnings.append("Default dataset file is missing.")
        return {
            "default_dataset_exists": default_exists,
            "default_dataset_valid": bool(default and default["ready_for_analysis"]),
            "current_dataset_exists": current_exists,
            "current_dataset_valid": bool(current and current["ready_for_analysis"]),
            "latest_report": latest,
            "warnings": warnings,
        }

    @staticmethod
    def _summary(report) -> dict | None:
        try:
            return report().head().asDict(recursive=True)
        except EngineError:
            return None


def report_json(report: DataFrame) -> str:
    """The one-row report as a JSON document."""
    row = report.select(F.to_json(F.struct("*")).alias("value")).head()
    return json.dumps(json.loads(row["value"]), indent=2)


