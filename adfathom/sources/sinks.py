"""Result tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(table: DataFrame, path: str) -> None:
    """CSV with a header; nulls are empty cells. One file per partition, written in parallel."""
    table.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)
