"""Ad tables from CSV, read as text so that the quality gate sees what the file says."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adfathom.schema import COLUMNS, HEADER_ALIASES, EngineError, NotFound
from adfathom.sources.files import path_exists
from adfathom.staging import staging_path

# Cell texts that mean "no value".
NA_WORDS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

_RECORD = "_record"


@dataclass(frozen=True)
class RawTable:
    """Text rows under the file's own header; `rows` is None when the file holds nothing."""

    header: list[str]
    rows: DataFrame | None


def _words(name: str) -> tuple[str, ...]:
    return tuple(re.findall("[a-z0-9]+", name.lower()))


#: Canonical columns by the words of every name that means them.
_MEANINGS = {_words(name): target for name, target in [*HEADER_ALIASES.items(), *zip(COLUMNS, COLUMNS)]}


def column_map(header: list[str]) -> tuple[dict[int, str], list[str], list[str]]:
    """Which header position means which canonical column, what is missing, what is doubled.

    A name is told by its words, runs of ASCII letters and digits in any case, whatever stands between them.
    An exact repeat of a header text counts as another name and so means nothing, while two
    different spellings of one column are a conflict.
    """
    found: dict[str, list[int]] = {}
    for place, name in enumerate(header):
        if name in header[:place]:
            continue
        target = _MEANINGS.get(_words(name))
        if target:
            found.setdefault(target, []).append(place)
    missing = [c for c in COLUMNS if c not in found]
    doubled = sorted(c for c, places in found.items() if len(places) > 1)
    return {places[0]: c for c, places in found.items()}, missing, doubled


def read_csv(spark: SparkSession, path: str) -> RawTable:
    """Scan a CSV file or folder of CSV files that share one header; other headers end the read.

    Blank lines are skipped, short rows are filled with nulls, and the words of `NA_WORDS`
    become null. Quoted cells may hold line breaks, so whether a line ends a record is only known from
    the file's start: each file is read by one task, and large tables come as folders of files.
    """
    if not path_exists(spark, path):
        raise NotFound(f"Dataset file was not found at {path}.")
    first = spark.read.text(path).filter(F.trim("value") != "").head()
    if first is None:
        return RawTable([], None)
    header = next(csv.reader([first["value"].lstrip("﻿")]))
    names = [f"c{i}" for i in range(len(header))]
    # Spark compares each file's header with the schema; texts that repeat cannot be column names
    plain = len({h.lower() for h in header}) == len(header) and all(header) and _RECORD not in header
    schema = T.StructType([T.StructField(h, T.StringType()) for h in (header if plain else names)])
    rows = (
        spark.read.schema(schema.add(_RECORD, T.StringType()))
        .option("header", True)
        .option("enforceSchema", not plain)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _RECORD)
        .option("columnPruning", False)
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
        .toDF(*names, _RECORD)
    )
    # a line of blanks is kept as a record with too few fields
    something = F.coalesce(F.col("c0").rlike(r"\S"), F.lit(False)) | F.coalesce(F.col(_RECORD).rlike(r"\S"), F.lit(True))
    rows = rows.where(something)
    rows = rows.withColumns({c: F.when(~F.col(c).isin(NA_WORDS), F.col(c)) for c in names})
    return RawTable(header, rows)


def read_csv_text(spark: SparkSession, content: str | bytes) -> RawTable:
    """An uploaded text: landed as a file, then scanned like any other."""
    text = content.decode("utf-8") if isinstance(content, bytes) else content
    if not text or not text.strip():
        return RawTable([], None)
    path = staging_path(spark, "upload")
    landed = spark.createDataFrame([(text.lstrip(),)], "value string").coalesce(1)
    landed.write.text(path)
    return read_csv(spark, path)


def raw_table(df: DataFrame) -> RawTable:
    """Any DataFrame as a raw table: every column as text under its own header."""
    cells = []
    for i, field in enumerate(df.schema):
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            cell = F.when(~F.isnan(cell), cell)  # a missing number
        cells.append(cell.cast("string").alias(f"c{i}"))
    return RawTable(df.columns, df.select(*cells))


def _complete(raw: RawTable, value: Column) -> Column:
    """`value`, or an error raised while the table is read if the row has too many fields."""
    if _RECORD not in raw.rows.columns:
        return value
    message = F.lit(f"CSV could not be parsed: a row has more than {len(raw.header)} fields.")
    # a record is kept where its number of fields is not the header's; quoted commas part no fields
    fields = F.size(F.split(F.regexp_replace(_RECORD, r'"([^"]|"")*"', ""), ",", -1))
    return F.when(F.col(_RECORD).isNotNull() & (fields > len(raw.header)), F.raise_error(message)).otherwise(value)


def row_count(raw: RawTable) -> int:
    # a query of the kept records alone is not allowed, so a cell is counted as well
    counted = raw.rows.agg(F.sum(_complete(raw, F.lit(1))).alias("n"), F.count("c0").alias("cells"))
    return counted.head()["n"] or 0


def canonical_text(raw: RawTable) -> DataFrame:
    """The eleven canonical columns as text, in order; other columns are dropped."""
    places, missing, doubled = column_map(raw.header)
    if missing or doubled:
        raise EngineError("The header does not map to the canonical columns.")
    by_target = {target: place for place, target in places.items()}
    columns = {c: F.col(f"c{by_target[c]}") for c in COLUMNS}
    columns["ad_id"] = _complete(raw, columns["ad_id"])
    return raw.rows.select(*[value.alias(c) for c, value in columns.items()])
