"""The quality gate: normalise, remove copies, count what is wrong, decide.

The order matters: cells are cleaned first, exact copies go next, and everything is counted on
what remains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adfathom.schema import CANONICAL_SCHEMA, COLUMNS, INTEGER_COLUMNS, MEASURES, NUMERIC_COLUMNS, TEXT_COLUMNS

# What counts as a number: sign, digits with an optional point, optional exponent.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# The characters trimmed off a cell, as a SQL literal.
WHITE_SPACE = r"' \t\n\r\u000b\u000c'"
# A measure of this size or more is no number that sums could hold.
LARGEST_MEASURE = 1e12
# Whole doubles below this are exact, so their text needs no decimals.
EXACT_DOUBLE = 1e15

MAPS = ["missing_values_by_column", "invalid_numeric_values", "negative_values"]
REPORT_SCHEMA = T.StructType(
    [
        T.StructField("row_count", T.LongType()),
        T.StructField("column_count", T.IntegerType()),
        T.StructField("duplicate_count", T.LongType()),
        *[T.StructField(m, T.MapType(T.StringType(), T.LongType())) for m in MAPS],
        T.StructField("clicks_greater_than_impressions", T.LongType()),
        T.StructField("purchases_greater_than_leads", T.LongType()),
        T.StructField("ready_for_analysis", T.BooleanType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
    ]
)

NO_ROWS = "CSV file contains no data rows."
EMPTY_FILE = "CSV file is empty."
PASSED = "Dataset passed validation and is ready for analysis."


def _number(cell: str) -> str:
    value = f"try_cast({cell} AS DOUBLE)"
    return f"""coalesce(CAST(try_cast({cell} AS BIGINT) AS DOUBLE),
                     CASE WHEN {cell} RLIKE r'{NUMBER}' AND abs({value}) < DOUBLE('Infinity')
                          THEN {value} END)"""


def number(cell: str) -> Column:
    """The finite double the text column `cell` spells, else null.

    Whole numbers, the usual case, need no pattern. Other text is matched first, as a plain cast
    would also take spellings such as 1d.
    """
    return F.expr(_number(cell))


def whole(cell: str) -> Column:
    """The long the text column `cell` spells without passing through a double, else null."""
    return F.expr(f"try_cast({cell} AS BIGINT)")


def _one_spelling(c: str) -> Column:
    """The one text of a number; other text as it is. Whole numbers lose sign, zeros, decimals."""
    value = f"value_{c}"
    return F.expr(
        f"""coalesce(CAST(whole_{c} AS STRING),
                     CASE WHEN abs({value}) < {EXACT_DOUBLE!r}D AND {value} = floor({value})
                          THEN CAST(CAST({value} AS BIGINT) AS STRING) END,
                     CAST({value} AS STRING),
                     CASE WHEN bare_{c} IS NOT NULL THEN {c} END)"""
    )


def normalised(text_rows: DataFrame) -> DataFrame:
    """Blank cells become null, the text dimensions are trimmed, numbers get one spelling.

    One spelling means that 1, 1.0 and `` 1`` are the same cell; text that is no number stays as
    it is. Each step is a projection of its own, so no cell is parsed twice.
    """
    bare = text_rows.withColumns(
        {
            (c if c in TEXT_COLUMNS else f"bare_{c}"): F.expr(f"nullif(btrim({c}, {WHITE_SPACE}), '')")
            for c in COLUMNS
        }
    )
    wholes = bare.withColumns({f"whole_{c}": whole(f"bare_{c}") for c in NUMERIC_COLUMNS})
    parsed = wholes.withColumns({f"value_{c}": number(f"bare_{c}") for c in NUMERIC_COLUMNS})
    return parsed.select(
        *[F.col(c) if c in TEXT_COLUMNS else _one_spelling(c).alias(c) for c in COLUMNS]
    )


def distinct_rows(rows: DataFrame) -> DataFrame:
    """Each different row once, with how often it came (`copies`); nulls equal nulls.

    Copies are added up before the shuffle, so a row that makes up a third of the input
    travels once per task.
    """
    return rows.groupBy(*COLUMNS).agg(F.count("*").alias("copies"))


def dedupe_counts(rows: DataFrame) -> DataFrame:
    """Rows before and after, and the difference, as one row."""
    counted = distinct_rows(rows).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_before"), F.count("*").alias("rows_after")
    )
    return counted.withColumn("duplicate_count", F.col("rows_before") - F.col("rows_after"))


def _with_values(distinct: DataFrame) -> DataFrame:
    """Add ``value_<c>``, each numeric cell parsed once, for the rules to look at."""
    return distinct.withColumns({f"value_{c}": number(c) for c in NUMERIC_COLUMNS})


def _rules() -> dict[str, str]:
    """Every rule a row can break, by name, as a condition that is never null."""
    rules = {f"missing:{c}": f"{c} IS NULL" for c in COLUMNS}
    rules |= {f"invalid:{c}": f"{c} IS NOT NULL AND value_{c} IS NULL" for c in NUMERIC_COLUMNS}
    for c in MEASURES:
        rules[f"invalid:{c}"] += f" OR coalesce(abs(value_{c}) >= {LARGEST_MEASURE!r}D, false)"
    rules |= {f"negative:{c}": f"coalesce(value_{c} < 0, false)" for c in NUMERIC_COLUMNS}
    for larger, smaller in (("clicks", "impressions"), ("purchases", "leads")):
        rules[f"{larger}>{smaller}"] = f"coalesce(value_{larger} > value_{smaller}, false)"
    return rules


def _counter(rule: str) -> str:
    """The column that counts a rule."""
    return rule.replace(":", "_").replace(">", "_greater_than_")


def quality_counts(distinct: DataFrame) -> DataFrame:
    """All counters in one pass, one row: missing_<c>, invalid_<c>, negative_<c> and the rest."""
    return _with_values(distinct).agg(
        F.count("*").alias("row_count"),
        (F.coalesce(F.sum("copies"), F.lit(0)) - F.count("*")).alias("duplicate_count"),
        *[F.expr(f"count_if({test}) AS {_counter(rule)}") for rule, test in _rules().items()],
    )


def _counter_map(prefix: str, columns: list[str]) -> Column:
    return F.expr("map(" + ", ".join(f"'{c}', {prefix}_{c}" for c in columns) + ")")


def _affected(prefix: str, columns: list[str]) -> Column:
    """Names of the columns whose counter is above zero, in schema order, joined by commas."""
    names = ", ".join(f"CASE WHEN {prefix}_{c} > 0 THEN '{c}' END" for c in columns)
    return F.expr(f"concat_ws(', ', {names})")


def _warnings() -> Column:
    def naming(text: str, prefix: str, columns: list[str]) -> Column:
        names = _affected(prefix, columns)
        return F.when(names != "", F.concat(F.lit(text), names, F.lit(".")))

    def counting(column: str, before: str, after: str) -> Column:
        n = F.col(column)
        return F.when(n > 0, F.concat(F.lit(before), n.cast("string"), F.lit(after)))

    fired = F.filter(
        F.array(
            F.when(F.col("row_count") == 0, NO_ROWS),
            counting("duplicate_count", "Removed ", " exact duplicate row(s)."),
            naming("Missing values were found in: ", "missing", COLUMNS),
            naming("Invalid numeric values were found in: ", "invalid", NUMERIC_COLUMNS),
            naming("Negative values were found in: ", "negative", NUMERIC_COLUMNS),
            counting(
                "clicks_greater_than_impressions", "", " row(s) have clicks greater than impressions."
            ),
            counting("purchases_greater_than_leads", "", " row(s) have purchases greater than leads."),
        ),
        lambda text: text.isNotNull(),
    )
    return F.when(F.size(fired) > 0, fired).otherwise(F.array(F.lit(PASSED)))


def quality_report(distinct: DataFrame) -> DataFrame:
    """The report of a table, one row. Copies alone do not make a table unready."""
    counts = quality_counts(distinct)
    clean = " AND ".join(["row_count > 0", *[f"{_counter(rule)} = 0" for rule in _rules()]])
    return counts.select(
        "row_count",
        F.lit(len(COLUMNS)).alias("column_count"),
        "duplicate_count",
        _counter_map("missing", COLUMNS).alias(MAPS[0]),
        _counter_map("invalid", NUMERIC_COLUMNS).alias(MAPS[1]),
        _counter_map("negative", NUMERIC_COLUMNS).alias(MAPS[2]),
        "clicks_greater_than_impressions",
        "purchases_greater_than_leads",
        F.expr(clean).alias("ready_for_analysis"),
        _warnings().alias("warnings"),
    )


def structural_report(spark: SparkSession, warnings: list[str], rows: int = 0, columns: int = 0) -> DataFrame:
    """The report of a file that cannot be counted: all counters zero, never ready."""
    maps = [dict.fromkeys(COLUMNS, 0), dict.fromkeys(NUMERIC_COLUMNS, 0), dict.fromkeys(NUMERIC_COLUMNS, 0)]
    return spark.createDataFrame([(rows, columns, 0, *maps, 0, 0, False, warnings)], REPORT_SCHEMA)


def quality_warnings(report: DataFrame) -> DataFrame:
    """The report's messages as rows (line, text)."""
    listed = report.select(F.posexplode("warnings").alias("line", "text"))
    return listed.select((F.col("line") + 1).alias("line"), "text")


def issue_counts(report: DataFrame) -> DataFrame:
    """The per-column counters above zero: kind, column_name, n."""
    parts = F.array(*[F.struct(F.lit(m).alias("kind"), F.col(m).alias("counters")) for m in MAPS])
    rows = report.select(F.inline(parts)).select("kind", F.explode("counters").alias("column_name", "n"))
    return rows.filter(F.col("n") > 0)


def issue_totals(report: DataFrame) -> DataFrame:
    """The sum of each kind's counters, zero included: kind, total."""
    parts = F.array(*[F.struct(F.lit(m).alias("kind"), F.col(m).alias("counters")) for m in MAPS])
    rows = report.select(F.inline(parts)).select("kind", F.explode("counters").alias("column_name", "n"))
    return rows.groupBy("kind").agg(F.sum("n").alias("total"))


def quarantine_rows(distinct: DataFrame) -> DataFrame:
    """The rows that keep a table from being ready, each with the rules it breaks."""
    listed = ", ".join(f"CASE WHEN {test.replace('value_', 'v.value_')} THEN '{rule}' END" for rule, test in _rules().items())
    # The cells are parsed into one struct that all rules look at: a filter on columns of their own would go below
    # them and parse a cell again for each rule.
    values = ", ".join(f"{_number(c)} AS value_{c}" for c in NUMERIC_COLUMNS)
    broken = F.expr(f"transform(array(struct({values})), v -> array_compact(array({listed})))[0]")
    # Naming `copies` keeps this filter above the grouping; below it, every rule would be spelled
    # out over the raw cells.
    some = "CASE WHEN size(broken_rules) > 0 THEN copies ELSE 0 END > 0"
    return distinct.withColumn("broken_rules", broken).filter(some)


def typed_rows(distinct: DataFrame) -> DataFrame:
    """The canonical table. Fractions in whole-number columns are cut off toward zero."""
    columns = []
    for c in CANONICAL_SCHEMA.fieldNames():
        if c in INTEGER_COLUMNS:
            value = F.coalesce(whole(c), F.col(f"value_{c}").try_cast("bigint"))
        elif c in NUMERIC_COLUMNS:
            value = F.col(f"value_{c}")
        else:
            value = F.col(c)
        columns.append(value.alias(c))
    return _with_values(distinct).select(*columns)
