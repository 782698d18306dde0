"""Text forms of numbers, and the rounding that goes with them.

``format_number`` with a pattern rounds the exact binary value half to even, which is what the
printed reports need. The trimmed forms of the screens round half away from zero, on the shortest decimal
that stands for the number (1.005 becomes 1.01), and keep the sign of what rounds to zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "N/A"
#: What the trimmed forms show for null and NaN.
NOT_AVAILABLE = "n/a"


def _pattern(value: Column, pattern: str) -> Column:
    # format_number takes the pattern form only through SQL; the Python wrapper wants an int.
    return F.call_function("format_number", value, F.lit(pattern))


def fixed(value: Column, decimals: int, grouped: bool = False) -> Column:
    """`value` with exactly `decimals` digits after the point."""
    whole = "#,##0" if grouped else "0"
    return _pattern(value, whole + ("." + "0" * decimals if decimals else ""))


def rounded(value: Column, decimals: int) -> Column:
    """Round the exact binary value, half to even; null stays null."""
    return fixed(value, decimals).cast("double")


def finite(value: Column) -> Column:
    """Null for NaN and for either infinity."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def report_ratio(value: Column) -> Column:
    """A ratio as the exports show it: six decimals, null when there is none."""
    return rounded(finite(value), 6)


def plain_money(value: Column) -> Column:
    """``$1234.50``, no thousands separator."""
    return F.concat(F.lit("$"), fixed(value, 2))


def grouped_money(value: Column) -> Column:
    """``$1,234.50``; a minus sign follows the dollar sign."""
    return F.concat(F.lit("$"), fixed(value, 2, grouped=True))


def money(value: Column) -> Column:
    return F.coalesce(grouped_money(value), F.lit(MISSING))


def percent(value: Column, decimals: int = 1) -> Column:
    return F.coalesce(F.concat(fixed(value * F.lit(100.0), decimals), F.lit("%")), F.lit(MISSING))


def ratio(value: Column) -> Column:
    return F.coalesce(F.concat(fixed(value, 2), F.lit("x")), F.lit(MISSING))


def count_text(value: Column) -> Column:
    return F.coalesce(fixed(value.cast("double"), 0, grouped=True), F.lit(MISSING))


def _trimmed(value: Column, most: int, pattern: str, before: str = "", after: str = "") -> Column:
    value = value.cast("double")
    size = _pattern(F.round(F.abs(value), most), pattern)
    shown = F.concat(F.when(value < 0, "-").otherwise(""), F.lit(before), size, F.lit(after))
    return F.coalesce(F.when(~F.isnan(value), shown), F.lit(NOT_AVAILABLE))


def trimmed_number(value: Column, most: int = 0) -> Column:
    """At most `most` decimals and thousands separators."""
    return _trimmed(value, most, "#,##0" + ("." + "#" * most if most else ""))


def trimmed_money(value: Column) -> Column:
    """Two decimals; a minus sign stands before the dollar sign."""
    return _trimmed(value, 2, "#,##0.00", before="$")


def trimmed_percent(value: Column) -> Column:
    """Percent with at most two decimals and thousands separators."""
    return _trimmed(value * F.lit(100.0), 2, "#,##0.##", after="%")


def trimmed_ratio(value: Column) -> Column:
    return _trimmed(value, 2, "#,##0.##", after="x")


def whole_percent(value: Column) -> Column:
    return F.concat(fixed(value * F.lit(100.0), 0), F.lit("%"))


# Which of the text forms a named result column takes in a printed table.
MONEY_COLUMNS = {
    "spend",
    "cpc",
    "cost_per_lead",
    "cac",
    "estimated_revenue",
    "estimated_variable_cost",
    "estimated_total_cost",
    "estimated_profit",
}
PERCENT_COLUMNS = {
    "ctr",
    "lead_conversion_rate",
    "purchase_conversion_rate",
    "conversion_probability",
    "average_precision",
    "f1_score",
    "roc_auc",
    "accuracy",
    "precision",
    "recall",
}
RATIO_COLUMNS = {"estimated_roas", "estimated_romi"}


def format_table(df):
    """Replace every money, percent and ratio column of `df` by its text form."""
    forms = {}
    for name in df.columns:
        if name in MONEY_COLUMNS:
            forms[name] = money(F.col(name))
        elif name in PERCENT_COLUMNS:
            forms[name] = percent(F.col(name))
        elif name in RATIO_COLUMNS:
            forms[name] = ratio(F.col(name))
    return df.withColumns(forms)
