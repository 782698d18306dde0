"""KPI ratios and financial estimates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfathom.schema import MEASURES, MONEY, Assumptions

SUMMARY_COLUMNS = [
    *MEASURES,
    "ctr",
    "cpc",
    "lead_conversion_rate",
    "purchase_conversion_rate",
    "cost_per_lead",
    "cac",
    "estimated_revenue",
    "estimated_variable_cost",
    "estimated_total_cost",
    "estimated_profit",
    "estimated_roas",
    "estimated_romi",
]


def _double(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def safe_divide(numerator: str, denominator: str) -> Column:
    """A double quotient of two SQL expressions; null when the denominator is zero or either
    side is null.
    """
    return F.expr(f"try_divide(CAST({numerator} AS DOUBLE), CAST({denominator} AS DOUBLE))")


def ctr(clicks: str = "clicks", impressions: str = "impressions") -> Column:
    return safe_divide(clicks, impressions)


def cpc(spend: str = "spend", clicks: str = "clicks") -> Column:
    return safe_divide(spend, clicks)


def lead_conversion_rate(leads: str = "leads", clicks: str = "clicks") -> Column:
    return safe_divide(leads, clicks)


def purchase_conversion_rate(purchases: str = "purchases", clicks: str = "clicks") -> Column:
    return safe_divide(purchases, clicks)


def cost_per_lead(spend: str = "spend", leads: str = "leads") -> Column:
    return safe_divide(spend, leads)


def cac(spend: str = "spend", purchases: str = "purchases") -> Column:
    return safe_divide(spend, purchases)


def ratios() -> dict[str, Column]:
    return {
        "ctr": ctr(),
        "cpc": cpc(),
        "lead_conversion_rate": lead_conversion_rate(),
        "purchase_conversion_rate": purchase_conversion_rate(),
        "cost_per_lead": cost_per_lead(),
        "cac": cac(),
    }


def financials(
    a: Assumptions,
    purchases: str = "purchases",
    spend: str = "spend",
    order_value: str | None = None,
) -> dict[str, Column]:
    """Revenue, costs, profit, ROAS and ROMI, with the whole fixed cost charged to the row.

    `order_value` names a column that replaces the assumed average order value, for scenario
    rows.
    """
    p, s = f"CAST({purchases} AS DOUBLE)", f"CAST({spend} AS DOUBLE)"
    revenue = f"({p} * {order_value or _double(a.average_order_value)})"
    variable = f"({p} * {_double(a.variable_cost)})"
    total = f"({s} + {variable} + {_double(a.fixed_campaign_operating_cost)})"
    profit = f"({revenue} - {total})"
    return {
        "estimated_revenue": F.expr(revenue),
        "estimated_variable_cost": F.expr(variable),
        "estimated_total_cost": F.expr(total),
        "estimated_profit": F.expr(profit),
        "estimated_roas": F.expr(f"try_divide({revenue}, {s})"),
        "estimated_romi": F.expr(f"try_divide({profit}, {total})"),
    }


def money_sum(value: Column | str) -> Column:
    """An order-independent sum of a money column, returned as a double."""
    if isinstance(value, str):
        return F.expr(f"CAST(sum(CAST({value} AS {MONEY})) AS DOUBLE)")
    return F.sum(value.cast(MONEY)).cast("double")


def measure_sums() -> list[Column]:
    plain = [F.expr(f"CAST(sum({m}) AS DOUBLE) AS {m}") for m in MEASURES if m != "spend"]
    return [*plain, money_sum("spend").alias("spend")]


def zero_when_empty(df: DataFrame) -> DataFrame:
    """Sums over no rows are zero, not null."""
    return df.fillna(0.0, subset=MEASURES)


def with_summary(totals: DataFrame, a: Assumptions) -> DataFrame:
    """Add the six ratios and six financials to a frame holding the five summed measures."""
    return totals.withColumns({**ratios(), **financials(a)})
