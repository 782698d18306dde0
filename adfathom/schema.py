"""The ad fact table and the parameters every plan shares."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import types as T

# Canonical columns, in the order every stored table keeps.
CANONICAL_SCHEMA = T.StructType(
    [
        T.StructField("ad_id", T.LongType()),
        T.StructField("campaign_id", T.LongType()),
        T.StructField("ad_set_id", T.LongType()),
        T.StructField("age", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("interest", T.LongType()),
        T.StructField("impressions", T.LongType()),
        T.StructField("clicks", T.LongType()),
        T.StructField("spend", T.DoubleType()),
        T.StructField("leads", T.LongType()),
        T.StructField("purchases", T.LongType()),
    ]
)
COLUMNS = CANONICAL_SCHEMA.fieldNames()
TEXT_COLUMNS = ["age", "gender"]
NUMERIC_COLUMNS = [c for c in COLUMNS if c not in TEXT_COLUMNS]
INTEGER_COLUMNS = [c for c in NUMERIC_COLUMNS if c != "spend"]

# Header spellings that mean a canonical column, besides its own name.
HEADER_ALIASES = {
    "xyz_campaign_id": "campaign_id",
    "fb_campaign_id": "ad_set_id",
    "spent": "spend",
    "total_conversion": "leads",
    "approved_conversion": "purchases",
}

MEASURES = ["impressions", "clicks", "leads", "purchases", "spend"]
# Grouping keys for which the report paths, unlike the analytics paths, drop nulls.
DIMENSIONS = ["campaign_id", "age", "gender", "interest"]

# Money is summed as a decimal, so a total does not depend on partition order.
MONEY = "decimal(28,6)"


@dataclass(frozen=True)
class Assumptions:
    """What-if financial inputs; all must be non-negative."""

    average_order_value: float = 75.0
    fulfilment_cost_per_purchase: float = 35.0
    transaction_cost_per_purchase: float = 2.0
    fixed_campaign_operating_cost: float = 0.0

    def __post_init__(self) -> None:
        for f in fields(self):
            value = float(getattr(self, f.name))
            if not 0 <= value < float("inf"):
                raise ValueError(f"{f.name} must be a finite number >= 0, got {value}")
            object.__setattr__(self, f.name, value)

    @property
    def variable_cost(self) -> float:
        return self.fulfilment_cost_per_purchase + self.transaction_cost_per_purchase

    def with_order_value(self, value: float) -> Assumptions:
        return replace(self, average_order_value=value)


DEFAULT_ASSUMPTIONS = Assumptions()


class EngineError(Exception):
    """Base of the errors a caller is expected to handle."""


class NotFound(EngineError):
    """A dataset, report or model that was asked for does not exist."""


class ValidationFailed(EngineError):
    """The quality gate refused a table; `report` holds the one-row report, if there is one."""

    def __init__(self, message: str, report=None) -> None:
        super().__init__(message)
        self.report = report
