"""Display names of campaigns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfathom.operators.ordered import running_totals
from adfathom.functions.text import MISSING
from adfathom.staging import stage

# The labels, used in turn, and the campaigns that have a place without a list.
LABELS = [
    "Campaign One",
    "Campaign Two",
    "Campaign Three",
    "Campaign Four",
    "Campaign Five",
    "Campaign Six",
    "Campaign Seven",
    "Campaign Eight",
    "Campaign Nine",
    "Campaign Ten",
    "Campaign Eleven",
    "Campaign Twelve",
]
DEFAULT_ORDER = ["916", "936", "1178"]

#: Names that are sent to all tasks; of more, rows and names meet by key. It sizes the plan and has no part in any result.
SHORT_LIST = 10_000

# A number in any spelling.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _named(position: Column, id_text: Column) -> Column:
    """Label number `position` (from 0, wrapping around) followed by the id."""
    label = F.element_at(
        F.array(*[F.lit(x) for x in LABELS]), (position % F.lit(len(LABELS)) + 1).cast("int")
    )
    return F.concat(label, F.lit(" ("), id_text, F.lit(")"))


def normalized_id(column: str) -> Column:
    """Whole numbers lose their decimals (``916.0`` is ``916``); other text is trimmed."""
    text = f"btrim(CAST({column} AS STRING))"
    value = f"try_cast({text} AS DOUBLE)"
    return F.expr(
        f"""coalesce(CAST(try_cast({text} AS BIGINT) AS STRING),
                     CASE WHEN {text} RLIKE r'{NUMBER}' AND {value} = floor({value})
                               AND abs({value}) < 1e15D
                          THEN CAST(CAST({value} AS BIGINT) AS STRING) END,
                     {text})"""
    )


def default_name(column: str) -> Column:
    """The name of an id when no list of ids is given: known ids by place, others by value."""
    text = normalized_id(column)
    place = F.array_position(F.array(*[F.lit(x) for x in DEFAULT_ORDER]), text)
    position = F.when(place > 0, place - 1).otherwise(_place_by_value(text))
    return F.coalesce(_named(position, text), F.lit(MISSING))


def _place_by_value(text: Column) -> Column:
    """The number that an id is, else the sum of its characters' codes."""
    codes = F.transform(F.split(text, ""), F.ascii)
    return F.coalesce(F.abs(text.try_cast("bigint")), F.aggregate(codes, F.lit(0).cast("bigint"), lambda n, code: n + code))


def unlisted_name(column: str) -> Column:
    """The name of an id that is not in the list of ids at hand."""
    text = normalized_id(column)
    return _named(_place_by_value(text), text)


def campaign_names(df: DataFrame) -> DataFrame:
    """One row per campaign of `df`: campaign_id, its place in id order from 1, campaign_name.

    Whole numbers come first, by value, then other ids as text; spellings of one id share a place.
    """
    ids = df.select("campaign_id").dropna().distinct().withColumn("_text", normalized_id("campaign_id"))
    number = F.col("_text").try_cast("bigint")
    key = F.struct(number.isNull().alias("t"), number.alias("n"), F.col("_text").alias("s"))
    keys = ids.select(key.alias("_key")).distinct().withColumn("one", F.lit(1))
    placed = running_totals(keys, "_key", ["one"]).select(F.col("_key.s").alias("_text"), "run_one")
    place = F.col("run_one").cast("bigint")
    return ids.join(placed, "_text").select(
        "campaign_id", place.alias("place"), _named(place - 1, F.col("_text")).alias("campaign_name")
    )


def with_campaign_name(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Add campaign_name to rows keyed by campaign_id; a row without a campaign reads N/A.

    An id that `names` does not list is named by its value. The list is staged and counted: a short one is sent to all
    tasks, so that the rows stay where they are instead of meeting in one task per campaign; a long one is joined by
    key, and the adaptive plan splits a campaign that holds most rows.
    """
    listed = stage(names.select("campaign_id", "campaign_name"), "names")
    if listed.count() <= SHORT_LIST:
        listed = F.broadcast(listed)
    joined = rows.join(listed, "campaign_id", "left")
    named = F.coalesce("campaign_name", unlisted_name("campaign_id"), F.lit(MISSING)).alias("campaign_name")
    return joined.select(*rows.columns, named)

