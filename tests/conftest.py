import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("adfathom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


COLUMNS = "ad_id bigint, campaign_id bigint, ad_set_id bigint, age string, gender string, interest bigint, impressions bigint, clicks bigint, spend double, leads bigint, purchases bigint"


@pytest.fixture(scope="session")
def two_ads(spark):
    """Two ads whose totals are easy to work out by hand."""
    rows = [
        (1, 916, 103916, "30-34", "M", 15, 1000, 100, 50.0, 10, 4),
        (2, 936, 103917, "35-39", "F", 20, 2000, 50, 75.0, 5, 1),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def null_keys(spark):
    """Ads of which some have no campaign or no age."""
    rows = [
        (1, 916, 1, "30-34", "M", 15, 1000, 100, 50.0, 10, 4),
        (2, None, 1, "30-34", "F", 15, 500, 10, 20.0, 2, 1),
        (3, None, 1, None, "F", 16, 500, 0, 0.0, 0, 0),
        (4, 936, 1, None, "M", 16, 0, 0, 5.0, 0, 0),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def many_ads(spark):
    """400 varied ads, by arithmetic on the id."""
    return spark.range(400).selectExpr(
        "id AS ad_id",
        "element_at(array(916L, 936L, 1178L), CAST(id % 3 + 1 AS INT)) AS campaign_id",
        "103000 + id % 50 AS ad_set_id",
        "element_at(array('30-34', '35-39', '40-44', '45-49'), CAST(id * 7 % 4 + 1 AS INT)) AS age",
        "CASE WHEN id * 5 % 7 < 3 THEN 'M' ELSE 'F' END AS gender",
        "10 + id * 11 % 20 AS interest",
        "100 + id * 37 % 4900 AS impressions",
        "id * 13 % 50 AS clicks",
        "CAST((id * 31 % 10000) / 100.0 AS DOUBLE) AS spend",
        "id * 13 % 50 DIV 5 AS leads",
        "CASE WHEN id * 13 % 50 > 22 AND id % 4 <> 1 THEN 1 + id % 3 ELSE 0 END AS purchases",
    )
