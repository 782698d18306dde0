"""Campaign tables derived from the test tables, in SQL that Spark and DuckDB both run.

Each test table is read whole: one ad per order, from orders, customer and lineitem.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from adfathom.schema import CANONICAL_SCHEMA
from adfathom.staging import dealt, stage, staging_path

# One ad per order with the eleven canonical columns.
ADS = """
SELECT CAST(o.o_orderkey AS BIGINT) AS ad_id,
       CAST(CASE o.o_custkey % 3 WHEN 0 THEN 916 WHEN 1 THEN 936 ELSE 1178 END AS BIGINT) AS campaign_id,
       CAST(103000 + o.o_custkey % 50 AS BIGINT) AS ad_set_id,
       CASE SUBSTRING(o.o_orderpriority, 1, 1) WHEN '1' THEN '30-34' WHEN '2' THEN '35-39'
            WHEN '3' THEN '40-44' ELSE '45-49' END AS age,
       CASE WHEN c.c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
       CAST(10 + o.o_custkey % 40 AS BIGINT) AS interest,
       CAST(COALESCE(li.qty, 0) * 100 AS BIGINT) AS impressions,
       CAST(COALESCE(li.q_ret, 0) AS BIGINT) AS clicks,
       CAST(CAST(COALESCE(li.disc_amt, 0) / 500 AS DECIMAL(18,2)) AS DOUBLE) AS spend,
       CAST(COALESCE(li.n_f, 0) AS BIGINT) AS leads,
       CAST(COALESCE(li.n_fn, 0) AS BIGINT) AS purchases
FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN (
  SELECT l_orderkey,
         SUM(CAST(l_quantity AS BIGINT)) AS qty,
         SUM(CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS q_ret,
         SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS disc_amt,
         SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS n_f,
         SUM(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN 1 ELSE 0 END) AS n_fn
  FROM lineitem GROUP BY l_orderkey
) li ON li.l_orderkey = o.o_orderkey
"""

# A stand-in score: heavily tied, in thousandths, and higher for ads that sold something.
SCORED = """
SELECT a.*,
       CAST((ad_id * 7919) % 700 + CASE WHEN purchases > 0 THEN 300 ELSE 0 END AS DOUBLE)
         / CAST(1000 AS DOUBLE) AS conversion_probability,
       CAST(CASE WHEN purchases > 0 THEN 1 ELSE 0 END AS INTEGER) AS converted
FROM ads a
"""

# A second score, for comparing curves.
RIVAL = """
SELECT a.*,
       CAST((ad_id * 104729) % 850 + CASE WHEN purchases > 0 THEN 150 ELSE 0 END AS DOUBLE)
         / CAST(1000 AS DOUBLE) AS conversion_probability,
       CAST(CASE WHEN purchases > 0 THEN 1 ELSE 0 END AS INTEGER) AS converted
FROM ads a
"""

# The ads as text cells with every kind of damage the gate counts, spread by ad_id, and with
# some rows repeated. No ad is left out.
RAW = """
SELECT CAST(ad_id AS STRING) AS ad_id,
       CASE WHEN ad_id % 89 = 0 THEN NULL ELSE CAST(campaign_id AS STRING) END AS campaign_id,
       CAST(ad_set_id AS STRING) AS ad_set_id,
       CASE WHEN ad_id % 53 = 0 THEN '   ' WHEN ad_id % 17 = 0 THEN CONCAT('  ', age, ' ') ELSE age END AS age,
       gender,
       CAST(interest AS STRING) AS interest,
       CASE WHEN ad_id % 101 = 0 THEN 'many' WHEN ad_id % 97 = 0 THEN '1' ELSE CAST(impressions AS STRING) END AS impressions,
       CASE WHEN ad_id % 19 = 0 THEN CONCAT(CAST(clicks AS STRING), '.0') ELSE CAST(clicks AS STRING) END AS clicks,
       CASE WHEN ad_id % 71 = 0 THEN CONCAT('-', CAST(CAST(spend AS DECIMAL(18,2)) AS STRING))
            WHEN ad_id % 73 = 0 THEN '1d'
            ELSE CAST(CAST(spend AS DECIMAL(18,2)) AS STRING) END AS spend,
       CAST(leads AS STRING) AS leads,
       CASE WHEN ad_id % 61 = 0 THEN CAST(leads + 1 AS STRING) ELSE CAST(purchases AS STRING) END AS purchases
FROM ads
UNION ALL
SELECT CAST(ad_id AS STRING), CAST(campaign_id AS STRING), CAST(ad_set_id AS STRING), age, gender,
       CAST(interest AS STRING), CAST(impressions AS STRING), CAST(clicks AS STRING),
       CAST(CAST(spend AS DECIMAL(18,2)) AS STRING), CAST(leads AS STRING), CAST(purchases AS STRING)
FROM ads WHERE ad_id % 10 = 0
"""

# The same as cells of a CSV file: a missing cell is one of the words for it, and a further column holds line
# breaks, commas and quotes. The names of the columns are those of the files that the engine is fed with.
RAW_CELLS = """
SELECT ad_id AS `AD ID`,
       coalesce(campaign_id, element_at(array('N/A', 'null', 'NaN', '', '#NA'), CAST(CAST(ad_id AS BIGINT) % 5 + 1 AS INT)))
         AS `xyz_Campaign_ID`,
       ad_set_id AS `fb-campaign-id`, age AS `Age`, gender AS `GENDER`, interest, impressions AS `Impressions`,
       CASE WHEN CAST(ad_id AS BIGINT) % 3 = 0 THEN concat('first line,', chr(10), 'said "so"', chr(10), ad_id) ELSE 'plain' END
         AS `Note (free)`,
       clicks AS `Clicks`, spend AS `Spent`, leads AS `Total_Conversion`, purchases AS ` Approved Conversion `
FROM raw
"""

# The ads with gaps in three features.
GAPPED = """
SELECT ad_id,
       CASE WHEN ad_id % 13 = 0 THEN NULL ELSE campaign_id END AS campaign_id,
       ad_set_id,
       CASE WHEN ad_id % 11 = 0 THEN NULL ELSE age END AS age,
       gender, interest,
       CASE WHEN ad_id % 7 = 0 THEN NULL ELSE impressions END AS impressions,
       clicks,
       CASE WHEN ad_id % 5 = 0 THEN NULL ELSE spend END AS spend,
       leads, purchases
FROM ads
"""

_SOURCES = ["orders", "customer", "lineitem"]
_staged: dict[tuple[str, str, str], DataFrame] = {}
_written: dict[tuple[str, str, str], str] = {}


def _view(df: DataFrame, sql: str) -> DataFrame:
    return df.sparkSession.sql(sql.replace("FROM ads", "FROM {ads}"), ads=df)


def ads_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ads as a lazy query over the test tables."""
    tables = {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in _SOURCES}
    sql = ADS
    for name, alias in (("FROM orders", "orders"), ("JOIN customer", "customer"), ("FROM lineitem", "lineitem")):
        sql = sql.replace(name, name.replace(alias, "{" + alias + "}"))
    rows = spark.sql(sql, **tables)
    return rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in CANONICAL_SCHEMA])


def _share(spark: SparkSession) -> None:
    """A session that names no shared folder gets one of the local machine, as the checks run on one."""
    context = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="adfathom-checks-"))


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored campaign table: derived once per application and folder, then read back.

    This is how the engine works on real data too: a table is gated and stored once, and every
    question reads the stored table.
    """
    key = (spark.sparkContext.applicationId, sf_dir, "ads")
    if key not in _staged:
        _share(spark)
        _staged[key] = stage(dealt(ads_view(spark, sf_dir)), "ads")
    return _staged[key]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(ads(spark, sf_dir), SCORED)


def rival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(ads(spark, sf_dir), RIVAL)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(ads(spark, sf_dir), RAW)


def raw_csv(spark: SparkSession, sf_dir: str) -> str:
    """The path of a folder of CSV files, written by Spark, that hold the damaged ads."""
    key = (spark.sparkContext.applicationId, sf_dir, "csv")
    if key not in _written:
        cells = spark.sql(RAW_CELLS.replace("FROM raw", "FROM {raw}"), raw=raw(spark, sf_dir))
        path = staging_path(spark, "csv")
        kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
        cells.write.options(header=True, escape='"', **kept).csv(path)
        _written[key] = path
    return _written[key]


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(ads(spark, sf_dir), GAPPED)
