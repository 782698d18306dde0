"""The same answers in plain SQL, for the driver's side-by-side check.

Written independently of the engine's plans: windows and self-contained subqueries over the
whole tables, with the default assumptions (order value 75, costs 35 and 2, no fixed cost).
"""

from __future__ import annotations

import re

from adfathom.operators import training
from checks import fixtures

MEASURES = """CAST(SUM(impressions) AS DOUBLE) AS impressions, CAST(SUM(clicks) AS DOUBLE) AS clicks,
  CAST(SUM(leads) AS DOUBLE) AS leads, CAST(SUM(purchases) AS DOUBLE) AS purchases,
  CAST(SUM(CAST(spend AS DECIMAL(18,6))) AS DOUBLE) AS spend"""

RATIOS = """clicks / NULLIF(impressions, 0) AS ctr, spend / NULLIF(clicks, 0) AS cpc,
  leads / NULLIF(clicks, 0) AS lead_conversion_rate,
  purchases / NULLIF(clicks, 0) AS purchase_conversion_rate,
  spend / NULLIF(leads, 0) AS cost_per_lead, spend / NULLIF(purchases, 0) AS cac"""

REVENUE = "purchases * CAST(75 AS DOUBLE)"
COST = "(spend + purchases * CAST(37 AS DOUBLE) + CAST(0 AS DOUBLE))"
MONEY = f"""{REVENUE} AS estimated_revenue, purchases * CAST(37 AS DOUBLE) AS estimated_variable_cost,
  {COST} AS estimated_total_cost, {REVENUE} - {COST} AS estimated_profit,
  {REVENUE} / NULLIF(spend, 0) AS estimated_roas,
  ({REVENUE} - {COST}) / NULLIF({COST}, 0) AS estimated_romi"""

SUMMARY = f"impressions, clicks, leads, purchases, spend, {RATIOS}, {MONEY}"

WORDS = "['One','Two','Three','Four','Five','Six','Seven','Eight','Nine','Ten','Eleven','Twelve']"


def name_of(place: str, id_text: str) -> str:
    """Label number `place` (from 0) with the id behind it."""
    return f"'Campaign ' || {WORDS}[CAST({place} % 12 AS INTEGER) + 1] || ' (' || {id_text} || ')'"


def trimmed(value: str, most: int, least: int = 0, before: str = "", after: str = "") -> str:
    """Text with thousands separators of a double, rounded half away from zero by its decimal digits."""
    rounded = f"CAST(ROUND(CAST(CAST(ABS({value}) AS VARCHAR) AS DECIMAL(38, 20)), {most}) AS DECIMAL(18, 2))"
    cents = f"CAST({rounded} * 100 AS BIGINT)"
    two = f"'.' || LPAD(CAST({cents} % 100 AS VARCHAR), 2, '0')"
    fraction = two if least else f"CASE WHEN {cents} % 100 = 0 THEN '' ELSE RTRIM({two}, '0') END"
    sign = f"CASE WHEN {value} < 0 THEN '-' ELSE '' END"
    return f"COALESCE({sign} || '{before}' || format('{{:,}}', {cents} // 100) || {fraction} || '{after}', 'n/a')"


def ranking(score: str) -> str:
    """ROC AUC and average precision of the rows of `scored` under a score; no score ranks last."""
    return f"""SELECT
  ROUND(CAST(SUM(fp * (2 * run_tp - tp)) AS DOUBLE) / (CAST(2 AS DOUBLE) * MAX(all_tp) * MAX(all_fp)), 10) AS roc_auc,
  ROUND(SUM(CAST(tp AS DOUBLE) / CAST(all_tp AS DOUBLE) * (CAST(run_tp AS DOUBLE) / CAST(run_tp + run_fp AS DOUBLE))), 10)
    AS average_precision
FROM (SELECT tp, fp, SUM(tp) OVER w AS run_tp, SUM(fp) OVER w AS run_fp,
             SUM(tp) OVER () AS all_tp, SUM(fp) OVER () AS all_fp
      FROM (SELECT {score} AS s, COUNT(*) FILTER (converted = 1) AS tp, COUNT(*) FILTER (converted = 0) AS fp
            FROM scored GROUP BY 1)
      WINDOW w AS (ORDER BY s DESC NULLS LAST))"""


TESTED = """CAST((SELECT SUM(n) FROM split_rows WHERE split = 'test') AS BIGINT) AS tested,
  CAST((SELECT SUM(n) FROM split_rows WHERE split = 'test' AND converted = 1) AS BIGINT) AS positives"""

PARTS = {
    "ads": fixtures.ADS,
    "scored": fixtures.SCORED,
    "rival": fixtures.RIVAL,
    "raw": fixtures.RAW,
    "gapped": fixtures.GAPPED,
    "names": f"""
SELECT campaign_id, CAST(place AS BIGINT) AS place,
       {name_of("(place - 1)", "CAST(campaign_id AS VARCHAR)")} AS campaign_name
FROM (SELECT campaign_id, ROW_NUMBER() OVER (ORDER BY campaign_id) AS place
      FROM (SELECT DISTINCT campaign_id FROM ads))""",
    "totals": f"SELECT {SUMMARY} FROM (SELECT {MEASURES} FROM ads)",
    "campaigns": f"SELECT campaign_id, {SUMMARY} FROM (SELECT campaign_id, {MEASURES} FROM ads GROUP BY campaign_id)",
    "named": "SELECT n.campaign_name, c.* FROM campaigns c JOIN names n USING (campaign_id)",
    "by_age": f"SELECT age, {SUMMARY} FROM (SELECT age, {MEASURES} FROM ads GROUP BY age)",
    "by_gender": f"SELECT gender, {SUMMARY} FROM (SELECT gender, {MEASURES} FROM ads GROUP BY gender)",
    "by_interest": f"""SELECT interest, {SUMMARY} FROM (SELECT interest, {MEASURES} FROM ads GROUP BY interest)
ORDER BY spend DESC, interest LIMIT 20""",
    "by_campaign_age": f"""SELECT campaign_id, age, {SUMMARY}
FROM (SELECT campaign_id, age, {MEASURES} FROM ads GROUP BY campaign_id, age)
ORDER BY spend DESC, campaign_id, age LIMIT 20""",
    "by_campaign_gender": f"""SELECT campaign_id, gender, {SUMMARY}
FROM (SELECT campaign_id, gender, {MEASURES} FROM ads GROUP BY campaign_id, gender)
ORDER BY spend DESC, campaign_id, gender LIMIT 20""",
    "flagged": """SELECT * FROM (
  SELECT c.*, COALESCE(purchase_conversion_rate, 0) AS rate,
         list_sort(LIST(spend) OVER ()) AS spends,
         list_sort(LIST(COALESCE(purchase_conversion_rate, 0)) OVER ()) AS rates
  FROM by_campaign_age c)
WHERE spend >= spends[LEN(spends) // 2 + 1] AND rate <= rates[LEN(rates) // 2 + 1]
ORDER BY spend DESC, campaign_id, age LIMIT 10""",
    "scenarios": f"""SELECT average_order_value, purchases * average_order_value AS estimated_revenue,
       purchases * average_order_value - {COST} AS estimated_profit,
       purchases * average_order_value / NULLIF(spend, 0) AS estimated_roas,
       (purchases * average_order_value - {COST}) / NULLIF({COST}, 0) AS estimated_romi
FROM totals, (SELECT UNNEST([37.5::DOUBLE, 56.25, 75, 93.75, 112.5, 150]) AS average_order_value)""",
    # -- quality gate
    "cleaned": """
SELECT ad_id, campaign_id, ad_set_id,
       CASE WHEN TRIM(age) = '' THEN NULL ELSE TRIM(age) END AS age, gender, interest, impressions,
       CASE WHEN clicks LIKE '%.0' THEN SUBSTRING(clicks, 1, LENGTH(clicks) - 2) ELSE clicks END AS clicks,
       CASE WHEN TRY_CAST(spend AS DOUBLE) IS NULL THEN spend ELSE CAST(CAST(spend AS DOUBLE) + 0 AS VARCHAR) END AS spend,  -- + 0: minus zero is zero
       leads, purchases
FROM raw""",
    "uniq": """SELECT ad_id, campaign_id, ad_set_id, age, gender, interest, impressions, clicks, spend, leads,
  purchases, COUNT(*) AS copies FROM cleaned GROUP BY ALL""",
    "vals": """SELECT u.*, TRY_CAST(impressions AS DOUBLE) AS v_imp, TRY_CAST(clicks AS DOUBLE) AS v_clk,
  TRY_CAST(spend AS DOUBLE) AS v_spd, TRY_CAST(leads AS DOUBLE) AS v_led,
  TRY_CAST(purchases AS DOUBLE) AS v_pur FROM uniq u""",
    "found": """SELECT COUNT(*) AS row_count, CAST(SUM(copies) AS BIGINT) - COUNT(*) AS duplicate_count,
  COUNT(*) FILTER (campaign_id IS NULL) AS m_campaign, COUNT(*) FILTER (age IS NULL) AS m_age,
  COUNT(*) FILTER (impressions IS NOT NULL AND v_imp IS NULL) AS i_impressions,
  COUNT(*) FILTER (spend IS NOT NULL AND v_spd IS NULL) AS i_spend,
  COUNT(*) FILTER (v_spd < 0) AS n_spend,
  COUNT(*) FILTER (v_clk > v_imp) AS over_clicks, COUNT(*) FILTER (v_pur > v_led) AS over_purchases
FROM vals""",
    "messages": """SELECT * FROM (
  SELECT 1 AS o, 'Removed ' || duplicate_count || ' exact duplicate row(s).' AS text, duplicate_count > 0 AS on_ FROM found
  UNION ALL SELECT 2, 'Missing values were found in: ' || CONCAT_WS(', ', CASE WHEN m_campaign > 0 THEN 'campaign_id' END,
    CASE WHEN m_age > 0 THEN 'age' END) || '.', m_campaign + m_age > 0 FROM found
  UNION ALL SELECT 3, 'Invalid numeric values were found in: ' || CONCAT_WS(', ', CASE WHEN i_impressions > 0 THEN 'impressions' END,
    CASE WHEN i_spend > 0 THEN 'spend' END) || '.', i_impressions + i_spend > 0 FROM found
  UNION ALL SELECT 4, 'Negative values were found in: spend.', n_spend > 0 FROM found
  UNION ALL SELECT 5, over_clicks || ' row(s) have clicks greater than impressions.', over_clicks > 0 FROM found
  UNION ALL SELECT 6, over_purchases || ' row(s) have purchases greater than leads.', over_purchases > 0 FROM found
) WHERE on_""",
    # -- features
    "medians": """SELECT MEDIAN(CAST(impressions AS DOUBLE)) AS m_imp, MEDIAN(CAST(clicks AS DOUBLE)) AS m_clk,
  MEDIAN(spend) AS m_spd FROM gapped""",
    "modes": """SELECT
  (SELECT campaign_id FROM gapped WHERE campaign_id IS NOT NULL GROUP BY campaign_id ORDER BY COUNT(*) DESC, campaign_id LIMIT 1) AS m_camp,
  (SELECT age FROM gapped WHERE age IS NOT NULL GROUP BY age ORDER BY COUNT(*) DESC, age LIMIT 1) AS m_age""",
    "imputed": """SELECT ad_id, CAST(COALESCE(campaign_id, m_camp) AS VARCHAR) AS campaign_id, COALESCE(age, m_age) AS age, gender,
  CAST(interest AS VARCHAR) AS interest, COALESCE(CAST(impressions AS DOUBLE), m_imp) AS impressions,
  CAST(clicks AS DOUBLE) AS clicks, COALESCE(spend, m_spd) AS spend
FROM gapped, medians, modes""",
    "split_plan": """SELECT converted, n, CASE WHEN place <= short THEN base + 1 ELSE base END AS n_train FROM (
  SELECT *, train - SUM(base) OVER () AS short, ROW_NUMBER() OVER (ORDER BY n * train % total DESC, converted) AS place FROM (
    SELECT converted, n, total, train, n * train // total AS base FROM (
      SELECT converted, n, SUM(n) OVER () AS total,
             SUM(n) OVER () - CAST(CEIL(SUM(n) OVER () * 0.25) AS BIGINT) AS train
      FROM (SELECT converted, COUNT(*) AS n FROM scored GROUP BY converted))))""",
    "split_rows": """SELECT 'train' AS split, converted, CAST(n_train AS BIGINT) AS n FROM split_plan
  UNION ALL SELECT 'test', converted, CAST(n - n_train AS BIGINT) FROM split_plan""",
    # -- evaluation
    "steps": """SELECT s, tp, fp, SUM(tp) OVER w AS run_tp, SUM(fp) OVER w AS run_fp,
  SUM(tp) OVER () AS all_tp, SUM(fp) OVER () AS all_fp,
  LEAD(tp) OVER w AS next_tp, LEAD(fp) OVER w AS next_fp,
  ROW_NUMBER() OVER w AS place, COUNT(*) OVER () AS places
FROM (SELECT conversion_probability AS s, COUNT(*) FILTER (converted = 1) AS tp, COUNT(*) FILTER (converted = 0) AS fp
      FROM scored GROUP BY 1)
WINDOW w AS (ORDER BY s DESC)""",
    "rival_steps": """SELECT s, tp, fp, SUM(tp) OVER w AS run_tp, SUM(fp) OVER w AS run_fp,
  SUM(tp) OVER () AS all_tp, SUM(fp) OVER () AS all_fp,
  LEAD(tp) OVER w AS next_tp, LEAD(fp) OVER w AS next_fp,
  ROW_NUMBER() OVER w AS place
FROM (SELECT conversion_probability AS s, COUNT(*) FILTER (converted = 1) AS tp, COUNT(*) FILTER (converted = 0) AS fp
      FROM rival GROUP BY 1)
WINDOW w AS (ORDER BY s DESC)""",
    "curve": """SELECT CAST(ROW_NUMBER() OVER (ORDER BY s DESC) AS BIGINT) AS point_idx,
  CAST(run_fp AS DOUBLE) / CAST(all_fp AS DOUBLE) AS x, CAST(run_tp AS DOUBLE) / CAST(all_tp AS DOUBLE) AS y
FROM steps WHERE place = 1 OR next_tp IS NULL OR next_tp <> tp OR next_fp <> fp
UNION ALL SELECT 0, 0.0, 0.0""",
    "rival_curve": """SELECT CAST(ROW_NUMBER() OVER (ORDER BY s DESC) AS BIGINT) AS point_idx,
  CAST(run_fp AS DOUBLE) / CAST(all_fp AS DOUBLE) AS x, CAST(run_tp AS DOUBLE) / CAST(all_tp AS DOUBLE) AS y
FROM rival_steps WHERE place = 1 OR next_tp IS NULL OR next_tp <> tp OR next_fp <> fp
UNION ALL SELECT 0, 0.0, 0.0""",
    "grid": "SELECT UNNEST([0.05::DOUBLE,0.1,0.15,0.2,0.25,0.3,0.35,0.4,0.45,0.5,0.55,0.6,0.65,0.7,0.75,0.8,0.85,0.9,0.95]) AS threshold",
    "sweep_counts": """SELECT threshold, COUNT(*) FILTER (hit) AS segments_selected, COUNT(*) AS n_total,
  COUNT(*) FILTER (hit AND converted = 1) AS true_positives, COUNT(*) FILTER (hit AND converted = 0) AS false_positives,
  COUNT(*) FILTER (NOT hit AND converted = 0) AS true_negatives, COUNT(*) FILTER (NOT hit AND converted = 1) AS false_negatives,
  CAST(COALESCE(SUM(purchases) FILTER (hit), 0) AS DOUBLE) AS purchases,
  CAST(COALESCE(SUM(CAST(spend AS DECIMAL(18,6))) FILTER (hit), 0) AS DOUBLE) AS spend
FROM (SELECT g.threshold, s.*, s.conversion_probability >= g.threshold AS hit FROM grid g, scored s)
GROUP BY threshold""",
    "sweep_rates": """SELECT *, COALESCE(CAST(true_positives AS DOUBLE) / NULLIF(true_positives + false_positives, 0), 0) AS prec,
  COALESCE(CAST(true_positives AS DOUBLE) / NULLIF(true_positives + false_negatives, 0), 0) AS rec FROM sweep_counts""",
    "sweep": f"""SELECT threshold, segments_selected, CAST(segments_selected AS DOUBLE) / CAST(n_total AS DOUBLE) AS pct_segments_selected,
  true_positives, false_positives, true_negatives, false_negatives, prec AS "precision", rec AS recall,
  COALESCE(CAST(2 AS DOUBLE) * prec * rec / NULLIF(prec + rec, 0), 0) AS f1_score,
  purchases AS actual_purchases, spend AS selected_spend, {REVENUE} AS estimated_revenue,
  {COST} AS estimated_total_cost, {REVENUE} - {COST} AS estimated_profit FROM sweep_rates""",
    "best": """SELECT * FROM sweep ORDER BY estimated_profit DESC, "precision" DESC, segments_selected, threshold LIMIT 1""",
    # -- advice
    "est": f"""SELECT s.*, CAST(purchases AS INTEGER) AS actual_purchases,
  CAST(CASE WHEN conversion_probability > 0.5 THEN 1 ELSE 0 END AS INTEGER) AS predicted_class,
  CAST(clicks AS DOUBLE) / NULLIF(impressions, 0) AS ctr, spend / NULLIF(clicks, 0) AS cpc,
  spend / NULLIF(purchases, 0) AS cac, CAST(purchases AS DOUBLE) / NULLIF(clicks, 0) AS purchase_conversion_rate,
  {REVENUE} AS estimated_revenue,
  {REVENUE} - spend - purchases * CAST(37 AS DOUBLE) - CAST(0 AS DOUBLE) AS estimated_profit
FROM scored s""",
    "mid": """SELECT MEDIAN(cac) AS m_cac, MEDIAN(spend) AS m_spend, MEDIAN(purchase_conversion_rate) AS m_rate, COUNT(*) AS n FROM est""",
    "ruled": """SELECT e.*, m.*, CASE
  WHEN conversion_probability < 0.4::DOUBLE AND estimated_profit < 0 AND spend > 0 AND purchases = 0 THEN 'Pause'
  WHEN conversion_probability < 0.5::DOUBLE AND spend > m_spend AND (purchases = 0 OR estimated_profit <= 0) THEN 'Reduce budget'
  WHEN conversion_probability >= 0.4::DOUBLE AND conversion_probability < 0.5::DOUBLE THEN 'Monitor'
  WHEN estimated_profit BETWEEN -5 AND 5 AND conversion_probability < 0.5::DOUBLE THEN 'Monitor'
  WHEN conversion_probability >= 0.5::DOUBLE AND estimated_profit > 0 AND cac < m_cac AND purchase_conversion_rate > m_rate
    THEN 'Increase budget carefully'
  WHEN conversion_probability >= 0.5::DOUBLE AND estimated_profit > 0 THEN 'Continue'
  WHEN conversion_probability >= 0.5::DOUBLE THEN 'Monitor'
  ELSE 'Reduce budget' END AS recommendation
FROM est e, mid m""",
    "advised": """SELECT r.*, CASE recommendation
  WHEN 'Increase budget carefully' THEN 'Recommended for budget increase because conversion probability is ' || pct
    || ' (above 50% threshold), estimated profit is ' || pro || ', and CAC (' || COALESCE(printf('$%.2f', cac), 'N/A')
    || ') is below the dataset median (' || printf('$%.2f', m_cac) || ').'
  WHEN 'Continue' THEN 'Recommended for continuation because conversion probability is ' || pct
    || ', estimated profit is positive (' || pro || '), and performance is near dataset medians.'
  WHEN 'Monitor' THEN 'Placed in monitoring because conversion probability (' || pct
    || ') is near the 50% threshold and estimated profit is ' || pro || '.'
  WHEN 'Reduce budget' THEN 'Recommended for budget reduction because conversion probability is ' || pct
    || ' (below 50% threshold), spend is ' || printf('$%.2f', spend) || ' (above median ' || printf('$%.2f', m_spend)
    || '), and purchases are ' || actual_purchases || '.'
  ELSE 'Recommended to pause because conversion probability is ' || pct
    || ' (well below 50% threshold), estimated profit is ' || pro || ', and no approved conversions were generated.' END
  AS recommendation_reason
FROM (SELECT *, printf('%.0f', conversion_probability * 100) || '%' AS pct, printf('$%.2f', estimated_profit) AS pro FROM ruled) r""",
    "labels5": "SELECT * FROM (VALUES (1,'Increase budget carefully'),(2,'Continue'),(3,'Monitor'),(4,'Reduce budget'),(5,'Pause')) t(label_order, recommendation)",
    "profits": f"""SELECT campaign_id, age, interest, {REVENUE} - spend - purchases * CAST(37 AS DOUBLE) AS profit, spend, purchases, wasted
FROM (SELECT campaign_id, age, interest, CAST(SUM(purchases) AS DOUBLE) AS purchases,
        CAST(SUM(CAST(spend AS DECIMAL(18,6))) AS DOUBLE) AS spend,
        CAST(SUM(CAST(spend AS DECIMAL(18,6))) FILTER (recommendation IN ('Pause', 'Reduce budget')) AS DOUBLE) AS wasted
      FROM ruled GROUP BY GROUPING SETS ((campaign_id), (age), (interest)))""",
    "picks": """SELECT
  (SELECT campaign_id FROM profits WHERE campaign_id IS NOT NULL ORDER BY profit DESC, campaign_id LIMIT 1) AS best_campaign,
  (SELECT campaign_id FROM profits WHERE campaign_id IS NOT NULL AND purchases > 0 ORDER BY spend / purchases, campaign_id LIMIT 1) AS low_cac,
  (SELECT campaign_id FROM profits WHERE campaign_id IS NOT NULL AND wasted IS NOT NULL ORDER BY wasted DESC, campaign_id LIMIT 1) AS waste,
  (SELECT age FROM profits WHERE age IS NOT NULL ORDER BY profit DESC, age LIMIT 1) AS best_age,
  (SELECT interest FROM profits WHERE interest IS NOT NULL ORDER BY profit DESC, interest LIMIT 1) AS best_interest""",
    "report_rows": f"""SELECT a.ad_id, a.campaign_id, n.campaign_name, age, gender, interest, impressions, clicks, spend, actual_purchases,
  CAST(printf('%.4f', conversion_probability) AS DOUBLE) AS conversion_probability, predicted_class,
  CAST(printf('%.6f', ctr) AS DOUBLE) AS ctr, CAST(printf('%.6f', cpc) AS DOUBLE) AS cpc,
  CAST(printf('%.6f', cac) AS DOUBLE) AS cac,
  CAST(printf('%.6f', purchase_conversion_rate) AS DOUBLE) AS purchase_conversion_rate,
  CAST(printf('%.2f', estimated_revenue) AS DOUBLE) AS estimated_revenue,
  CAST(printf('%.2f', estimated_profit) AS DOUBLE) AS estimated_profit, recommendation
FROM ruled a JOIN names n USING (campaign_id)""",
}

OPENING = "High engagement does not automatically mean high business value."
LIMITATION = (
    "Recommendations are scenario estimates based on model predictions and financial "
    "assumptions, not guaranteed outcomes."
)
ACTION = "Validate top recommendations with domain experts and A/B test budget changes incrementally."


def _summary(kept: str) -> str:
    counts = ", ".join(
        f"CAST(COUNT(*) FILTER (recommendation = '{label}') AS BIGINT) AS {name}"
        for label, name in (
            ("Increase budget carefully", "n_increase_budget_carefully"),
            ("Continue", "n_continue"),
            ("Monitor", "n_monitor"),
            ("Reduce budget", "n_reduce_budget"),
            ("Pause", "n_pause"),
        )
    )
    return f"""SELECT CAST(best_campaign AS VARCHAR) AS best_campaign_by_profit, CAST(low_cac AS VARCHAR) AS lowest_cac_campaign,
  (SELECT campaign_name FROM names WHERE campaign_id = waste) AS largest_inefficient_spend_area,
  best_age AS best_age_group, CAST(best_interest AS VARCHAR) AS best_interest_group, k.*,
  '{LIMITATION}' AS main_limitation, '{ACTION}' AS recommended_next_action
FROM picks, (SELECT {counts},
  CAST(SUM(purchases) AS DOUBLE) * CAST(75 AS DOUBLE) - CAST(SUM(CAST(spend AS DECIMAL(18,6))) AS DOUBLE)
  - CAST(SUM(purchases) AS DOUBLE) * CAST(37 AS DOUBLE) AS estimated_profit_selected FROM ruled WHERE {kept}) k"""


FINDINGS = f"""SELECT 1 AS line, (SELECT campaign_name FROM names WHERE campaign_id = best_campaign)
    || ' has the highest estimated profit among all campaigns in the current dataset.' AS text FROM picks
UNION ALL SELECT 2, (SELECT campaign_name FROM names WHERE campaign_id = low_cac)
    || ' achieves the lowest customer acquisition cost (CAC) among campaigns with at least one purchase.' FROM picks
UNION ALL SELECT 3, 'Age group ''' || best_age || ''' generates the highest estimated profit.' FROM picks
UNION ALL SELECT 4, 'Interest group ' || best_interest || ' produces the strongest estimated profit.' FROM picks
UNION ALL SELECT 5, (SELECT campaign_name FROM names WHERE campaign_id = waste)
    || ' represents the largest concentration of spend in segments recommended for budget reduction or pause.' FROM picks
UNION ALL SELECT 6, COUNT(*) || ' segment(s) meet the criteria for careful budget increase (above-threshold probability, positive estimated profit, below-median CAC).'
  FROM ruled WHERE recommendation = 'Increase budget carefully' HAVING COUNT(*) > 0
UNION ALL SELECT 7, COUNT(*) || ' segment(s) are recommended for pause (substantially below threshold, negative estimated profit, no conversions).'
  FROM ruled WHERE recommendation = 'Pause' HAVING COUNT(*) > 0
UNION ALL SELECT 8, 'Total estimated profit across all selected segments: ' || printf('$%.2f', estimated_profit_selected)
    || ' (scenario estimate, not guaranteed).' FROM ({_summary("TRUE")})"""

SEGMENTS = """ad_id, campaign_id, age, gender, interest, impressions, clicks, spend, actual_purchases, conversion_probability,
  predicted_class, ctr, cpc, cac, purchase_conversion_rate, estimated_revenue, estimated_profit, recommendation"""


def _strategy(order: int, name: str, chosen: str) -> str:
    return f"""SELECT {order} AS strategy_order, '{name}' AS strategy, COUNT(*) AS segments_selected,
  CAST(COALESCE(SUM(purchases), 0) AS DOUBLE) AS purchases, CAST(COALESCE(SUM(CAST(spend AS DECIMAL(18,6))), 0) AS DOUBLE) AS spend
FROM (SELECT s.*, b.threshold AS cut, b.segments_selected AS k,
  ROW_NUMBER() OVER (ORDER BY (ad_id * 48271 + 42) % 2147483647, ad_id) AS r_random,
  ROW_NUMBER() OVER (ORDER BY clicks DESC, ad_id) AS r_clicks,
  ROW_NUMBER() OVER (ORDER BY CASE WHEN clicks > 0 THEN 0 ELSE 1 END, spend / NULLIF(clicks, 0), ad_id) AS r_cpc
  FROM scored s, best b) WHERE {chosen}"""


STRATEGIES = " UNION ALL ".join(
    [
        _strategy(1, "Model (recommended threshold)", "conversion_probability >= cut"),
        _strategy(2, "Continue all segments", "TRUE"),
        _strategy(3, "Random selection (same count)", "r_random <= k"),
        _strategy(4, "Most clicks (same count)", "r_clicks <= k"),
        _strategy(5, "Lowest CPC (same count)", "r_cpc <= k"),
    ]
)


def _audience(view: str, table: str, value: str, keys: str, join: str = "") -> str:
    return f"SELECT '{view}' AS group_type, {value} AS group_value, {keys}, {SUMMARY} FROM {table} {join}"


_ZERO_COLUMNS = {
    "missing": "ad_id ad_set_id gender interest impressions clicks spend leads purchases",
    "invalid": "ad_id campaign_id ad_set_id interest clicks leads purchases",
    "negative": "ad_id campaign_id ad_set_id interest impressions clicks leads purchases",
}
_ZEROS = ", ".join(
    f"CAST(0 AS BIGINT) AS {kind}_{c}" for kind, names in _ZERO_COLUMNS.items() for c in names.split()
)

_RULES = """CONCAT_WS(',', CASE WHEN campaign_id IS NULL THEN 'missing:campaign_id' END, CASE WHEN age IS NULL THEN 'missing:age' END,
  CASE WHEN impressions IS NOT NULL AND v_imp IS NULL THEN 'invalid:impressions' END,
  CASE WHEN spend IS NOT NULL AND v_spd IS NULL THEN 'invalid:spend' END, CASE WHEN v_spd < 0 THEN 'negative:spend' END,
  CASE WHEN v_clk > v_imp THEN 'clicks>impressions' END, CASE WHEN v_pur > v_led THEN 'purchases>leads' END)"""

_TYPED = """TRY_CAST(ad_id AS BIGINT) AS ad_id, TRY_CAST(campaign_id AS BIGINT) AS campaign_id, TRY_CAST(ad_set_id AS BIGINT) AS ad_set_id,
  age, gender, TRY_CAST(interest AS BIGINT) AS interest, TRY_CAST(impressions AS BIGINT) AS impressions,
  TRY_CAST(clicks AS BIGINT) AS clicks, TRY_CAST(spend AS DOUBLE) AS spend, TRY_CAST(leads AS BIGINT) AS leads,
  TRY_CAST(purchases AS BIGINT) AS purchases"""


def _top(table: str, column: str, order: str) -> str:
    return f"(SELECT {column} FROM {table} ORDER BY {order} LIMIT 1)"


ANSWERS = {
    "scan_normalized": f"SELECT {_TYPED} FROM cleaned",
    "typed_rows": f"SELECT {_TYPED} FROM uniq",
    "preview": "SELECT * FROM ads ORDER BY ad_id LIMIT 20",
    "dedupe_count": """SELECT CAST(SUM(copies) AS BIGINT) AS rows_before, COUNT(*) AS rows_after,
  CAST(SUM(copies) AS BIGINT) - COUNT(*) AS duplicate_count FROM uniq""",
    "quality_counts": f"""SELECT row_count, duplicate_count, m_campaign AS missing_campaign_id, m_age AS missing_age,
  i_impressions AS invalid_impressions, i_spend AS invalid_spend, n_spend AS negative_spend,
  over_clicks AS clicks_greater_than_impressions, over_purchases AS purchases_greater_than_leads, {_ZEROS} FROM found""",
    "quality_report": """SELECT row_count, 11 AS column_count, duplicate_count, over_clicks AS clicks_greater_than_impressions,
  over_purchases AS purchases_greater_than_leads,
  row_count > 0 AND m_campaign + m_age + i_impressions + i_spend + n_spend + over_clicks + over_purchases = 0 AS ready_for_analysis,
  (SELECT STRING_AGG(text, ' | ' ORDER BY o) FROM messages) AS warnings, m_age AS missing_age, i_spend AS invalid_spend,
  n_spend AS negative_spend FROM found""",
    "quality_report_clean": """SELECT COUNT(*) AS row_count, CAST(0 AS BIGINT) AS duplicate_count, TRUE AS ready_for_analysis,
  'Dataset passed validation and is ready for analysis.' AS warnings FROM (SELECT DISTINCT * FROM ads)""",
    "quality_warnings": "SELECT CAST(ROW_NUMBER() OVER (ORDER BY o) AS INTEGER) AS line, text FROM messages",
    "quality_issue_counts": """SELECT * FROM (
  SELECT 'missing_values_by_column' AS kind, 'campaign_id' AS column_name, m_campaign AS n FROM found
  UNION ALL SELECT 'missing_values_by_column', 'age', m_age FROM found
  UNION ALL SELECT 'invalid_numeric_values', 'impressions', i_impressions FROM found
  UNION ALL SELECT 'invalid_numeric_values', 'spend', i_spend FROM found
  UNION ALL SELECT 'negative_values', 'spend', n_spend FROM found) WHERE n > 0""",
    "quality_issue_totals": """SELECT 'missing_values_by_column' AS kind, m_campaign + m_age AS total FROM found
  UNION ALL SELECT 'invalid_numeric_values', i_impressions + i_spend FROM found
  UNION ALL SELECT 'negative_values', n_spend FROM found""",
    "quarantine_rows": f"""SELECT CAST(ad_id AS BIGINT) AS ad_id, copies, broken_rules
  FROM (SELECT *, {_RULES} AS broken_rules FROM vals) WHERE broken_rules <> ''""",
    "ad_metrics": f"SELECT ad_id, {RATIOS} FROM (SELECT ad_id, CAST(impressions AS DOUBLE) AS impressions, CAST(clicks AS DOUBLE) AS clicks, CAST(leads AS DOUBLE) AS leads, CAST(purchases AS DOUBLE) AS purchases, spend FROM ads)",
    "ad_financials": f"SELECT ad_id, {MONEY} FROM (SELECT ad_id, CAST(purchases AS DOUBLE) AS purchases, spend FROM ads)",
    "campaign_names": "SELECT * FROM names",
    "campaign_names_by_place": f"""SELECT campaign_id, CAST(place AS BIGINT) AS place, {name_of("(place - 1)", "CAST(campaign_id AS VARCHAR)")} AS campaign_name
  FROM (SELECT campaign_id, ROW_NUMBER() OVER (ORDER BY campaign_id) AS place FROM (SELECT DISTINCT ad_set_id AS campaign_id FROM ads))""",
    "campaign_names_of_ads": f"""SELECT campaign_id, CAST(place AS BIGINT) AS place, {name_of("(place - 1)", "CAST(campaign_id AS VARCHAR)")} AS campaign_name
  FROM (SELECT campaign_id, ROW_NUMBER() OVER (ORDER BY campaign_id) AS place FROM (SELECT DISTINCT ad_id AS campaign_id FROM ads))""",
    "campaign_default_names": f"""SELECT campaign_id, ad_set_id, {name_of("CASE campaign_id WHEN 916 THEN 0 WHEN 936 THEN 1 ELSE 2 END", "CAST(campaign_id AS VARCHAR)")} AS campaign_name,
  {name_of("ad_set_id", "CAST(ad_set_id AS VARCHAR)")} AS ad_set_name FROM (SELECT DISTINCT campaign_id, ad_set_id FROM ads)""",
    "formatted_metrics": "SELECT campaign_id, format('{:,.0f}', impressions) AS impressions, "
    + ", ".join(
        f"COALESCE('$' || format('{{:,.2f}}', {c}), 'N/A') AS {c}"
        for c in "spend cpc cost_per_lead cac estimated_revenue estimated_variable_cost estimated_total_cost estimated_profit".split()
    )
    + ", "
    + ", ".join(
        f"COALESCE(printf('%.1f', {c} * 100) || '%', 'N/A') AS {c}"
        for c in "ctr lead_conversion_rate purchase_conversion_rate".split()
    )
    + ", "
    + ", ".join(f"COALESCE(printf('%.2f', {c}) || 'x', 'N/A') AS {c}" for c in ("estimated_roas", "estimated_romi"))
    + " FROM campaigns",
    "ui_number_forms": f"""SELECT ad_id, {trimmed("half", 0)} AS whole_text, {trimmed("eighth", 2)} AS number_text,
  {trimmed("eighth", 2, 2, before="$")} AS money_text, {trimmed("share", 2, after="%")} AS percent_text,
  {trimmed("gain", 2, after="x")} AS ratio_text
  FROM (SELECT ad_id, sign * clicks / 2 AS half, sign * impressions / 8 AS eighth,
    sign * (CAST(clicks AS DOUBLE) / NULLIF(impressions, 0)) / 8 * CAST(100 AS DOUBLE) AS share,
    (purchases * CAST(75 AS DOUBLE) - CAST(spend AS DOUBLE)) / NULLIF(CAST(spend AS DOUBLE), 0) AS gain
    FROM (SELECT *, CASE WHEN ad_id % 2 = 1 THEN CAST(-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS sign FROM ads))""",
    "overview_totals": "SELECT * FROM totals",
    "funnel_stages": """SELECT 1 AS stage_order, 'Impressions' AS stage, impressions AS value FROM totals
  UNION ALL SELECT 2, 'Clicks', clicks FROM totals UNION ALL SELECT 3, 'Leads', leads FROM totals
  UNION ALL SELECT 4, 'Purchases', purchases FROM totals""",
    "funnel_conversion": """SELECT *, conversion_rate * 100 AS conversion_rate_percent FROM (
  SELECT step_order, transition, from_count, to_count, COALESCE(to_count / NULLIF(from_count, 0), 0) AS conversion_rate FROM (
  SELECT 1 AS step_order, 'Impressions to Clicks' AS transition, impressions AS from_count, clicks AS to_count FROM totals
  UNION ALL SELECT 2, 'Clicks to Leads', clicks, leads FROM totals
  UNION ALL SELECT 3, 'Leads to Purchases', leads, purchases FROM totals))""",
    "campaign_rollup": "SELECT * FROM campaigns",
    "audience_all_sets": f"""SELECT CASE WHEN gc = 1 AND gi = 0 THEN 'interest' WHEN gc = 1 AND ga = 0 THEN 'age' WHEN gc = 1 THEN 'gender'
    WHEN ga = 0 THEN 'campaign_age' ELSE 'campaign_gender' END AS group_type, campaign_id, age, gender, interest, {SUMMARY}
  FROM (SELECT campaign_id, age, gender, interest, GROUPING(campaign_id) AS gc, GROUPING(age) AS ga, GROUPING(interest) AS gi, {MEASURES}
    FROM ads GROUP BY GROUPING SETS ((age), (gender), (interest), (campaign_id, age), (campaign_id, gender)))""",
    "audience_by_age": _audience("age", "by_age", "age", "age"),
    "audience_by_gender": _audience("gender", "by_gender", "gender", "gender"),
    "audience_by_interest": _audience("interest", "by_interest", "CAST(interest AS VARCHAR)", "interest"),
    "audience_campaign_age": _audience("campaign_age", "by_campaign_age", "campaign_name || ' / ' || age", "campaign_id, age", "JOIN names USING (campaign_id)"),
    "audience_campaign_gender": _audience("campaign_gender", "by_campaign_gender", "campaign_name || ' / ' || gender", "campaign_id, gender", "JOIN names USING (campaign_id)"),
    "audience_kpis": """SELECT (SELECT COUNT(*) FROM by_age) + (SELECT COUNT(*) FROM by_gender) + (SELECT COUNT(*) FROM by_interest) AS total_segments,
  (SELECT MAX(purchases) FROM by_interest) AS top_interest_purchases""",
    "high_spend_low_conversion": """SELECT campaign_name || ' / ' || age AS group_value, campaign_id, age, spend, purchase_conversion_rate, estimated_profit
  FROM flagged JOIN names USING (campaign_id)""",
    "sensitivity": "SELECT * FROM scenarios",
    "insight_overview": f"""SELECT 1 AS line, '{OPENING}' AS text
  UNION ALL SELECT 2, 'The current assumptions estimate revenue at $' || format('{{:,.2f}}', estimated_revenue) || ' and estimated profit at $' || format('{{:,.2f}}', estimated_profit) || '.' FROM totals
  UNION ALL SELECT 3, {_top("named", "campaign_name", "estimated_profit DESC, spend DESC, campaign_id")} || ' has the highest estimated profit in the loaded data.'
  UNION ALL SELECT 4, c || ' has the most clicks, but ' || p || ' has the stronger estimated business value.' FROM (
    SELECT {_top("named", "campaign_name", "clicks DESC, spend DESC, campaign_id")} AS c, {_top("named", "campaign_name", "estimated_profit DESC, spend DESC, campaign_id")} AS p) WHERE c <> p""",
    "insight_campaigns": f"""SELECT 1 AS line, '{OPENING}' AS text
  UNION ALL SELECT 2, {_top("(SELECT * FROM named WHERE ctr IS NOT NULL)", "campaign_name", "ctr DESC, spend DESC, campaign_id")} || ' has the highest click-through rate.'
  UNION ALL SELECT 3, {_top("named", "campaign_name", "estimated_profit DESC, spend DESC, campaign_id")} || ' has the highest estimated profit.'
  UNION ALL SELECT 4, {_top("(SELECT * FROM named WHERE cac IS NOT NULL)", "campaign_name", "cac, spend DESC, campaign_id")} || ' has the lowest CAC among campaigns with purchases.'""",
    "insight_audiences": f"""SELECT 1 AS line, '{OPENING}' AS text
  UNION ALL SELECT 2, 'Age group ' || {_top("by_age", "age", "estimated_profit DESC, spend DESC, age")} || ' has the highest estimated profit.'
  UNION ALL SELECT 3, 'Gender group ' || {_top("by_gender", "gender", "estimated_profit DESC, spend DESC, gender")} || ' has the highest estimated profit.'
  UNION ALL SELECT 4, 'Interest group ' || {_top("by_interest", "interest", "purchases DESC, spend DESC, interest")} || ' has the most purchases.'
  UNION ALL SELECT 5, COUNT(*) || ' high-spend segment(s) show below-median purchase conversion.' FROM flagged HAVING COUNT(*) > 0""",
    "insight_sensitivity": f"""SELECT 1 AS line, '{OPENING}' AS text
  UNION ALL SELECT 2, COALESCE('Estimated profit turns non-negative at an average order value of $' || format('{{:,.2f}}', MIN(average_order_value)) || '.',
    'Estimated profit remains negative across the tested average-order-value scenarios.') FROM scenarios WHERE estimated_profit >= 0""",
    "top_segments_profit": "SELECT CAST(interest AS VARCHAR) AS group_value, spend, estimated_profit FROM by_interest ORDER BY estimated_profit DESC, group_value LIMIT 15",
    "top_interests_purchases": "SELECT interest, spend, purchases FROM by_interest ORDER BY purchases DESC, spend DESC, interest LIMIT 10",
    "campaign_view": "SELECT * FROM named WHERE LOWER(campaign_name) LIKE '%campaign t%' OR CAST(campaign_id AS VARCHAR) LIKE '%campaign t%'",
    "campaign_view_totals": """SELECT COUNT(*) AS campaigns, CAST(SUM(CAST(estimated_profit AS DECIMAL(18,6))) AS DOUBLE) AS estimated_profit,
  CAST(SUM(CAST(spend AS DECIMAL(18,6))) AS DOUBLE) AS spend FROM named WHERE campaign_name LIKE '%9%'""",
    "campaign_export": """SELECT campaign_name AS "Campaign", spend AS "Spend", clicks AS "Clicks", purchases AS "Purchases", ctr AS "CTR", cac AS "CAC",
  estimated_roas AS "Estimated ROAS", estimated_profit AS "Estimated profit" FROM named""",
    "filter_options": """SELECT DISTINCT 'campaign_id' AS option, CAST(campaign_id AS VARCHAR) AS value FROM ads
  UNION SELECT 'age', age FROM ads UNION SELECT 'gender', gender FROM ads UNION SELECT 'interest', CAST(interest AS VARCHAR) FROM ads""",
    "conversion_target": "SELECT ad_id, CAST(CASE WHEN purchases > 0 THEN 1 ELSE 0 END AS INTEGER) AS converted FROM ads",
    "feature_table": """SELECT ad_id, CAST(campaign_id AS VARCHAR) AS campaign_id, age, gender, CAST(interest AS VARCHAR) AS interest,
  CAST(impressions AS DOUBLE) AS impressions, CAST(clicks AS DOUBLE) AS clicks, spend,
  CAST(CASE WHEN purchases > 0 THEN 1 ELSE 0 END AS INTEGER) AS converted FROM gapped""",
    "imputed_features": "SELECT * FROM imputed",
    "scaled_features": "SELECT ad_id, "
    + ", ".join(
        f"ROUND(({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER (), 8) AS {c}" for c in ("impressions", "clicks", "spend")
    )
    + " FROM imputed",
    "one_hot_levels": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS level, COUNT(*) AS n FROM imputed GROUP BY {c}"
        for c in ("campaign_id", "age", "gender", "interest")
    ),
    "split_sizes": "SELECT * FROM split_rows",
    "class_distribution": """SELECT part, converted AS label, CAST(n AS BIGINT) AS n, CAST(n AS DOUBLE) / CAST(SUM(n) OVER (PARTITION BY part) AS DOUBLE) AS share FROM (
  SELECT split AS part, converted, n FROM split_rows UNION ALL SELECT 'total', converted, SUM(n) FROM split_rows GROUP BY converted)""",
    "confusion_metrics": """SELECT tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives,
  CAST(tp + tn AS DOUBLE) / CAST(tp + tn + fp + fn AS DOUBLE) AS accuracy, p AS "precision", r AS recall,
  CAST(2 AS DOUBLE) * p * r / (p + r) AS f1_score
  FROM (SELECT *, CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS p, CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) AS r FROM (
    SELECT COUNT(*) FILTER (converted = 0 AND predicted_class = 0) AS tn, COUNT(*) FILTER (converted = 0 AND predicted_class = 1) AS fp,
    COUNT(*) FILTER (converted = 1 AND predicted_class = 0) AS fn, COUNT(*) FILTER (converted = 1 AND predicted_class = 1) AS tp FROM est))""",
    "roc_auc": "SELECT ROUND(CAST(SUM(fp * (2 * run_tp - tp)) AS DOUBLE) / (CAST(2 AS DOUBLE) * MAX(all_tp) * MAX(all_fp)), 10) AS roc_auc FROM steps",
    "average_precision": "SELECT ROUND(SUM(CAST(tp AS DOUBLE) / CAST(all_tp AS DOUBLE) * (CAST(run_tp AS DOUBLE) / CAST(run_tp + run_fp AS DOUBLE))), 10) AS average_precision FROM steps",
    "roc_curve": "SELECT * FROM curve",
    "pr_curve": """SELECT CAST(places - place AS BIGINT) AS point_idx, CAST(run_tp AS DOUBLE) / CAST(all_tp AS DOUBLE) AS x,
  CAST(run_tp AS DOUBLE) / CAST(run_tp + run_fp AS DOUBLE) AS y FROM steps
  UNION ALL SELECT MAX(places), 0.0, 1.0 FROM steps""",
    "roc_curve_aligned": """SELECT point_idx, COALESCE(a.x, 1.0) AS first_fpr, COALESCE(a.y, 1.0) AS first_tpr, COALESCE(b.x, 1.0) AS second_fpr, COALESCE(b.y, 1.0) AS second_tpr
  FROM curve a FULL JOIN rival_curve b USING (point_idx)""",
    "threshold_sweep": "SELECT * FROM sweep",
    "best_threshold": """SELECT *, 'Threshold ' || printf('%.2f', threshold) || ' maximises historical estimated profit ($' || format('{:,.2f}', estimated_profit) || ') on the held-out test set.' AS recommended_reason FROM best""",
    "strategy_comparison": f"""SELECT strategy_order, strategy, segments_selected, purchases AS actual_purchases, spend AS selected_spend,
  {REVENUE} AS estimated_revenue, {REVENUE} - {COST} AS estimated_profit FROM ({STRATEGIES})""",
    "segment_metrics": "SELECT ad_id, actual_purchases, ctr, cpc, cac, purchase_conversion_rate, estimated_revenue, estimated_profit FROM est",
    "segment_medians": "SELECT n, m_cac AS cac, m_spend AS spend, m_rate AS purchase_conversion_rate FROM mid",
    "recommendations": f"SELECT {SEGMENTS} FROM ruled",
    "recommendation_reason": "SELECT ad_id, recommendation, recommendation_reason FROM advised",
    "recommendations_filtered": "SELECT ad_id, campaign_id, gender, recommendation FROM ruled WHERE campaign_id = 936 AND gender = 'M'",
    "recommendation_counts": """SELECT label_order, l.recommendation, COUNT(r.ad_id) AS n FROM labels5 l
  LEFT JOIN (SELECT * FROM ruled WHERE campaign_id = 936 AND gender = 'M') r ON r.recommendation = l.recommendation GROUP BY 1, 2""",
    "recommendation_nonzero": """SELECT label_order, l.recommendation, COUNT(*) AS n FROM labels5 l JOIN (
  SELECT CASE WHEN conversion_probability < 0.9::DOUBLE AND estimated_profit < 0 AND spend > 0 AND purchases = 0 THEN 'Pause'
    WHEN conversion_probability < 1 AND spend > m_spend AND (purchases = 0 OR estimated_profit <= 0) THEN 'Reduce budget'
    WHEN conversion_probability >= 0.9::DOUBLE AND conversion_probability < 1 THEN 'Monitor'
    WHEN estimated_profit BETWEEN -5 AND 5 AND conversion_probability < 1 THEN 'Monitor'
    ELSE 'Reduce budget' END AS recommendation FROM ruled) r ON r.recommendation = l.recommendation GROUP BY 1, 2""",
    "recommendation_view": f"""SELECT ad_id, {name_of("CASE campaign_id WHEN 916 THEN 0 WHEN 936 THEN 1 ELSE 2 END", "CAST(campaign_id AS VARCHAR)")} AS campaign_name,
  age, gender, interest, cac, recommendation FROM ruled WHERE age LIKE '%30-3%'""",
    "inefficient_spend": """SELECT campaign_id, COUNT(*) AS n, CAST(SUM(CAST(spend AS DECIMAL(18,6))) AS DOUBLE) AS spend FROM ruled
  WHERE recommendation IN ('Pause', 'Reduce budget') GROUP BY campaign_id""",
    "executive_summary": _summary("TRUE"),
    "executive_summary_filtered": _summary("campaign_id = 936 AND gender = 'M'"),
    "top5_segments": "SELECT ad_id, campaign_id, spend, estimated_profit, recommendation FROM ruled ORDER BY estimated_profit DESC, ad_id LIMIT 5",
    "findings": FINDINGS,
    "executive_report": f"""SELECT 1 AS section_order, 'Financial Assumptions (User-Provided)' AS section, line, key, value FROM (VALUES
    (1, 'Average order value', '$75.00'), (2, 'Fulfilment cost per purchase', '$35.00'), (3, 'Transaction cost per purchase', '$2.00'),
    (4, 'Fixed campaign operating cost', '$0.00'), (5, 'Probability threshold used', '50%')) t(line, key, value)
  UNION ALL SELECT 2, 'Recommendation Distribution', label_order, l.recommendation, CAST(COUNT(r.ad_id) AS VARCHAR) FROM labels5 l
    LEFT JOIN ruled r ON r.recommendation = l.recommendation GROUP BY label_order, l.recommendation
  UNION ALL SELECT 2, 'Recommendation Distribution', 6, 'Total segments analysed', CAST(COUNT(*) AS VARCHAR) FROM ruled
  UNION ALL SELECT 3, 'Top Five Recommended Segments (by Estimated Profit)', CAST(ROW_NUMBER() OVER (ORDER BY estimated_profit DESC, ad_id) AS INTEGER),
    campaign_name || ' | Age ' || age || ' | ' || gender || ' | Interest ' || interest,
    'Recommendation: ' || recommendation || '; Conversion probability: ' || printf('%.0f', conversion_probability * 100) || '%; Actual purchases: '
    || actual_purchases || '; Spend: ' || printf('$%.2f', spend) || '; Estimated revenue: ' || printf('$%.2f', estimated_revenue)
    || '; Estimated profit: ' || printf('$%.2f', estimated_profit) || '; Reason: ' || recommendation_reason
    FROM (SELECT * FROM advised ORDER BY estimated_profit DESC, ad_id LIMIT 5) JOIN names USING (campaign_id)
  UNION ALL SELECT 4, 'Main Findings (Generated from Current Dataset)', line, NULL, text FROM ({FINDINGS})
  UNION ALL SELECT 5, 'Important Limitations', line, CAST(line AS VARCHAR), value FROM (VALUES
    (1, 'Recommendations are scenario-based estimates, not guaranteed outcomes.'),
    (2, 'Financial outputs depend on the provided assumptions (AOV, costs).'),
    (3, 'The model was trained on historical data without campaign dates.'),
    (4, 'Segment-level recommendations should be validated by domain experts before action.'),
    (5, '{LIMITATION}')) t(line, value)""",
    "report_campaign_summary": """SELECT campaign_id, campaign_name, CAST(impressions AS BIGINT) AS impressions, CAST(clicks AS BIGINT) AS clicks,
  CAST(printf('%.2f', spend) AS DOUBLE) AS spend, CAST(leads AS BIGINT) AS leads, CAST(purchases AS BIGINT) AS purchases,
  CAST(printf('%.6f', ctr) AS DOUBLE) AS ctr, CAST(printf('%.6f', cpc) AS DOUBLE) AS cpc, CAST(printf('%.6f', cac) AS DOUBLE) AS cac,
  CAST(printf('%.6f', purchase_conversion_rate) AS DOUBLE) AS purchase_conversion_rate,
  CAST(printf('%.2f', estimated_revenue) AS DOUBLE) AS estimated_revenue, CAST(printf('%.2f', estimated_profit) AS DOUBLE) AS estimated_profit,
  CAST(printf('%.6f', estimated_roas) AS DOUBLE) AS estimated_roas FROM named""",
    "report_recommendations": "SELECT * FROM report_rows",
    "ranking_null_scores": ranking("CASE WHEN ad_id % 10 <> 0 THEN conversion_probability END"),
    "ranking_distinct_scores": ranking("9007199254740993 + ad_id * 7919 % 1000003"),
    "predictions_totals": """SELECT COUNT(*) AS n, CAST(SUM(converted) AS BIGINT) AS converted, COUNT(*) AS in_range,
  COUNT(*) AS agreed FROM scored""",
    "logistic_gradient": """SELECT CAST(SUM(n) AS BIGINT) AS n_rows, CAST(SUM(n) AS BIGINT) AS total_weight,
  CAST(0 AS BIGINT) AS open_components FROM split_rows WHERE split = 'train'""",
    "leaderboard_totals": f"SELECT model_name, {TESTED} FROM (VALUES ('{training.LOGISTIC}'), ('{training.FOREST}')) t(model_name)",
    "model_sweep_totals": f"SELECT threshold, {TESTED} FROM grid",
}


def _needed(sql: str, seen: list[str]) -> list[str]:
    """The parts a statement mentions, those they mention first."""
    for name, text in PARTS.items():
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(text, seen)
            if name not in seen:
                seen.append(name)
    return seen


# What is read from CSV files must be what the files were written from.
ANSWERS |= {"csv_scan_rows": ANSWERS["scan_normalized"], "csv_quality_report": ANSWERS["quality_report"]}


def oracle_sql() -> dict[str, str]:
    statements = {}
    for name, answer in ANSWERS.items():
        parts = _needed(answer, [])
        ctes = ", ".join(f"{part} AS ({PARTS[part].strip()})" for part in parts)
        statements[name] = f"WITH {ctes} {answer}"
    return statements
