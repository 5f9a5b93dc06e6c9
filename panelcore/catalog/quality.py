"""Coverage, gaps, outliers, filling and flags, on sparse and dense panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcore.catalog.base import (
    EDGES,
    FLAGS,
    LONG,
    RUNS,
    VARIABLES,
    WEEKS,
    customer_panel,
    customers,
    nation_panel,
    pick,
    query,
    weekly,
)
from panelcore.catalog.sources import boundary_affected
from panelcore.operators import quality
from panelcore.params import QualityParams

FILLED = ["avg_price", "max_price"]
PARAMS = QualityParams(fill_variables=tuple(FILLED), max_gap=2)

REPORT = FLAGS + RUNS + """,
longest AS (SELECT entity, variable, max(gap_length) AS longest FROM runs GROUP BY 1, 2),
report AS (
  SELECT f.entity, f.variable, count(*) AS n_expected, count(value) AS n_present,
         count(value) / count(*) AS coverage, count(*) - count(value) AS n_missing,
         coalesce(max(longest), 0) AS longest_missing_run,
         min(period) FILTER (value IS NOT NULL) AS first_valid,
         max(period) FILTER (value IS NOT NULL) AS last_valid,
         count(*) FILTER (is_outlier) AS n_outliers,
         CASE WHEN count(value) > 0 THEN count(*) FILTER (is_outlier) / count(value)
              ELSE 0 END AS pct_outliers
  FROM flags f LEFT JOIN longest USING (entity, variable) GROUP BY 1, 2)"""
REPORT_COLUMNS = pick(
    "entity variable #n_expected #n_present ~coverage #n_missing #longest_missing_run "
    "first_valid last_valid #n_outliers ~pct_outliers", "FROM report")


@query("quality_report", weekly(REPORT + " " + REPORT_COLUMNS))
def quality_report(spark, d):
    return quality.quality_report(nation_panel(spark, d, WEEKS), VARIABLES, 5.0)


@query("quality_report_customers", customers(REPORT + " " + REPORT_COLUMNS))
def quality_report_customers(spark, d):
    return quality.quality_report(customer_panel(spark, d), VARIABLES, 5.0)


@query("longest_missing_run", weekly(LONG + RUNS + """
SELECT l.entity, l.variable, CAST(coalesce(max(gap_length), 0) AS BIGINT) AS longest_missing_run
FROM (SELECT DISTINCT entity, variable FROM long) l LEFT JOIN runs USING (entity, variable)
GROUP BY 1, 2"""))
def longest_missing_run(spark, d):
    return quality.longest_run(quality.melt(nation_panel(spark, d, WEEKS), VARIABLES))


@query("long_gaps", weekly(LONG + RUNS + """
SELECT entity, variable, start, "end", gap_length FROM runs WHERE gap_length > 2"""))
def long_gaps(spark, d):
    return quality.long_gaps(nation_panel(spark, d, WEEKS), VARIABLES, 2)


@query("mad_outliers", customers(FLAGS + " " + pick(
    "entity period variable ~value is_outlier", "FROM flags")))
def mad_outliers(spark, d):
    return quality.mad_outliers(quality.melt(customer_panel(spark, d), VARIABLES), 5.0)


def _fill_sql(share: str, tie: bool = False) -> str:
    """Short inner gaps of two variables filled; ``share`` places a row in its gap."""
    edges = "".join(
        f""",
         last_value(CASE WHEN {v} IS NOT NULL THEN {x} END IGNORE NULLS) OVER back AS {n}p_{v},
         last_value(CASE WHEN {v} IS NOT NULL THEN {x} END IGNORE NULLS) OVER ahead AS {n}n_{v}"""
        for v in FILLED for n, x in (("x", v), ("i", "i"), ("t", "period"))
    )
    out = ""
    for v in FILLED:
        s = share.format(v=v)
        value = (f"CASE WHEN {s} <= 0.5 THEN xp_{v} ELSE xn_{v} END" if tie
                 else f"xp_{v} + (xn_{v} - xp_{v}) * ({s})")
        short = f"{v} IS NULL AND coalesce(in_{v} - ip_{v} - 1 <= 2, false)"
        out += f""",
         CASE WHEN {short} THEN {value} ELSE {v} END AS f_{v}, {short} AS {v}_interpolated"""
    return f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period) AS i FROM panel),
edged AS (
  SELECT *{edges}
  FROM numbered WINDOW
    back AS (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING),
    ahead AS (PARTITION BY entity ORDER BY period DESC ROWS UNBOUNDED PRECEDING)),
filled AS (SELECT *{out} FROM edged)"""


LINEAR = _fill_sql("(i - ip_{v}) / (in_{v} - ip_{v})")
TIME = _fill_sql("date_diff('day', tp_{v}, period) / date_diff('day', tp_{v}, tn_{v})")
NEAREST = _fill_sql("(i - ip_{v}) / (in_{v} - ip_{v})", tie=True)
FILL_COLUMNS = (
    " SELECT entity, period, avg_price_interpolated, max_price_interpolated, "
    "CAST(round(CAST(f_avg_price AS DECIMAL(38,9)), 6) AS DOUBLE) AS avg_price, "
    "CAST(round(CAST(f_max_price AS DECIMAL(38,9)), 6) AS DOUBLE) AS max_price FROM filled"
)


def _interpolated(spark, d, method: str):
    panel = nation_panel(spark, d, WEEKS)
    return quality.interpolate_short_gaps(panel, FILLED, method, 2).select(
        "entity", "period", "avg_price", "max_price", "avg_price_interpolated",
        "max_price_interpolated")


@query("interpolate_linear", weekly(LINEAR + FILL_COLUMNS))
def interpolate_linear(spark, d):
    return _interpolated(spark, d, "linear")


@query("interpolate_time", weekly(TIME + FILL_COLUMNS))
def interpolate_time(spark, d):
    return _interpolated(spark, d, "time")


@query("interpolate_nearest", weekly(NEAREST + FILL_COLUMNS))
def interpolate_nearest(spark, d):
    return _interpolated(spark, d, "nearest")


CLEAN = FLAGS + LINEAR + """,
any_out AS (
  SELECT entity, period, bool_or(is_outlier) AS o, count(*) FILTER (is_outlier) AS n_out
  FROM flags GROUP BY 1, 2),
cleaned AS (
  SELECT f.entity, f.period, f.orders, f_avg_price AS avg_price, f_max_price AS max_price,
         avg_price_interpolated, max_price_interpolated, n_out,
         CASE WHEN f.orders IS NULL OR f_avg_price IS NULL OR f_max_price IS NULL THEN 'missing'
              WHEN o THEN 'outlier'
              WHEN avg_price_interpolated OR max_price_interpolated THEN 'interpolated'
              ELSE 'ok' END AS data_quality
  FROM filled f JOIN any_out USING (entity, period))"""
CLEAN_COLUMNS = " " + pick(
    "entity period ~orders ~avg_price ~max_price avg_price_interpolated max_price_interpolated "
    "data_quality", "FROM cleaned")


def _cleaned(panel):
    return quality.clean(panel, VARIABLES, PARAMS).select(
        "entity", "period", *VARIABLES, *[f"{v}_interpolated" for v in FILLED], "data_quality")


@query("clean_panel", weekly(CLEAN + CLEAN_COLUMNS))
def clean_panel(spark, d):
    return _cleaned(nation_panel(spark, d, WEEKS))


@query("clean_panel_customers", customers(CLEAN + CLEAN_COLUMNS))
def clean_panel_customers(spark, d):
    return _cleaned(customer_panel(spark, d))


@query("clean_report", weekly(CLEAN + """
SELECT CAST(sum(avg_price_interpolated::INT + max_price_interpolated::INT) AS BIGINT)
         AS n_interpolated,
       CAST(sum((orders IS NULL)::INT + (avg_price IS NULL)::INT + (max_price IS NULL)::INT)
            AS BIGINT) AS n_still_missing,
       CAST(sum(n_out) AS BIGINT) AS n_outliers
FROM cleaned"""))
def clean_report(spark, d):
    cleaned = quality.clean(nation_panel(spark, d, WEEKS), VARIABLES, PARAMS)
    return quality.clean_report(cleaned, VARIABLES, FILLED)


@query("worst_gaps", weekly(LONG + RUNS + """
SELECT entity, variable, start, "end", gap_length FROM runs WHERE gap_length > 2
ORDER BY gap_length DESC, entity, variable, start LIMIT 3"""))
def worst_gaps(spark, d):
    return quality.worst_gaps(nation_panel(spark, d, WEEKS), VARIABLES, 2)


SUMMARY = """,
per AS (
  SELECT entity, count(*) AS c, count(DISTINCT period) AS p, min(period) AS a, max(period) AS b,
         count(orders) + count(avg_price) + count(max_price) AS present
  FROM panel GROUP BY 1)"""


@query("panel_summary", weekly(SUMMARY + EDGES + """,
ev AS (
  SELECT n_name AS entity, CAST(arg_max(o_orderdate, (o_totalprice, o_orderkey)) AS DATE) AS effective
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1),
hit AS (SELECT entity, neighbour FROM ev JOIN pairs USING (entity)
        WHERE effective BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
          AND neighbour IS NOT NULL),
marked AS (SELECT entity FROM hit UNION SELECT neighbour FROM hit)
SELECT count(*) AS n_entities, CAST(sum(c) AS BIGINT) AS n_rows, max(p) AS periods_per_entity,
       min(a) AS first_period, max(b) AS last_period, CAST(3 AS BIGINT) AS n_variables,
       CAST(round(CAST(sum(present) / (sum(c) * 3) AS DECIMAL(38,9)), 6) AS DOUBLE)
         AS overall_coverage,
       count(*) FILTER (present / (c * 3) < 0.8) AS n_low_coverage,
       count(m.entity) AS n_boundary_affected, max(p) < 80 AS pooling_required
FROM per LEFT JOIN marked m ON m.entity = per.entity"""))
def panel_summary(spark, d):
    return quality.summarise(nation_panel(spark, d, WEEKS), VARIABLES, PARAMS,
                             boundary_affected(spark, d))


@query("low_coverage", customers(REPORT + """,
cov AS (SELECT entity, avg(coverage) AS coverage FROM report GROUP BY 1) """ + pick(
    "entity ~coverage", "FROM cov WHERE coverage < 0.12")))
def low_coverage(spark, d):
    report = quality.quality_report(customer_panel(spark, d), VARIABLES, 5.0)
    return quality.low_coverage(report, 0.12)


@query("quality_counts", weekly(CLEAN + """
SELECT data_quality, count(*) AS n FROM cleaned GROUP BY 1"""))
def quality_counts(spark, d):
    return _cleaned(nation_panel(spark, d, WEEKS)).groupBy("data_quality").agg(
        F.count(F.lit(1)).alias("n"))
