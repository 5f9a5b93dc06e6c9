"""Normals, forward curves, reach verdicts and seasonal answers."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from panelcore.catalog.base import (
    MONTHS,
    TARGET,
    VARIABLES,
    WEEKS,
    monthly,
    nation_levels,
    nation_panel,
    observed,
    pick,
    query,
    staged_panel,
    weekly,
)
from panelcore.catalog.features import FULL, nation_edges, nation_names
from panelcore.catalog.forecasts import FORECASTS, NAIVE, naive_model
from panelcore.operators import project, seasonal
from panelcore.params import ClampParams, ProjectionParams, SeasonalParams
from panelcore.plans.production import Setting, train_production
from panelcore.session import cut_lineage

ALL = [*VARIABLES, "exposure"]
PROJECTION = ProjectionParams(max_recursive_steps=6)
SEASONAL = SeasonalParams(trailing_years=3)
CLAMP = ClampParams("sigma", 2.0)


def _normals_sql(position: str) -> str:
    return f""",
typical AS (
  SELECT entity, {position} - 1 AS position, avg(orders) AS orders, avg(avg_price) AS avg_price,
         avg(max_price) AS max_price, avg(exposure) AS exposure
  FROM panel GROUP BY 1, 2)"""


NORMAL_COLUMNS = " " + pick(
    "entity #position ~orders ~avg_price ~max_price ~exposure", "FROM typical")


@query("normals_months", monthly(_normals_sql("month(period)") + NORMAL_COLUMNS))
def normals_months(spark, d):
    return project.normals(nation_panel(spark, d), ALL, MONTHS)


@query("normals_weeks", weekly(_normals_sql("week(period)") + NORMAL_COLUMNS))
def normals_weeks(spark, d):
    return project.normals(nation_panel(spark, d, WEEKS), ALL, WEEKS)


@query("extend_panel", monthly(_normals_sql("month(period)") + """,
overall AS (SELECT entity, avg(orders) AS o, avg(avg_price) AS a, avg(max_price) AS m,
                   avg(exposure) AS e FROM panel GROUP BY 1),
future AS (
  SELECT entity, CAST(unnest(generate_series(TIMESTAMP '2001-09-01', TIMESTAMP '2001-11-01',
                                             INTERVAL 1 MONTH)) AS DATE) AS period FROM people),
ext AS (
  SELECT entity, period, orders, avg_price, max_price, exposure FROM panel
  UNION ALL
  SELECT f.entity, f.period, coalesce(orders, o), coalesce(avg_price, a), coalesce(max_price, m),
         coalesce(exposure, e)
  FROM future f LEFT JOIN typical t ON t.entity = f.entity AND t.position = month(f.period) - 1
  JOIN overall v ON v.entity = f.entity) """ + pick(
    "entity period ~orders ~avg_price ~max_price ~exposure", "FROM ext")))
def extend_panel(spark, d):
    return project.extend_panel(nation_panel(spark, d), ALL, 3, MONTHS)


ENDS = """,
ends AS (
  SELECT entity, min(period) AS first_period,
         max(period) FILTER (orders IS NOT NULL) AS last_observed
  FROM panel GROUP BY 1 HAVING max(period) FILTER (orders IS NOT NULL) IS NOT NULL)"""


@query("project_direct", monthly(FORECASTS + ENDS + " " + pick(
    "entity origin_date target_date ~predicted_rate ~lower_rate ~upper_rate",
    "FROM forecasts JOIN ends USING (entity) "
    "WHERE target_date > last_observed AND origin_date <= last_observed")))
def project_direct(spark, d):
    panel = staged_panel(spark, d)
    rows = project.project_direct(panel, naive_model(spark, d, panel), "orders")
    return rows.select("entity", "origin_date", "target_date", "predicted_rate", "lower_rate",
                       "upper_rate")


# Persistence fed with its own output: the clamped count of the last observation, carried on.
# A step needs the lags 11 and 12 of its origin, which are observed or fed back themselves.
RECURSIVE = FORECASTS + ENDS + """,
span AS (SELECT entity, avg(orders) - 2 * stddev_samp(orders) AS low,
                avg(orders) + 2 * stddev_samp(orders) AS high FROM panel GROUP BY 1),
start AS (
  SELECT e.entity, last_observed, f.predicted_log AS l, p.exposure, low, high
  FROM ends e JOIN forecasts f ON f.entity = e.entity AND f.origin_date = last_observed
  JOIN panel p ON p.entity = e.entity AND p.period = last_observed
  JOIN span s ON s.entity = e.entity),
walk AS (
  SELECT entity, last_observed, exposure, low, high, 1 AS step, l FROM start
  UNION ALL
  SELECT w.entity, w.last_observed, w.exposure, low, high, step + 1,
         ln(1 + least(greatest(greatest(exp(l) - 1, 0) * w.exposure / 100000, low), high)
                / w.exposure * 100000)
  FROM walk w
  JOIN levels a ON a.entity = w.entity AND a.target_level IS NOT NULL
    AND a.period = CAST(w.last_observed + (step - 11) * INTERVAL 1 MONTH AS DATE)
  JOIN levels b ON b.entity = w.entity AND b.target_level IS NOT NULL
    AND b.period = CAST(w.last_observed + (step - 12) * INTERVAL 1 MONTH AS DATE)
  WHERE step < 7),
curve AS (
  SELECT entity, CAST(last_observed + step * INTERVAL 1 MONTH AS DATE) AS target_date,
         step AS steps_ahead, greatest(exp(l) - 1, 0) AS predicted_rate,
         CASE WHEN step = 1 THEN greatest(exp(l - w) - 1, 0)
              ELSE greatest(greatest(exp(l) - 1, 0)
                   - (greatest(exp(l + w) - 1, 0) - greatest(exp(l) - 1, 0)) * sqrt(step), 0) END
           AS lower_rate,
         CASE WHEN step = 1 THEN greatest(exp(l + w) - 1, 0)
              ELSE greatest(exp(l) - 1, 0)
                   + (greatest(exp(l + w) - 1, 0) - greatest(exp(l) - 1, 0)) * sqrt(step) END
           AS upper_rate,
         CASE WHEN step = 1 THEN 'direct' ELSE 'recursive' END AS mode,
         1 - (step - 1) / 7.0 AS reliability
  FROM walk, width)"""


CURVE_COLUMNS = ("entity target_date #steps_ahead ~predicted_rate ~lower_rate ~upper_rate mode "
                 "~reliability")


@query("project_recursive", monthly(RECURSIVE + " " + pick(CURVE_COLUMNS, "FROM curve")))
def project_recursive(spark, d):
    panel = staged_panel(spark, d)
    model = naive_model(spark, d, panel)
    return project.project_recursive(panel, ALL, model, TARGET, MONTHS, CLAMP, PROJECTION)


# One entity stops reporting years before the others; its curve starts at its own end.
STALE = "entity = 'FRANCE' AND period > DATE '1998-06-01'"


@query("project_recursive_stale", monthly("").replace("levels AS (", f"""full_panel AS (SELECT * FROM panel),
stale_panel AS (SELECT * REPLACE (CASE WHEN NOT ({STALE}) THEN orders END AS orders) FROM full_panel),
levels AS (""").replace("orders / exposure * 100000) AS target_level FROM panel",
                        "orders / exposure * 100000) AS target_level FROM stale_panel")
       + RECURSIVE.replace("FROM panel", "FROM stale_panel").replace("JOIN panel p", "JOIN stale_panel p")
       + " " + pick(CURVE_COLUMNS, "FROM curve"))
def project_recursive_stale(spark, d):
    panel = staged_panel(spark, d).withColumn("orders", F.when(~F.expr(STALE), F.col("orders")))
    model = naive_model(spark, d, panel)
    return project.project_recursive(panel, ALL, model, TARGET, MONTHS, CLAMP, PROJECTION)


@query("project_to_asked", monthly(RECURSIVE + """,
asked AS (SELECT entity, CAST(last_observed + k * INTERVAL 1 MONTH AS DATE) AS asked
          FROM ends, (VALUES (0), (1), (4), (30)) t(k)),
answered AS (
  SELECT c.*, asked, last_observed, CAST(last_observed + INTERVAL 1 MONTH AS DATE) AS direct_until,
         asked > CAST(last_observed + INTERVAL 7 MONTH AS DATE) AS truncated
  FROM asked JOIN ends USING (entity) JOIN curve c USING (entity) WHERE target_date <= asked) """
                                   + pick("asked last_observed direct_until truncated " + CURVE_COLUMNS,
                                          "FROM answered")))
def project_to_asked(spark, d):
    """Asked for the last observed month, and 1, 4 and 30 months later."""
    panel = staged_panel(spark, d)
    ends = project.last_observed(panel, TARGET.target)
    shifts = F.explode(F.array(*map(F.lit, (0, 1, 4, 30))))
    requests = ends.select("entity", "last_observed", shifts.alias("k")).select(
        "entity", F.add_months("last_observed", F.col("k")).alias("asked"))
    model = naive_model(spark, d, panel)
    return project.project_to(panel, requests, ALL, model, TARGET, MONTHS, CLAMP, PROJECTION)


# The same recursion on weeks: lags 51 and 52, and steps of seven days.
_WEEKLY = (("lag(target_level, 12)", "lag(target_level, 52)"), ("lag(target_level, 11)", "lag(target_level, 51)"),
           ("step - 11", "step - 51"), ("step - 12", "step - 52"), ("INTERVAL 1 MONTH", "INTERVAL 7 DAY"))


def weekly_sql(text: str) -> str:
    for a, b in _WEEKLY:
        text = text.replace(a, b)
    return text


@query("project_recursive_weeks", weekly(weekly_sql(RECURSIVE) + " " + pick(CURVE_COLUMNS, "FROM curve")))
def project_recursive_weeks(spark, d):
    panel = cut_lineage(nation_panel(spark, d, WEEKS))
    p = dataclasses.replace(NAIVE, lags=(52,))
    model = train_production(panel, p, 1, Setting(TARGET, WEEKS), "persistence")
    return project.project_recursive(panel, ALL, model, TARGET, WEEKS, CLAMP, PROJECTION)


@query("project_recursive_ridge")
def project_recursive_ridge(spark, d):
    panel = staged_panel(spark, d)
    model = train_production(panel, FULL, 1, Setting(TARGET, MONTHS), "ridge",
                             edges=nation_edges(spark, d), entities=nation_names(spark, d))
    return project.project_recursive(panel, ALL, model, TARGET, MONTHS, CLAMP, PROJECTION)


REQUESTS = """,
requests AS (
  SELECT DISTINCT entity, CAST(period + k * INTERVAL 1 MONTH AS DATE) AS target_date
  FROM obs, (VALUES (-12), (0), (72), (84), (400)) t(k))"""


def _requests(spark, d):
    shifts = F.explode(F.array(*map(F.lit, (-12, 0, 72, 84, 400))))
    seen = observed(spark, d, MONTHS).select("entity", "period", shifts.alias("k"))
    return seen.select("entity", F.add_months("period", F.col("k")).alias("asked")).distinct()


@query("classify_targets", monthly(ENDS + REQUESTS + """,
edges_ AS (
  SELECT r.*, first_period, last_observed,
         CAST(last_observed + INTERVAL 7 MONTH AS DATE) AS furthest_forecastable,
         CAST(last_observed + INTERVAL 24 MONTH AS DATE) AS furthest_seasonal,
         CAST(last_observed + INTERVAL 300 MONTH AS DATE) AS furthest_climatology
  FROM requests r JOIN ends USING (entity)),
v AS (
  SELECT *, CASE WHEN target_date < first_period THEN 'before_data'
                 WHEN target_date <= last_observed THEN 'historical'
                 WHEN target_date > furthest_climatology THEN 'beyond_reach'
                 WHEN target_date > furthest_seasonal THEN 'climatology'
                 WHEN target_date > furthest_forecastable THEN 'seasonal'
                 ELSE 'forecastable' END AS reach
  FROM edges_),
res AS (
  SELECT v.*, CASE WHEN reach = 'before_data' THEN 0
                   ELSE date_diff('month', last_observed, target_date) END AS steps_ahead,
         CASE WHEN reach = 'historical' AND target_level IS NOT NULL
              THEN greatest(exp(target_level) - 1, 0) END AS observed_rate
  FROM v LEFT JOIN levels l ON l.entity = v.entity AND l.period = v.target_date) """ + pick(
    "entity target_date reach last_observed furthest_forecastable furthest_seasonal "
    "furthest_climatology #steps_ahead ~observed_rate", "FROM res")))
def classify_targets(spark, d):
    return project.classify_targets(nation_panel(spark, d), _requests(spark, d), TARGET, MONTHS, 1,
                                    PROJECTION, SeasonalParams())


def profile_sql(position: str, per_year: int) -> str:
    return f""",
win AS (
  SELECT * FROM (
    SELECT entity, period, target_level AS l, {position} AS position,
           1 - row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS step
    FROM levels WHERE target_level IS NOT NULL)
  WHERE step > -{per_year * SEASONAL.trailing_years}),
cell AS (
  SELECT entity, position, avg(l) AS m, quantile_cont(l, 0.1) AS q0, quantile_cont(l, 0.9) AS q1,
         count(*) AS c
  FROM win GROUP BY 1, 2),
resid AS (SELECT w.*, l - m AS r FROM win w JOIN cell USING (entity, position)),
base AS (
  SELECT entity, avg(l) AS baseline, quantile_cont(l, 0.1) AS p0, quantile_cont(l, 0.9) AS p1,
         count(*) AS n, max(period) AS last_period,
         CASE WHEN count(*) > {per_year} THEN regr_slope(r, step) ELSE 0 END AS slope,
         CASE WHEN count(*) > {per_year} THEN avg(r) - regr_slope(r, step) * avg(step)
              ELSE avg(r) END AS level
  FROM resid GROUP BY 1)"""


SLOT = """
         coalesce(m, baseline) AS centre, coalesce(c, 0) AS observed,
         least(CASE WHEN c > 1 THEN q0 - m WHEN n > 1 THEN p0 - baseline ELSE 0 END, 0) AS low,
         greatest(CASE WHEN c > 1 THEN q1 - m WHEN n > 1 THEN p1 - baseline ELSE 0 END, 0) AS high
"""


def seasonal_sql(position: str, per_year: int, ahead: str, requests: str) -> str:
    at = position.replace("period", "target_date")
    return profile_sql(position, per_year) + f""",
asked AS ({requests}),
placed AS (
  SELECT a.entity, a.target_date, {ahead} AS ahead, b.*  EXCLUDE (entity), {at} AS slot
  FROM asked a JOIN base b USING (entity)),
slots AS (
  SELECT p.*, {SLOT}
  FROM placed p LEFT JOIN cell c ON c.entity = p.entity AND c.position = p.slot),
points AS (
  SELECT *, ahead <= 24 AS near,
         CASE WHEN ahead <= 24 AND ahead > 0 THEN slope * 0.9 * (1 - 0.9 ** ahead) / (1 - 0.9)
              ELSE 0 END AS drift
  FROM slots),
res AS (
  SELECT entity, target_date,
         greatest(exp(x) - 1, 0) AS predicted_rate, greatest(exp(x + low) - 1, 0) AS lower_rate,
         greatest(exp(x + high) - 1, 0) AS upper_rate,
         least(1, observed / {SEASONAL.trailing_years}.0) AS reliability,
         observed AS years_observed, near AS anchored,
         greatest(exp(x) - 1, 0) - greatest(exp(x - drift) - 1, 0) AS trend_shift,
         ahead AS periods_ahead
  FROM (SELECT *, centre + CASE WHEN near THEN level ELSE 0 END + drift AS x FROM points)) """ + pick(
        "entity target_date ~predicted_rate ~lower_rate ~upper_rate ~reliability #years_observed "
        "anchored ~trend_shift #periods_ahead", "FROM res")


MONTH_SLOT = "(month(period) - 1)"
WEEK_SLOT = "CAST(floor((dayofyear(period) - 1) * 52 / 366) AS INTEGER)"


@query("project_seasonal_months", monthly(seasonal_sql(
    MONTH_SLOT, 12, "date_diff('month', last_period, target_date)",
    "SELECT DISTINCT entity, CAST(period + INTERVAL 60 MONTH AS DATE) AS target_date FROM obs")))
def project_seasonal_months(spark, d):
    requests = observed(spark, d, MONTHS).select(
        "entity", F.add_months("period", 60).alias("target_date")).distinct()
    return seasonal.project_seasonal(nation_levels(spark, d), requests, MONTHS, SEASONAL, 0.2,
                                     "log1p")


@query("project_seasonal_weeks", weekly(seasonal_sql(
    WEEK_SLOT, 52, "CAST(floor(date_diff('day', last_period, target_date) / 7) AS BIGINT)",
    "SELECT DISTINCT entity, CAST(period + INTERVAL 2100 DAY AS DATE) AS target_date FROM obs")))
def project_seasonal_weeks(spark, d):
    requests = observed(spark, d, WEEKS).select(
        "entity", F.date_add("period", 2100).alias("target_date")).distinct()
    return seasonal.project_seasonal(nation_levels(spark, d, WEEKS), requests, WEEKS, SEASONAL,
                                     0.2, "log1p")


def climatology_sql(position: str, per_year: int, label: str) -> str:
    return profile_sql(position, per_year) + f""",
every AS (SELECT b.*, unnest(range({per_year})) AS slot FROM base b),
slots AS (
  SELECT p.*, {SLOT}
  FROM every p LEFT JOIN cell c ON c.entity = p.entity AND c.position = p.slot),
res AS (
  SELECT entity, slot AS position, {label} AS label, greatest(exp(centre) - 1, 0) AS predicted,
         greatest(exp(centre + low) - 1, 0) AS lower, greatest(exp(centre + high) - 1, 0) AS upper,
         observed
  FROM slots) """ + pick("entity #position label ~predicted ~lower ~upper #observed", "FROM res")


@query("climatology_months", monthly(climatology_sql(
    MONTH_SLOT, 12, "strftime(make_date(2000, CAST(slot + 1 AS INTEGER), 1), '%b')")))
def climatology_months(spark, d):
    return seasonal.climatology_year(nation_levels(spark, d), MONTHS, SEASONAL, 0.2, "log1p")


@query("climatology_weeks", weekly(climatology_sql(
    WEEK_SLOT, 52, "CAST(slot + 1 AS VARCHAR)")))
def climatology_weeks(spark, d):
    return seasonal.climatology_year(nation_levels(spark, d, WEEKS), WEEKS, SEASONAL, 0.2, "log1p")
