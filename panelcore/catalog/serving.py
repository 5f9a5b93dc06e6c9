"""Lookups a reader makes on the stored tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from panelcore.catalog.base import TARGET, monthly, nation_panel, pick, query, staged_panel
from panelcore.catalog.forecasts import (
    FORECAST_COLUMNS,
    FORECASTS,
    RISK,
    naive_model,
    served,
)
from panelcore.catalog.risk import ADVICE, BOUNDS, DRIVERS, evidence_sql
from panelcore.operators import serving
from panelcore.plans.production import load_production, save_production
from panelcore.session import scratch_path

AS_OF = date(2000, 3, 1)
UPTO = """,
upto AS (
  SELECT f.*, row_number() OVER (PARTITION BY entity ORDER BY target_date DESC) AS r
  FROM forecasts f WHERE target_date <= DATE '2000-03-01')"""


@query("latest_forecast", monthly(FORECASTS + """,
n AS (SELECT f.*, row_number() OVER (PARTITION BY entity ORDER BY origin_date DESC) AS r
      FROM forecasts f) """ + pick(FORECAST_COLUMNS, "FROM n WHERE r = 1")))
def latest_forecast(spark, d):
    return serving.latest(served(spark, d, "forecasts"))


@query("forecast_as_of", monthly(FORECASTS + UPTO + " " + pick(
    FORECAST_COLUMNS, "FROM upto WHERE r = 1")))
def forecast_as_of(spark, d):
    return serving.at_period(served(spark, d, "forecasts"), AS_OF)


@query("forecast_as_of_fallback", monthly(FORECASTS + """,
n AS (SELECT f.*, row_number() OVER (PARTITION BY entity ORDER BY origin_date DESC) AS r
      FROM forecasts f) """ + pick(FORECAST_COLUMNS, "FROM n WHERE r = 1")))
def forecast_as_of_fallback(spark, d):
    """No entity has a forecast that early, so the latest ones are returned."""
    return serving.at_period(served(spark, d, "forecasts"), date(1990, 1, 1))


@query("entity_forecasts", monthly(FORECASTS + " " + pick(
    FORECAST_COLUMNS, "FROM forecasts WHERE entity = 'NATION_3' ORDER BY origin_date")))
def entity_forecasts(spark, d):
    return serving.for_entity(served(spark, d, "forecasts", "NATION_3"), "NATION_3",
                              "origin_date")


@query("recommendation_as_of", monthly(ADVICE + " " + pick(
    "entity origin_date target_date tier ~trigger_log",
    "FROM advice WHERE entity = 'NATION_3' AND target_date <= DATE '2000-03-01' "
    "ORDER BY target_date DESC LIMIT 1")))
def recommendation_as_of(spark, d):
    rows = served(spark, d, "recommendations", "NATION_3")
    return serving.recommendation_for(rows, "NATION_3", AS_OF).select(
        "entity", "origin_date", "target_date", "tier", "trigger_log")


@query("forecast_periods", monthly(FORECASTS + " SELECT DISTINCT target_date FROM forecasts"))
def forecast_periods(spark, d):
    return serving.target_periods(served(spark, d, "forecasts"))


@query("forecast_entities", monthly(FORECASTS + " SELECT DISTINCT entity FROM forecasts"))
def forecast_entities(spark, d):
    return serving.entities(served(spark, d, "forecasts"))


@query("watchlist", monthly(FORECASTS + BOUNDS + UPTO + """,
w AS (SELECT u.entity, upper_rate AS predicted, value_rate AS threshold,
             upper_rate / value_rate - 1 AS exceedance
      FROM upto u JOIN bounds b ON b.entity = u.entity AND b.tier = 'HIGH' AND value_rate > 0
      WHERE r = 1 AND upper_rate >= value_rate) """ + pick(
    "entity ~predicted ~threshold ~exceedance", "FROM w")))
def watchlist(spark, d):
    return serving.watchlist(served(spark, d, "forecasts"), served(spark, d, "thresholds"), "HIGH",
                             AS_OF)


@query("risk_bands", monthly(FORECASTS + UPTO + """,
q AS (SELECT quantile_cont(upper_rate, [0.2, 0.4, 0.6, 0.8]) AS e FROM upto WHERE r = 1),
b AS (SELECT entity, upper_rate, (upper_rate >= e[1])::INT + (upper_rate >= e[2])::INT
             + (upper_rate >= e[3])::INT + (upper_rate >= e[4])::INT AS band
      FROM upto, q WHERE r = 1) """ + pick("entity ~upper_rate #band", "FROM b")))
def risk_bands(spark, d):
    shown = serving.at_period(served(spark, d, "forecasts"), AS_OF)
    return serving.with_bands(shown).select("entity", "upper_rate", "band")


@query("tier_of_rate", monthly(FORECASTS + BOUNDS + UPTO + """,
t AS (SELECT u.entity, predicted_rate,
             CASE WHEN predicted_rate >= greatest(exp(q2) - 1, 0) AND q2 > q1 THEN 'HIGH'
                  WHEN predicted_rate >= greatest(exp(q1) - 1, 0) THEN 'MEDIUM' ELSE 'LOW' END
               AS tier
      FROM upto u JOIN q USING (entity) WHERE r = 1) """ + pick(
    "entity ~predicted_rate tier", "FROM t")))
def tier_of_rate(spark, d):
    rows = serving.at_period(served(spark, d, "forecasts"), AS_OF)
    return serving.tier_for(rows, served(spark, d, "thresholds"), F.col("predicted_rate"), RISK).select(
        "entity", "predicted_rate", "tier")


HISTORY = """,
history AS (SELECT entity, period,
                   CASE WHEN target_level IS NOT NULL THEN greatest(exp(target_level) - 1, 0) END
                     AS actual FROM levels)"""


@query("observed_history", monthly(HISTORY + " " + pick("entity period ~actual", "FROM history")))
def observed_history(spark, d):
    return serving.observed_history(nation_panel(spark, d), TARGET)


@query("recent_window", monthly(HISTORY + """,
newest AS (SELECT DISTINCT period FROM history ORDER BY period DESC LIMIT 36) """ + pick(
    "entity period ~actual", "FROM history WHERE period IN (SELECT period FROM newest)")))
def recent_window(spark, d):
    history = serving.observed_history(nation_panel(spark, d), TARGET)
    return serving.recent_window(history)


@query("seasonality", monthly("""
SELECT month(period) AS month,
       CAST(round(CAST(avg(orders) AS DECIMAL(38,9)), 6) AS DOUBLE) AS mean_target
FROM panel GROUP BY 1"""))
def seasonality(spark, d):
    return serving.seasonality(nation_panel(spark, d), "orders")


@query("stored_serving_tables", monthly(ADVICE + HISTORY + """
SELECT 'forecasts' AS name, count(*) AS n FROM forecasts
UNION ALL SELECT 'history', count(*) FROM history
UNION ALL SELECT 'recommendations', count(*) FROM advice
UNION ALL SELECT 'thresholds', count(*) FROM bounds"""))
def stored_serving_tables(spark, d):
    counts = [
        served(spark, d, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        for name in ("forecasts", "history", "recommendations", "thresholds")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("stored_recommendations", monthly(ADVICE + " " + evidence_sql(
    "80% interval upper bound", DRIVERS)))
def stored_recommendations(spark, d):
    """Every stored recommendation, drivers included."""
    return served(spark, d, "recommendations")


@query("stored_history", monthly(HISTORY + " " + pick("entity period ~actual", "FROM history")))
def stored_history(spark, d):
    return served(spark, d, "history")


# The width at a level: the calibration sizes at rank (n - 1) * ceil((n + 1) * level) / n.
def _width_sql(name: str, level: str) -> str:
    return f""",
{name} AS (
  SELECT lo.a + (hi.a - lo.a) * (h - floor(h)) AS w
  FROM (SELECT (n - 1) * least(ceil((n + 1) * {level}::DOUBLE) / n, 1.0::DOUBLE) AS h
        FROM sized LIMIT 1)
  JOIN sized lo ON lo.i = floor(h) JOIN sized hi ON hi.i = ceil(h))"""


def _reloaded(spark, d):
    panel = staged_panel(spark, d)
    path = scratch_path(spark, "frozen")
    save_production(naive_model(spark, d, panel), path)
    return panel, load_production(spark, path)


@query("reloaded_predictions", monthly(FORECASTS + _width_sql("w80", "0.8") + _width_sql("w90", "0.9")
       + """,
again AS (
  SELECT entity, origin_date, target_date, alpha, predicted_log, predicted_log - w AS lower_log,
         predicted_log + w AS upper_log, predicted_rate,
         greatest(exp(predicted_log - w) - 1, 0) AS lower_rate,
         greatest(exp(predicted_log + w) - 1, 0) AS upper_rate
  FROM forecasts, (SELECT 0.2::DOUBLE AS alpha, w FROM w80 UNION ALL SELECT 0.1::DOUBLE, w FROM w90)) """
       + pick("~alpha " + FORECAST_COLUMNS, "FROM again")))
def reloaded_predictions(spark, d):
    """A frozen model, stored and read again, scores the panel at two interval levels."""
    panel, model = _reloaded(spark, d)
    at = [model.predict(panel, a).withColumn("alpha", F.lit(a)) for a in (0.2, 0.1)]
    return at[0].unionByName(at[1])


@query("reloaded_quantiles", monthly(FORECASTS + """,
q AS (SELECT level, quantile_cont(y - l0, level) AS shift
      FROM origins JOIN tail_axis USING (period),
           (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) v(level)
      WHERE r <= 12 AND y IS NOT NULL GROUP BY 1),
spread AS (
  SELECT entity, origin_date, target_date, level, predicted_log + shift AS quantile_log,
         greatest(exp(predicted_log + shift) - 1, 0) AS quantile_rate
  FROM forecasts, q) """.replace("quantile_cont(y - l0, level)", "CASE level "
       + " ".join(f"WHEN {q} THEN quantile_cont(y - l0, {q})" for q in (0.05, 0.5, 0.95)) + " END")
       + pick("entity origin_date target_date ~level ~quantile_log ~quantile_rate", "FROM spread")))
def reloaded_quantiles(spark, d):
    panel, model = _reloaded(spark, d)
    return model.predict_quantiles(panel, [0.05, 0.5, 0.95])
