"""Thresholds, tiers, evidence and alerts on the persistence forecast."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from panelcore.catalog.base import TARGET, monthly, nation_levels, pick, query, staged_panel
from panelcore.catalog.forecasts import FORECASTS, RISK, naive_forecasts, naive_model
from panelcore.functions.scalars import inverse_target
from panelcore.operators import risk

POINT = dataclasses.replace(RISK, alert_on="point")

BOUNDS = """,
q AS (
  SELECT entity, quantile_cont(target_level, 0.75) AS q1, quantile_cont(target_level, 0.9) AS q2,
         count(target_level) AS n
  FROM levels GROUP BY 1 HAVING count(target_level) > 0),
bounds AS (
  SELECT entity, 1 AS tier_index, 'MEDIUM' AS tier, q1 AS value_log,
         greatest(exp(q1) - 1, 0) AS value_rate, '75% historical percentile' AS label,
         n AS n_observations FROM q
  UNION ALL SELECT entity, 2, 'HIGH', q2, greatest(exp(q2) - 1, 0),
         '90% historical percentile', n FROM q)"""


def advice_sql(trigger: str) -> str:
    return FORECASTS + BOUNDS + f""",
tiered AS (
  SELECT f.*, {trigger} AS trigger_log, greatest(exp({trigger}) - 1, 0) AS trigger_rate,
         CASE WHEN {trigger} >= q2 AND q2 > q1 THEN 2 WHEN {trigger} >= q1 THEN 1 ELSE 0 END
           AS tier_index
  FROM forecasts f JOIN q USING (entity)),
advice AS (
  SELECT t.*, ['LOW', 'MEDIUM', 'HIGH'][t.tier_index + 1] AS tier, b.value_rate AS threshold_rate,
         coalesce(b.label, 'below the lowest threshold') AS threshold_label, b.n_observations,
         ['Keep routine monitoring', 'Review stock levels; Brief regional staff',
          'Escalate to the duty lead; Report daily until the alert clears'][t.tier_index + 1]
           AS actions
  FROM tiered t LEFT JOIN bounds b ON b.entity = t.entity AND b.tier_index = t.tier_index)"""


ADVICE = advice_sql("upper_log")
BOUND_COLUMNS = pick("entity #tier_index tier ~value_log ~value_rate label #n_observations",
                     "FROM bounds")


@query("quantile_thresholds", monthly(BOUNDS + " " + BOUND_COLUMNS))
def quantile_thresholds(spark, d):
    return bounds(spark, d)


def bounds(spark, d):
    return risk.thresholds(nation_levels(spark, d), RISK, TARGET.transform)


@query("ewma_thresholds", monthly(""",
series AS (SELECT entity, target_level AS x,
                  row_number() OVER (PARTITION BY entity ORDER BY period) AS i
           FROM levels WHERE target_level IS NOT NULL),
smooth AS (
  SELECT entity, i, x, x AS y FROM series WHERE i = 1
  UNION ALL
  SELECT s.entity, s.i, s.x, 0.3 * s.x + 0.7 * m.y
  FROM smooth m JOIN series s ON s.entity = m.entity AND s.i = m.i + 1),
e AS (SELECT entity, arg_max(y, i) AS centre, stddev_samp(x - y) AS sd, count(*) AS n
      FROM smooth GROUP BY 1 HAVING count(*) >= 2),
bounds AS (
  SELECT entity, k AS tier_index, ['MEDIUM', 'HIGH'][k] AS tier, centre + k * 2.0 * sd AS value_log,
         greatest(exp(centre + k * 2.0 * sd) - 1, 0) AS value_rate,
         'EWMA + ' || (2 * k) || ' sigma' AS label, n AS n_observations
  FROM e, (VALUES (1), (2)) t(k)) """ + BOUND_COLUMNS))
def ewma_thresholds(spark, d):
    p = dataclasses.replace(RISK, method="ewma")
    return risk.thresholds(nation_levels(spark, d), p, TARGET.transform)


def advice(spark, d, p=RISK):
    return risk.recommend(naive_forecasts(spark, d), bounds(spark, d), p, TARGET.transform)


EVIDENCE = pick(
    "entity origin_date target_date ~predicted_rate ~lower_rate ~upper_rate tier #tier_index "
    "~trigger_log ~trigger_rate trigger_basis ~threshold_rate threshold_label #n_observations "
    "drivers actions", "FROM (SELECT *, {drivers} AS drivers, '{basis}' AS trigger_basis FROM advice)")
# The persistence forecast moves with one column, unless its level is the mean level.
DRIVERS = """CASE WHEN predicted_log <> (SELECT avg(l0) FROM origins) THEN 'case rate (current)' ELSE '' END"""


def evidence_sql(basis: str, drivers: str = "''") -> str:
    return EVIDENCE.replace("{basis}", basis).replace("{drivers}", drivers)


def driven_advice(spark, d):
    """Recommendations with the columns behind each forecast."""
    panel = staged_panel(spark, d)
    model = naive_model(spark, d, panel)
    return risk.recommend(model.predict(panel), bounds(spark, d), RISK, TARGET.transform,
                          drivers=model.drivers(panel))


@query("recommendations", monthly(ADVICE + " " + evidence_sql("80% interval upper bound", DRIVERS)))
def recommendations(spark, d):
    return risk.evidence(driven_advice(spark, d))


@query("recommendations_on_point", monthly(
    advice_sql("predicted_log") + " " + evidence_sql("point forecast")))
def recommendations_on_point(spark, d):
    return risk.evidence(advice(spark, d, POINT))


@query("assigned_tiers", monthly(ADVICE + """
SELECT entity, tier, count(*) AS n FROM advice GROUP BY 1, 2"""))
def assigned_tiers(spark, d):
    rows = risk.assign_tier(naive_forecasts(spark, d), bounds(spark, d), F.col("upper_log"), RISK)
    return rows.groupBy("entity", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("attached_actions", monthly(ADVICE + """
SELECT tier, actions, count(*) AS n FROM advice GROUP BY 1, 2"""))
def attached_actions(spark, d):
    return advice(spark, d).groupBy("tier", F.array_join("actions", "; ").alias("actions")).agg(
        F.count(F.lit(1)).alias("n"))


@query("alert_summary", monthly(ADVICE + """,
tiers(tier_index, tier, nominal_share) AS (VALUES (0, 'LOW', 0.75), (1, 'MEDIUM', 0.15),
                                                  (2, 'HIGH', 0.1)),
c AS (SELECT tier, count(*) AS c FROM advice GROUP BY 1),
s AS (SELECT t.tier_index, t.tier, coalesce(c, 0) AS count,
             coalesce(c, 0) / (SELECT sum(c) FROM c) AS realised_share, nominal_share
      FROM tiers t LEFT JOIN c USING (tier)),
r AS (SELECT *, realised_share / nominal_share AS ratio FROM s) """ + pick(
    "#tier_index tier #count ~realised_share ~nominal_share ~ratio", "FROM r")))
def alert_summary(spark, d):
    return risk.alert_summary(advice(spark, d), RISK)


def _one_decimal(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,9)), 1) AS DECIMAL(38,1))"


SENTENCE = f""",
sentences AS (
  SELECT *, tier || ' - predicted ' || {_one_decimal('predicted_rate')} ||
         ' cases per 100k (80% interval upper bound ' || {_one_decimal('upper_rate')} || ')' ||
         CASE WHEN tier_index > 0
              THEN ', above the ' || threshold_label || ' of ' || {_one_decimal('threshold_rate')}
                   || ' for ' || entity || ' (n=' || n_observations || ')'
              ELSE ', below the lowest threshold for ' || entity END ||
         '. Actions: ' || actions || '.' AS sentence
  FROM advice)"""


@query("rendered_sentences", monthly(ADVICE + SENTENCE + """
SELECT entity, origin_date, sentence FROM sentences"""))
def rendered_sentences(spark, d):
    return risk.render_all(advice(spark, d)).select("entity", "origin_date", "sentence")


@query("rendered_with_drivers", monthly(ADVICE + SENTENCE.replace(
    "'. Actions: '", f"""'.' || CASE WHEN {DRIVERS} <> '' THEN ' Top drivers: ' || {DRIVERS} || '.'
              ELSE '' END || ' Actions: '""") + """
SELECT entity, origin_date, sentence FROM sentences"""))
def rendered_with_drivers(spark, d):
    return risk.render_all(driven_advice(spark, d)).select("entity", "origin_date", "sentence")


@query("top_alerts", monthly(ADVICE + " " + pick(
    "entity origin_date tier ~trigger_log",
    "FROM advice WHERE tier_index > 0 ORDER BY trigger_log DESC, entity, origin_date LIMIT 10")))
def top_alerts(spark, d):
    return risk.top_alerts(advice(spark, d), 10).select(
        "entity", "origin_date", "tier", "trigger_log")


@query("current_tiers", monthly(BOUNDS + """,
newest AS (
  SELECT entity, arg_max(period, period) AS period, arg_max(target_level, period) AS level
  FROM levels WHERE target_level IS NOT NULL GROUP BY 1),
t AS (SELECT n.entity, period, greatest(exp(level) - 1, 0) AS rate,
             CASE WHEN level >= q2 AND q2 > q1 THEN 'HIGH' WHEN level >= q1 THEN 'MEDIUM'
                  ELSE 'LOW' END AS tier
      FROM newest n JOIN q USING (entity)) """ + pick("entity period ~rate tier", "FROM t")))
def current_tiers(spark, d):
    """Facts to decision: where each entity's newest observation stands."""
    levels = nation_levels(spark, d).where("target_level is not null")
    newest = levels.groupBy("entity").agg(
        F.max("period").alias("period"), F.max_by("target_level", "period").alias("level"))
    tiers = risk.assign_tier(newest, bounds(spark, d), F.col("level"), RISK)
    rate = inverse_target(F.col("level"), TARGET.transform)
    return tiers.select("entity", "period", rate.alias("rate"), "tier")
