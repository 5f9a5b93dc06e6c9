"""Counterfactuals on the panel and their effect on the forecast."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from panelcore.catalog.base import MONTHS, monthly, nation_panel, pick, query, staged_panel
from panelcore.catalog.forecasts import FORECASTS, naive_model
from panelcore.operators import whatif
from panelcore.params import ClampParams, Scenario

MORE = Scenario("orders", 60.0, "percent", date(1999, 1, 1), date(2000, 12, 31))
CHEAPER = Scenario("max_price", -50_000.0, "absolute", date(1997, 1, 1), None)
SIGMA, MINMAX = ClampParams("sigma", 2.0), ClampParams("minmax")

_RANGE = {
    "sigma": "avg({v}) - 2 * stddev_samp({v}) AS low, avg({v}) + 2 * stddev_samp({v}) AS high",
    "minmax": "min({v}) AS low, max({v}) AS high",
}


def changed_sql(variable: str, wanted: str, touched: str, strategy: str) -> str:
    span = _RANGE[strategy].format(v=variable)
    return f""",
span AS (SELECT entity, {span} FROM panel GROUP BY 1),
held AS (
  SELECT p.*, {touched} AS touched, {wanted} AS wanted,
         CASE WHEN {variable} IS NOT NULL THEN
           least(greatest({wanted}, least(low, {variable})), greatest(high, {variable})) END AS held
  FROM panel p JOIN span USING (entity)),
changed AS (
  SELECT * REPLACE (CASE WHEN touched THEN held ELSE {variable} END AS {variable}),
         touched AND coalesce(abs(held - wanted) > 1e-8 + 1e-5 * abs(wanted), false) AS clamped
  FROM held)"""


MORE_SQL = changed_sql("orders", "orders * 1.6",
                       "period BETWEEN DATE '1999-01-01' AND DATE '2000-12-31'", "sigma")
CHEAPER_SQL = changed_sql("max_price", "max_price - 50000", "period >= DATE '1997-01-01'", "minmax")
CHANGED = pick("entity period ~orders ~avg_price ~max_price touched clamped", "FROM changed")


def _changed(spark, d, s, c):
    return whatif.apply_scenario(nation_panel(spark, d), s, c).drop("exposure")


@query("apply_scenario_percent", monthly(MORE_SQL + " " + CHANGED))
def apply_scenario_percent(spark, d):
    return _changed(spark, d, MORE, SIGMA)


@query("apply_scenario_absolute", monthly(CHEAPER_SQL + " " + CHANGED))
def apply_scenario_absolute(spark, d):
    return _changed(spark, d, CHEAPER, MINMAX)


@query("scenario_mask", monthly(MORE_SQL + """
SELECT entity, count(*) FILTER (touched) AS n_touched, count(*) FILTER (NOT touched) AS n_other
FROM changed GROUP BY 1"""))
def scenario_mask(spark, d):
    mask = whatif.scenario_mask(MORE)
    return nation_panel(spark, d).groupBy("entity").agg(
        F.count_if(mask).alias("n_touched"), F.count_if(~mask).alias("n_other"))


@query("scenario_counts", monthly(MORE_SQL + """
SELECT count(*) FILTER (touched) AS n_touched, count(*) FILTER (clamped) AS n_clamped
FROM changed"""))
def scenario_counts(spark, d):
    return whatif.scenario_counts(_changed(spark, d, MORE, SIGMA))


def _span_sql(strategy: str) -> str:
    return monthly(f", span AS (SELECT entity, {_RANGE[strategy].format(v='orders')} "
                   "FROM panel GROUP BY 1) " + pick("entity ~low ~high", "FROM span"))


@query("plausible_range_sigma", _span_sql("sigma"))
def plausible_range_sigma(spark, d):
    return whatif.plausible_range(nation_panel(spark, d), "orders", SIGMA)


@query("plausible_range_minmax", _span_sql("minmax"))
def plausible_range_minmax(spark, d):
    return whatif.plausible_range(nation_panel(spark, d), "orders", MINMAX)


DELTA = FORECASTS + MORE_SQL + """,
after AS (SELECT entity, period, ln(1 + orders / exposure * 100000) AS a0 FROM changed),
delta AS (
  SELECT f.entity, origin_date, a0 - predicted_log AS delta_log,
         greatest(exp(a0) - 1, 0) - predicted_rate AS delta_rate, predicted_log AS predicted_base,
         lower_log AS lower_base, upper_log AS upper_base, a0 AS predicted_scenario,
         a0 - w AS lower_scenario, a0 + w AS upper_scenario
  FROM forecasts f JOIN after a ON a.entity = f.entity AND a.period = f.origin_date, width)"""


def _what_if(spark, d):
    panel = staged_panel(spark, d)
    model = naive_model(spark, d, panel)
    return model, *whatif.what_if(panel, MORE, model, SIGMA)


@query("what_if", monthly(DELTA + " " + pick(
    "entity origin_date ~delta_log ~delta_rate ~predicted_base ~lower_base ~upper_base "
    "~predicted_scenario ~lower_scenario ~upper_scenario", "FROM delta")))
def what_if(spark, d):
    return _what_if(spark, d)[1]


@query("what_if_summary", monthly(DELTA + """,
s AS (SELECT avg(delta_rate) AS mean_delta, max(delta_rate) AS max_delta,
             min(delta_rate) AS min_delta, count(*) AS n_forecasts FROM delta),
c AS (SELECT count(*) FILTER (touched) AS n_touched, count(*) FILTER (clamped) AS n_clamped
      FROM changed),
r AS (SELECT *, n_clamped / n_touched AS clamped_share, n_clamped > 0 AS out_of_range,
             true AS affects_model FROM s, c) """ + pick(
    "~mean_delta ~max_delta ~min_delta #n_forecasts #n_touched #n_clamped ~clamped_share "
    "out_of_range affects_model", "FROM r")))
def what_if_summary(spark, d):
    model, deltas, counts = _what_if(spark, d)
    return whatif.what_if_summary(deltas, counts, bool(model.columns_from("orders")))


BATCH = {
    "more": MORE,
    "fewer": Scenario("orders", -30.0, "percent", date(1998, 1, 1), date(1998, 6, 30),
                      ("NATION_1", "NATION_2")),
    "nowhere": Scenario("orders", 10.0, "percent", None, None, ("ATLANTIS",)),
}


def _batch_sql() -> str:
    parts = []
    for name, factor, touched in (
            ("more", 1.6, "period BETWEEN DATE '1999-01-01' AND DATE '2000-12-31'"),
            ("fewer", 0.7, "period BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' "
                           "AND entity IN ('NATION_1', 'NATION_2')")):
        body = changed_sql("orders", f"orders * {factor}", touched, "sigma").lstrip(",\n")
        parts.append(f"(WITH {body} SELECT '{name}' AS scenario, * FROM changed)")
    return FORECASTS + ", worlds AS (" + " UNION ALL ".join(parts) + """),
reach AS (SELECT scenario, entity, min(period) AS a,
                 CAST(max(period) + INTERVAL 12 MONTH AS DATE) AS z
          FROM worlds WHERE touched GROUP BY 1, 2),
after AS (SELECT scenario, entity, period, ln(1 + orders / exposure * 100000) AS a0 FROM worlds),
delta AS (
  SELECT a.scenario, f.entity, origin_date, a0 - predicted_log AS delta_log,
         greatest(exp(a0) - 1, 0) - predicted_rate AS delta_rate
  FROM forecasts f JOIN after a ON a.entity = f.entity AND a.period = f.origin_date
  JOIN reach r ON r.scenario = a.scenario AND r.entity = f.entity
  WHERE origin_date BETWEEN r.a AND r.z)"""


def _batch(spark, d):
    panel = staged_panel(spark, d)
    return whatif.what_if_batch(panel, BATCH, naive_model(spark, d, panel), SIGMA, MONTHS)


@query("what_if_batch", monthly(_batch_sql() + " " + pick(
    "scenario entity origin_date ~delta_log ~delta_rate", "FROM delta")))
def what_if_batch(spark, d):
    """Three scenarios, one rescoring of what they reach."""
    return _batch(spark, d)[0].select("scenario", "entity", "origin_date", "delta_log", "delta_rate")


@query("what_if_batch_counts", monthly(_batch_sql() + """
SELECT n.scenario, count(*) FILTER (touched) AS n_touched, count(*) FILTER (clamped) AS n_clamped
FROM (VALUES ('more'), ('fewer'), ('nowhere')) n(scenario) LEFT JOIN worlds USING (scenario)
GROUP BY 1"""))
def what_if_batch_counts(spark, d):
    return _batch(spark, d)[1]
