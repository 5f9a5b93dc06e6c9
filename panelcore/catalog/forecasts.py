"""The frozen persistence model that the decision queries share, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelcore.catalog.base import MONTHS, TARGET, staged_panel
from panelcore.params import FeatureParams, RiskParams
from panelcore.plans.production import PanelModel, Setting, build_serving, train_production
from panelcore.session import scratch_path
from panelcore.sources import runs

NAIVE = FeatureParams(include_lags=False, lags=(12,), cyclic=False, entity_identity=False,
                      sequence_length=1)
SETTING = Setting(TARGET, MONTHS)


def naive_model(spark, d, panel=None) -> PanelModel:
    panel = staged_panel(spark, d) if panel is None else panel
    return train_production(panel, NAIVE, 1, SETTING, "persistence")


def naive_forecasts(spark, d):
    panel = staged_panel(spark, d)
    return naive_model(spark, d, panel).predict(panel)


#: Where the serving tables of this session lie, by application and table folder.
_BUILT: dict[tuple[str, str], str] = {}
RISK = RiskParams()


def served(spark, d, table: str, entity: str | None = None) -> DataFrame:
    """A stored serving table. The first reader of a session builds and stores the run;
    later ones only read it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        root = scratch_path(spark, "serving")
        panel = staged_panel(spark, d)
        build_serving(panel, naive_model(spark, d, panel), RISK, root, "dashboard")
        _BUILT[key] = root
    return runs.load_run(spark, _BUILT[key], "dashboard", table, entity)


#: ``origins``: complete windows; ``width``: one row; ``forecasts``: the scored panel.
MODEL = """,
lagged AS (
  SELECT entity, period, target_level AS l0, lag(target_level, 11) OVER w AS l11,
         lag(target_level, 12) OVER w AS l12, lead(target_level, 1) OVER w AS y
  FROM levels WINDOW w AS (PARTITION BY entity ORDER BY period)),
origins AS (SELECT * FROM lagged WHERE l0 + l11 + l12 IS NOT NULL),
tail_axis AS (
  SELECT period, row_number() OVER (ORDER BY period DESC) AS r
  FROM (SELECT DISTINCT period FROM origins WHERE y IS NOT NULL)),
sized AS (
  SELECT abs(y - l0) AS a, row_number() OVER (ORDER BY abs(y - l0)) - 1 AS i,
         count(*) OVER () AS n
  FROM origins JOIN tail_axis USING (period) WHERE r <= 12 AND y IS NOT NULL),
spot AS (SELECT (n - 1) * least(ceil((n + 1) * 0.8::DOUBLE) / n, 1.0::DOUBLE) AS h
       FROM sized LIMIT 1),
width AS (
  SELECT lo.a + (hi.a - lo.a) * (h - floor(h)) AS w
  FROM spot JOIN sized lo ON lo.i = floor(h) JOIN sized hi ON hi.i = ceil(h))"""

FORECASTS = MODEL + """,
forecasts AS (
  SELECT entity, period AS origin_date, CAST(period + INTERVAL 1 MONTH AS DATE) AS target_date,
         l0 AS predicted_log, l0 - w AS lower_log, l0 + w AS upper_log,
         greatest(exp(l0) - 1, 0) AS predicted_rate, greatest(exp(l0 - w) - 1, 0) AS lower_rate,
         greatest(exp(l0 + w) - 1, 0) AS upper_rate
  FROM origins, width)"""
FORECAST_COLUMNS = ("entity origin_date target_date ~predicted_log ~lower_log ~upper_log "
                    "~predicted_rate ~lower_rate ~upper_rate")
