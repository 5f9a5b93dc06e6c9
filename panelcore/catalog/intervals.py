"""Conformal calibration on the persistence forecast of every fold."""

from __future__ import annotations

from panelcore.catalog.base import MONTHS, TARGET, monthly, pick, query
from panelcore.catalog.evaluation import (
    CONFORMAL,
    FOLDS,
    METRICS,
    PERSISTENCE,
    cuts,
    metrics_sql,
    scored_by,
)
from panelcore.catalog.features import PLAIN, build
from panelcore.operators import evaluate, intervals, models
from panelcore.plans.production import Setting, store_evaluation
from panelcore.session import cut_lineage, scratch_path
from panelcore.sources import runs

# ``{key}`` is the grouping column; level and half-width per group.
WIDTHS = """,
sized AS (
  SELECT fold, abs(y - prediction) AS a,
         row_number() OVER (PARTITION BY fold ORDER BY abs(y - prediction)) - 1 AS i,
         count(*) OVER (PARTITION BY fold) AS n
  FROM scored WHERE role = 'val'),
lev AS (
  SELECT DISTINCT fold, n, least(ceil((n + 1) * 0.8::DOUBLE) / n, 1.0::DOUBLE) AS level
  FROM sized),
widths AS (
  SELECT l.fold, l.n, l.level,
         lo.a + (hi.a - lo.a) * ((l.n - 1) * l.level - floor((l.n - 1) * l.level)) AS width
  FROM lev l JOIN sized lo ON lo.fold = l.fold AND lo.i = floor((l.n - 1) * l.level)
  JOIN sized hi ON hi.fold = l.fold AND hi.i = ceil((l.n - 1) * l.level)),
bounded AS (
  SELECT s.*, prediction - width AS lower, prediction + width AS upper
  FROM scored s JOIN widths USING (fold) WHERE role = 'test')"""

LEVELS = ", ".join(f"{q}" for q in intervals.QUANTILE_LEVELS)
QUANTILES = f""",
q AS (
  SELECT fold, unnest([{LEVELS}]::DOUBLE[]) AS level,
         unnest(quantile_cont(y - prediction, [{LEVELS}])) AS quantile
  FROM scored WHERE role = 'val' GROUP BY fold)"""


def _scored(spark, d):
    return scored_by(spark, d, models.persistence)


def _residuals(spark, d):
    return intervals.calibration_residuals(_scored(spark, d).where("role = 'val'"), ["fold"])


@query("calibration_residuals", monthly(PERSISTENCE + """,
r AS (SELECT fold, y - prediction AS residual FROM scored WHERE role = 'val') """ + pick(
    "#fold ~residual", "FROM r")))
def calibration_residuals(spark, d):
    return _residuals(spark, d)


@query("conformal_width", monthly(PERSISTENCE + WIDTHS + " " + pick(
    "#fold #n ~level ~width", "FROM widths")))
def conformal_width(spark, d):
    return intervals.conformal_width(_residuals(spark, d), ["fold"], 0.2)


@query("conformal_width_range_split", monthly(PERSISTENCE + WIDTHS + " " + pick(
    "#fold #n ~level ~width", "FROM widths")))
def conformal_width_range_split(spark, d):
    """The same widths on the path for groups too large to order in one task."""
    return intervals.conformal_width(_residuals(spark, d), ["fold"], 0.2)


@query("conformal_intervals", monthly(PERSISTENCE + WIDTHS + " " + pick(
    "#fold entity period ~y ~prediction ~lower ~upper", "FROM bounded")))
def conformal_intervals(spark, d):
    return _bounded(spark, d).select("fold", "entity", "period", "y", "prediction", "lower",
                                     "upper")


def _bounded(spark, d):
    scored = _scored(spark, d)
    residuals = intervals.calibration_residuals(scored.where("role = 'val'"), ["fold"])
    widths = intervals.conformal_width(residuals, ["fold"], 0.2)
    return intervals.predict_interval(scored.where("role = 'test'"), widths, ["fold"])


@query("interval_coverage", monthly(PERSISTENCE + WIDTHS + """,
c AS (SELECT fold, avg(CASE WHEN y BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END) AS coverage,
             avg(upper - lower) AS mean_width FROM bounded GROUP BY 1) """ + pick(
    "#fold ~coverage ~mean_width", "FROM c")))
def interval_coverage(spark, d):
    return evaluate.interval_metrics(_bounded(spark, d))


@query("residual_quantiles", monthly(PERSISTENCE + QUANTILES + " " + pick(
    "#fold ~level ~quantile", "FROM q")))
def residual_quantiles(spark, d):
    return intervals.residual_quantiles(_residuals(spark, d), ["fold"])


def _scored_and_levels(spark, d):
    scored = _scored(spark, d)
    residuals = intervals.calibration_residuals(scored.where("role = 'val'"), ["fold"])
    levels = intervals.residual_quantiles(residuals, ["fold"])
    return scored.where("role = 'test'"), levels


def _quantile_rows(spark, d):
    return intervals.predict_quantiles(*_scored_and_levels(spark, d), ["fold"])


@query("predictive_quantiles", monthly(PERSISTENCE + QUANTILES + """,
pq AS (SELECT fold, entity, period, level, prediction + quantile AS quantile
       FROM scored JOIN q USING (fold) WHERE role = 'test') """ + pick(
    "#fold entity period ~level ~quantile", "FROM pq")))
def predictive_quantiles(spark, d):
    return _quantile_rows(spark, d).select("fold", "entity", "period", "level", "quantile")


@query("quantile_crps", monthly(PERSISTENCE + QUANTILES + """,
e AS (SELECT fold, level, y - prediction - quantile AS e
      FROM scored JOIN q USING (fold) WHERE role = 'test'),
c AS (SELECT fold, 2 * avg(greatest(level * e, (level - 1) * e)) AS crps FROM e GROUP BY 1) """
    + pick("#fold ~crps", "FROM c")))
def quantile_crps(spark, d):
    return intervals.fold_crps(*_scored_and_levels(spark, d), ["fold"])


#: Stored evaluations of this session, by application and table folder.
_RUNS: dict[tuple[str, str], str] = {}


def _evaluated(spark, d, table: str):
    """One table of the stored evaluation of the persistence forecast."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _RUNS:
        root = scratch_path(spark, "evaluations")
        samples, spec = build(spark, d, PLAIN)
        samples = cut_lineage(samples.drop("seq"))
        setting = Setting(TARGET, MONTHS, FOLDS, CONFORMAL)
        store_evaluation(samples, cuts(samples), lambda: models.persistence(spec), setting, root,
                         "persistence", {"model": "persistence"})
        _RUNS[key] = root
    return runs.load_run(spark, _RUNS[key], "persistence", table)


@query("stored_evaluation", monthly(PERSISTENCE + WIDTHS + metrics_sql() + """,
c AS (SELECT fold, avg(CASE WHEN y BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END) AS coverage,
             avg(upper - lower) AS mean_width FROM bounded GROUP BY 1),
r AS (SELECT * FROM metrics JOIN c USING (fold)) """ + pick(
    f"#fold {METRICS} ~coverage ~mean_width", "FROM r")))
def stored_evaluation(spark, d):
    """Fold metrics of a whole guarded evaluation, read back from its run."""
    return _evaluated(spark, d, "folds")


@query("stored_evaluation_predictions", monthly(PERSISTENCE + WIDTHS + " " + pick(
    "#fold role entity period ~y ~prediction ~lower ~upper", "FROM bounded")))
def stored_evaluation_predictions(spark, d):
    return _evaluated(spark, d, "predictions")
