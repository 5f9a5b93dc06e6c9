"""Scoring forecasts fold by fold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcore.checks import finite_or_fail, require_finite, require_usable
from panelcore.functions.scalars import inverse_target, shift_period, unfloored_rate
from panelcore.operators import intervals
from panelcore.operators.folds import assign_folds, fold_counts, fold_numbers
from panelcore.operators.models import Forecaster
from panelcore.params import Calendar, ConformalParams, FoldParams
from panelcore.session import cut_lineage

POINT_METRICS = ("mae_log", "rmse_log", "r2_log", "mae_rate", "rmse_rate", "r2_rate", "crps_rate")


def score_folds(samples: DataFrame, plan: DataFrame, p: FoldParams,
                factory: Callable[[], Forecaster], guard: bool = True) -> DataFrame:
    """Validation and test rows of every fold with ``prediction``; a fresh model per fold.

    ``guard`` counts the roles of every fold first. Without it, a prediction that is not
    finite fails the job that reads it, at no extra pass.
    """
    assigned = assign_folds(samples, plan)
    if guard:
        require_usable(fold_counts(assigned))
        return factory().score(assigned, fold_numbers(p), factory)
    scored = factory().score(assigned, fold_numbers(p), factory)
    return scored.withColumn("prediction", finite_or_fail("prediction"))


def point_metrics(transform: str) -> list[Column]:
    """MAE, RMSE, R2 on both scales; R2 is NULL where the actuals are constant."""
    y, p = F.col("y"), F.col("prediction")
    scales = {
        "log": (y, p),
        "rate": (unfloored_rate(y, transform), unfloored_rate(p, transform)),
    }
    out = []
    for name, (a, b) in scales.items():
        e = a - b
        syy = F.regr_syy(a, b)
        r2 = F.lit(1.0) - F.try_divide(F.sum(e * e), F.when(syy != 0, syy))
        out += [
            F.avg(F.abs(e)).alias(f"mae_{name}"),
            F.sqrt(F.avg(e * e)).alias(f"rmse_{name}"),
            r2.alias(f"r2_{name}"),
        ]
    a, b = scales["rate"]
    # The CRPS of a point forecast is its absolute error.
    return [*out, F.avg(F.abs(a - b)).alias("crps_rate")]


def fold_metrics(scored: DataFrame, transform: str) -> DataFrame:
    return scored.groupBy("fold").agg(*point_metrics(transform))


def interval_metrics(with_bounds: DataFrame) -> DataFrame:
    return with_bounds.groupBy("fold").agg(
        intervals.coverage().alias("coverage"),
        intervals.interval_width().alias("mean_width"),
    )


def aggregate_folds(metrics: DataFrame, names=POINT_METRICS) -> DataFrame:
    """``metric, mean, std``: undefined folds are skipped, one fold has std 0."""
    long = metrics.unpivot("fold", list(names), "metric", "value")
    usable = F.when(F.abs("value") < float("inf"), F.col("value"))
    return long.groupBy("metric").agg(
        F.avg(usable).alias("mean"),
        F.when(F.count(usable) > 0, F.coalesce(F.stddev_samp(usable), F.lit(0.0))).alias("std"),
    )


def prediction_rows(with_bounds: DataFrame, horizon: int, calendar: Calendar, transform: str
                    ) -> DataFrame:
    """Keyed predictions with their target date, on both scales."""
    keep = [c for c in ("fold",) if c in with_bounds.columns]
    has_y = "y" in with_bounds.columns
    cols = [
        *keep, "entity", F.col("period").alias("origin_date"),
        shift_period(F.col("period"), horizon, calendar).alias("target_date"),
    ]
    if has_y:
        cols += [F.col("y").alias("actual_log"),
                 unfloored_rate(F.col("y"), transform).alias("actual_rate")]
    cols += [
        F.col("prediction").alias("predicted_log"),
        F.col("lower").alias("lower_log"),
        F.col("upper").alias("upper_log"),
        inverse_target(F.col("prediction"), transform).alias("predicted_rate"),
        inverse_target(F.col("lower"), transform).alias("lower_rate"),
        inverse_target(F.col("upper"), transform).alias("upper_rate"),
    ]
    return with_bounds.select(*cols)


def run_experiment(samples: DataFrame, plan: DataFrame, p: FoldParams, factory,
                   conformal: ConformalParams, transform: str) -> dict[str, DataFrame]:
    """Everything one configuration yields: scored rows, metrics and intervals.

    A prediction that is not finite is an error, not a metric.
    """
    scored = cut_lineage(score_folds(samples, plan, p, factory).drop("seq"))  # read six times
    require_finite(scored, "prediction")
    val, test = scored.where("role = 'val'"), scored.where("role = 'test'")
    residuals = intervals.calibration_residuals(val, ["fold"])
    intervals.check_calibration(residuals, ["fold"], conformal)
    widths = intervals.conformal_width(residuals, ["fold"], conformal.alpha)
    bounded = intervals.predict_interval(test, widths, ["fold"])
    metrics = fold_metrics(test, transform)
    return {
        "predictions": bounded,
        "folds": metrics.join(interval_metrics(bounded), "fold"),
        "summary": aggregate_folds(metrics),
        "widths": widths,
    }


def compare(summaries: DataFrame, metrics=POINT_METRICS, sort_by: str = "mae_rate") -> DataFrame:
    """Runs side by side (``run, metric, mean`` in), best first."""
    return (
        summaries.groupBy("run").pivot("metric", list(metrics)).agg(F.first("mean"))
        .orderBy(F.asc_nulls_last(sort_by), "run")
    )


def significance(table: DataFrame, metric: str = "mae_rate") -> DataFrame:
    """Gap of each configuration to the best of its (model, horizon), in std units."""
    w = W.partitionBy("model", "horizon").orderBy(F.asc_nulls_last(metric), "experiment")
    best = F.first(F.struct(metric, f"{metric}_std", "experiment")).over(w)
    gap = F.col(metric) - F.col("_best")[metric]
    spread = F.greatest(F.col(f"{metric}_std"), F.col("_best")[f"{metric}_std"], F.lit(1e-12))
    return table.withColumn("_best", best).select(
        "model", "horizon", "experiment", metric,
        F.col("_best.experiment").alias("best_experiment"),
        gap.alias("gap"),
        (gap / spread).alias("gap_in_std"),
        (gap / spread >= 1.0).alias("distinguishable"),
    )


def select_configuration(table: DataFrame, model: str, metric: str = "mae_rate",
                         parsimony: bool = True) -> DataFrame:
    """One row ``experiment, horizon``: the best, or the smallest within one best-std."""
    rows = table.where(F.col("model") == model)
    best = rows.agg(
        F.min_by(F.struct("experiment", "horizon", metric, f"{metric}_std"),
                 F.struct(metric, "experiment")).alias("b")
    ).select("b.*")
    if not parsimony:
        return best.select("experiment", "horizon")
    best = best.select(
        F.col("horizon"), F.col(metric).alias("_m"),
        F.greatest(F.col(f"{metric}_std"), F.lit(1e-12)).alias("_s"),
    )
    tied = rows.join(best, "horizon").where((F.col(metric) - F.col("_m")) / F.col("_s") < 1.0)
    return tied.agg(
        F.min_by(F.struct("experiment", "horizon"),
                 F.struct("n_features", metric, "experiment")).alias("b")
    ).select("b.*")
