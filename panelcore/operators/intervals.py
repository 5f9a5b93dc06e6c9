"""Split-conformal intervals and predictive quantiles, per fold, at any row count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcore.checks import ContractError
from panelcore.functions.quantiles import pooled_quantiles
from panelcore.functions.ranks import one_group
from panelcore.functions.scalars import finite
from panelcore.operators.models import FittedModel
from panelcore.params import ConformalParams

#: Quantile levels scored by the CRPS: 0.05 to 0.95 in steps of 0.05.
QUANTILE_LEVELS = [round(0.05 * k, 2) for k in range(1, 20)]


def calibration_residuals(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Signed residuals of the whole validation block; non-finite ones are dropped."""
    r = scored.select(*keys, (F.col("y") - F.col("prediction")).alias("residual"))
    return r.where(finite(F.col("residual")))


def check_calibration(residuals: DataFrame, keys: list[str], p: ConformalParams) -> None:
    counts = residuals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    r = counts.agg(F.min("n")).first()
    if (r[0] or 0) < p.min_residuals:
        raise ContractError(f"only {r[0] or 0} calibration residuals, need {p.min_residuals}")


def conformal_width(residuals: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """``keys + (n, level, width)``: half-width with the finite-sample correction."""
    counts = residuals.groupBy(*keys).agg(F.count("residual").alias("n"))
    level = F.least(F.ceil((F.col("n") + 1) * F.lit(1.0 - alpha)) / F.col("n"), F.lit(1.0))
    wanted = counts.where("n > 0").select(*keys, "n", level.alias("level"))
    sizes = residuals.select(*keys, F.abs("residual").alias("size"))
    found = pooled_quantiles(sizes, keys, "size", wanted.select(*keys, "level"))
    joined = found.join(wanted.drop("level"), keys) if keys else found.join(wanted, "level")
    return joined.select(*keys, "n", "level", F.col("quantile").alias("width"))


def residual_quantiles(residuals: DataFrame, keys: list[str], levels=None) -> DataFrame:
    """``keys + (level, quantile)`` of the signed residuals."""
    return pooled_quantiles(residuals, keys, "residual", list(levels or QUANTILE_LEVELS))


def predict_interval(scored: DataFrame, widths: DataFrame, keys: list[str]) -> DataFrame:
    """Point plus and minus the half-width of its group.

    ``widths`` has one row per fold, so it is broadcast: a shuffle on the fold would
    put all rows of a fold into one task.
    """
    w = F.col("width")
    one = widths.select(*keys, "width")
    rows = scored.join(F.broadcast(one), keys) if keys else one_group(one, scored)
    return rows.withColumn("lower", F.col("prediction") - w).withColumn(
        "upper", F.col("prediction") + w
    ).drop("width")


def predict_quantiles(scored: DataFrame, quantiles: DataFrame, keys: list[str]) -> DataFrame:
    """Point plus residual quantile, one row per level (19 levels by default).

    Levels reach each row as one short array; there is one array per fold.
    """
    return _with_levels(scored, quantiles, keys).select(
        *scored.columns, F.explode("_q").alias("_e")
    ).select(
        *scored.columns, F.col("_e.level").alias("level"),
        (F.col("prediction") + F.col("_e.quantile")).alias("quantile"),
    )


def _with_levels(scored: DataFrame, quantiles: DataFrame, keys: list[str]) -> DataFrame:
    """``_q``: the few levels of a row's fold as one array; one array per fold is sent."""
    packed = quantiles.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("level", "quantile"))).alias("_q")
    )
    return scored.join(F.broadcast(packed), keys)


def fold_crps(scored: DataFrame, quantiles: DataFrame, keys: list[str]) -> DataFrame:
    """``keys + crps`` with the levels folded inside each row: no row per level."""
    def loss(q):
        e = F.col("y") - F.col("prediction") - q["quantile"]
        return F.greatest(q["level"] * e, (q["level"] - 1.0) * e)

    total = F.aggregate("_q", F.lit(0.0), lambda acc, q: acc + loss(q))
    rows = _with_levels(scored, quantiles, keys).withColumn("_loss", total)
    return rows.groupBy(*keys).agg(
        (2.0 * F.sum("_loss") / F.sum(F.size("_q"))).alias("crps"))


def coverage():
    """Share of actuals inside the inclusive interval."""
    return F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double"))


def interval_width():
    return F.avg(F.col("upper") - F.col("lower"))


def crps():
    """Twice the mean pinball loss over the rows of :func:`predict_quantiles`."""
    e = F.col("y") - F.col("quantile")
    return 2.0 * F.avg(F.greatest(F.col("level") * e, (F.col("level") - 1.0) * e))


class ConformalModel(FittedModel):
    """Any fitted model with a calibrated half-width."""

    def __init__(self, inner: FittedModel, width: float) -> None:
        self.inner, self.width = inner, float(width)

    def transform(self, samples: DataFrame) -> DataFrame:
        p = F.col("prediction")
        return self.inner.transform(samples).withColumns(
            {"lower": p - self.width, "upper": p + self.width}
        )


def conformalise(inner: FittedModel, calibration: DataFrame, p: ConformalParams
                 ) -> ConformalModel:
    """Wrap a fitted model, calibrated on rows it has not been fitted on."""
    residuals = calibration_residuals(inner.transform(calibration), [])
    found = conformal_width(residuals, [], p.alpha).first()
    n = found["n"] if found else 0
    if n < p.min_residuals:
        raise ContractError(f"only {n} calibration residuals, need {p.min_residuals}")
    return ConformalModel(inner, found["width"])
