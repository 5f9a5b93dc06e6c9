"""Lookups over stored result tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcore.functions.quantiles import pooled_quantiles
from panelcore.functions.ranks import one_group
from panelcore.functions.scalars import inverse_target, target_level
from panelcore.operators import risk
from panelcore.params import RiskParams, TargetParams

#: Share of the values shown below each map band edge.
BAND_LEVELS = [0.2, 0.4, 0.6, 0.8]
# Edges used when nothing is shown.
DEFAULT_BREAKS = [0.25, 0.5, 0.75, 1.0]
RECENT_PERIODS = 36


def _newest(rows: DataFrame, by: str, tie: str) -> DataFrame:
    """One row per entity; the map-side combine keeps one candidate per task."""
    payload = F.struct(*rows.columns)
    return rows.groupBy("entity").agg(
        F.max_by(payload, F.struct(by, tie)).alias("_r")
    ).select("_r.*")


def latest(forecasts: DataFrame) -> DataFrame:
    """The most recent forecast of each entity."""
    return _newest(forecasts, "origin_date", "target_date")


def at_period(forecasts: DataFrame, period: date) -> DataFrame:
    """As-of lookup: per entity the newest forecast for ``period`` or before.

    Falls back to the latest forecasts only when no entity has any. Both candidates of
    an entity come out of one aggregate, so the forecasts are computed once, by the job
    that reads the result.
    """
    on_time = F.col("target_date") <= F.lit(period)
    row = F.struct(*forecasts.columns)
    best = forecasts.groupBy("entity").agg(
        F.max_by(F.when(on_time, row),
                 F.when(on_time, F.struct("target_date", "origin_date"))).alias("_due"),
        F.max_by(row, F.struct("origin_date", "target_date")).alias("_last"),
    )
    some = best.agg(F.max(F.col("_due").isNotNull()).alias("_some"))
    due = one_group(some, best).withColumn("_r", F.when(F.col("_some"), F.col("_due")).otherwise(
        F.col("_last")))
    return due.where("_r is not null").select("_r.*")


def for_entity(rows: DataFrame, entity: str, order: str) -> DataFrame:
    """One entity's rows in order; the filter reaches the scan."""
    return rows.where(F.col("entity") == entity).orderBy(order)


def recommendation_for(recommendations: DataFrame, entity: str, period: date | None = None
                       ) -> DataFrame:
    """One entity's recommendation as of a period, or its latest one."""
    rows = recommendations.where(F.col("entity") == entity)
    on_time = F.lit(True) if period is None else F.col("target_date") <= F.lit(period)
    # Rows in time always win over later ones; the latest is the fallback.
    best = F.max_by(F.struct(*rows.columns), F.struct(on_time, "target_date", "origin_date"))
    return rows.groupBy("entity").agg(best.alias("_r")).select("_r.*")


def target_periods(forecasts: DataFrame) -> DataFrame:
    return forecasts.select("target_date").distinct().orderBy("target_date")


def entities(forecasts: DataFrame) -> DataFrame:
    return forecasts.select("entity").distinct().orderBy("entity")


def watchlist(forecasts: DataFrame, thresholds: DataFrame, top_tier: str, period: date
              ) -> DataFrame:
    """Entities whose upper bound reaches their own top threshold, by exceedance."""
    limits = thresholds.where(
        (F.col("tier") == top_tier) & (F.col("value_rate") > 0)
    ).select("entity", F.col("value_rate").alias("threshold"))
    value = F.col("upper_rate")
    return (
        at_period(forecasts, period).join(limits, "entity")
        .where(value >= F.col("threshold"))
        .select("entity", value.alias("predicted"), "threshold",
                (value / F.col("threshold") - 1.0).alias("exceedance"))
        .orderBy(F.desc("exceedance"), "entity")
    )


def with_bands(shown: DataFrame, value: str = "upper_rate") -> DataFrame:
    """``band``: how many of the four edges each shown value reaches.

    The edges are quantiles of the values shown, one row that joins back; nothing comes
    to the driver. Without any value the fixed edges hold.
    """
    edges = pooled_quantiles(shown, [], value, BAND_LEVELS).agg(
        F.sort_array(F.collect_list("quantile")).alias("_edges"))
    fixed = F.array(*map(F.lit, DEFAULT_BREAKS))
    usable = F.when(F.size("_edges") > 0, F.col("_edges")).otherwise(fixed)
    rows = one_group(edges.select(usable.alias("_edges")), shown)
    return rows.withColumn("band", band_of(F.col(value), F.col("_edges"))).drop("_edges")


def band_of(value: Column, edges: Column) -> Column:
    """Index of the band a value falls in."""
    return F.size(F.filter(edges, lambda b: value >= b))


def tier_for(rows: DataFrame, thresholds: DataFrame, rate: Column, p: RiskParams) -> DataFrame:
    """Tier of a given rate against the entity's own thresholds; NULL without any."""
    return risk.assign_tier(rows, thresholds, rate, p, value="value_rate", strict=False)


def observed_history(panel: DataFrame, t: TargetParams) -> DataFrame:
    """The observed rate on the reported scale."""
    return panel.select(
        "entity", "period", inverse_target(target_level(t), t.transform).alias("actual")
    )


def recent_window(rows: DataFrame, n: int = RECENT_PERIODS, column: str = "period") -> DataFrame:
    """Rows of the last ``n`` distinct periods (the view a chart opens on)."""
    newest = rows.select(column).distinct().orderBy(F.desc(column)).limit(n)
    return rows.join(F.broadcast(newest), column, "left_semi")


def seasonality(panel: DataFrame, target: str) -> DataFrame:
    """Mean target per calendar month."""
    return panel.groupBy(F.month("period").alias("month")).agg(F.avg(target).alias("mean_target"))
