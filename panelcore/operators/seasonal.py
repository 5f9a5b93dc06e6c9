"""Typical years and seasonal projections for any number of requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcore.functions.scalars import damped_steps, inverse_target, profile_position
from panelcore.operators.features import LEVEL
from panelcore.params import Calendar, SeasonalParams

# Calendar labels of the typical year.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun",
          "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def trailing_window(levels: DataFrame, calendar: Calendar, p: SeasonalParams) -> DataFrame:
    """Each entity's last ``trailing_years`` of observed levels, with position and step.

    ``step`` is 0 at the last observation and negative before it.
    """
    newest = W.partitionBy("entity").orderBy(F.desc("period"))
    return (
        levels.where(F.col(LEVEL).isNotNull())
        .withColumn("step", 1 - F.row_number().over(newest))
        .where(F.col("step") > -calendar.per_year * p.trailing_years)
        .select("entity", "period", LEVEL, "step",
                profile_position(F.col("period"), calendar).alias("position"))
    )


def profiles(levels: DataFrame, calendar: Calendar, p: SeasonalParams, alpha: float) -> DataFrame:
    """One row per entity: baseline, level, slope and its positions as an array.

    All steps reuse the partitioning by entity: the position means come from a
    window, both aggregates follow without a further shuffle.
    """
    window = trailing_window(levels, calendar, p)
    cell = W.partitionBy("entity", "position")
    residual = F.col(LEVEL) - F.avg(LEVEL).over(cell)
    rows = window.withColumn("residual", residual)
    edges = [alpha / 2.0, 1.0 - alpha / 2.0]
    cells = rows.groupBy("entity", "position").agg(
        F.avg(LEVEL).alias("m"),
        F.percentile(LEVEL, edges).alias("q"),
        F.count(F.lit(1)).alias("c"),
    )
    per_cell = cells.groupBy("entity").agg(
        F.map_from_entries(F.collect_list(F.struct("position", F.struct("m", "q", "c")))).alias(
            "cells"
        )
    )
    n, slope = F.count(F.lit(1)), F.regr_slope("residual", "step")
    trended = (n > calendar.per_year) & F.lit(p.use_trend)
    intercept = F.avg("residual") - slope * F.avg("step")
    level = F.when(trended, F.coalesce(intercept, F.avg("residual"))).otherwise(F.avg("residual"))
    bases = rows.groupBy("entity").agg(
        F.avg(LEVEL).alias("baseline"),
        F.percentile(LEVEL, edges).alias("pooled"),
        n.alias("n_observations"),
        F.max("period").alias("last_period"),
        (level if p.use_level_anchor else F.lit(0.0)).alias("level"),
        F.when(trended, F.coalesce(slope, F.lit(0.0))).otherwise(F.lit(0.0)).alias("slope"),
    )
    return bases.join(per_cell, "entity")


def _slot(position: Column) -> dict[str, Column]:
    """Centre, asymmetric band and count of one position of a profile row."""
    cell = F.try_element_at("cells", position)
    several = F.coalesce(F.col("n_observations") > 1, F.lit(False))
    wide = F.coalesce(cell["c"] > 1, F.lit(False))

    def offset(i: int) -> Column:
        pooled = F.when(several, F.col("pooled")[i] - F.col("baseline")).otherwise(F.lit(0.0))
        return F.when(wide, cell["q"][i] - cell["m"]).otherwise(pooled)

    return {
        "centre": F.coalesce(cell["m"], F.col("baseline")),
        # A band must bracket the value it surrounds.
        "low": F.least(offset(0), F.lit(0.0)),
        "high": F.greatest(offset(1), F.lit(0.0)),
        "observed": F.coalesce(cell["c"], F.lit(0)).cast("long"),
    }


def periods_ahead(last: Column, target: Column, calendar: Calendar) -> Column:
    if calendar.granularity == "monthly":
        return (F.year(target) - F.year(last)) * 12 + F.month(target) - F.month(last)
    return F.floor(F.datediff(target, last) / (365 // calendar.per_year)).cast("int")


def project_seasonal(levels: DataFrame, requests: DataFrame, calendar: Calendar,
                     p: SeasonalParams, alpha: float, transform: str) -> DataFrame:
    """Answers ``entity, target_date`` requests from profiles, level and damped trend.

    Beyond ``max_projection_periods`` only the profile is left. Requests with an
    entity that has no history yield no row.
    """
    joined = requests.select("entity", "target_date").join(
        profiles(levels, calendar, p, alpha), "entity"
    )
    ahead = periods_ahead(F.col("last_period"), F.col("target_date"), calendar)
    reach = F.col("ahead") <= p.max_projection_periods
    drift = F.when(
        reach, F.col("slope") * damped_steps(F.col("ahead"), p.trend_damping)
    ).otherwise(F.lit(0.0))
    level = F.when(reach, F.col("level")).otherwise(F.lit(0.0))
    slot = joined.withColumns(
        {"ahead": ahead, **_slot(profile_position(F.col("target_date"), calendar))}
    ).withColumns({"drift": drift, "point": F.col("centre") + level + drift})

    def back(c: Column) -> Column:
        return inverse_target(c, transform)

    point = F.col("point")
    return slot.select(
        "entity", "target_date",
        back(point).alias("predicted_rate"),
        back(point + F.col("low")).alias("lower_rate"),
        back(point + F.col("high")).alias("upper_rate"),
        F.least(F.lit(1.0), F.col("observed") / F.lit(float(max(p.trailing_years, 1)))).alias(
            "reliability"
        ),
        F.col("observed").alias("years_observed"),
        (reach & F.lit(p.use_level_anchor)).alias("anchored"),
        (back(point) - back(point - F.col("drift"))).alias("trend_shift"),
        F.col("ahead").cast("int").alias("periods_ahead"),
    )


def climatology_year(levels: DataFrame, calendar: Calendar, p: SeasonalParams, alpha: float,
                     transform: str) -> DataFrame:
    """Every position of every entity's typical year with its band."""
    n = calendar.per_year
    rows = profiles(levels, calendar, p, alpha).withColumn(
        "position", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    )
    s = _slot(F.col("position"))
    label = (
        F.element_at(F.array(*map(F.lit, MONTHS)), F.col("position") + 1)
        if calendar.granularity == "monthly"
        else (F.col("position") + 1).cast("string")
    )
    return rows.withColumns(s).select(
        "entity", "position", label.alias("label"),
        inverse_target(F.col("centre"), transform).alias("predicted"),
        inverse_target(F.col("centre") + F.col("low"), transform).alias("lower"),
        inverse_target(F.col("centre") + F.col("high"), transform).alias("upper"),
        "observed",
    )
