"""Forward projection under typical conditions, for all entities at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcore.functions.scalars import (
    inverse_target,
    periods_between,
    shift_period,
    target_level,
    year_position,
)
from panelcore.operators.recursion import linear_form, projected_paths, windows_past
from panelcore.operators.whatif import PanelScorer, plausible_range
from panelcore.params import (
    Calendar,
    ClampParams,
    ProjectionParams,
    SeasonalParams,
    TargetParams,
)
from panelcore.session import cut_lineage

BEFORE_DATA, HISTORICAL, FORECASTABLE = "before_data", "historical", "forecastable"
SEASONAL, CLIMATOLOGY, BEYOND_REACH = "seasonal", "climatology", "beyond_reach"


def normals(panel: DataFrame, variables: list[str], calendar: Calendar) -> DataFrame:
    """Mean of every variable per (entity, calendar position)."""
    return panel.groupBy(
        "entity", year_position(F.col("period"), calendar).alias("position")
    ).agg(*[F.avg(v).alias(v) for v in variables])


def last_observed(panel: DataFrame, target: str) -> DataFrame:
    """``entity, first_period, last_observed``; entities never observed are left out."""
    return panel.groupBy("entity").agg(
        F.min("period").alias("first_period"),
        F.max(F.when(F.col(target).isNotNull(), F.col("period"))).alias("last_observed"),
    ).where("last_observed is not null")


def extend_panel(panel: DataFrame, variables: list[str], k: int, calendar: Calendar,
                 history: DataFrame | None = None) -> DataFrame:
    """Panel plus ``k`` periods of normals after each entity's end.

    A position never seen falls back to the entity mean. ``history`` supplies the
    normals where ``panel`` is only its tail. Keys that exist are never doubled,
    because new periods start after the entity's last one.
    """
    base = panel if history is None else history
    typical = normals(base, variables, calendar)
    overall = base.groupBy("entity").agg(*[F.avg(v).alias(f"_m_{v}") for v in variables])
    ends = panel.groupBy("entity").agg(F.max("period").alias("_end"))
    future = ends.select(
        "entity",
        F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)),
                              lambda i: shift_period(F.col("_end"), i, calendar))).alias("period"),
    )
    filled = (
        future.withColumn("position", year_position(F.col("period"), calendar))
        .join(typical, ["entity", "position"], "left")
        .join(overall, "entity", "left")
        .select("entity", "period",
                *[F.coalesce(F.col(v), F.col(f"_m_{v}")).alias(v) for v in variables])
    )
    return panel.select("entity", "period", *variables).unionByName(filled)


def project_direct(panel: DataFrame, model: PanelScorer, target: str) -> DataFrame:
    """Forecasts past the last observation that read observed rows only."""
    ends = last_observed(panel, target).select("entity", "last_observed")
    return model.predict(panel).join(ends, "entity").where(
        (F.col("target_date") > F.col("last_observed"))
        & (F.col("origin_date") <= F.col("last_observed"))
    )


def project_recursive(panel: DataFrame, variables: list[str], model, t: TargetParams,
                      calendar: Calendar, clamp: ClampParams, p: ProjectionParams) -> DataFrame:
    """Direct steps, then up to ``max_recursive_steps`` fed by the model's own output.

    Predictions are written back as counts, held inside the entity's observed range.
    Models that are linear in the target's past walk forward inside one row per entity;
    all others are rescored step by step. Either way an entity reads the look-back window
    before its own last observation, however long others have gone on.
    """
    bounds = plausible_range(panel, t.target, clamp)
    reach = model.horizon + p.max_recursive_steps
    form = None
    if hasattr(model, "fitted"):
        form = linear_form(model.fitted.inner, model.spec, t.target)
    if form is None:
        return _curve(_rescored(panel, variables, model, t, calendar, bounds, p), p)
    paths = projected_paths(panel, variables, model, form, t, calendar, bounds, reach)
    steps = paths.select("entity", "last_observed", F.posexplode("path").alias("_i", "_p")).where(
        "_p is not null")
    ahead = F.col("_i") + 1
    rate = lambda shift: inverse_target(F.col("_p") + F.lit(shift), t.transform)
    width = model.fitted.width
    return _curve(steps.select(
        "entity", shift_period(F.col("last_observed"), ahead, calendar).alias("target_date"),
        ahead.alias("steps_ahead"), F.greatest(ahead - model.horizon, F.lit(0)).alias("depth"),
        rate(0.0).alias("predicted_rate"), rate(width).alias("upper_rate"),
        rate(-width).alias("lower_rate"),
    ), p)


def _curve(steps: DataFrame, p: ProjectionParams) -> DataFrame:
    """Mode, widened interval and reliability of steps ``depth`` rounds past the direct ones.

    The half-width grows with the square root of the rounds, a random-walk rule.
    """
    half = (F.col("upper_rate") - F.col("predicted_rate")) * F.sqrt(F.col("depth") + F.lit(1.0))
    fresh = F.col("depth") == 0
    cap = float(p.max_recursive_steps + 1)
    return steps.select(
        "entity", "target_date", "steps_ahead", "predicted_rate",
        F.when(fresh, F.col("lower_rate"))
        .otherwise(F.greatest(F.col("predicted_rate") - half, F.lit(0.0))).alias("lower_rate"),
        F.when(fresh, F.col("upper_rate")).otherwise(F.col("predicted_rate") + half).alias(
            "upper_rate"),
        F.when(fresh, "direct").otherwise("recursive").alias("mode"),
        F.greatest(F.lit(0.0), F.lit(1.0) - F.col("depth") / F.lit(cap)).alias("reliability"),
    )


def _rescored(panel: DataFrame, variables: list[str], model, t: TargetParams, calendar: Calendar,
              bounds: DataFrame, p: ProjectionParams) -> DataFrame:
    """The steps of a model that is not linear, rescored once per step.

    Each step writes the predictions of one more period back and goes through the model's
    own feature builder. Only the predictions of a step are written; the panel is always
    the same base plus what is known, so no plan is longer than the first one.
    """
    h = model.horizon
    back, reach = model.look_back + h, h + p.max_recursive_steps
    if getattr(model, "edges", None) is not None:
        # Entities read their neighbours' rows, so windows must overlap in time.
        spread = last_observed(panel, t.target).agg(periods_between(
            F.min("last_observed"), F.max("last_observed"), calendar)).first()[0] or 0
        back, reach = back + spread, reach + spread
    working = cut_lineage(windows_past(panel, variables, t, calendar, back, reach))
    ends = working.select("entity", "last_observed").distinct()
    bounds = cut_lineage(bounds)

    def scored(df: DataFrame, first: int, last: int) -> DataFrame:
        """Predictions whose target lies ``first`` to ``last`` steps past the end."""
        ahead = periods_between(F.col("last_observed"), F.col("target_date"), calendar)
        rows = model.predict(df).join(ends, "entity").withColumn("steps_ahead", ahead)
        return cut_lineage(rows.where(F.col("steps_ahead").between(first, last)).select(
            "entity", "target_date", "steps_ahead",
            F.greatest(ahead - h, F.lit(0)).alias("depth"),
            "predicted_rate", "upper_rate", "lower_rate"))

    known = scored(working.select("entity", "period", *variables), 1, h)
    for depth in range(1, p.max_recursive_steps + 1):
        fed = known.where(F.col("steps_ahead") <= depth).select(
            "entity", F.col("target_date").alias("period"), F.col("predicted_rate").alias("_r"))
        count = F.col("_r") * F.col(t.exposure) / F.lit(t.per)
        held = F.when(count.isNotNull(),
                      F.least(F.greatest(count, F.col("low")), F.col("high")))
        filled = (
            working.join(fed, ["entity", "period"], "left").join(bounds, "entity", "left")
            .withColumn(t.target, F.coalesce(F.col(t.target), held))
            .select("entity", "period", *variables)
        )
        known = known.unionByName(scored(filled, h + depth, h + depth))
    return known


def project_to(panel: DataFrame, requests: DataFrame, variables: list[str], model, t: TargetParams,
               calendar: Calendar, clamp: ClampParams, p: ProjectionParams) -> DataFrame:
    """Every step from the first forecastable period to an asked one (``entity, asked``).

    Steps past ``max_recursive_steps`` are cut off and the answer is ``truncated``;
    ``direct_until`` is where the model still read observed rows only. A period that is
    already observed has no step to give.
    """
    curve = project_recursive(panel, variables, model, t, calendar, clamp, p)
    ends = last_observed(panel, t.target).select("entity", "last_observed")
    asked = requests.select("entity", F.trunc("asked", calendar.unit).alias("asked")).distinct()
    direct = shift_period(F.col("last_observed"), model.horizon, calendar)
    cap = shift_period(F.col("last_observed"), model.horizon + p.max_recursive_steps, calendar)
    wanted = asked.join(ends, "entity").select(
        "entity", "asked", "last_observed", direct.alias("direct_until"),
        (F.col("asked") > cap).alias("truncated"))
    # A request meets the few steps of its entity's curve.
    return wanted.join(curve, "entity").where(F.col("target_date") <= F.col("asked"))


def classify_targets(panel: DataFrame, requests: DataFrame, t: TargetParams, calendar: Calendar,
                     horizon: int, p: ProjectionParams, s: SeasonalParams) -> DataFrame:
    """How each asked month (``entity, asked``) can be answered, and the observed value.

    Only the panel's per-entity range and one equality lookup are needed.
    """
    bounds = last_observed(panel, t.target)
    asked = requests.select("entity", F.to_date(F.date_trunc("month", "asked")).alias(
        "target_date"))
    last = F.col("last_observed")
    furthest = shift_period(last, horizon + p.max_recursive_steps, calendar)
    seasonal_edge = shift_period(last, s.max_projection_periods, calendar)
    climate_edge = F.add_months(last, 12 * s.climatology_max_years)
    target = F.col("target_date")
    reach = (
        F.when(target < F.col("first_period"), BEFORE_DATA)
        .when(target <= last, HISTORICAL)
        .when(target > climate_edge, BEYOND_REACH)
        .when(target > seasonal_edge, CLIMATOLOGY)
        .when(target > furthest, SEASONAL)
        .otherwise(FORECASTABLE)
    )
    rate = inverse_target(target_level(t), t.transform)
    levels = panel.select("entity", F.col("period").alias("target_date"), rate.alias("_rate"))
    # Whole periods are counted upwards, so a month between two weeks counts in full.
    up = periods_between(last, target, calendar)
    if calendar.granularity == "weekly":
        ahead = F.ceil(F.datediff(target, last) / 7).cast("int")
        back = F.ceil(F.datediff(last, target) / 7).cast("int")
        up = F.when(target > last, ahead).otherwise(-back)
    steps = F.when(F.col("reach") == BEFORE_DATA, F.lit(0)).otherwise(up)
    return (
        asked.join(bounds, "entity")
        .withColumn("reach", reach)
        .join(levels, ["entity", "target_date"], "left")
        .select(
            "entity", "target_date", "reach", "last_observed",
            furthest.alias("furthest_forecastable"),
            seasonal_edge.alias("furthest_seasonal"),
            climate_edge.alias("furthest_climatology"),
            steps.alias("steps_ahead"),
            F.when(F.col("reach") == HISTORICAL, F.col("_rate")).alias("observed_rate"),
        )
    )
