"""Counterfactual panels: change one raw variable, clamp it, rescore, difference."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcore.functions.ranks import one_group
from panelcore.functions.scalars import shift_period
from panelcore.operators.features import NAMED
from panelcore.params import ClampParams, ParamError, Scenario

# Tolerance of the comparison that counts clamped cells.
ABS_TOL, REL_TOL = 1e-8, 1e-5


class PanelScorer(Protocol):
    """Scores a panel with the feature function it was fitted with."""

    def predict(self, panel: DataFrame) -> DataFrame: ...

    def columns_from(self, raw_variable: str) -> list[str]: ...


def scenario_mask(s: Scenario) -> Column:
    """True for the panel rows a scenario touches."""
    mask = F.lit(True)
    if s.entities is not None:
        mask = mask & F.col("entity").isin(list(s.entities))
    if s.start is not None:
        mask = mask & (F.col("period") >= F.lit(s.start))
    if s.end is not None:
        mask = mask & (F.col("period") <= F.lit(s.end))
    return mask


def plausible_range(panel: DataFrame, variable: str, c: ClampParams) -> DataFrame:
    """``entity, low, high`` from the entity's own history."""
    if c.strategy == "minmax":
        return panel.groupBy("entity").agg(
            F.min(variable).alias("low"), F.max(variable).alias("high")
        )
    reach = F.lit(c.n_sigma) * F.stddev_samp(variable)
    return panel.groupBy("entity").agg(
        (F.avg(variable) - reach).alias("low"), (F.avg(variable) + reach).alias("high")
    )


def apply_scenario(panel: DataFrame, s: Scenario, c: ClampParams) -> DataFrame:
    """The changed panel plus ``touched`` and ``clamped``.

    Bounds are widened by each cell's own value, so a zero change changes nothing.
    """
    if s.variable not in panel.columns:
        raise ParamError(f"{s.variable!r} is not a panel column")
    x = F.col(s.variable).cast("double")
    wanted = x * (1.0 + s.change / 100.0) if s.mode == "percent" else x + s.change
    bounds = plausible_range(panel, s.variable, c)
    low, high = F.least(F.col("low"), x), F.greatest(F.col("high"), x)
    held = F.when(x.isNotNull(), F.least(F.greatest(wanted, low), high))
    off = F.abs(held - wanted) > F.lit(ABS_TOL) + F.lit(REL_TOL) * F.abs(wanted)
    marked = panel.join(bounds, "entity").withColumns({
        "touched": scenario_mask(s), "_held": held, "_off": F.coalesce(off, F.lit(False)),
    })
    cols = [
        F.when(F.col("touched"), F.col("_held")).otherwise(x).alias(v) if v == s.variable
        else F.col(v)
        for v in panel.columns
    ]
    return marked.select(*cols, "touched", (F.col("touched") & F.col("_off")).alias("clamped"))


def scenario_counts(changed: DataFrame) -> DataFrame:
    return changed.agg(
        F.count_if("touched").alias("n_touched"), F.count_if("clamped").alias("n_clamped")
    )


def forecast_delta(baseline: DataFrame, scenario: DataFrame, also: tuple[str, ...] = ()
                   ) -> DataFrame:
    """Changes per (entity, origin) between two forecast tables; the columns ``also`` of
    the second one are kept."""
    keys = ["entity", "origin_date"]
    values = ("predicted_log", "lower_log", "upper_log", "predicted_rate")

    def named(df: DataFrame, side: str, *more: str) -> DataFrame:
        return df.select(*keys, *more, *[F.col(v).alias(f"{v}_{side}") for v in values])

    both = named(baseline, "base").join(named(scenario, "scenario", *also), keys)
    return both.select(
        *also, *keys,
        (F.col("predicted_log_scenario") - F.col("predicted_log_base")).alias("delta_log"),
        (F.col("predicted_rate_scenario") - F.col("predicted_rate_base")).alias("delta_rate"),
        *[F.col(f"{v}_log_{s}").alias(f"{v}_{s}")
          for s in ("base", "scenario") for v in ("predicted", "lower", "upper")],
    )


def what_if(panel: DataFrame, s: Scenario, model: PanelScorer, c: ClampParams
            ) -> tuple[DataFrame, DataFrame]:
    """``(deltas, counts)``; a scenario that touches nothing is an error."""
    changed = apply_scenario(panel, s, c)
    if changed.where("touched").isEmpty():
        raise ParamError(f"the scenario on {s.variable!r} selects no rows")
    after = changed.select(*panel.columns)
    return forecast_delta(model.predict(panel), model.predict(after)), scenario_counts(changed)


#: Sets scenario and entity apart in the key of a stacked panel.
MARK = "\x1f"


def touched_cells(panel: DataFrame, scenarios: dict[str, Scenario], c: ClampParams) -> DataFrame:
    """``scenario, entity, period, variable, held, clamped``: the sparse change of each
    scenario, one row per panel cell it touches. One pass over the panel for all of them;
    ranges are one row per entity."""
    for s in scenarios.values():
        if s.variable not in panel.columns:
            raise ParamError(f"{s.variable!r} is not a panel column")
    bounds = None
    for v in sorted({s.variable for s in scenarios.values()}):
        span = plausible_range(panel, v, c).select(
            "entity", F.col("low").alias(f"_low_{v}"), F.col("high").alias(f"_high_{v}"))
        bounds = span if bounds is None else bounds.join(span, "entity")
    changes = []
    for name, s in scenarios.items():
        x = F.col(s.variable).cast("double")
        wanted = x * (1.0 + s.change / 100.0) if s.mode == "percent" else x + s.change
        low, high = F.least(F.col(f"_low_{s.variable}"), x), F.greatest(F.col(f"_high_{s.variable}"), x)
        held = F.when(x.isNotNull(), F.least(F.greatest(wanted, low), high))
        off = F.abs(held - wanted) > F.lit(ABS_TOL) + F.lit(REL_TOL) * F.abs(wanted)
        changes.append(F.when(scenario_mask(s), F.struct(
            F.lit(name).alias("scenario"), F.lit(s.variable).alias("variable"), held.alias("held"),
            F.coalesce(off, F.lit(False)).alias("clamped"))))
    cells = F.explode(F.array_compact(F.array(*changes))).alias("_x")
    return panel.join(bounds, "entity").select("entity", "period", cells).select(
        "_x.scenario", "entity", "period", "_x.variable", "_x.held", "_x.clamped")


def what_if_batch(panel: DataFrame, scenarios: dict[str, Scenario], model, c: ClampParams,
                  calendar) -> tuple[DataFrame, DataFrame]:
    """``(deltas, counts)`` of many scenarios, each row with its ``scenario``.

    Only what a scenario can reach is scored again: the entities it touches, and those
    that read them along the model's edges, from the first touched period to ``look_back``
    periods past the last. These stretches of all scenarios are stacked under their own
    keys and scored by one call; origins outside have no row, their change is zero.
    ``counts`` has a row per scenario, with zeros where it touches nothing.
    """
    if model.reads_entity:
        raise ParamError("a model that profiles entities by key cannot score a stacked panel")
    cells = touched_cells(panel, scenarios, c)
    reached = cells.groupBy("scenario", "entity").agg(
        F.min("period").alias("_first"), F.max("period").alias("_last"))
    neighbours = None
    if model.edges is not None:
        neighbours = model.edges.select("entity", "neighbour")
        along = reached.withColumnRenamed("entity", "neighbour").join(neighbours, "neighbour").drop(
            "neighbour")
        reached = reached.unionByName(along).groupBy("scenario", "entity").agg(
            F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    back = model.look_back
    stretch = reached.select(
        "scenario", "entity", shift_period(F.col("_first"), -back, calendar).alias("_from"),
        shift_period(F.col("_last"), back, calendar).alias("_to"))
    read = stretch
    if neighbours is not None:  # the neighbours' rows are read, not scored
        beside = stretch.join(neighbours, "entity").select(
            "scenario", F.col("neighbour").alias("entity"), "_from", "_to")
        read = stretch.unionByName(beside).groupBy("scenario", "entity").agg(
            F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    inside = F.col("period").between(F.col("_from"), F.col("_to"))
    if neighbours is not None and model.p.weight_scheme == "exposure":
        inside = F.lit(True)  # those weights are means over all periods
    rows = panel.join(read, "entity").where(inside)
    changed = rows.drop("_from", "_to")
    keys = ["scenario", "entity", "period"]
    for v in sorted({s.variable for s in scenarios.values()}):
        own = cells.where(F.col("variable") == v).select(*keys, F.col("held").alias("_held"), F.lit(
            True).alias("_hit"))
        changed = changed.join(own, keys, "left").withColumn(
            v, F.when(F.col("_hit"), F.col("_held")).otherwise(F.col(v).cast("double"))).drop("_held", "_hit")
    key = F.concat("scenario", F.lit(MARK), "entity")
    stacked = changed.withColumn(NAMED, F.col("entity")).withColumn("entity", key).drop("scenario")
    after = model.stacked(list(scenarios), MARK).predict(stacked)
    after = after.withColumns({
        "scenario": F.substring_index("entity", MARK, 1),
        "entity": F.substring_index("entity", MARK, -1)})
    scored = after.join(reached.select(
        "scenario", "entity", "_first", shift_period(F.col("_last"), back, calendar).alias("_to")),
        ["scenario", "entity"]).where(F.col("origin_date").between(F.col("_first"), F.col("_to")))
    touched = reached.select("entity").distinct()
    base = model.predict(panel).join(touched, "entity", "left_semi")
    both = forecast_delta(base, scored.drop("_first", "_to"), ("scenario",))
    names = panel.sparkSession.createDataFrame([(n,) for n in scenarios], "scenario string")
    counts = cells.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_touched"), F.count_if("clamped").alias("n_clamped"))
    counts = names.join(counts, "scenario", "left").na.fill(0, ["n_touched", "n_clamped"])
    return both, counts


def what_if_summary(deltas: DataFrame, counts: DataFrame, affects_model: bool) -> DataFrame:
    """One row: spread of the change, guardrail shares, whether the model listens."""
    spread = deltas.agg(
        F.avg("delta_rate").alias("mean_delta"), F.max("delta_rate").alias("max_delta"),
        F.min("delta_rate").alias("min_delta"), F.count(F.lit(1)).alias("n_forecasts"),
    )
    share = F.coalesce(F.try_divide(F.col("n_clamped"), F.col("n_touched")), F.lit(0.0))
    return one_group(counts, spread).select(
        "mean_delta", "max_delta", "min_delta", "n_forecasts", "n_touched", "n_clamped",
        share.alias("clamped_share"), (F.col("n_clamped") > 0).alias("out_of_range"),
        F.lit(bool(affects_model)).alias("affects_model"),
    )
