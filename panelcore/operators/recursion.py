"""Recursive projection inside one row per entity.

A forecast that is linear in its features (a ridge, or the pick of one column) is, past
the last observation, a recursion over an entity's own past: each step needs a few
earlier levels and counts, and a part that does not depend on the target and is known
for all steps beforehand. So every entity packs its look-back window into arrays, counted
from its *own* last observation, and one ``aggregate`` over the step numbers walks
forward: predict, turn the prediction into a count, hold it inside the entity's range,
append it, go on. There is no loop on the driver, no rescoring and no checkpoint.

Where a feature reads the neighbours' targets the entities depend on each other. Then the
driver loops over the few steps; a step is one join of what was fed back along the edges.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcore.functions.scalars import (
    finite,
    inverse_target,
    periods_between,
    shift_period,
    target_level,
    year_position,
)
from panelcore.operators.features import (
    LEVEL,
    design,
    series,
    spatial_weights,
)
from panelcore.operators.models import ColumnForecast, FittedModel, LinearForecast
from panelcore.params import Calendar, FeatureParams, ParamError, TargetParams
from panelcore.session import cut_lineage


@dataclass
class LinearForm:
    """A forecast as intercept, weights of known columns per step back, and weights per
    offset of the past levels, counts and neighbour sums. Offsets of weight 0 stay:
    a sample needs them to be present."""

    intercept: float = 0.0
    known: list[dict[str, float]] = field(default_factory=list)
    level: dict[int, float] = field(default_factory=dict)
    count: dict[int, float] = field(default_factory=dict)
    around: dict[int, float] = field(default_factory=dict)


def linear_form(fitted: FittedModel, spec, target: str) -> LinearForm | None:
    """The form of a fitted model, or None where it is not linear in the target's past."""
    steps, names = spec.timesteps, spec.columns
    if isinstance(fitted, ColumnForecast):
        weight = lambda back, c: 1.0 if back == 0 and c == fitted.column else 0.0
        form = LinearForm()
    elif isinstance(fitted, LinearForecast):
        # The flat view is step-major, oldest first.
        weight = lambda back, c: float(
            fitted.coefficients[(steps - 1 - back) * len(names) + names.index(c)])
        form = LinearForm(fitted.intercept)
    else:
        return None
    form.known = [{} for _ in range(steps)]
    for f in spec.schema:
        m = f.metadata
        for back in range(steps):
            w = weight(back, f.name)
            if m["raw_variable"] != target:
                if m["transform"] == "spatial_lag":
                    return None  # reads rows of other entities outside their own windows
                form.known[back][f.name] = w
                continue
            if f.name.startswith(f"{LEVEL}_lag_"):
                store, shares = form.level, {m["lag"]: 1.0}
            elif m["transform"] == "identity":
                store, shares = form.count, {0: 1.0}
            elif m["transform"] == "lag":
                store, shares = form.count, {m["lag"]: 1.0}
            elif m["transform"] == "spatial_lag":
                store, shares = form.around, {m["lag"]: 1.0}
            elif m["transform"] == "rolling" and m["agg"] in ("mean", "sum"):
                each = 1.0 / m["window"] if m["agg"] == "mean" else 1.0
                store, shares = form.count, dict.fromkeys(range(m["window"]), each)
            else:
                return None
            for k, share in shares.items():
                store[back + k] = store.get(back + k, 0.0) + w * share
    return form


def known_parameters(p: FeatureParams, target: str, columns: list[str]) -> FeatureParams:
    """The feature parameters without what reads the target."""
    without = lambda names: tuple(v for v in names if v != target)
    return dataclasses.replace(
        p, level_variables=without(p.level_variables), lag_variables=without(p.lag_variables),
        rolling_variables=without(p.rolling_variables), include_target_lags=False,
        include_spatial=p.include_spatial and p.spatial_variable != target,
        selected_columns=tuple(columns))


def known_part(rows: DataFrame, form: LinearForm, model, t: TargetParams) -> DataFrame:
    """``entity, period, known``: what an origin's forecast owes to columns that do not
    read the target; null where one of them is missing."""
    columns = list(form.known[0]) if form.known else []
    if not columns:
        return rows.select("entity", "period", F.lit(0.0).alias("known"))
    s = model.setting
    p = known_parameters(model.p, t.target, columns)
    wide, spec = design(rows, p, t, s.calendar, model.horizon, model.edges, model.entities)
    complete = reduce(lambda a, b: a & b, [finite(F.col(f"`{c}`")) for c in spec.columns])
    parts = []
    for back, weights in enumerate(form.known):
        terms = [F.col(f"`{c}`") * F.lit(w) for c, w in weights.items() if w and c in spec.columns]
        parts.append(_total(terms).alias(f"_p{back}"))
    steps = wide.select("entity", "period", complete.alias("_ok"), *parts)
    frame = series().rowsBetween(-(len(parts) - 1), 0)
    total = _total([F.lag(f"_p{b}", b).over(series()) if b else F.col("_p0")
                    for b in range(len(parts))])
    whole = F.count_if("_ok").over(frame) == len(parts)
    return steps.select("entity", "period", F.when(whole, total).alias("known"))


def _total(terms: list[Column]) -> Column:
    """A balanced sum, so that wide models do not nest deeply."""
    if not terms:
        return F.lit(0.0)
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) & ~1:]
    return terms[0]


def windows_past(panel: DataFrame, variables: list[str], t: TargetParams, calendar: Calendar,
                 back: int, reach: int) -> DataFrame:
    """The panel from ``back`` periods before each entity's last observation to ``reach``
    after it: ``entity, last_observed, pos, period, variables``.

    Past the end the target is open, and a covariate without a value is its normal: the
    mean of the calendar position, or of the entity where that was never seen. One pass
    sums up positions; entity means are made of those.
    """
    position = year_position(F.col("period"), calendar)
    typical = [v for v in variables if v != t.target]
    cells = panel.groupBy("entity", position.alias("position")).agg(
        F.max(F.when(F.col(t.target).isNotNull(), F.col("period"))).alias("_last"),
        *[f(v).alias(f"_{k}_{v}") for v in typical for k, f in (("s", F.sum), ("c", F.count))])
    whole = cells.groupBy("entity").agg(
        F.max("_last").alias("last_observed"),
        F.map_from_entries(F.collect_list(F.struct("position", F.struct(
            [F.try_divide(f"_s_{v}", f"_c_{v}").alias(v) for v in typical]
            or [F.lit(None).cast("double").alias("none")])))).alias("_at"),  # by position
        *[F.try_divide(F.sum(f"_s_{v}"), F.sum(f"_c_{v}")).alias(f"_m_{v}") for v in typical],
    ).where("last_observed is not null")
    axis = whole.withColumn("pos", F.explode(F.sequence(F.lit(-back), F.lit(reach)))).withColumn(
        "period", shift_period(F.col("last_observed"), F.col("pos"), calendar))
    normal = F.try_element_at("_at", position)
    after = F.col("pos") > 0
    return axis.join(panel.select("entity", "period", *variables), ["entity", "period"], "left").select(
        "entity", "last_observed", "pos", "period",
        F.when(~after, F.col(t.target)).cast("double").alias(t.target),
        *[F.when(after, F.coalesce(F.col(v), normal[v], F.col(f"_m_{v}"))).otherwise(F.col(v))
          .cast("double").alias(v) for v in typical])


def neighbour_sums(panel: DataFrame, weights: DataFrame, target: str) -> DataFrame:
    """``entity, period, around``: weighted sum of the neighbours' observed targets."""
    seen = panel.where(F.col(target).isNotNull()).select(
        F.col("entity").alias("neighbour"), "period", target)
    return seen.join(weights, "neighbour").groupBy("entity", "period").agg(
        F.sum(F.col("weight") * F.col(target)).alias("around"))


def packed(rows: DataFrame, around: DataFrame | None, form: LinearForm, model, t: TargetParams,
           bounds: DataFrame) -> DataFrame:
    """One row per entity with its window as arrays, ordered by ``pos``."""
    known = known_part(rows, form, model, t)
    cells = rows.withColumn("level", target_level(t)).join(known, ["entity", "period"])
    if around is None:
        cells = cells.withColumn("around", F.lit(None).cast("double"))
    else:
        cells = cells.join(around, ["entity", "period"], "left")
    one = F.struct("pos", "level", F.col(t.target).alias("count"), "around", "known",
                   F.col(t.exposure).alias("exposure"))
    arrays = cells.groupBy("entity", "last_observed").agg(F.sort_array(F.collect_list(one)).alias("w"))
    return arrays.join(bounds, "entity", "left").select(
        "entity", "last_observed", "low", "high",
        *[F.col(f"w.{c}").alias(c) for c in ("level", "count", "around", "known", "exposure")])


def _predicted(form: LinearForm, origin: Column, level: Column, count: Column, around: Column
               ) -> Column:
    past = [(level, form.level), (count, form.count), (around, form.around)]
    terms = [F.lit(form.intercept), F.get("known", origin)]
    terms += [F.get(values, origin - k) * F.lit(w) for values, offsets in past
              for k, w in sorted(offsets.items())]
    return _total(terms)


def _fed_back(prediction: Column, at: Column, t: TargetParams) -> tuple[Column, Column]:
    """The count that a prediction stands for, held in range, and its level."""
    exposure = F.get("exposure", at)
    count = inverse_target(prediction, t.transform) * exposure / F.lit(t.per)
    held = F.when(count.isNotNull(), F.least(F.greatest(count, F.col("low")), F.col("high")))
    rate = F.try_divide(held, exposure) * F.lit(float(t.per))
    return held, F.log1p(rate) if t.transform == "log1p" else rate


def advanced(state: DataFrame, form: LinearForm, t: TargetParams, back: int, horizon: int,
             reach: int) -> DataFrame:
    """``entity, last_observed, path``: the predictions of steps 1 to ``reach``, on the
    modelled scale, each fed back before the next."""
    def grow(acc: Column, i: Column) -> Column:
        at = F.lit(back) + i
        p = _predicted(form, at - horizon, acc["level"], acc["count"], F.col("around"))
        count, level = _fed_back(p, at, t)
        return F.struct(F.concat(acc["level"], F.array(level)).alias("level"),
                        F.concat(acc["count"], F.array(count)).alias("count"),
                        F.concat(acc["path"], F.array(p)).alias("path"))

    start = F.struct(F.slice("level", 1, back + 1).alias("level"),
                     F.slice("count", 1, back + 1).alias("count"),
                     F.array().cast("array<double>").alias("path"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(reach)), start, grow, lambda acc: acc["path"])
    return state.select("entity", "last_observed", path.alias("path"))


def advanced_together(state: DataFrame, weights: DataFrame, form: LinearForm, t: TargetParams,
                      calendar: Calendar, back: int, horizon: int, reach: int) -> DataFrame:
    """:func:`advanced` where entities read each other: a join along the edges per step.

    The state is one row per entity, written after every step.
    """
    state = state.withColumns({
        "level": F.slice("level", 1, back + 1), "count": F.slice("count", 1, back + 1),
        "path": F.array().cast("array<double>")})
    for i in range(1, reach + 1):
        at = F.lit(back + i)
        p = _predicted(form, at - horizon, F.col("level"), F.col("count"), F.col("around"))
        step = state.withColumn("_p", p)
        count, level = _fed_back(F.col("_p"), at, t)
        step = step.withColumns({"_c": count, "_l": level})
        step = step.withColumns({
            "path": F.concat("path", F.array("_p")), "count": F.concat("count", F.array("_c")),
            "level": F.concat("level", F.array("_l"))}).drop("_p", "_c", "_l")
        state = cut_lineage(_with_neighbours(step, weights, calendar, back, i) if i < reach else step)
    return state.select("entity", "last_observed", "path")


def _with_neighbours(state: DataFrame, weights: DataFrame, calendar: Calendar, back: int, i: int
                     ) -> DataFrame:
    """``around`` at step ``i`` with what neighbours have fed back for that period."""
    there = state.select(F.col("entity").alias("neighbour"), F.col("last_observed").alias("_end"),
                         F.col("count").alias("_fed"))
    ahead = periods_between(F.col("_end"), F.col("last_observed"), calendar) + i
    fed = F.when((ahead > 0), F.get("_fed", F.lit(back) + ahead))
    sums = (
        state.select("entity", "last_observed").join(weights, "entity").join(there, "neighbour")
        .groupBy("entity").agg(F.sum(F.col("weight") * fed).alias("_a"))
    )
    at = back + i
    seen = F.get("around", F.lit(at))
    both = F.when(seen.isNotNull() | F.col("_a").isNotNull(),
                  F.coalesce(seen, F.lit(0.0)) + F.coalesce("_a", F.lit(0.0)))
    return state.join(sums, "entity", "left").withColumn("around", F.transform(
        "around", lambda x, k: F.when(k == at, both).otherwise(x))).drop("_a")


def projected_paths(panel: DataFrame, variables: list[str], model, form: LinearForm,
                    t: TargetParams, calendar: Calendar, bounds: DataFrame, reach: int) -> DataFrame:
    """``entity, last_observed, path`` of every entity that was ever observed."""
    spatial = model.p.include_spatial and model.p.spatial_variable == t.target
    if spatial and model.edges is None:
        raise ParamError("spatial features need an edge list")
    back = model.look_back + model.horizon
    rows = windows_past(panel, variables, t, calendar, back, reach)
    if not (spatial and form.around):
        state = packed(rows, None, form, model, t, bounds)
        return advanced(state, form, t, back, model.horizon, reach)
    weights = spatial_weights(model.edges, panel, model.p.weight_scheme, t.exposure)
    around = neighbour_sums(panel, weights, t.target)
    state = packed(rows, around, form, model, t, bounds)
    return advanced_together(state, cut_lineage(weights), form, t, calendar, back, model.horizon, reach)
