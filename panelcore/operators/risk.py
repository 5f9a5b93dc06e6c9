"""Thresholds per entity, tiers, actions and alert accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcore.checks import require_columns_present
from panelcore.functions.ranks import one_group
from panelcore.functions.scalars import inverse_target
from panelcore.operators.features import LEVEL
from panelcore.params import RiskParams

# Fixed value: wording for a forecast that crosses no threshold.
BELOW_ALL = "below the lowest threshold"


def _multiples(p: RiskParams) -> range:
    return range(1, len(p.tiers))


def _per_tier(values: list[Column], labels: list[str], p: RiskParams) -> Column:
    return F.explode(F.array(*[
        F.struct(F.lit(i).alias("tier_index"), F.lit(p.tiers[i]).alias("tier"),
                 v.alias("value_log"), F.lit(label).alias("label"))
        for i, v, label in zip(_multiples(p), values, labels)
    ]))


def _threshold_rows(grouped: DataFrame, exploded: Column, transform: str) -> DataFrame:
    return grouped.select("entity", exploded.alias("t"), "n_observations").select(
        "entity", "t.tier_index", "t.tier", "t.value_log",
        inverse_target(F.col("t.value_log"), transform).alias("value_rate"),
        "t.label", "n_observations",
    )


def quantile_thresholds(levels: DataFrame, p: RiskParams, transform: str) -> DataFrame:
    """Boundaries at linear quantiles of each entity's own observed levels."""
    grouped = (
        levels.where(F.col(LEVEL).isNotNull())
        .groupBy("entity")
        .agg(
            F.percentile(LEVEL, list(p.quantiles)).alias("_q"),
            F.count(LEVEL).alias("n_observations"),
        )
    )
    values = [F.col("_q")[i - 1] for i in _multiples(p)]
    labels = [f"{q:.0%} historical percentile" for q in p.quantiles]
    return _threshold_rows(grouped, _per_tier(values, labels, p), transform)


def ewma_thresholds(levels: DataFrame, p: RiskParams, transform: str) -> DataFrame:
    """Last smoothed level plus multiples of the residual deviation.

    The recursion runs inside the row as a fold over the entity's ordered levels,
    an array the period axis bounds; it carries the smoothed value and the running
    moments of the residual.
    """
    series = (
        levels.where(F.col(LEVEL).isNotNull())
        .groupBy("entity")
        .agg(F.array_sort(F.collect_list(F.struct("period", LEVEL))).alias("_s"))
        .where(F.size("_s") >= 2)
    )
    a = F.lit(p.ewma_alpha)
    start = F.struct(
        F.lit(None).cast("double").alias("y"), F.lit(0.0).alias("n"),
        F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"),
    )

    def step(acc: Column, point: Column) -> Column:
        x = point[LEVEL]
        y = F.coalesce(a * x + (F.lit(1.0) - a) * acc["y"], x)
        n = acc["n"] + 1.0
        delta = x - y - acc["mean"]
        mean = acc["mean"] + delta / n
        return F.struct(
            y.alias("y"), n.alias("n"), mean.alias("mean"),
            (acc["m2"] + delta * (x - y - mean)).alias("m2"),
        )

    grouped = series.select(
        "entity", F.aggregate("_s", start, step).alias("e"),
        F.size("_s").cast("long").alias("n_observations"),
    )
    sd = F.sqrt(F.col("e.m2") / (F.col("e.n") - 1.0))
    values = [F.col("e.y") + F.lit(m * p.ewma_sigma) * sd for m in _multiples(p)]
    labels = [f"EWMA + {m * p.ewma_sigma:g} sigma" for m in _multiples(p)]
    return _threshold_rows(grouped, _per_tier(values, labels, p), transform)


def thresholds(levels: DataFrame, p: RiskParams, transform: str) -> DataFrame:
    build = {"quantile": quantile_thresholds, "ewma": ewma_thresholds}[p.method]
    return build(levels, p, transform)


def _packed(bounds: DataFrame, value: str) -> DataFrame:
    """One row per entity: its two or three boundaries, lowest first.

    Equal boundaries keep the milder tier last, which is the one reported.
    """
    return bounds.groupBy("entity").agg(
        F.sort_array(F.collect_list(F.struct(
            F.col(value).alias("at"), (-F.col("tier_index")).alias("order"),
            "tier_index", "tier", "value_log", "value_rate", "label", "n_observations",
        ))).alias("_bounds")
    )


def _highest_crossed(trigger: Column) -> Column:
    return F.try_element_at(
        F.filter("_bounds", lambda b: b["at"] <= trigger), F.lit(-1)
    )


def assign_tier(rows: DataFrame, bounds: DataFrame, trigger: Column, p: RiskParams,
                value: str = "value_log", strict: bool = True) -> DataFrame:
    """Adds ``tier, tier_index, crossed``: the highest boundary at or below ``trigger``.

    The boundaries of an entity arrive as one short array, so the join is an
    equality on the entity and emits no (row, boundary) pairs.
    """
    joined = rows.join(_packed(bounds, value), "entity", "left")
    known = F.col("_bounds")
    if strict:
        known = F.coalesce(known, F.raise_error(
            F.concat(F.lit("no thresholds for "), F.col("entity"))).cast(
                joined.schema["_bounds"].dataType))
    return (
        joined.withColumn("_bounds", known)
        .withColumn("crossed", _highest_crossed(trigger))
        .withColumn("tier", F.when(F.col("_bounds").isNotNull(),
                                   F.coalesce("crossed.tier", F.lit(p.tiers[0]))))
        .withColumn("tier_index", F.when(F.col("_bounds").isNotNull(),
                                         F.coalesce("crossed.tier_index", F.lit(0))))
        .drop("_bounds")
    )


def recommend(forecasts: DataFrame, bounds: DataFrame, p: RiskParams, transform: str,
              alpha: float = 0.2, drivers: DataFrame | None = None, top_k: int = 2
              ) -> DataFrame:
    """Forecasts with tier, evidence, drivers and actions."""
    basis = "upper_log" if p.alert_on == "upper" else "predicted_log"
    require_columns_present(
        forecasts, ("entity", "origin_date", "target_date", "predicted_log", basis)
    )
    trigger = F.col(basis)
    rows = assign_tier(forecasts, bounds, trigger, p)
    label = (
        f"{1 - alpha:.0%} interval upper bound" if p.alert_on == "upper" else "point forecast"
    )
    out = rows.withColumns({
        "trigger_log": trigger,
        "trigger_rate": inverse_target(trigger, transform),
        "trigger_basis": F.lit(label),
    })
    return attach_actions(out, p, drivers, top_k)


def attach_actions(rows: DataFrame, p: RiskParams, drivers: DataFrame | None = None,
                   top_k: int = 2) -> DataFrame:
    """Adds ``actions`` by tier and the first ``top_k`` of ``drivers`` where known."""
    actions = F.when(F.col("tier") == p.tiers[0], F.array(*map(F.lit, p.actions[p.tiers[0]])))
    for t in p.tiers[1:]:
        actions = actions.when(F.col("tier") == t, F.array(*map(F.lit, p.actions[t])))
    out = rows.withColumn("actions", actions)
    if drivers is None:
        empty = F.array().cast("array<struct<label:string,value:double>>")
        return out.withColumn("drivers", empty)
    return out.join(
        drivers.select("entity", "origin_date", F.slice("drivers", 1, top_k).alias("drivers")),
        ["entity", "origin_date"], "left",
    )


def alert_summary(recommendations: DataFrame, p: RiskParams) -> DataFrame:
    """Realised against nominal tier shares, every tier listed."""
    edges = [0.0, *p.quantiles, 1.0]
    rows = [(i, t, edges[i + 1] - edges[i]) for i, t in enumerate(p.tiers)]
    spark = recommendations.sparkSession
    nominal = spark.createDataFrame(rows, "tier_index int, tier string, nominal_share double")
    counts = recommendations.groupBy("tier").agg(F.count(F.lit(1)).alias("_c"))
    # A handful of tiers: the total is a sum over their counts.
    total = counts.agg(F.sum("_c").alias("_n"))
    share = F.coalesce(F.col("_c"), F.lit(0)) / F.col("_n")
    return (
        one_group(total, nominal).join(counts, "tier", "left")
        .select(
            "tier_index", "tier", F.coalesce("_c", F.lit(0)).cast("long").alias("count"),
            share.alias("realised_share"), "nominal_share",
            F.try_divide(share, F.col("nominal_share")).alias("ratio"),
        )
    )


def evidence(recommendations: DataFrame) -> DataFrame:
    """The flat evidence row behind each recommendation."""
    keep = ["entity", "origin_date", "target_date", "predicted_rate", "lower_rate",
            "upper_rate", "tier", "tier_index", "trigger_log", "trigger_rate", "trigger_basis"]
    return recommendations.select(
        *keep,
        F.col("crossed.value_rate").alias("threshold_rate"),
        F.coalesce("crossed.label", F.lit(BELOW_ALL)).alias("threshold_label"),
        F.col("crossed.n_observations").alias("n_observations"),
        F.array_join(F.transform("drivers", lambda d: d["label"]), ", ").alias("drivers"),
        F.array_join("actions", "; ").alias("actions"),
    )


def render(recommendations: DataFrame, alpha: float = 0.2) -> DataFrame:
    """One sentence per recommendation, every clause taken from a field."""
    # Fixed value: the wording of the sentence.
    c = F.col("crossed")

    def shown(x: Column) -> Column:
        return F.round(x, 9)  # so that the last bit does not decide a rounded digit

    head = F.concat(
        F.col("tier"),
        F.format_string(" - predicted %.1f cases per 100k (", shown(F.col("predicted_rate"))),
        F.lit(f"{1 - alpha:.0%} interval upper bound "),
        F.format_string("%.1f)", shown(F.col("upper_rate"))),
    )
    above = F.format_string(
        ", above the %s of %.1f for %s (n=%d)",
        c["label"], shown(c["value_rate"]), F.col("entity"), c["n_observations"],
    )
    below = F.concat(F.lit(f", {BELOW_ALL} for "), F.col("entity"))
    names = F.array_join(F.transform("drivers", lambda d: d["label"]), ", ")
    top = F.when(F.size("drivers") > 0, F.concat(F.lit(" Top drivers: "), names, F.lit(".")))
    actions = F.concat(F.lit(" Actions: "), F.array_join("actions", "; "), F.lit("."))
    return recommendations.withColumn(
        "sentence",
        F.concat(head, F.when(c.isNotNull(), above).otherwise(below), F.lit("."),
                 F.coalesce(top, F.lit("")), actions),
    )


def render_all(recommendations: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Sentences, most severe tier first, then by trigger."""
    return render(recommendations, alpha).orderBy(
        F.desc("tier_index"), F.desc("trigger_log"), "entity", "origin_date"
    )


def top_alerts(recommendations: DataFrame, n: int) -> DataFrame:
    """The ``n`` strongest recommendations above the lowest tier."""
    return recommendations.where("tier_index > 0").orderBy(
        F.desc("trigger_log"), "entity", "origin_date"
    ).limit(n)
