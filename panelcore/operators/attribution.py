"""Shapley attributions as distributed jobs: rows by column, always long or arrays."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcore.functions.ranks import global_row_number, one_group
from panelcore.operators.features import ENTITY_VARIABLE, IDENTITY_PREFIX, LEVEL, FeatureSpec
from panelcore.operators.models import ColumnForecast, FittedModel, LinearForecast
from panelcore.params import ParamError

KEYS = ["entity", "period"]
# Wording of the variables that are not panel columns.
LABELS = {"__calendar__": "calendar seasonality", "__entity__": "entity identity"}
LEVEL_LABEL = "case rate"


def spaced_positions(n_rows: int, limit: int) -> list[int]:
    """Evenly spaced 0-based positions: floor(i * (n - 1) / (k - 1))."""
    k = min(limit, n_rows)
    if k <= 1:
        return [0] * k
    return [int(i * (n_rows - 1) / (k - 1)) for i in range(k)]


def rows_to_explain(samples: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` samples, evenly spaced in (entity, period) order.

    This bound is the operator's purpose: it spreads a sample over the whole panel.
    Positions come from a range-partitioned numbering of the keys.
    """
    numbered = global_row_number(samples.select(*KEYS), KEYS)
    wanted = [p + 1 for p in spaced_positions(numbered.count(), limit)]
    keys = numbered.where(F.col("row_number").isin(wanted)).select(*KEYS)
    return samples.join(keys, KEYS, "left_semi")


# -- attributions -------------------------------------------------------------


def linear_coefficients(model: LinearForecast) -> np.ndarray:
    """Coefficients on the unscaled flat view."""
    return model.coefficients


def is_linear(model: FittedModel) -> bool:
    return isinstance(model, (LinearForecast, ColumnForecast))


def flat_coefficients(model: FittedModel, spec: FeatureSpec) -> np.ndarray:
    """Coefficients on the flat view of a linear model or of the pick of one column."""
    if isinstance(model, LinearForecast):
        return model.coefficients
    if isinstance(model, ColumnForecast):
        flat = np.zeros((spec.timesteps, len(spec.columns)))
        flat[-1, spec.columns.index(model.column)] = 1.0  # the newest step
        return flat.ravel()
    raise ParamError("only models that are linear in their columns have coefficients")


def mean_background(background: DataFrame, spec: FeatureSpec) -> DataFrame:
    """One row: the mean of every flat feature as an array, by one vector aggregate."""
    flat = background.select(array_to_vector(F.flatten("seq")).alias("x"))
    return flat.agg(Summarizer.mean(F.col("x")).alias("m")).select(
        vector_to_array("m").alias("_mean"))


def explain_linear(samples: DataFrame, spec: FeatureSpec, coefficients, background: DataFrame
                   ) -> DataFrame:
    """Exact values for a linear model: coefficient times distance to the mean.

    ``entity, period, column, value``, summed over the time steps inside the row.
    """
    f = len(spec.columns)
    coef = F.array(*[F.lit(float(c)) for c in coefficients])
    parts = F.zip_with(
        F.zip_with(F.flatten("seq"), F.col("_mean"), lambda x, m: x - m), coef,
        lambda d, c: d * c,
    )
    summed = F.transform(
        F.sequence(F.lit(0), F.lit(f - 1)),
        lambda i: F.aggregate(
            F.sequence(F.lit(0), F.lit(spec.timesteps - 1)), F.lit(0.0),
            lambda acc, k: acc + F.get("_parts", k * f + i),
        ),
    )
    rows = one_group(mean_background(background, spec), samples).withColumn("_parts", parts)
    return _long(rows.select(*KEYS, summed.alias("_values")), spec)


def _long(rows: DataFrame, spec: FeatureSpec) -> DataFrame:
    names = F.array(*map(F.lit, spec.columns))
    return rows.select(*KEYS, F.explode(F.arrays_zip(names.alias("column"),
                                                     F.col("_values").alias("value"))).alias("a")
                       ).select(*KEYS, "a.column", "a.value")


def explain_sampled(samples: DataFrame, spec: FeatureSpec, model: FittedModel,
                    background: DataFrame, permutations: int = 20, seed: int = 7) -> DataFrame:
    """Sampled-permutation Shapley values for any model.

    Every (row, permutation) pairs with one background row picked by a hash, so the
    background is joined by equality. Features switch from background to row one by
    one; each prediction counts with a plus for the feature just switched and a
    minus for the next, and one map-side combined sum yields the values.
    """
    f = len(spec.columns)
    pool = global_row_number(background.select(*KEYS, "seq"), KEYS).select(
        F.col("row_number").alias("_b"), F.col("seq").alias("_bg")
    )
    n_background = pool.count()
    if n_background == 0:
        raise ParamError("the background is empty")
    draw = F.xxhash64("entity", "period", "_perm", F.lit(seed))
    order = F.transform(
        F.array_sort(F.transform(
            F.sequence(F.lit(0), F.lit(f - 1)),
            lambda i: F.struct(F.xxhash64("entity", "period", "_perm", i, F.lit(seed)).alias("h"),
                               i.alias("i")),
        )), lambda s: s["i"],
    )
    drawn = (
        samples.select(*KEYS, "seq", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias(
            "_perm"))
        .withColumns({"_b": F.pmod(draw, F.lit(n_background)) + 1, "_order": order})
        .join(pool, "_b")
    )
    # A feature is switched on from prefix length _rank[i] on; ranks are found once per
    # permutation, behind the join, not per prefix and cell.
    ranked = drawn.withColumn("_rank", F.transform(
        F.sequence(F.lit(0), F.lit(f - 1)), lambda i: F.array_position("_order", i)))
    prefixes = ranked.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(f))))
    mixed = prefixes.withColumn("seq", F.zip_with("seq", "_bg", _mix))
    scored = model.transform(mixed)
    plus = F.when(F.col("_j") > 0, F.struct(F.get("_order", F.col("_j") - 1).alias("i"),
                                            F.col("prediction").alias("v")))
    minus = F.when(F.col("_j") < f, F.struct(F.get("_order", F.col("_j")).alias("i"),
                                             (-F.col("prediction")).alias("v")))
    return (
        scored.select(*KEYS, F.explode(F.array_compact(F.array(plus, minus))).alias("e"))
        .groupBy(*KEYS, F.element_at(F.array(*map(F.lit, spec.columns)),
                                     F.col("e.i") + 1).alias("column"))
        .agg((F.sum("e.v") / F.lit(float(permutations))).alias("value"))
    )


def _mix(row: Column, bg: Column) -> Column:
    """One time step with the switched-on features of the row over the background."""
    return F.transform(
        row, lambda x, i: F.when(F.get("_rank", i) <= F.col("_j"), x).otherwise(F.get(bg, i))
    )


# -- summaries ----------------------------------------------------------------


def global_importance(values: DataFrame) -> DataFrame:
    """Mean absolute attribution per column."""
    return values.groupBy("column").agg(F.avg(F.abs("value")).alias("importance"))


def raw_importance(importance: DataFrame, provenance: DataFrame) -> DataFrame:
    """Importance summed back to the raw driver."""
    return importance.join(provenance.select("column", "raw_variable"), "column").groupBy(
        "raw_variable"
    ).agg(F.sum("importance").alias("importance"))


def top_drivers(values: DataFrame, provenance: DataFrame, k: int = 3) -> DataFrame:
    """``entity, origin_date, drivers``: the k largest contributions, as labelled structs.

    A prediction has as many rows as there are columns, so ranking stays small.
    """
    w = W.partitionBy(*KEYS).orderBy(F.desc(F.abs("value")), "column")
    labels = provenance.select("column", describe_column().alias("label"))
    ranked = values.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    return ranked.join(labels, "column").groupBy("entity", "period").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "label", "value"))),
                    lambda s: F.struct(s["label"].alias("label"), s["value"].alias("value"))
                    ).alias("drivers")
    ).withColumnRenamed("period", "origin_date")


def _drivers_only(values: DataFrame, provenance: DataFrame) -> DataFrame:
    kept = provenance.where(F.col("raw_variable") != ENTITY_VARIABLE).select("column")
    return values.join(kept, "column", "left_semi")


def entity_ranking(values: DataFrame, provenance: DataFrame) -> DataFrame:
    """Mean absolute attribution per (entity, column), indicators excluded."""
    return _drivers_only(values, provenance).groupBy("entity", "column").agg(
        F.avg(F.abs("value")).alias("importance")
    )


def top_driver_per_entity(ranking: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("column", "importance"), F.struct("importance", "column"))
    return ranking.groupBy("entity").agg(best.alias("b")).select("entity", "b.*")


def ranking_table(ranking: DataFrame, entities: list[str]) -> DataFrame:
    """Columns by entities, for a report over a listed set of entities."""
    return ranking.groupBy("column").pivot("entity", entities).agg(F.first("importance"))


def select_features(values: DataFrame, provenance: DataFrame, k: int = 5) -> DataFrame:
    """The k most important columns over all rows, indicators excluded."""
    return global_importance(_drivers_only(values, provenance)).orderBy(
        F.desc("importance"), "column"
    ).limit(k)


def entity_drivers(values: DataFrame, provenance: DataFrame, entity: str, k: int = 8
                   ) -> DataFrame:
    """One entity's mean signed attributions, strongest first."""
    labels = provenance.select("column", describe_column().alias("label"))
    return (
        _drivers_only(values.where(F.col("entity") == entity), provenance)
        .groupBy("column").agg(F.avg("value").alias("value"))
        .join(labels, "column")
        .orderBy(F.desc(F.abs("value")), "column").limit(k)
    )


#: Fixed wording per kind of column; names in braces are filled from provenance.
PHRASES = {
    "identity": "{name} (current)",
    "lag": "{name} lag-{lag}",
    "rolling": "{name} {window}-period {agg}",
    "spatial_lag": "neighbouring {name} lag-{lag}",
    "cyclic": "{name} ({phase})",
    "static": "{name}",
    "entity": "entity identity: {entity}",
}


def describe_column() -> Column:
    """A provenance row as a phrase: the template of its kind with the blanks filled."""
    raw, column = F.col("raw_variable"), F.col("column")
    kind = (
        F.when(raw == ENTITY_VARIABLE, "entity")
        .when((F.col("transform") == "lag") & (F.col("lag") == 0), "identity")
        .otherwise(F.col("transform"))
    )
    spoken = F.replace(raw, F.lit("_"), F.lit(" "))
    blanks = {
        "name": F.when(column.startswith(LEVEL), LEVEL_LABEL).otherwise(
            F.coalesce(F.try_element_at(_lookup(LABELS), raw), spoken)),
        "lag": F.col("lag").cast("string"),
        "window": F.col("window").cast("string"),
        "agg": F.col("agg"),
        "phase": F.when(column.endswith("sin"), "sine").otherwise("cosine"),
        "entity": F.replace(column, F.lit(IDENTITY_PREFIX), F.lit("")),
    }
    phrase = F.try_element_at(_lookup(PHRASES), kind)
    for blank, value in blanks.items():
        phrase = F.replace(phrase, F.lit(f"{{{blank}}}"), F.coalesce(value, F.lit("")))
    return F.coalesce(phrase, column)


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
