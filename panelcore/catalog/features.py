"""Lags, frames, neighbourhoods, targets and samples."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcore.catalog.base import (
    EDGES,
    MONTHS,
    TARGET,
    VARIABLES,
    WEEKS,
    customer_panel,
    exposure,
    customers,
    monthly,
    nation_levels,
    nation_names,
    nation_panel,
    neighbour_pairs,
    pick,
    query,
    staged_panel,
    weekly,
)
from panelcore.functions.scalars import cyclic, inverse_target
from panelcore.operators import features
from panelcore.params import FeatureParams
from panelcore.sources.registry import symmetric_edges

FULL = FeatureParams(
    variable_source={"orders": "counts", "avg_price": "prices", "max_price": "prices",
                     "exposure": "people"},
    level_variables=("orders", "avg_price", "max_price"),
    lags=(1, 2, 3, 12),
    lag_variables=("orders", "avg_price"),
    windows=(3,),
    rolling_variables=("avg_price", "max_price"),
    include_spatial=True,
    spatial_lags=(1,),
    spatial_variable="orders",
    static_variables=("exposure",),
    sequence_length=6,
)
PLAIN = dataclasses.replace(FULL, entity_identity=False)


def nation_edges(spark, d) -> DataFrame:
    return symmetric_edges(neighbour_pairs(spark, d))


def build(spark, d, p: FeatureParams, horizon: int = 1):
    names = nation_names(spark, d) if p.entity_identity else None
    return features.build_samples(staged_panel(spark, d), p, TARGET, MONTHS, horizon,
                                  nation_edges(spark, d), names)


# -- SQL of the design --------------------------------------------------------


def design_columns(h: int = 1, spatial: bool = True) -> dict[str, tuple[str, str]]:
    """Column name to (SQL, raw variable), in the order of the builder."""
    cols = {v: (f"p.{v}", v) for v in VARIABLES}
    for v in ("orders", "avg_price"):
        for k in (1, 2, 3, 12):
            cols[f"{v}_lag_{k}"] = (f"lag(p.{v}, {k}) OVER w", v)
    for v in ("avg_price", "max_price"):
        cols[f"{v}_roll3_mean"] = (
            f"CASE WHEN count(p.{v}) OVER r3 = 3 THEN avg(p.{v}) OVER r3 END", v)
    if spatial:
        cols["orders_spatial_lag_1"] = ("sp.orders_spatial_lag_1", "orders")
    angle = "2 * pi() * (month(p.period) - 1) / 12"
    cols["season_sin"] = (f"sin({angle})", "__calendar__")
    cols["season_cos"] = (f"cos({angle})", "__calendar__")
    cols["exposure"] = ("p.exposure", "exposure")
    for k in sorted({0, 1, 2, 3, 12, 12 - h}):
        cols[f"target_level_lag_{k}"] = (f"lag(p.target_level, {k}) OVER w", "orders")
    return cols


SPATIAL = EDGES + """,
shifted AS (
  SELECT entity, period, lag(orders, 1) OVER w AS v1, lag(orders, 2) OVER w AS v2
  FROM panel WINDOW w AS (PARTITION BY entity ORDER BY period)),
weights AS (
  SELECT entity, neighbour, 1.0 / count(*) OVER (PARTITION BY entity) AS weight FROM edges),
sp AS (
  SELECT w.entity, s.period, sum(weight * v1) AS orders_spatial_lag_1,
         sum(weight * v2) AS orders_spatial_lag_2
  FROM weights w JOIN shifted s ON s.entity = w.neighbour GROUP BY 1, 2)"""


def design_sql(h: int = 1, spatial: bool = True, steps: int = 6) -> str:
    """CTEs ``wide`` and ``samples``; SPATIAL must precede them."""
    cols = design_columns(h, spatial)
    listed = ",\n         ".join(f"{sql} AS {name}" for name, (sql, _) in cols.items())
    complete = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    join = "LEFT JOIN sp ON sp.entity = p.entity AND sp.period = p.period" if spatial else ""
    return f""",
wide AS (
  SELECT p.entity, p.period, {listed},
         lead(p.target_level, {h}) OVER w AS y
  FROM levels p {join}
  WINDOW w AS (PARTITION BY p.entity ORDER BY p.period),
         r3 AS (PARTITION BY p.entity ORDER BY p.period ROWS 2 PRECEDING)),
complete AS (
  SELECT *, sum(CASE WHEN {complete} THEN 1 ELSE 0 END)
              OVER (PARTITION BY entity ORDER BY period ROWS {steps - 1} PRECEDING) AS n_ok
  FROM wide),
samples AS (SELECT * FROM complete WHERE n_ok = {steps} AND y IS NOT NULL)"""


DESIGN = SPATIAL + design_sql()
COLUMNS = list(design_columns())


# -- single operators ---------------------------------------------------------


@query("lag_features", customers(""",
f AS (SELECT entity, period, lag(orders, 1) OVER w AS orders_lag_1,
             lag(orders, 12) OVER w AS orders_lag_12, lag(avg_price, 1) OVER w AS avg_price_lag_1,
             lag(avg_price, 12) OVER w AS avg_price_lag_12
      FROM panel WINDOW w AS (PARTITION BY entity ORDER BY period)) """ + pick(
    "entity period ~orders_lag_1 ~orders_lag_12 ~avg_price_lag_1 ~avg_price_lag_12", "FROM f")))
def lag_features(spark, d):
    cols = features.lag_columns(["orders", "avg_price"], (1, 12))
    return customer_panel(spark, d).select("entity", "period", *cols)


_AGGS = {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "std": "stddev_samp"}
_ROLLED = [f"{v}_roll{w}_{a}" for v in ("orders", "avg_price") for w in (3, 6) for a in _AGGS]


@query("rolling_features", weekly(", f AS (SELECT entity, period, " + ", ".join(
    f"CASE WHEN count({v}) OVER r{w} = {w} THEN {fn}({v}) OVER r{w} END AS {v}_roll{w}_{a}"
    for v in ("orders", "avg_price") for w in (3, 6) for a, fn in _AGGS.items()) + """
  FROM panel WINDOW r3 AS (PARTITION BY entity ORDER BY period ROWS 2 PRECEDING),
                    r6 AS (PARTITION BY entity ORDER BY period ROWS 5 PRECEDING)) """ + pick(
    "entity period " + " ".join(f"~{c}" for c in _ROLLED), "FROM f")))
def rolling_features(spark, d):
    cols = features.rolling_columns(["orders", "avg_price"], (3, 6), tuple(_AGGS))
    return nation_panel(spark, d, WEEKS).select("entity", "period", *cols)


@query("spatial_weights_uniform", monthly(SPATIAL + " " + pick(
    "entity neighbour ~weight", "FROM weights")))
def spatial_weights_uniform(spark, d):
    return features.spatial_weights(nation_edges(spark, d), exposure(spark, d))


@query("spatial_weights_exposure", monthly(EDGES + """,
ww AS (SELECT e.entity, e.neighbour,
              p.exposure / sum(p.exposure) OVER (PARTITION BY e.entity) AS weight
       FROM edges e JOIN people p ON p.entity = e.neighbour) """ + pick(
    "entity neighbour ~weight", "FROM ww")))
def spatial_weights_exposure(spark, d):
    return features.spatial_weights(nation_edges(spark, d), exposure(spark, d), "exposure",
                                    "exposure")


@query("spatial_lag_features", monthly(SPATIAL + " " + pick(
    "entity period ~orders_spatial_lag_1 ~orders_spatial_lag_2", "FROM sp")))
def spatial_lag_features(spark, d):
    panel = staged_panel(spark, d)
    weights = features.spatial_weights(nation_edges(spark, d), exposure(spark, d))
    return features.spatial_lags(panel, weights, "orders", (1, 2))


def _cyclic(panel, calendar):
    s, c = cyclic(F.col("period"), calendar)
    return panel.select("entity", "period", s.alias("season_sin"), c.alias("season_cos"))


@query("cyclic_months", monthly(
    ", f AS (SELECT entity, period, sin(2 * pi() * (month(period) - 1) / 12) AS season_sin, "
    "cos(2 * pi() * (month(period) - 1) / 12) AS season_cos FROM grid) "
    + pick("entity period ~season_sin ~season_cos", "FROM f")))
def cyclic_months(spark, d):
    return _cyclic(nation_panel(spark, d), MONTHS)


@query("cyclic_weeks", weekly(
    ", f AS (SELECT entity, period, sin(2 * pi() * (week(period) - 1) / 52) AS season_sin, "
    "cos(2 * pi() * (week(period) - 1) / 52) AS season_cos FROM grid) "
    + pick("entity period ~season_sin ~season_cos", "FROM f")))
def cyclic_weeks(spark, d):
    return _cyclic(nation_panel(spark, d, WEEKS), WEEKS)


@query("entity_identity", monthly(
    " SELECT g.entity, period, n_name AS marker, "
    "CASE WHEN g.entity = n_name THEN 1.0::DOUBLE ELSE 0.0 END AS value "
    "FROM grid g CROSS JOIN nation"))
def entity_identity(spark, d):
    names = nation_names(spark, d)
    wide = nation_panel(spark, d).select("entity", "period", *features.identity_columns(names))
    long = wide.unpivot(["entity", "period"], wide.columns[2:], "marker", "value")
    return long.withColumn(
        "marker", F.replace("marker", F.lit(features.IDENTITY_PREFIX), F.lit("")))


@query("level_and_static_features", monthly(" " + pick(
    "entity period ~orders ~avg_price ~exposure", "FROM panel")))
def level_and_static_features(spark, d):
    p = FeatureParams(level_variables=("orders", "avg_price"), include_lags=False, cyclic=False,
                      static_variables=("exposure",), include_target_lags=False,
                      entity_identity=False)
    wide, spec = features.design(nation_panel(spark, d), p, TARGET, MONTHS, 1)
    return wide.select("entity", "period", *spec.columns)


@query("target_level", monthly(" " + pick("entity period ~target_level", "FROM levels")))
def target_level(spark, d):
    return nation_levels(spark, d).select("entity", "period", "target_level")


@query("inverse_target", monthly(
    ", f AS (SELECT entity, period, greatest(exp(target_level - 3.0) - 1, 0) AS rate FROM levels "
    "WHERE target_level IS NOT NULL) " + pick("entity period ~rate", "FROM f")))
def inverse(spark, d):
    levels = nation_levels(spark, d).where("target_level is not null")
    return levels.select("entity", "period",
                         inverse_target(F.col("target_level") - 3.0, "log1p").alias("rate"))


@query("forward_target", monthly(
    ", f AS (SELECT entity, period, lead(target_level, 3) OVER (PARTITION BY entity "
    "ORDER BY period) AS y FROM levels) " + pick("entity period ~y", "FROM f")))
def forward_target(spark, d):
    return nation_levels(spark, d).select("entity", "period",
                                          features.forward_target(3).alias("y"))


@query("target_lag_features", monthly(
    ", f AS (SELECT entity, period, " + ", ".join(
        f"lag(target_level, {k}) OVER w AS target_level_lag_{k}" for k in (0, 1, 2, 3, 9, 12))
    + " FROM levels WINDOW w AS (PARTITION BY entity ORDER BY period)) " + pick(
        "entity period " + " ".join(f"~target_level_lag_{k}" for k in (0, 1, 2, 3, 9, 12)),
        "FROM f")))
def target_lag_features(spark, d):
    offsets = features.target_offsets(FULL, 3, 12)
    cols = features.target_lag_columns("orders", offsets)
    return nation_levels(spark, d).select("entity", "period", *cols)


@query("feature_design", monthly(DESIGN + " " + pick(
    "entity period " + " ".join(f"~{c}" for c in COLUMNS) + " ~y", "FROM wide")))
def feature_design(spark, d):
    wide, _ = features.design(staged_panel(spark, d), PLAIN, TARGET, MONTHS, 1,
                              nation_edges(spark, d))
    return wide


@query("feature_design_customers", customers(""",
levels AS (SELECT *, 1000.0::DOUBLE AS exposure, ln(1 + orders / 1000.0 * 100000) AS target_level
           FROM panel)""" + design_sql(1, False) + " " + pick(
    "entity period " + " ".join(f"~{c}" for c in design_columns(1, False)) + " ~y", "FROM wide")))
def feature_design_customers(spark, d):
    """The design over every customer and month, where the panel grows with the tables."""
    p = dataclasses.replace(PLAIN, include_spatial=False)
    panel = customer_panel(spark, d).withColumn("exposure", F.lit(1000.0))
    return features.design(panel, p, TARGET, MONTHS, 1)[0]


@query("source_selection", monthly(DESIGN + " " + pick(
    "entity period ~avg_price ~max_price ~avg_price_lag_1 ~avg_price_lag_2 ~avg_price_lag_3 "
    "~avg_price_lag_12 ~avg_price_roll3_mean ~max_price_roll3_mean ~season_sin ~season_cos ~y",
    "FROM wide")))
def source_selection(spark, d):
    p = dataclasses.replace(PLAIN, sources=("prices",))
    return features.design(staged_panel(spark, d), p, TARGET, MONTHS, 1, nation_edges(spark, d))[0]


@query("column_selection", monthly(DESIGN + " " + pick(
    "entity period ~avg_price_lag_1 ~orders_spatial_lag_1 ~target_level_lag_0 ~y", "FROM wide")))
def column_selection(spark, d):
    chosen = ("orders_spatial_lag_1", "avg_price_lag_1", "target_level_lag_0")
    p = dataclasses.replace(PLAIN, selected_columns=chosen)
    return features.design(staged_panel(spark, d), p, TARGET, MONTHS, 1, nation_edges(spark, d))[0]


@query("window_sequences", monthly(DESIGN + """,
cells AS (
  SELECT entity, period, lag(orders, 5) OVER w AS oldest, orders AS newest,
         sum(target_level_lag_0) OVER (PARTITION BY entity ORDER BY period ROWS 5 PRECEDING)
           AS level_sum, 6 AS n_steps
  FROM wide WINDOW w AS (PARTITION BY entity ORDER BY period)) """ + pick(
    "entity period ~oldest ~newest ~level_sum #n_steps ~y",
    "FROM cells JOIN (SELECT entity, period, y FROM samples) USING (entity, period)")))
def window_sequences(spark, d):
    samples, spec = build(spark, d, FULL)
    i = spec.columns.index("target_level_lag_0")
    total = F.aggregate("seq", F.lit(0.0), lambda acc, row: acc + row[i])
    return samples.select(
        "entity", "period",
        features.step_value(samples, spec, "orders", 5).alias("oldest"),
        features.step_value(samples, spec, "orders").alias("newest"),
        total.alias("level_sum"), F.size("seq").alias("n_steps"), "y")


@query("flat_columns", monthly(DESIGN + ", lagged AS (SELECT entity, period, " + ", ".join(
    f'lag({c}, {k}) OVER w AS "{c}@t-{k}"' for k in range(5, -1, -1) for c in COLUMNS)
    + """ FROM wide WINDOW w AS (PARTITION BY entity ORDER BY period)),
means AS (SELECT """ + ", ".join(
        f'avg("{c}@t-{k}") AS "{c}@t-{k}"' for k in range(5, -1, -1) for c in COLUMNS)
    + """ FROM lagged JOIN (SELECT entity, period FROM samples) USING (entity, period)),
long AS (UNPIVOT means ON COLUMNS(*) INTO NAME "column" VALUE mean_value)
SELECT "column", CAST(round(CAST(mean_value AS DECIMAL(38,9)), 6) AS DOUBLE) AS mean_value
FROM long"""))
def flat_columns(spark, d):
    samples, spec = build(spark, d, PLAIN)
    names = F.array(*map(F.lit, features.flat_names(spec)))
    flat = features.flatten_sequence(F.col("seq"))
    long = samples.select(F.explode(F.arrays_zip(names.alias("column"), flat.alias("v"))).alias(
        "c"))
    return long.groupBy(F.col("c.column").alias("column")).agg(F.avg("c.v").alias("mean_value"))


@query("dropped_entities", customers(""",
pair AS (
  SELECT entity, orders, lag(orders, 1) OVER w AS before, lead(orders, 1) OVER w AS after
  FROM panel WINDOW w AS (PARTITION BY entity ORDER BY period))
SELECT DISTINCT entity FROM panel WHERE entity NOT IN (
  SELECT entity FROM pair WHERE orders + before + after IS NOT NULL)"""))
def dropped_entities(spark, d):
    p = FeatureParams(level_variables=("orders",), include_lags=False, cyclic=False,
                      include_target_lags=False, entity_identity=False, sequence_length=2)
    panel = customer_panel(spark, d).withColumn("exposure", F.lit(1000.0))
    samples, _ = features.build_samples(panel, p, TARGET, MONTHS, 1)
    return features.dropped_entities(panel, samples)


def _raw_sql() -> str:
    parts: dict[str, list[str]] = {}
    for c, (_, raw) in design_columns().items():
        parts.setdefault(raw, []).append(f"avg(abs({c}))")
    return " UNION ALL ".join(
        f"SELECT '{raw}' AS raw_variable, {' + '.join(x)} AS mean_abs FROM samples"
        for raw, x in parts.items())


@query("provenance_totals", monthly(DESIGN + f", v AS ({_raw_sql()}) " + pick(
    "raw_variable ~mean_abs", "FROM v")))
def provenance_totals(spark, d):
    samples, spec = build(spark, d, PLAIN)
    names = F.array(*map(F.lit, spec.columns))
    last = F.element_at("seq", spec.timesteps)
    long = samples.select(F.explode(F.arrays_zip(names.alias("column"), last.alias("v"))).alias(
        "c"))
    means = long.groupBy(F.col("c.column").alias("column")).agg(
        F.avg(F.abs("c.v")).alias("mean_abs"))
    return features.by_raw_variable(means, spec.provenance(spark), "mean_abs")


@query("sample_counts", monthly(DESIGN + """
SELECT entity, count(*) AS n_samples, min(period) AS first_origin, max(period) AS last_origin
FROM samples GROUP BY 1"""))
def sample_counts(spark, d):
    samples, _ = build(spark, d, FULL)
    return samples.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_samples"), F.min("period").alias("first_origin"),
        F.max("period").alias("last_origin"))
