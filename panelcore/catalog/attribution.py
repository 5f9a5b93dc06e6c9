"""Attributions of a linear model (exact) and of any model (sampled)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcore.catalog.base import MONTHS, TARGET, monthly, nation_names, pick, query, staged_panel
from panelcore.functions.ranks import one_group
from panelcore.operators import attribution
from panelcore.operators.features import build_samples
from panelcore.operators.models import BoostedTrees, FittedModel, Ridge
from panelcore.operators.tree_attribution import explain_trees, stored_leaves
from panelcore.params import FeatureParams
from panelcore.session import cut_lineage, scratch_path

SMALL = FeatureParams(level_variables=("avg_price", "max_price"), include_lags=False, lags=(12,),
                      entity_identity=False, sequence_length=2)
COLUMNS = ["avg_price", "max_price", "season_sin", "season_cos", "target_level_lag_0",
           "target_level_lag_11", "target_level_lag_12"]
RAW = {"avg_price": "avg_price", "max_price": "max_price", "season_sin": "__calendar__",
       "season_cos": "__calendar__"}
LABELS = {"avg_price": "avg price (current)", "max_price": "max price (current)",
          "season_sin": "calendar seasonality (sine)",
          "season_cos": "calendar seasonality (cosine)",
          "target_level_lag_0": "case rate (current)",
          "target_level_lag_11": "case rate lag-11", "target_level_lag_12": "case rate lag-12"}
# One weight per column for the older and the newer of two steps.
OLDER = [1e-6, -2e-6, 0.10, -0.05, 0.20, 0.05, 0.10]
NEWER = [3e-6, 1e-6, -0.20, 0.15, 0.45, 0.10, 0.15]

#: The registry of the given tables, which fixes the columns of the wide ranking.
NATIONS = [f"NATION_{i}" for i in range(25)]

_BASE = {"avg_price": "avg_price", "max_price": "max_price",
         "season_sin": "sin(2 * pi() * (month(period) - 1) / 12)",
         "season_cos": "cos(2 * pi() * (month(period) - 1) / 12)",
         "target_level_lag_0": "target_level",
         "target_level_lag_11": "lag(target_level, 11) OVER w",
         "target_level_lag_12": "lag(target_level, 12) OVER w"}

SAMPLES = """,
wide AS (
  SELECT entity, period, """ + ", ".join(f"{sql} AS {c}" for c, sql in _BASE.items()) + """,
         lead(target_level, 1) OVER w AS y
  FROM levels WINDOW w AS (PARTITION BY entity ORDER BY period)),
pairs_ AS (
  SELECT *, """ + ", ".join(f"lag({c}, 1) OVER w AS old_{c}" for c in COLUMNS) + """
  FROM wide WINDOW w AS (PARTITION BY entity ORDER BY period)),
samples AS (SELECT * FROM pairs_ WHERE y IS NOT NULL AND """ + " AND ".join(
    f"{c} IS NOT NULL AND old_{c} IS NOT NULL" for c in COLUMNS) + ")"

VALUES = SAMPLES + """,
means AS (SELECT """ + ", ".join(
    f"avg({c}) AS m_{c}, avg(old_{c}) AS o_{c}" for c in COLUMNS) + """ FROM samples),
vals AS (""" + " UNION ALL ".join(
    f"SELECT entity, period, '{c}' AS \"column\", '{RAW.get(c, 'orders')}' AS raw_variable, "
    f"'{LABELS[c]}' AS label, {i} AS pos, "
    f"({a}) * (old_{c} - o_{c}) + ({b}) * ({c} - m_{c}) AS value FROM samples, means"
    for i, (c, a, b) in enumerate(zip(COLUMNS, OLDER, NEWER))) + ")"


def _samples(spark, d):
    samples, spec = build_samples(staged_panel(spark, d), SMALL, TARGET, MONTHS, 1)
    return cut_lineage(samples), spec


def values(spark, d):
    samples, spec = _samples(spark, d)
    rows = attribution.explain_linear(samples, spec, [*OLDER, *NEWER], samples)
    return rows, spec.provenance(spark)


class Weighted(FittedModel):
    """A given linear model, to check sampled attributions against exact ones."""

    def __init__(self, weights) -> None:
        self.weights = weights

    def transform(self, samples):
        w = F.array(*map(F.lit, self.weights))
        products = F.zip_with(F.flatten("seq"), w, lambda x, c: x * c)
        return samples.withColumn(
            "prediction", F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x))


@query("rows_to_explain", monthly(SAMPLES + """,
numbered AS (SELECT entity, period, row_number() OVER (ORDER BY entity, period) - 1 AS i,
                    count(*) OVER () AS n FROM samples),
wanted AS (SELECT DISTINCT CAST(floor(k * (n - 1) / 59) AS BIGINT) AS i
           FROM (SELECT max(n) AS n FROM numbered), range(60) t(k))
SELECT entity, period FROM numbered JOIN wanted USING (i)"""))
def rows_to_explain(spark, d):
    samples, _ = _samples(spark, d)
    return attribution.rows_to_explain(samples, 60).select("entity", "period")


@query("linear_attribution", monthly(VALUES + " " + pick(
    'entity period "column" ~value', "FROM vals")))
def linear_attribution(spark, d):
    return values(spark, d)[0]


@query("sampled_attribution")
def sampled_attribution(spark, d):
    samples, spec = _samples(spark, d)
    return attribution.explain_sampled(samples, spec, Weighted([*OLDER, *NEWER]), samples,
                                       permutations=20)


@query("sampled_attribution_exact", monthly(VALUES + " " + pick(
    'entity period "column" ~value', "FROM vals")))
def sampled_attribution_exact(spark, d):
    """Against the mean row every permutation of a linear model gives the exact values."""
    samples, spec = _samples(spark, d)
    f = len(spec.columns)
    steps = F.transform(F.sequence(F.lit(0), F.lit(spec.timesteps - 1)),
                        lambda k: F.slice("_mean", k * f + 1, f))
    mean = cut_lineage(attribution.mean_background(samples, spec).select(
        F.lit("mean").alias("entity"), F.lit(MONTHS.start).alias("period"), steps.alias("seq")))
    return attribution.explain_sampled(samples, spec, Weighted([*OLDER, *NEWER]), mean,
                                       permutations=2)


@query("ridge_attribution")
def ridge_attribution(spark, d):
    samples, spec = _samples(spark, d)
    model = Ridge(spec).fit(samples)
    rows = attribution.explain_linear(samples, spec, attribution.linear_coefficients(model),
                                      samples)
    return attribution.global_importance(rows)


@query("tree_attribution", monthly(SAMPLES + f"""
SELECT entity, period, CAST({len(COLUMNS)} AS BIGINT) AS n_columns, 0.0::DOUBLE AS gap FROM samples"""))
def tree_attribution(spark, d):
    """Exact values of stored boosted trees; ``gap`` is what a row's values lack to the
    distance of its forecast from the mean forecast."""
    samples, spec = _samples(spark, d)
    path = scratch_path(spark, "trees")
    fitted = BoostedTrees(spec).fit(samples)
    fitted.save(path)
    values = explain_trees(samples, spec, stored_leaves(spark, path, spec), samples)
    total = values.groupBy("entity", "period").agg(
        F.count("column").alias("n_columns"), F.sum("value").alias("_sum"))
    scored = fitted.transform(samples).select("entity", "period", "prediction")
    mean = scored.agg(F.avg("prediction").alias("_mean"))
    gap = F.round(F.col("_sum") - (F.col("prediction") - F.col("_mean")), 6)
    return one_group(mean, scored).join(total, ["entity", "period"]).select(
        "entity", "period", "n_columns", F.abs(gap).alias("gap"))


IMPORTANCE = VALUES + """,
importance AS (SELECT "column", raw_variable, label, avg(abs(value)) AS importance
               FROM vals GROUP BY 1, 2, 3)"""


@query("global_importance", monthly(IMPORTANCE + " " + pick(
    '"column" ~importance', "FROM importance")))
def global_importance(spark, d):
    return attribution.global_importance(values(spark, d)[0])


@query("raw_variable_importance", monthly(IMPORTANCE + """,
r AS (SELECT raw_variable, sum(importance) AS importance FROM importance GROUP BY 1) """ + pick(
    "raw_variable ~importance", "FROM r")))
def raw_variable_importance(spark, d):
    rows, provenance = values(spark, d)
    return attribution.raw_importance(attribution.global_importance(rows), provenance)


@query("top_drivers", monthly(VALUES + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity, period
                                        ORDER BY abs(value) DESC, "column") AS r FROM vals)
SELECT entity, period AS origin_date, string_agg(label, ', ' ORDER BY r) AS drivers
FROM ranked WHERE r <= 3 GROUP BY 1, 2"""))
def top_drivers(spark, d):
    rows = attribution.top_drivers(*values(spark, d), k=3)
    labels = F.array_join(F.transform("drivers", lambda x: x["label"]), ", ")
    return rows.select("entity", "origin_date", labels.alias("drivers"))


RANKING = VALUES + """,
ranking AS (SELECT entity, "column", avg(abs(value)) AS importance FROM vals GROUP BY 1, 2)"""


@query("entity_ranking", monthly(RANKING + " " + pick(
    'entity "column" ~importance', "FROM ranking")))
def entity_ranking(spark, d):
    return attribution.entity_ranking(*values(spark, d))


@query("top_driver_per_entity", monthly(RANKING + """,
t AS (SELECT entity, "column", importance, row_number() OVER (
        PARTITION BY entity ORDER BY importance DESC) AS r FROM ranking) """ + pick(
    'entity "column" ~importance', "FROM t WHERE r = 1")))
def top_driver_per_entity(spark, d):
    return attribution.top_driver_per_entity(attribution.entity_ranking(*values(spark, d)))


@query("ranking_table", monthly(RANKING + ", r AS (" + pick(
    'entity "column" ~importance', "FROM ranking") + """)
SELECT "column", """ + ", ".join(
    f"max(importance) FILTER (WHERE entity = '{n}') AS \"{n}\"" for n in NATIONS)
    + """ FROM r GROUP BY 1"""))
def ranking_table(spark, d):
    ranking = attribution.entity_ranking(*values(spark, d))
    return attribution.ranking_table(ranking, nation_names(spark, d))


@query("selected_features", monthly(IMPORTANCE + " " + pick(
    '"column" ~importance', "FROM importance ORDER BY importance DESC LIMIT 5")))
def selected_features(spark, d):
    return attribution.select_features(*values(spark, d), k=5)


@query("described_columns", monthly(IMPORTANCE + " " + pick(
    '"column" label ~importance', "FROM importance")))
def described_columns(spark, d):
    rows, provenance = values(spark, d)
    labels = provenance.select("column", attribution.describe_column().alias("label"))
    return attribution.global_importance(rows).join(labels, "column").select(
        "column", "label", "importance")


@query("entity_drivers", monthly(VALUES + """,
e AS (SELECT "column", label, avg(value) AS value FROM vals WHERE entity = 'NATION_3'
      GROUP BY 1, 2) """ + pick('"column" label ~value',
                                "FROM e ORDER BY abs(value) DESC LIMIT 8")))
def entity_drivers(spark, d):
    return attribution.entity_drivers(*values(spark, d), "NATION_3").select(
        "column", "label", "value")
