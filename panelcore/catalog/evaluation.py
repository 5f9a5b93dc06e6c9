"""Folds, forecasters, metrics and the ablation grid."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcore.catalog.base import (
    MONTHS,
    TARGET,
    monthly,
    nation_levels,
    pick,
    query,
    staged_panel,
    table,
)
from panelcore.catalog.features import (
    COLUMNS,
    DESIGN,
    FULL,
    PLAIN,
    SPATIAL,
    build,
    design_columns,
    design_sql,
    nation_edges,
)
from panelcore.functions.scalars import finite
from panelcore.operators import evaluate, folds, models
from panelcore.operators.features import LEVEL, design
from panelcore.params import ConformalParams, FoldParams, SeasonalParams
from panelcore.plans.production import (
    Experiment,
    Setting,
    evaluate_selection,
    ablation_grid as ablations,
)
from panelcore.session import cut_lineage

FOLDS = FoldParams(n_folds=4, initial_train=24, test_size=6, step=6)
CONFORMAL = ConformalParams()
SEASONAL = SeasonalParams()


def cuts(samples, horizon: int = 1):
    return folds.rolling_origin(samples, FOLDS, horizon)


def scored_by(spark, d, factory, p=PLAIN, horizon: int = 1):
    """Validation and test rows of every fold, from samples materialised once.

    Arrays are stored only for forecasters that read them.
    """
    samples, spec = build(spark, d, p, horizon)
    samples = cut_lineage(samples if factory(spec).reads_sequence else samples.drop("seq"))
    return evaluate.score_folds(samples, cuts(samples, horizon), FOLDS, lambda: factory(spec),
                                guard=False)


def roles_sql(h: int = 1) -> str:
    """CTE ``roles``: fold, period, role from the distinct origins of ``samples``."""
    parts = []
    for k in range(FOLDS.n_folds):
        cut = FOLDS.initial_train + k * FOLDS.step
        usable = cut - h
        n_val = max(1, round(usable * FOLDS.validation_fraction))
        parts.append(
            f"SELECT {k} AS fold, period, CASE WHEN i < {usable - n_val} THEN 'fit' "
            f"WHEN i < {usable} THEN 'val' WHEN i >= {cut} AND i < {cut + FOLDS.test_size} "
            "THEN 'test' END AS role FROM axis")
    return """,
axis AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS i
         FROM (SELECT DISTINCT period FROM samples)),
roles AS (SELECT * FROM (""" + " UNION ALL ".join(parts) + ") WHERE role IS NOT NULL)"


def scored_sql(h: int, column: str) -> str:
    return f""",
scored AS (
  SELECT fold, role, entity, period, y, {column} AS prediction
  FROM samples JOIN roles USING (period) WHERE role <> 'fit')"""


def metrics_sql(source: str = "scored") -> str:
    rate = "(exp(y) - 1)", "(exp(prediction) - 1)"
    cols = []
    for name, (a, b) in {"log": ("y", "prediction"), "rate": rate}.items():
        cols += [
            f"avg(abs({a} - {b})) AS mae_{name}",
            f"sqrt(avg(({a} - {b}) ** 2)) AS rmse_{name}",
            f"1 - sum(({a} - {b}) ** 2) / nullif(regr_syy({a}, {b}), 0) AS r2_{name}",
        ]
    cols.append(f"avg(abs({rate[0]} - {rate[1]})) AS crps_rate")
    return f""",
metrics AS (SELECT fold, {', '.join(cols)} FROM {source} WHERE role = 'test' GROUP BY fold)"""


SUMMARY = """,
long AS (UNPIVOT metrics ON COLUMNS(* EXCLUDE fold) INTO NAME metric VALUE value),
summary AS (SELECT metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std
            FROM long GROUP BY 1)"""
METRICS = "~mae_log ~rmse_log ~r2_log ~mae_rate ~rmse_rate ~r2_rate ~crps_rate"
EVAL = DESIGN + roles_sql()
PERSISTENCE = EVAL + scored_sql(1, "target_level_lag_0")
SEASONAL_NAIVE = EVAL + scored_sql(1, "target_level_lag_11")


@query("fold_table", monthly(EVAL + " " + pick("#fold period role", "FROM roles")))
def fold_table(spark, d):
    samples, _ = build(spark, d, PLAIN)
    return cuts(samples)


@query("fold_counts", monthly(EVAL + """
SELECT CAST(fold AS BIGINT) AS fold, role, count(*) AS n
FROM samples JOIN roles USING (period) GROUP BY 1, 2"""))
def fold_counts(spark, d):
    samples, _ = build(spark, d, PLAIN)
    return folds.fold_counts(folds.assign_folds(samples, cuts(samples)))


@query("available_folds", monthly(DESIGN + """
SELECT count(DISTINCT period) AS n_periods,
       CAST((count(DISTINCT period) - 30) // 6 + 1 AS BIGINT) AS n_folds FROM samples"""))
def available_folds(spark, d):
    samples, _ = build(spark, d, PLAIN)
    return folds.available_folds(samples, FOLDS)


@query("tail_split", monthly(DESIGN + """,
axis AS (SELECT period, row_number() OVER (ORDER BY period DESC) AS r
         FROM (SELECT DISTINCT period FROM samples))
SELECT CASE WHEN r <= 12 THEN 'tail' ELSE 'fit' END AS part, count(*) AS n,
       min(period) AS first_origin, max(period) AS last_origin
FROM samples JOIN axis USING (period) GROUP BY 1"""))
def tail_split(spark, d):
    samples, _ = build(spark, d, PLAIN)
    part = F.when(F.col("period") < F.lit(folds.tail_cutoff(samples, 12)), "fit").otherwise("tail")
    return samples.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.min("period").alias("first_origin"),
        F.max("period").alias("last_origin"))


@query("scaling_moments", monthly(DESIGN + """,
steps AS (
  SELECT w.* FROM samples s JOIN wide w ON w.entity = s.entity
    AND w.period BETWEEN s.period - INTERVAL 5 MONTH AND s.period),
m AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg({c}) AS mean, CASE WHEN stddev_pop({c}) > 0 "
    f"THEN stddev_pop({c}) ELSE 1 END AS scale FROM steps" for c in COLUMNS)
    + ") " + pick('"column" ~mean ~scale', "FROM m")))
def scaling_moments(spark, d):
    wide, spec = design(staged_panel(spark, d), PLAIN, TARGET, MONTHS, 1, nation_edges(spark, d))
    return models.covered_moments(wide, spec)


@query("standardised_features", monthly(DESIGN + """,
steps AS (
  SELECT w.orders, w.avg_price, s.entity FROM samples s JOIN wide w ON w.entity = s.entity
    AND w.period BETWEEN s.period - INTERVAL 5 MONTH AND s.period),
m AS (SELECT avg(orders) AS a, stddev_pop(orders) AS sa, avg(avg_price) AS b,
             stddev_pop(avg_price) AS sb FROM steps),
z AS (SELECT entity, avg((orders - a) / sa) AS orders, avg((avg_price - b) / sb) AS avg_price
      FROM steps, m GROUP BY 1) """ + pick("entity ~orders ~avg_price", "FROM z")))
def standardised_features(spark, d):
    samples, spec = build(spark, d, PLAIN)
    mean, sd = models.scale_factors(samples, spec)
    rows = models.standardise(samples, mean, sd).select("entity", F.explode("seq").alias("r"))
    return rows.groupBy("entity").agg(
        F.avg(F.col("r")[spec.columns.index("orders")]).alias("orders"),
        F.avg(F.col("r")[spec.columns.index("avg_price")]).alias("avg_price"))


SCORED = pick("#fold role entity period ~y ~prediction", "FROM scored")


@query("persistence_forecast", monthly(PERSISTENCE + " " + SCORED))
def persistence_forecast(spark, d):
    return scored_by(spark, d, models.persistence).select(
        "fold", "role", "entity", "period", "y", "prediction")


@query("seasonal_naive_forecast", monthly(SEASONAL_NAIVE + " " + SCORED))
def seasonal_naive_forecast(spark, d):
    return scored_by(spark, d, lambda s: models.seasonal_naive(s, 12)).select(
        "fold", "role", "entity", "period", "y", "prediction")


# The profile reads position and anchor at the oldest of the six steps.
SEASONAL_TREND = EVAL + """,
keyed AS (
  SELECT fold, role, entity, period, y, month(period - INTERVAL 5 MONTH) - 1 AS pos, anchor
  FROM samples JOIN roles USING (period) JOIN (
    SELECT entity, period, lag(target_level, 5) OVER (PARTITION BY entity ORDER BY period)
      AS anchor FROM levels) USING (entity, period)),
cell AS (SELECT fold, entity, pos, avg(y) AS cell FROM keyed WHERE role = 'fit' GROUP BY 1, 2, 3),
base AS (SELECT fold, entity, avg(y) AS base FROM keyed WHERE role = 'fit' GROUP BY 1, 2),
pool AS (SELECT fold, pos, avg(y) AS pooled FROM keyed WHERE role = 'fit' GROUP BY 1, 2),
total AS (SELECT fold, avg(y) AS overall FROM keyed WHERE role = 'fit' GROUP BY 1),
exp AS (
  SELECT k.*, coalesce(cell, base, pooled, overall) AS expected,
         anchor - coalesce(base, overall) AS deviation
  FROM keyed k LEFT JOIN cell USING (fold, entity, pos) LEFT JOIN base USING (fold, entity)
  LEFT JOIN pool USING (fold, pos) JOIN total USING (fold)),
weight AS (
  SELECT fold, coalesce(sum(deviation * (y - expected)) / nullif(sum(deviation * deviation), 0), 0)
           AS weight
  FROM exp WHERE role = 'fit' GROUP BY 1),
scored AS (
  SELECT fold, role, entity, period, y, expected + weight * deviation AS prediction
  FROM exp JOIN weight USING (fold) WHERE role <> 'fit')"""


def _seasonal(spec):
    return models.SeasonalTrend(spec, 12, SEASONAL)


@query("seasonal_trend_forecast", monthly(SEASONAL_TREND + " " + SCORED))
def seasonal_trend_forecast(spark, d):
    return scored_by(spark, d, _seasonal, FULL).select(
        "fold", "role", "entity", "period", "y", "prediction")


@query("anchor_weight", monthly(SEASONAL_TREND + " " + pick("#fold ~weight", "FROM weight")))
def anchor_weight(spark, d):
    samples, spec = build(spark, d, FULL)
    assigned = folds.assign_folds(samples, cuts(samples)).where("role = 'fit'")
    rows = [(k[0], w) for k, w in _seasonal(spec).fit(assigned).weights.items()]
    return spark.createDataFrame(rows, "fold int, weight double")


def _metrics(spark, d, factory, p=PLAIN):
    scored = scored_by(spark, d, factory, p).where("role = 'test'")
    return evaluate.fold_metrics(scored, "log1p")


@query("fold_metrics", monthly(PERSISTENCE + metrics_sql() + " " + pick(
    "#fold " + METRICS, "FROM metrics")))
def fold_metrics(spark, d):
    return _metrics(spark, d, models.persistence)


@query("seasonal_trend_metrics", monthly(SEASONAL_TREND + metrics_sql() + " " + pick(
    "#fold " + METRICS, "FROM metrics")))
def seasonal_trend_metrics(spark, d):
    return _metrics(spark, d, _seasonal, FULL)


@query("aggregate_folds", monthly(PERSISTENCE + metrics_sql() + SUMMARY + " " + pick(
    "metric ~mean ~std", "FROM summary")))
def aggregate_folds(spark, d):
    return evaluate.aggregate_folds(_metrics(spark, d, models.persistence))


COMPARED = ("mae_log", "rmse_log", "mae_rate", "rmse_rate")


def _compare_sql() -> str:
    parts = []
    for run, column in (("persistence", "target_level_lag_0"),
                        ("seasonal_naive", "target_level_lag_11")):
        body = scored_sql(1, column).lstrip(",\n") + metrics_sql()
        cols = ", ".join(f"avg({m}) AS {m}" for m in COMPARED)
        parts.append(f"(WITH {body} SELECT '{run}' AS run, {cols} FROM metrics)")
    return EVAL + ", both_runs AS (" + " UNION ALL ".join(parts) + ") " + pick(
        "run " + " ".join(f"~{m}" for m in COMPARED), "FROM both_runs")


@query("compare_runs", monthly(_compare_sql()))
def compare_runs(spark, d):
    runs = {"persistence": models.persistence,
            "seasonal_naive": lambda s: models.seasonal_naive(s, 12)}
    tables = [
        evaluate.aggregate_folds(_metrics(spark, d, f), COMPARED).withColumn("run", F.lit(n))
        for n, f in runs.items()]
    return evaluate.compare(tables[0].unionByName(tables[1]), COMPARED)


@query("ridge_metrics")
def ridge_metrics(spark, d):
    return _metrics(spark, d, lambda s: models.Ridge(s))


#: Scored folds of the boosted trees, by application and table folder: two queries read them.
_BOOSTED: dict[tuple[str, str], DataFrame] = {}


def _boosted(spark, d) -> DataFrame:
    key = (spark.sparkContext.applicationId, d)
    if key not in _BOOSTED:
        _BOOSTED[key] = cut_lineage(scored_by(spark, d, lambda s: models.BoostedTrees(s)).drop("seq"))
    return _BOOSTED[key]


@query("gradient_boosting_metrics")
def gradient_boosting_metrics(spark, d):
    return evaluate.fold_metrics(_boosted(spark, d).where("role = 'test'"), "log1p")


@query("gradient_boosting_checks", monthly(EVAL + """
SELECT CAST(fold AS BIGINT) AS fold, role, count(*) AS n, true AS finite, true AS beats_persistence
FROM samples JOIN roles USING (period) WHERE role <> 'fit' GROUP BY 1, 2"""))
def gradient_boosting_checks(spark, d):
    """Every fold scores all its rows with finite values, closer than persistence does."""
    p, y = F.col("prediction"), F.col("y")
    naive = F.avg(F.abs(y - F.col(f"{LEVEL}_lag_0")))
    return _boosted(spark, d).groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min(finite(p)).alias("finite"),
        (F.avg(F.abs(y - p)) < naive).alias("beats_persistence"))


GRID = [Experiment("with_spatial"), Experiment("without_spatial", {"include_spatial": False})]


def _ablation_sql() -> str:
    parts = []
    for name, spatial in (("with_spatial", True), ("without_spatial", False)):
        for h in (1, 3):
            for model, column in (("persistence", "target_level_lag_0"),
                                  ("seasonal_naive", f"target_level_lag_{12 - h}")):
                body = (design_sql(h, spatial) + roles_sql(h) + scored_sql(h, column)
                        + metrics_sql() + SUMMARY).lstrip(",\n")
                n = len(design_columns(h, spatial))
                parts.append(f"""(WITH {body}
SELECT '{name}' AS experiment, '{model}' AS model, {h} AS horizon, {n} AS n_features,
       (SELECT count(*) FROM samples) AS n_samples, 4 AS folds,
       max(mean) FILTER (metric = 'mae_rate') AS mae_rate,
       max(std) FILTER (metric = 'mae_rate') AS mae_rate_std,
       max(mean) FILTER (metric = 'r2_log') AS r2_log FROM summary)""")
    return SPATIAL + ", cells AS (" + " UNION ALL ".join(parts) + ") " + pick(
        "experiment model #horizon #n_features #n_samples #folds ~mae_rate ~mae_rate_std ~r2_log",
        "FROM cells")


@query("ablation_grid", monthly(_ablation_sql()))
def ablation_grid(spark, d):
    setting = Setting(TARGET, MONTHS, FOLDS, CONFORMAL)
    table, _ = ablations(staged_panel(spark, d), PLAIN, GRID, [1, 3], setting,
                         ["persistence", "seasonal_naive"], nation_edges(spark, d))
    return table.select("experiment", "model", "horizon", "n_features", "n_samples", "folds",
                        "mae_rate", "mae_rate_std", "r2_log")


@query("ablation_skips", """
SELECT 'no_history' AS experiment, m AS model, CAST(h AS BIGINT) AS horizon,
       'the feature set carries no ' || chr(39) || 'target_level_lag_' ||
       CASE WHEN m = 'persistence' THEN '0' ELSE CAST(12 - h AS VARCHAR) END || chr(39) AS reason
FROM (VALUES ('persistence'), ('seasonal_naive')) a(m), (VALUES (1), (3)) b(h)
WHERE EXISTS (SELECT 1 FROM orders)""")
def ablation_skips(spark, d):
    """What a grid leaves out: without the target's history neither baseline can run."""
    setting = Setting(TARGET, MONTHS, FOLDS, CONFORMAL)
    grid = [Experiment("base"), Experiment("no_history", {"include_target_lags": False})]
    return ablations(staged_panel(spark, d), PLAIN, grid, [1, 3], setting,
                     ["persistence", "seasonal_naive"], nation_edges(spark, d))[1]


# A results table derived from the data: "experiment" is the lag used as forecast,
# "model" the region, and the years act as folds.
RESULTS_SQL = """,
err AS (
  SELECT r_name AS model, entity, period, target_level,
         abs(target_level - lag(target_level, 1) OVER w) AS e1,
         abs(target_level - lag(target_level, 2) OVER w) AS e2,
         abs(target_level - lag(target_level, 12) OVER w) AS e12
  FROM levels JOIN nation ON n_name = entity JOIN region ON n_regionkey = r_regionkey
  WINDOW w AS (PARTITION BY entity ORDER BY period)),
err_long AS (
  SELECT model, year(period) AS yr, 'lag_01' AS experiment, 1 AS n_features, e1 AS e FROM err
  UNION ALL SELECT model, year(period), 'lag_02', 2, e2 FROM err
  UNION ALL SELECT model, year(period), 'lag_12', 12, e12 FROM err),
by_year AS (SELECT model, experiment, n_features, yr, avg(e) AS mae FROM err_long GROUP BY ALL),
results AS (
  SELECT experiment, model, 1 AS horizon, n_features, avg(mae) AS mae_rate,
         stddev_samp(mae) AS mae_rate_std
  FROM by_year GROUP BY ALL)"""


def _results(spark, d):
    w = W.partitionBy("entity").orderBy("period")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    region = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("entity"), F.col("r_name").alias("model"))
    x = F.col("target_level")
    errors = nation_levels(spark, d).select(
        "entity", F.year("period").alias("yr"),
        *[F.abs(x - F.lag(x, k).over(w)).alias(f"lag_{k:02d}") for k in (1, 2, 12)]
    ).join(region, "entity")
    long = errors.unpivot(["model", "yr"], ["lag_01", "lag_02", "lag_12"], "experiment", "e")
    return (
        long.groupBy("model", "experiment", "yr").agg(F.avg("e").alias("mae"))
        .groupBy("experiment", "model").agg(
            F.lit(1).alias("horizon"),
            F.substring(F.first("experiment"), 5, 2).cast("int").alias("n_features"),
            F.avg("mae").alias("mae_rate"), F.stddev_samp("mae").alias("mae_rate_std"))
    )


@query("significance", monthly(RESULTS_SQL + """,
best AS (
  SELECT model, horizon, arg_min(experiment, mae_rate) AS best_experiment,
         min(mae_rate) AS best, arg_min(mae_rate_std, mae_rate) AS best_std
  FROM results GROUP BY 1, 2),
sig AS (
  SELECT r.model, r.horizon, experiment, mae_rate, best_experiment, mae_rate - best AS gap,
         (mae_rate - best) / greatest(mae_rate_std, best_std, 1e-12) AS gap_in_std,
         (mae_rate - best) / greatest(mae_rate_std, best_std, 1e-12) >= 1 AS distinguishable
  FROM results r JOIN best b ON b.model = r.model AND b.horizon = r.horizon) """ + pick(
    "model #horizon experiment ~mae_rate best_experiment ~gap ~gap_in_std distinguishable",
    "FROM sig")))
def significance(spark, d):
    return evaluate.significance(_results(spark, d))


@query("select_configuration", monthly(RESULTS_SQL + """,
best AS (SELECT min(mae_rate) AS m, arg_min(mae_rate_std, mae_rate) AS s FROM results
         WHERE model = 'ASIA')
SELECT arg_min(experiment, n_features) AS experiment, CAST(1 AS BIGINT) AS horizon
FROM results, best WHERE model = 'ASIA' AND (mae_rate - m) / greatest(s, 1e-12) < 1"""))
def select_configuration(spark, d):
    return evaluate.select_configuration(_results(spark, d), "ASIA")


# The selected cell keeps two columns, so more samples survive.
TWO_COLUMNS = """,
wide AS (
  SELECT entity, period, avg_price, target_level AS target_level_lag_0,
         lead(target_level, 1) OVER (PARTITION BY entity ORDER BY period) AS y
  FROM levels),
complete AS (
  SELECT *, count(avg_price + target_level_lag_0)
              OVER (PARTITION BY entity ORDER BY period ROWS 5 PRECEDING) AS n_ok
  FROM wide),
samples AS (SELECT * FROM complete WHERE n_ok = 6 AND y IS NOT NULL)"""


def _selection_sql() -> str:
    tail = roles_sql() + scored_sql(1, "target_level_lag_0") + metrics_sql() + SUMMARY
    parts = [
        f"""(WITH {(ctes + tail).lstrip(",").lstrip()}
SELECT '{name}' AS experiment, {n} AS n_features, (SELECT count(*) FROM samples) AS n_samples,
       max(mean) FILTER (metric = 'mae_rate') AS mae_rate,
       max(std) FILTER (metric = 'mae_rate') AS mae_rate_std FROM summary)"""
        for name, n, ctes in (("all", len(COLUMNS), design_sql()), ("selected", 2, TWO_COLUMNS))]
    return SPATIAL + ", cells AS (" + " UNION ALL ".join(parts) + ") " + pick(
        "experiment #n_features #n_samples ~mae_rate ~mae_rate_std", "FROM cells")


@query("selection_check", monthly(_selection_sql()))
def selection_check(spark, d):
    setting = Setting(TARGET, MONTHS, FOLDS, CONFORMAL)
    table = evaluate_selection(staged_panel(spark, d), PLAIN, ["avg_price", "target_level_lag_0"],
                               1, setting, "persistence", nation_edges(spark, d))
    return table.select("experiment", "n_features", "n_samples", "mae_rate", "mae_rate_std")


# Ridge in closed form: two columns, one step, one alpha, by Cramer's rule per fold.
RIDGE = """,
wide AS (
  SELECT entity, period, avg_price, target_level AS target_level_lag_0,
         lead(target_level, 1) OVER (PARTITION BY entity ORDER BY period) AS y
  FROM levels),
samples AS (SELECT * FROM wide WHERE avg_price + target_level_lag_0 + y IS NOT NULL)""" + (
    roles_sql()) + """,
fit AS (SELECT fold, avg_price AS a, target_level_lag_0 AS t, y
        FROM samples JOIN roles USING (period) WHERE role = 'fit'),
m AS (SELECT fold, stddev_pop(a) AS sa, stddev_pop(t) AS st, avg(a) AS ma, avg(t) AS mt,
             avg(y) AS my FROM fit GROUP BY 1),
z AS (SELECT fold, (a - ma) / sa AS z1, (t - mt) / st AS z2, y - my AS e
      FROM fit JOIN m USING (fold)),
g AS (SELECT fold, sum(z1 * z1) + 1.0 AS s11, sum(z2 * z2) + 1.0 AS s22, sum(z1 * z2) AS s12,
             sum(z1 * e) AS r1, sum(z2 * e) AS r2 FROM z GROUP BY 1),
b AS (SELECT fold, (r1 * s22 - r2 * s12) / (s11 * s22 - s12 * s12) AS b1,
             (r2 * s11 - r1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM g),
scored AS (
  SELECT fold, role, entity, period, y,
         my + b1 * (avg_price - ma) / sa + b2 * (target_level_lag_0 - mt) / st AS prediction
  FROM samples JOIN roles USING (period) JOIN m USING (fold) JOIN b USING (fold)
  WHERE role <> 'fit')"""
RIDGE_COLUMNS = dataclasses.replace(
    PLAIN, selected_columns=("avg_price", "target_level_lag_0"), sequence_length=1)


@query("ridge_forecast", monthly(RIDGE + " " + SCORED))
def ridge_forecast(spark, d):
    return scored_by(spark, d, lambda s: models.Ridge(s, (1.0,)), RIDGE_COLUMNS).select(
        "fold", "role", "entity", "period", "y", "prediction")


# The same model with alpha chosen per fold by leave-one-out: the error of a left-out row is
# its residual over 1 - h, where h is its leverage.
RIDGE_ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)
RIDGE_LOO = RIDGE[:RIDGE.index("g AS (")] + """g AS (
  SELECT fold, alpha, count(*) AS n, sum(z1 * z1) + alpha AS s11, sum(z2 * z2) + alpha AS s22,
         sum(z1 * z2) AS s12, sum(z1 * e) AS r1, sum(z2 * e) AS r2
  FROM z, (VALUES """ + ", ".join(f"({a}::DOUBLE)" for a in RIDGE_ALPHAS) + """) v(alpha)
  GROUP BY 1, 2),
b AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM g),
c AS (SELECT *, (r1 * s22 - r2 * s12) / det AS b1, (r2 * s11 - r1 * s12) / det AS b2 FROM b),
loo AS (
  SELECT fold, alpha, any_value(b1) AS b1, any_value(b2) AS b2,
         sum(((e - b1 * z1 - b2 * z2)
              / (1 - 1.0 / n - (z1 * z1 * s22 - 2 * z1 * z2 * s12 + z2 * z2 * s11) / det)) ** 2) AS sse
  FROM z JOIN c USING (fold) GROUP BY 1, 2),
best AS (SELECT fold, arg_min(alpha, sse) AS alpha, arg_min(b1, sse) AS b1, arg_min(b2, sse) AS b2
         FROM loo GROUP BY 1),
scored AS (
  SELECT fold, role, entity, period, y,
         my + b1 * (avg_price - ma) / sa + b2 * (target_level_lag_0 - mt) / st AS prediction
  FROM samples JOIN roles USING (period) JOIN m USING (fold) JOIN best USING (fold)
  WHERE role <> 'fit')"""


@query("ridge_loo_metrics", monthly(RIDGE_LOO + metrics_sql() + " " + pick(
    "#fold " + METRICS, "FROM metrics")))
def ridge_loo_metrics(spark, d):
    return _metrics(spark, d, lambda s: models.Ridge(s, RIDGE_ALPHAS), RIDGE_COLUMNS)


@query("prediction_rows", monthly(PERSISTENCE + """,
pred AS (
  SELECT fold, entity, period AS origin_date,
         CAST(period + INTERVAL 1 MONTH AS DATE) AS target_date, y AS actual_log,
         exp(y) - 1 AS actual_rate, prediction AS predicted_log, prediction - 0.1 AS lower_log,
         prediction + 0.1 AS upper_log, greatest(exp(prediction) - 1, 0) AS predicted_rate,
         greatest(exp(prediction - 0.1) - 1, 0) AS lower_rate,
         greatest(exp(prediction + 0.1) - 1, 0) AS upper_rate
  FROM scored WHERE role = 'test') """ + pick(
    "#fold entity origin_date target_date ~actual_log ~actual_rate ~predicted_log ~lower_log "
    "~upper_log ~predicted_rate ~lower_rate ~upper_rate", "FROM pred")))
def prediction_rows(spark, d):
    scored = scored_by(spark, d, models.persistence).where("role = 'test'")
    p = F.col("prediction")
    bounded = scored.withColumns({"lower": p - 0.1, "upper": p + 0.1})
    return evaluate.prediction_rows(bounded, 1, MONTHS, "log1p")
