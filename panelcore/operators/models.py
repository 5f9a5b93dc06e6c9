"""Forecasters over sample tables (``entity, period, seq, y``).

A forecaster is fitted on rows and returns a model whose ``transform`` adds
``prediction``. Nothing here gathers samples: fits are aggregates, or Spark ML.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcore.functions.ranks import one_group
from panelcore.functions.scalars import finite, position_from_cyclic
from panelcore.operators.boosting import boosted, predicted
from panelcore.operators.features import LEVEL, FeatureSpec, flatten_sequence, series, step_value
from panelcore.operators.statistics import (
    RidgePath,
    fold_moments,
    leave_one_out,
    pooled_scale,
    segment_moments,
)
from panelcore.params import SeasonalParams


class ModelUnavailable(ValueError):
    """The feature set lacks what a model needs; the caller records a skip."""


class FittedModel(ABC):
    @abstractmethod
    def transform(self, samples: DataFrame) -> DataFrame:
        """Samples plus ``prediction``."""


class Forecaster(ABC):
    """Anything the runner can evaluate; it never asks which kind it is."""

    #: Whether fit or forecast read ``seq``; if not, it need not be stored.
    reads_sequence = True

    @abstractmethod
    def fit(self, train: DataFrame, val: DataFrame | None = None) -> FittedModel: ...

    def score(self, assigned: DataFrame, numbers: list[int],
              factory: Callable[[], "Forecaster"]) -> DataFrame:
        """Validation and test rows of every fold; a fresh model is fitted per fold.

        ``assigned`` carries ``fold`` and ``role``. Forecasters that need no fit, or fit
        all folds in one grouped aggregate, override this with a single pass.
        """
        parts = []
        for k in numbers:
            rows = assigned.where(F.col("fold") == k)
            fitted = factory().fit(rows.where("role = 'fit'"), rows.where("role = 'val'"))
            parts.append(fitted.transform(rows.where("role <> 'fit'")))
        return reduce(DataFrame.unionByName, parts)


# -- column selectors ---------------------------------------------------------


class ColumnForecast(Forecaster, FittedModel):
    """Predicts one column of the origin row."""

    reads_sequence = False

    def __init__(self, spec: FeatureSpec, column: str) -> None:
        if column not in spec.columns:
            raise ModelUnavailable(f"the feature set carries no {column!r}")
        self.spec, self.column = spec, column

    def fit(self, train, val=None) -> "ColumnForecast":
        return self

    def score(self, assigned, numbers, factory) -> DataFrame:
        return self.transform(assigned.where("role <> 'fit'"))

    def transform(self, samples: DataFrame) -> DataFrame:
        return samples.withColumn("prediction", step_value(samples, self.spec, self.column))


def persistence(spec: FeatureSpec) -> ColumnForecast:
    """The level observed at the origin."""
    return ColumnForecast(spec, f"{LEVEL}_lag_0")


def seasonal_naive(spec: FeatureSpec, per_year: int) -> ColumnForecast:
    """The level of the same period one year before the target."""
    if spec.horizon >= per_year:
        raise ModelUnavailable(f"horizon {spec.horizon} reaches past one year of {per_year}")
    return ColumnForecast(spec, f"{LEVEL}_lag_{per_year - spec.horizon}")


# -- scaling ------------------------------------------------------------------


def scale_factors(train: DataFrame, spec: FeatureSpec) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale per feature over samples and steps; a constant feature keeps scale 1.

    One vector aggregate of the flat view; its steps are pooled afterwards, so no row is
    repeated per step.
    """
    flat = train.select(array_to_vector(flatten_sequence(F.col("seq"))).alias("x"))
    found = Summarizer.metrics("mean", "variance", "count").summary(F.col("x"))
    r = flat.select(found.alias("s")).first()["s"]
    n = r["count"]
    variance = r["variance"].toArray() * ((n - 1) / n)
    return pooled_scale(r["mean"].toArray(), variance, spec.timesteps)


def covered_moments(wide: DataFrame, spec: FeatureSpec, before: Column | None = None) -> DataFrame:
    """``column, mean, scale`` of all steps of all samples, from the panel rows themselves.

    A sample covers the T rows up to its origin, so a row counts once for each surviving
    sample among the T origins from its own period on: a running count over the row's
    following frame. Rows are weighted by that count and none is repeated. ``before``
    restricts the origins to those earlier than a date.
    """
    ahead = series().rowsBetween(0, spec.timesteps - 1)
    behind = series().rowsBetween(-(spec.timesteps - 1), 0)
    complete = reduce(lambda a, b: a & b, [finite(F.col(f"`{c}`")) for c in spec.columns])
    cells = F.array(*[F.col(f"`{c}`").cast("double") for c in spec.columns])
    rows = wide.select("entity", "period", "y", cells.alias("x"), complete.alias("_ok"))
    origin = (F.count_if("_ok").over(behind) == spec.timesteps) & finite(F.col("y"))
    if before is not None:
        origin = origin & (F.col("period") < before)
    rows = rows.withColumn("_origin", origin).withColumn("w", F.count_if("_origin").over(ahead))
    covered = rows.where("w > 0").select(array_to_vector("x").alias("x"), F.col("w").cast("double"))
    stats = Summarizer.metrics("mean", "variance", "min", "max").summary(
        F.col("x"), F.col("w"))
    one = covered.agg(stats.alias("s"), F.sum("w").alias("n"),
                      F.sum(F.col("w") * F.col("w")).alias("w2"))
    arrays = [vector_to_array(F.col(f"s.{c}")).alias(c) for c in ("mean", "variance", "min", "max")]
    names = F.array(*map(F.lit, spec.columns)).alias("column")
    cells = one.select("w2", "n", F.arrays_zip(names, *arrays).alias("a")).select(
        "w2", "n", F.explode("a").alias("c"))
    # The summary divides by n - w2 / n; the population deviation divides by n.
    population = F.col("c.variance") * (F.col("n") - F.col("w2") / F.col("n")) / F.col("n")
    return cells.select(
        "c.column", "c.mean",
        F.when(F.col("c.min") == F.col("c.max"), 1.0).otherwise(F.sqrt(population)).alias("scale"))


def standardise(samples: DataFrame, mean: np.ndarray, sd: np.ndarray) -> DataFrame:
    """``seq`` with every step standardised by the fitted factors."""
    m, s = F.array(*map(F.lit, mean.tolist())), F.array(*map(F.lit, sd.tolist()))
    pair = F.arrays_zip(m.alias("m"), s.alias("s"))
    scaled = F.transform(
        "seq", lambda row: F.zip_with(row, pair, lambda x, p: (x - p["m"]) / p["s"])
    )
    return samples.withColumn("seq", scaled)


# -- learned models -----------------------------------------------------------


class PipelineForecast(FittedModel):
    """A Spark ML pipeline on the flat view; stored through the ML writer."""

    def __init__(self, stages: PipelineModel, info: dict | None = None) -> None:
        self.stages, self.info = stages, info or {}

    def transform(self, samples: DataFrame) -> DataFrame:
        flat = samples.withColumn("flat", array_to_vector(flatten_sequence(F.col("seq"))))
        return self.stages.transform(flat).drop("flat", "scaled")

    def save(self, path: str) -> None:
        self.stages.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> "PipelineForecast":
        return PipelineForecast(PipelineModel.load(path))


class LinearForecast(FittedModel):
    """Intercept plus coefficients of the raw flat view."""

    def __init__(self, coefficients: np.ndarray, intercept: float, info: dict | None = None) -> None:
        self.coefficients = np.asarray(coefficients, dtype=float)
        self.intercept, self.info = float(intercept), info or {}

    def transform(self, samples: DataFrame) -> DataFrame:
        coef = F.array(*map(F.lit, self.coefficients.tolist()))
        return samples.withColumn("prediction", weighted_sum(F.flatten("seq"), coef, F.lit(self.intercept)))

    def state(self) -> dict:
        return {"coefficients": self.coefficients.tolist(), "intercept": self.intercept,
                "info": self.info}


def weighted_sum(values: Column, weights: Column, start: Column) -> Column:
    """``start`` plus the inner product of two arrays."""
    products = F.zip_with(values, weights, lambda x, w: x * w)
    return F.aggregate(products, start, lambda total, x: total + x)


class Ridge(Forecaster):
    """Ridge on the scaled flat view; alpha by closed-form leave-one-out.

    All folds are solved from one pass of mergeable moments (:mod:`statistics`), and all
    their leave-one-out errors, for every alpha, come from one more. The products of the
    flat features (features squared) are what the driver holds; there is no other limit
    on their number.
    """

    def __init__(self, spec: FeatureSpec, alphas=(0.01, 0.1, 1.0, 10.0, 100.0)) -> None:
        self.spec, self.alphas = spec, tuple(float(a) for a in alphas)

    def _solve(self, rows: DataFrame, numbers: list[int]) -> dict[int, LinearForecast]:
        moments = fold_moments(segment_moments(rows), numbers)
        if not moments:
            raise ModelUnavailable("there is no row to fit on")
        paths = {k: RidgePath.of(m, self.spec.timesteps) for k, m in moments.items()}
        alphas = {k: self.alphas[0] for k in paths}
        if len(self.alphas) > 1:
            errors = leave_one_out(rows, paths, self.alphas)
            alphas = {k: min(self.alphas, key=errors[k].get) for k in paths}
        return {k: LinearForecast(*path.solution(alphas[k]), {"alpha": alphas[k]})
                for k, path in paths.items()}

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> LinearForecast:
        return self._solve(labelled_vectors(train, F.lit(0)), [0])[0]

    def score(self, assigned, numbers, factory) -> DataFrame:
        once = labelled_vectors(fit_rows_once(assigned), F.col("fold"))
        fitted = self._solve(once, numbers)
        table = assigned.sparkSession.createDataFrame(
            [(k, m.coefficients.tolist(), m.intercept) for k, m in fitted.items()],
            "fold int, _coef array<double>, _start double")
        rows = assigned.where("role <> 'fit'").join(F.broadcast(table), "fold")  # a row per fold
        return rows.withColumn("prediction", weighted_sum(
            F.flatten("seq"), F.col("_coef"), F.col("_start"))).drop("_coef", "_start")


def fit_rows_once(assigned: DataFrame) -> DataFrame:
    """Fit rows of expanding folds, each once, in the first fold that fits on it.

    Later folds keep a period, so that fold number is the row's segment.
    """
    fit = assigned.where("role = 'fit'")
    first = fit.groupBy("period").agg(F.min("fold").alias("_first"))  # one row per period
    return fit.join(F.broadcast(first), "period").where(F.col("fold") == F.col("_first"))


def labelled_vectors(rows: DataFrame, segment: Column) -> DataFrame:
    """``segment, v``: the flat view with the label as last coordinate."""
    v = F.concat(F.flatten("seq"), F.array(F.col("y").cast("double")))
    return rows.select(segment.cast("int").alias("segment"), v.alias("v"))


class BoostedTrees(Forecaster):
    """Gradient-boosted trees on the flat view.

    Folds are boosted side by side on shared bins (:mod:`boosting`); a single model, which
    is stored, is Spark's own with the same rounds, depth and learning rate.
    """

    def __init__(self, spec: FeatureSpec, n_trees: int = 400, max_depth: int = 3,
                 learning_rate: float = 0.05, seed: int = 42) -> None:
        self.spec = spec
        self.args = dict(maxIter=n_trees, maxDepth=max_depth, stepSize=learning_rate, seed=seed)

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> PipelineForecast:
        rows = train.select(array_to_vector(flatten_sequence(F.col("seq"))).alias("flat"), "y")
        gbt = GBTRegressor(featuresCol="flat", labelCol="y", **self.args)
        return PipelineForecast(Pipeline(stages=[gbt]).fit(rows))

    def score(self, assigned, numbers, factory) -> DataFrame:
        a = self.args
        rows = labelled_vectors(fit_rows_once(assigned), F.col("fold"))
        cuts, trees = boosted(rows, max(numbers) + 1, a["maxIter"], a["maxDepth"], a["stepSize"])
        return predicted(assigned.where("role <> 'fit'"), cuts, trees, a["maxDepth"])


# -- seasonal profile ---------------------------------------------------------


class SeasonalTrend(Forecaster):
    """Mean level per (entity, position in the year), pulled by one anchor weight.

    Entities are profiled by their key, so no indicator columns are needed.
    """

    reads_sequence = False

    def __init__(self, spec: FeatureSpec, per_year: int, p: SeasonalParams) -> None:
        needed = ("season_sin", "season_cos", f"{LEVEL}_lag_0")
        missing = [c for c in needed if c not in spec.columns]
        if missing:
            raise ModelUnavailable(f"the seasonal profile needs {missing}")
        self.spec, self.per_year, self.p = spec, per_year, p

    def keyed(self, samples: DataFrame) -> DataFrame:
        """Position and anchor read at the configured step of the sequence."""
        back = self.spec.timesteps - 1 if self.p.anchor_step == "oldest" else 0
        at = lambda c: step_value(samples, self.spec, c, back)
        return samples.withColumns({
            "_pos": position_from_cyclic(at("season_sin"), at("season_cos"), self.per_year),
            "_anchor": at(f"{LEVEL}_lag_0"),
        })

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> "SeasonalModel":
        """One profile row per entity; rows that carry ``fold`` are fitted per fold."""
        by = [c for c in ("fold",) if c in train.columns]
        cells = self.keyed(train).groupBy(*by, "entity", "_pos").agg(
            F.sum("y").alias("_s"), F.count("y").alias("_c")
        )
        mean = F.sum("_s") / F.sum("_c")
        profile = cells.groupBy(*by, "entity").agg(
            mean.alias("_base"),
            F.map_from_entries(
                F.collect_list(F.struct("_pos", (F.col("_s") / F.col("_c")).alias("m")))
            ).alias("_cells"),
        )
        # At most one row per position of the year (and fold).
        positions = cells.groupBy(*by, "_pos").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
        pooled = positions.groupBy(*by).agg(
            mean.alias("_overall"),
            F.map_from_entries(
                F.collect_list(F.struct("_pos", (F.col("_s") / F.col("_c")).alias("m")))
            ).alias("_pooled"),
        )
        model = SeasonalModel(self, by, profile, pooled)
        if self.p.use_level_anchor:
            model.weights = fit_anchor(model.expected(train), by)
        return model

    def score(self, assigned, numbers, factory) -> DataFrame:
        fitted = self.fit(assigned.where("role = 'fit'"))
        return fitted.transform(assigned.where("role <> 'fit'"))


class SeasonalModel(FittedModel):
    def __init__(self, parent: SeasonalTrend, by: list[str], profile, pooled) -> None:
        self.parent, self.by, self.profile, self.pooled = parent, by, profile, pooled
        self.weights: dict[tuple, float] = {}

    @property
    def weight(self) -> float:
        return self.weights.get((), 0.0)

    def expected(self, samples: DataFrame) -> DataFrame:
        """Profile value and deviation of the anchor from the baseline.

        A position an entity never showed falls back to the entity's mean; an entity
        never seen falls back to the pooled profile.
        """
        rows = self.parent.keyed(samples)
        pooled = F.broadcast(self.pooled)  # one row per fold
        rows = rows.join(pooled, self.by) if self.by else one_group(self.pooled, rows)
        joined = rows.join(self.profile, [*self.by, "entity"], "left")
        at = lambda m: F.try_element_at(m, F.col("_pos"))
        return joined.withColumns({
            "expected": F.coalesce(at("_cells"), "_base", at("_pooled"), "_overall"),
            "deviation": F.col("_anchor") - F.coalesce("_base", "_overall"),
        })

    def transform(self, samples: DataFrame) -> DataFrame:
        weight = F.lit(self.weight)
        for (k,), w in ((k, w) for k, w in self.weights.items() if k):
            weight = F.when(F.col("fold") == k, F.lit(w)).otherwise(weight)
        point = F.col("expected") + weight * F.col("deviation")
        return self.expected(samples).select(*samples.columns, point.alias("prediction"))


def fit_anchor(scored: DataFrame, by: list[str]) -> dict[tuple, float]:
    """One shared least-squares coefficient of the error on the deviation (per fold)."""
    d, e = F.col("deviation"), F.col("y") - F.col("expected")
    rows = scored.groupBy(*by).agg(F.sum(d * e).alias("de"), F.sum(d * d).alias("dd")).collect()
    return {tuple(r[b] for b in by): float(r["de"] / r["dd"]) if r["dd"] else 0.0 for r in rows}


# -- storage ------------------------------------------------------------------


def save_fitted(model: FittedModel, path: str) -> dict:
    """Write what a fitted model holds below ``path``; the rest is returned, for JSON."""
    if isinstance(model, ColumnForecast):
        return {"kind": "column", "column": model.column}
    if isinstance(model, LinearForecast):
        return {"kind": "linear", **model.state()}
    if isinstance(model, PipelineForecast):
        model.save(path)
        return {"kind": "pipeline"}
    if isinstance(model, SeasonalModel) and not model.by:
        model.profile.write.mode("overwrite").parquet(f"{path}/profile")
        model.pooled.write.mode("overwrite").parquet(f"{path}/pooled")
        return {"kind": "seasonal", "weight": model.weight}
    raise ValueError(f"{type(model).__name__} cannot be stored")


def load_fitted(spark, state: dict, path: str, spec: FeatureSpec, per_year: int,
                seasonal: SeasonalParams) -> FittedModel:
    """What :func:`save_fitted` stored."""
    kind = state["kind"]
    if kind == "column":
        return ColumnForecast(spec, state["column"])
    if kind == "linear":
        return LinearForecast(state["coefficients"], state["intercept"], state["info"])
    if kind == "pipeline":
        return PipelineForecast.load(path)
    profile, pooled = (spark.read.parquet(f"{path}/{t}") for t in ("profile", "pooled"))
    model = SeasonalModel(SeasonalTrend(spec, per_year, seasonal), [], profile, pooled)
    model.weights = {(): state["weight"]}
    return model


# -- roster -------------------------------------------------------------------

#: Models that read single cells of a sample, never its sequence.
CELL_MODELS = frozenset({"persistence", "seasonal_naive", "seasonal_trend"})


def model_factories(spec: FeatureSpec, per_year: int, seasonal: SeasonalParams | None = None,
                    alphas=(0.01, 0.1, 1.0, 10.0, 100.0), n_trees: int = 400
                    ) -> dict[str, Callable[[], Forecaster]]:
    """A factory per model name; calling one may raise :class:`ModelUnavailable`."""
    return {
        "persistence": lambda: persistence(spec),
        "seasonal_naive": lambda: seasonal_naive(spec, per_year),
        "seasonal_trend": lambda: SeasonalTrend(spec, per_year, seasonal or SeasonalParams()),
        "ridge": lambda: Ridge(spec, alphas),
        "gradient_boosting": lambda: BoostedTrees(spec, n_trees),
    }
