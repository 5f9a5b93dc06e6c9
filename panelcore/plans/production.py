"""Ablation grids, the frozen model, and the tables served from one run."""

from __future__ import annotations

import dataclasses
import itertools
import json
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.storagelevel import StorageLevel

from panelcore.checks import require_same_columns
from panelcore.functions.scalars import inverse_target, shift_period
from panelcore.operators import attribution, evaluate, folds, intervals, models, risk, serving
from panelcore.operators.features import (
    FeatureSpec,
    build_samples,
    look_back,
    with_level,
)
from panelcore.params import (
    Calendar,
    ConformalParams,
    FeatureParams,
    FoldParams,
    ParamError,
    RiskParams,
    SeasonalParams,
    TargetParams,
)
from panelcore.operators.residuals import ResidualStore
from panelcore.session import cut_lineage
from panelcore.sources import runs


@dataclass(frozen=True)
class Experiment:
    """A named change to the feature parameters."""

    name: str
    changes: dict = field(default_factory=dict)
    note: str = ""


def apply_experiment(p: FeatureParams, e: Experiment) -> FeatureParams:
    return dataclasses.replace(p, **e.changes)


@dataclass(frozen=True)
class Setting:
    """What every cell of a grid shares."""

    target: TargetParams
    calendar: Calendar
    folds: FoldParams = FoldParams()
    conformal: ConformalParams = ConformalParams()
    seasonal: SeasonalParams = SeasonalParams()
    alphas: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0)
    n_trees: int = 400


RESULT_FIELDS = (
    "experiment string, model string, horizon int, n_features int, n_samples long, "
    "n_dropped_entities long, folds int, "
    + ", ".join(f"{m} double, {m}_std double" for m in evaluate.POINT_METRICS))
SKIP_FIELDS = "experiment string, model string, horizon int, reason string"


def ablation_grid(panel: DataFrame, base: FeatureParams, experiments: list[Experiment],
                  horizons, setting: Setting, names=None, edges: DataFrame | None = None,
                  entities: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, skips): each cell of experiment x horizon x model lands in one of them.

    The driver walks configurations only, and what comes back is a few numbers per cell.
    """
    spark = panel.sparkSession
    setting.folds.check_horizons(horizons)
    n_entities = panel.select("entity").distinct().count()
    done: list[dict] = []
    skips: list[tuple] = []
    for e, h in itertools.product(experiments, horizons):
        with _prepared(panel, apply_experiment(base, e), h, setting, names, edges, entities) as ready:
            if isinstance(ready, str):
                skips.append((e.name, "*", h, ready))
                continue
            roster = models.model_factories(ready.spec, setting.calendar.per_year,
                                            setting.seasonal, setting.alphas, setting.n_trees)
            for name in names or roster:
                outcome = _cell(ready, roster.get(name), setting)
                if isinstance(outcome, str):
                    skips.append((e.name, name, h, outcome))
                else:
                    done.append({"experiment": e.name, "model": name, "horizon": h,
                                 "n_dropped_entities": n_entities - ready.n_seen, **outcome})
    if not done:
        raise ParamError(f"no cell of the grid could run: {skips[:1]}")
    fields = StructType.fromDDL(RESULT_FIELDS)
    rows = [tuple(r[f] for f in fields.names) for r in done]
    return spark.createDataFrame(rows, fields), spark.createDataFrame(skips, SKIP_FIELDS)


@dataclass(frozen=True)
class Prepared:
    """The samples of one feature configuration and horizon."""

    samples: DataFrame
    plan: DataFrame
    spec: FeatureSpec
    n_samples: int
    n_seen: int


@contextmanager
def _prepared(panel, p, horizon, setting, names, edges, entities):
    """Samples kept on executors while the models of a configuration run, or the reason
    why its features cannot be built. Dropping columns changes which samples survive, so
    every configuration has its own."""
    try:
        samples, spec = build_samples(panel, p, setting.target, setting.calendar, horizon, edges,
                                      entities)
    except ParamError as reason:
        yield f"features: {reason}"
        return
    if names and models.CELL_MODELS.issuperset(names):
        samples = samples.drop("seq")
    samples = samples.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        plan = folds.rolling_origin(samples, setting.folds, horizon)
        evaluate.require_usable(folds.fold_counts(folds.assign_folds(samples, plan)))
        n, seen = samples.agg(F.count(F.lit(1)), F.count_distinct("entity")).first()
        yield Prepared(samples, plan, spec, n, seen)
    finally:
        samples.unpersist()


def _cell(ready: Prepared, factory: Callable | None, setting: Setting) -> dict | str:
    """Metrics of one model on prepared samples, or the reason why it cannot run."""
    if factory is None:
        return "no such model"
    try:
        factory()
    except models.ModelUnavailable as reason:
        return str(reason)
    scored = evaluate.score_folds(ready.samples, ready.plan, setting.folds, factory, guard=False)
    test = scored.where("role = 'test'")
    found = evaluate.aggregate_folds(evaluate.fold_metrics(test, setting.target.transform))
    out: dict = {"n_features": len(ready.spec.columns), "n_samples": ready.n_samples,
                 "folds": setting.folds.n_folds}
    for r in found.collect():
        out[r["metric"]], out[f"{r['metric']}_std"] = r["mean"], r["std"]
    return out


def store_evaluation(samples: DataFrame, plan: DataFrame, factory: Callable, setting: Setting,
                     root: str, run: str, meta: dict | None = None, overwrite: bool = False) -> None:
    """Evaluate one configuration with all its guards, and store everything it yields.

    Tables of the run: ``predictions`` (bucketed by entity, without the samples' arrays),
    ``folds``, ``summary`` and ``widths``; the manifest carries the parameters.
    """
    found = evaluate.run_experiment(samples, plan, setting.folds, factory, setting.conformal,
                                    setting.target.transform)
    keep = ["fold", "role", "entity", "period", "y", "prediction", "lower", "upper"]
    tables = {**found, "predictions": found["predictions"].select(*keep)}
    about = {"folds": dataclasses.asdict(setting.folds),
             "conformal": dataclasses.asdict(setting.conformal), **(meta or {})}
    runs.save_run(root, run, tables, about, overwrite, {"predictions": 8})


def evaluate_selection(panel: DataFrame, base: FeatureParams, chosen: list[str], horizon: int,
                       setting: Setting, model: str, edges=None, entities=None) -> DataFrame:
    """All columns against the chosen ones through the same folds."""
    grid = [Experiment("all"), Experiment("selected", {"selected_columns": tuple(chosen)})]
    table, _ = ablation_grid(panel, base, grid, [horizon], setting, [model], edges, entities)
    return table


class PanelModel:
    """A fitted model together with the feature parameters it was fitted with.

    ``residuals`` are those of the calibration tail; from them intervals at any level and
    predictive quantiles are looked up without fitting anything again.
    """

    def __init__(self, fitted: intervals.ConformalModel, spec: FeatureSpec, p: FeatureParams,
                 setting: Setting, edges: DataFrame | None = None,
                 entities: list[str] | None = None,
                 residuals: DataFrame | ResidualStore | None = None) -> None:
        self.fitted, self.spec, self.p, self.setting = fitted, spec, p, setting
        self.edges, self.entities, self._residuals = edges, entities, residuals

    @property
    def horizon(self) -> int:
        return self.spec.horizon

    @property
    def look_back(self) -> int:
        return look_back(self.p, self.horizon, self.setting.calendar.per_year)

    @property
    def store(self) -> ResidualStore:
        """The ranked residuals, ordered when they are first asked for."""
        if self._residuals is None:
            raise ParamError("the model carries no calibration residuals")
        if not isinstance(self._residuals, ResidualStore):
            self._residuals = ResidualStore.of(self._residuals)
        return self._residuals

    def columns_from(self, raw_variable: str) -> list[str]:
        return self.spec.named(raw_variable=raw_variable)

    @property
    def reads_entity(self) -> bool:
        """Whether the fitted model itself looks entities up by their key."""
        return isinstance(self.fitted.inner, models.SeasonalModel)

    def stacked(self, names: list[str], mark: str) -> PanelModel:
        """The model for a panel that holds every entity once per name, as name, mark and
        entity; edges are repeated within each name."""
        edges = self.edges
        if edges is not None:
            at = F.explode(F.array(*map(F.lit, names))).alias("_n")
            edges = edges.select("*", at).select(
                F.concat("_n", F.lit(mark), "entity").alias("entity"),
                F.concat("_n", F.lit(mark), "neighbour").alias("neighbour"))
        return PanelModel(self.fitted, self.spec, self.p, self.setting, edges, self.entities,
                          self._residuals)

    def samples(self, panel: DataFrame) -> DataFrame:
        """Every complete window of a panel, from the columns the model was fitted on."""
        s = self.setting
        samples, spec = build_samples(panel, self.p, s.target, s.calendar, self.horizon,
                                      self.edges, self.entities, require_target=False)
        require_same_columns(self.spec.columns, spec.columns, self.spec.timesteps,
                             spec.timesteps)
        return samples.drop("y")

    def predict(self, panel: DataFrame, alpha: float | None = None) -> DataFrame:
        """Forecasts for every origin whose window is complete; no target is needed.

        ``alpha`` asks for intervals at another level than the one calibrated.
        """
        s = self.setting
        fitted = self.fitted
        if alpha is not None:
            fitted = intervals.ConformalModel(fitted.inner, self.store.width(alpha))
        return evaluate.prediction_rows(
            fitted.transform(self.samples(panel)), self.horizon, s.calendar, s.target.transform
        )

    def predict_quantiles(self, panel: DataFrame, levels: list[float] | None = None) -> DataFrame:
        """``entity, origin_date, target_date, level, quantile_log, quantile_rate``: the
        point plus each residual quantile (19 levels by default)."""
        s = self.setting
        levels = list(levels or intervals.QUANTILE_LEVELS)
        table = F.array(*[F.struct(F.lit(q).alias("level"), F.lit(float(r)).alias("shift"))
                          for q, r in zip(levels, self.store.quantiles(levels))])
        rows = self.fitted.inner.transform(self.samples(panel)).select(
            "entity", F.col("period").alias("origin_date"),
            shift_period(F.col("period"), self.horizon, s.calendar).alias("target_date"),
            "prediction", F.explode(table).alias("_q"))
        log = F.col("prediction") + F.col("_q.shift")
        return rows.select("entity", "origin_date", "target_date", F.col("_q.level").alias("level"),
                           log.alias("quantile_log"),
                           inverse_target(log, s.target.transform).alias("quantile_rate"))

    def drivers(self, panel: DataFrame, k: int = 3) -> DataFrame:
        """``entity, origin_date, drivers``: the columns that move each forecast most, for
        models that are linear in their columns; those without effect are left out."""
        coefficients = attribution.flat_coefficients(self.fitted.inner, self.spec)
        samples = self.samples(panel)
        values = attribution.explain_linear(samples, self.spec, coefficients, samples)
        provenance = self.spec.provenance(panel.sparkSession)
        return attribution.top_drivers(values.where("value <> 0"), provenance, k)


def train_production(panel: DataFrame, p: FeatureParams, horizon: int, setting: Setting,
                     model: str, calibration_periods: int = 12, edges: DataFrame | None = None,
                     entities: list[str] | None = None) -> PanelModel:
    """Fit on all but the calibration tail, then calibrate on the tail."""
    samples, spec = build_samples(panel, p, setting.target, setting.calendar, horizon, edges,
                                  entities)
    if model in models.CELL_MODELS:
        samples = samples.drop("seq")
    samples = samples.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fit, tail = folds.tail_split(samples, calibration_periods)
        factory: Callable = models.model_factories(
            spec, setting.calendar.per_year, setting.seasonal, setting.alphas, setting.n_trees
        )[model]
        inner = factory().fit(fit, tail)
        fitted = intervals.conformalise(inner, tail, setting.conformal)
        residuals = intervals.calibration_residuals(inner.transform(tail), [])
    finally:
        samples.unpersist()
    return PanelModel(fitted, spec, p, setting, edges, entities, residuals)


def save_production(model: PanelModel, path: str) -> None:
    """The fitted model, its ranked residuals, and one JSON row with every parameter."""
    s = model.setting
    spark = SparkSession.active()
    meta = {
        "features": dataclasses.asdict(model.p), "columns": model.spec.schema.jsonValue(),
        "timesteps": model.spec.timesteps, "horizon": model.spec.horizon,
        "width": model.fitted.width, "entities": model.entities,
        "target": dataclasses.asdict(s.target), "calendar": dataclasses.asdict(s.calendar),
        "conformal": dataclasses.asdict(s.conformal), "seasonal": dataclasses.asdict(s.seasonal),
        "model": models.save_fitted(model.fitted.inner, f"{path}/model"),
        "n_residuals": model.store.n,
    }
    model.store.save(f"{path}/residuals")
    if model.edges is not None:
        model.edges.write.mode("overwrite").parquet(f"{path}/edges")
    row = [(json.dumps(meta, default=str),)]
    spark.createDataFrame(row, "meta string").coalesce(1).write.mode("overwrite").text(
        f"{path}/meta"  # last, so that what it names is complete
    )


def load_production(spark: SparkSession, path: str) -> PanelModel:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    tuples = {k: tuple(v) if isinstance(v, list) else v for k, v in meta["features"].items()}
    p = FeatureParams(**tuples)
    cal = meta["calendar"]
    calendar = Calendar(date.fromisoformat(cal["start"]), date.fromisoformat(cal["end"]),
                        cal["granularity"])
    setting = Setting(TargetParams(**meta["target"]), calendar,
                      conformal=ConformalParams(**meta["conformal"]),
                      seasonal=SeasonalParams(**meta["seasonal"]))
    spec = FeatureSpec(StructType.fromJson(meta["columns"]), meta["timesteps"], meta["horizon"])
    inner = models.load_fitted(spark, meta["model"], f"{path}/model", spec, calendar.per_year,
                               setting.seasonal)
    edges = spark.read.parquet(f"{path}/edges") if p.include_spatial else None
    store = ResidualStore.load(spark, f"{path}/residuals", meta["n_residuals"])
    return PanelModel(intervals.ConformalModel(inner, meta["width"]), spec, p, setting, edges,
                      meta["entities"], store)


#: Tables whose readers ask for one entity.
BY_ENTITY = ("history", "thresholds", "forecasts", "recommendations")


def serving_tables(panel: DataFrame, model: PanelModel, p: RiskParams,
                   with_drivers: bool = True) -> dict[str, DataFrame]:
    """History, thresholds, forecasts and recommendations for the readers.

    The panel is scored once; recommendations start from the forecasts as written.
    """
    t = model.setting.target
    forecasts = cut_lineage(model.predict(panel))
    bounds = risk.thresholds(with_level(panel, t), p, t.transform)
    drivers = model.drivers(panel) if with_drivers else None
    advice = risk.recommend(forecasts, bounds, p, t.transform, model.setting.conformal.alpha, drivers)
    return {
        "history": serving.observed_history(panel, t),
        "thresholds": bounds,
        "forecasts": forecasts,
        "recommendations": risk.evidence(advice),
    }


def build_serving(panel: DataFrame, model: PanelModel, p: RiskParams, root: str, run: str,
                  overwrite: bool = False, buckets: int = 8) -> None:
    """Compute and store every serving table under one run, bucketed by entity."""
    linear = attribution.is_linear(model.fitted.inner)
    tables = serving_tables(panel, model, p, with_drivers=linear)
    meta = {"horizon": model.horizon, "width": model.fitted.width}
    runs.save_run(root, run, tables, meta, overwrite, {t: buckets for t in BY_ENTITY})
