"""Stored models at any interval level, ranked residuals, bucketed runs."""

import numpy as np
import pytest
from conftest import TARGET, calendar, wave_panel
from pyspark.sql import functions as F

from panelcore.checks import ContractError
from panelcore.operators import intervals, models
from panelcore.operators.residuals import ResidualStore
from panelcore.params import FeatureParams, FoldParams, ParamError, RiskParams
from panelcore.plans import production
from panelcore.sources import runs

N = 84
P = FeatureParams(level_variables=("rainfall",), include_lags=False, lags=(12,), sequence_length=2,
                  entity_identity=False)


@pytest.fixture(scope="module")
def panel(spark):
    return wave_panel(spark, ("a", "b", "c"), N).cache()


def trained(panel, name):
    setting = production.Setting(TARGET, calendar(N), FoldParams(2, 36, 12, 12), n_trees=4)
    return production.train_production(panel, P, 1, setting, name)


@pytest.mark.parametrize("name", ["persistence", "seasonal_trend", "ridge", "gradient_boosting"])
def test_every_kind_of_model_is_stored_with_its_residuals(spark, panel, tmp_path, name):
    m = trained(panel, name)
    production.save_production(m, str(tmp_path / "m"))
    again = production.load_production(spark, str(tmp_path / "m"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    for alpha in (None, 0.1, 0.4):
        for a, b in zip(rows(again.predict(panel, alpha)), rows(m.predict(panel, alpha)), strict=True):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])
    assert again.store.width(0.2) == pytest.approx(m.fitted.width)
    wide, narrow = (again.predict(panel, a).agg(F.avg(F.col("upper_log") - F.col("lower_log"))).first()[0]
                    for a in (0.05, 0.5))
    assert wide > narrow
    q = again.predict_quantiles(panel, [0.1, 0.9]).groupBy("entity", "origin_date").pivot(
        "level", [0.1, 0.9]).agg(F.first("quantile_log"))
    assert q.where(F.col("`0.1`") > F.col("`0.9`")).count() == 0


def test_ranked_residuals_are_quantiles(spark, tmp_path):
    rng = np.random.default_rng(2)
    values = np.concatenate([np.full(300, 0.25), rng.normal(size=600)])  # a third is one value
    df = spark.createDataFrame([(float(v),) for v in values], "residual double").repartition(6)
    store = ResidualStore.of(df)
    store.save(str(tmp_path / "r"))
    again = ResidualStore.load(spark, str(tmp_path / "r"), store.n)
    levels = [0.0, 0.05, 0.333, 0.5, 0.95, 1.0]
    assert again.quantiles(levels) == pytest.approx(list(np.quantile(values, levels)))
    widths = intervals.conformal_width(df, [], 0.13).first()["width"]
    assert again.width(0.13) == pytest.approx(widths)
    with pytest.raises(ContractError):
        ResidualStore(0, again.signed, again.sizes).width(0.1)


def test_models_that_cannot_be_stored_or_explained_say_so(panel, tmp_path):
    class Odd(models.FittedModel):
        def transform(self, samples):
            return samples

    with pytest.raises(ValueError):
        models.save_fitted(Odd(), str(tmp_path))
    m = trained(panel, "seasonal_trend")
    with pytest.raises(ParamError):
        m.drivers(panel)
    bare = production.PanelModel(m.fitted, m.spec, m.p, m.setting)
    with pytest.raises(ParamError):
        bare.predict(panel, 0.1)


def test_serving_run_is_read_by_bucket(spark, panel, tmp_path):
    m = trained(panel, "persistence")
    root = str(tmp_path / "serving")
    production.build_serving(panel, m, RiskParams(), root, "r1", buckets=3)
    whole = runs.load_run(spark, root, "r1", "recommendations")
    one = runs.load_run(spark, root, "r1", "recommendations", "b")
    assert one.columns == whole.columns and {r.entity for r in one.collect()} == {"b"}
    assert one.count() == whole.where("entity = 'b'").count()
    assert len({f.rsplit("/", 2)[1] for f in one.inputFiles()}) <= 3
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    shown = whole.where("drivers <> ''").count()
    assert shown > 0 and whole.where("drivers like '%case rate%'").count() == shown


def test_drivers_name_the_column_that_moves_the_forecast(panel):
    m = trained(panel, "persistence")
    rows = m.drivers(panel).collect()
    assert rows and all([d["label"] for d in r.drivers] == ["case rate (current)"] for r in rows)
