"""The stacked what-if against one scenario at a time, and boosted folds."""

from datetime import date

import numpy as np
import pytest
from conftest import TARGET, calendar, wave_panel
from pyspark.sql import functions as F

from panelcore.operators import boosting, evaluate, features, folds, models, whatif
from panelcore.params import ClampParams, FeatureParams, FoldParams, ParamError, Scenario
from panelcore.plans.production import Setting, train_production

N = 72
P = FeatureParams(level_variables=("rainfall",), lags=(1, 12), lag_variables=("rainfall", "cases"),
                  windows=(3,), rolling_variables=("rainfall",), sequence_length=2,
                  include_spatial=True, spatial_lags=(1,), spatial_variable="cases")
SCENARIOS = {
    "wet": Scenario("rainfall", 40.0, "percent", date(2012, 1, 1), date(2012, 4, 1), ("a",)),
    "late": Scenario("cases", 90.0, "absolute", date(2014, 6, 1), None, ("b",)),
    "all": Scenario("rainfall", -20.0, "percent"),
    "none": Scenario("cases", 5.0, entities=("nobody",)),
}


@pytest.fixture(scope="module")
def trained(spark):
    panel = wave_panel(spark, ("a", "b", "c"), N, trend=0.002).select(
        "entity", "period", "cases", "rainfall", "population").cache()
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")],
                                  "entity string, neighbour string")
    s = Setting(TARGET, calendar(N), FoldParams(2, 36, 12, 12))
    return panel, train_production(panel, P, 1, s, "ridge", edges=edges, entities=["a", "b", "c"])


def test_batch_equals_single_scenarios(trained):
    panel, m = trained
    deltas, counts = whatif.what_if_batch(panel, SCENARIOS, m, ClampParams(), calendar(N))
    got = {(r.scenario, r.entity, r.origin_date): r.delta_rate for r in deltas.collect()}
    n = {r.scenario: (r.n_touched, r.n_clamped) for r in counts.collect()}
    assert n["none"] == (0, 0) and n["wet"][0] == 4 and n["all"][0] == 3 * N
    for name, s in SCENARIOS.items():
        if name == "none":
            assert not any(k[0] == name for k in got)
            continue
        single, count = whatif.what_if(panel, s, m, ClampParams())
        r = count.first()
        assert (r.n_touched, r.n_clamped) == n[name]
        moved = 0
        for r in single.collect():
            mine = got.get((name, r.entity, r.origin_date))
            if mine is None:
                assert r.delta_rate == pytest.approx(0.0, abs=1e-12)
            else:
                assert mine == pytest.approx(r.delta_rate)
                moved += abs(mine) > 1e-9
        assert moved
    # Entity c is not touched by "wet" and reads nobody who is.
    assert {k[1] for k in got if k[0] == "wet"} == {"a", "b"}


def test_models_that_look_entities_up_are_refused(spark, trained):
    panel, m = trained
    p = FeatureParams(include_lags=False, lags=(12,), sequence_length=1, entity_identity=False)
    seasonal = train_production(panel, p, 1, m.setting, "seasonal_trend")
    with pytest.raises(ParamError):
        whatif.what_if_batch(panel, SCENARIOS, seasonal, ClampParams(), calendar(N))


# -- boosting -----------------------------------------------------------------


def test_folds_side_by_side_equal_folds_alone(spark, monkeypatch):
    monkeypatch.setattr(boosting, "WRITE", 2)
    monkeypatch.setattr(boosting, "DIRECT", 1)
    panel = wave_panel(spark, ("a", "b", "c"), 96, trend=0.002)
    p = FeatureParams(level_variables=("rainfall",), include_lags=False, lags=(12,), sequence_length=2)
    samples, spec = features.build_samples(panel, p, TARGET, calendar(96), 1, None, ["a", "b", "c"])
    samples = samples.cache()
    shape = FoldParams(2, 48, 12, 12)
    plan = folds.rolling_origin(samples, shape, 1)
    make = lambda: models.BoostedTrees(spec, n_trees=6, learning_rate=0.3)
    scored = evaluate.score_folds(samples, plan, shape, make)
    got = {(r.fold, r.entity, r.period): r.prediction for r in scored.collect()}
    assigned = folds.assign_folds(samples, plan)
    rows = models.labelled_vectors(models.fit_rows_once(assigned), F.col("fold"))
    cuts, trees = boosting.boosted(rows, 2, 6, 3, 0.3)
    for k in (0, 1):
        part = assigned.where(F.col("fold") == k).collect()
        flat = lambda rs: boosting.binned(np.array([np.ravel(r.seq) for r in rs]), cuts)
        fit = [r for r in part if r.role == "fit"]
        x, y = flat(fit), np.array([r.y for r in fit])
        now = np.zeros(len(y))
        for n, t in enumerate(trees):  # the tree's leaves are means of residuals
            leaf = t.leaf(x, k, 3)
            weight = 0.3 if n else 1.0
            for v in np.unique(leaf):
                assert t.value[k, v] == pytest.approx(weight * (y - now)[leaf == v].mean())
            before = ((y - now) ** 2).sum()
            now = now + t.value[k, leaf]
            assert ((y - now) ** 2).sum() <= before + 1e-9
        rest = [r for r in part if r.role != "fit"]
        want = sum(t.value[k, t.leaf(flat(rest), k, 3)] for t in trees)
        assert [got[k, r.entity, r.period] for r in rest] == pytest.approx(list(want))


def test_first_split_is_the_best_of_all_cuts(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (200, 3)).astype(float)
    y = np.where(x[:, 1] > 5, 2.0, -1.0) + 0.1 * rng.normal(size=200)
    df = spark.createDataFrame([(0, [*map(float, r), float(v)]) for r, v in zip(x, y)],
                               "segment int, v array<double>").repartition(3)
    cuts, trees = boosting.boosted(df, 1, 1, 1, 1.0)
    t = trees[0]
    assert t.feature[0, 0] == 1 and cuts[1][t.cut[0, 0]] == pytest.approx(5.5)
    assert t.value[0] == pytest.approx([y[x[:, 1] <= 5].mean(), y[x[:, 1] > 5].mean()])


def test_constant_labels_make_no_split(spark):
    df = spark.createDataFrame([(0, [float(i), 3.0]) for i in range(20)], "segment int, v array<double>")
    _, trees = boosting.boosted(df, 1, 2, 2, 0.5)
    assert (trees[0].feature == -1).all()  # every row goes left, down to the first leaf
    assert trees[0].value[0, 0] == pytest.approx(3.0)
    assert trees[1].value[0, 0] == pytest.approx(0.0)


def test_driver_gets_splits_and_no_histograms(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i % 2, [*map(float, r)]) for i, r in enumerate(rng.normal(size=(300, 21)))]
    df = spark.createDataFrame(rows, "segment int, v array<double>").repartition(6)
    sent, collect = [], type(df).collect

    def counted(self):
        out = collect(self)
        sent.append(sum(len(x) for r in out for x in r if isinstance(x, (bytes, bytearray))))
        return out

    monkeypatch.setattr(type(df), "collect", counted)
    _, trees = boosting.boosted(df, 2, 2, 3, 0.5)
    assert len(trees) == 2 and (trees[0].feature >= 0).any()
    assert sum(sent) == 2 * 2 * (1 + 2 + 4) * 32  # rounds x folds x nodes, whatever the features and tasks
