import numpy as np
import pytest
from conftest import TARGET, calendar, months, wave_panel
from pyspark.sql import functions as F

from panelcore.checks import ContractError
from panelcore.functions.quantiles import pooled_quantiles
from panelcore.functions.ranks import global_row_number
from panelcore.operators import (
    attribution,
    evaluate,
    features,
    folds,
    intervals,
    models,
    statistics,
)
from panelcore.params import (
    ConformalParams,
    FeatureParams,
    FoldParams,
    SeasonalParams,
)

P = FeatureParams(level_variables=("rainfall", "temperature"), include_lags=False, lags=(12,),
                  sequence_length=3)
FOLDS = FoldParams(n_folds=2, initial_train=60, test_size=12, step=12)


@pytest.fixture(scope="module")
def built(spark):
    panel = wave_panel(spark, ("a", "b", "c"), 120, trend=0.002)
    samples, spec = features.build_samples(panel, P, TARGET, calendar(120), 1, None,
                                           ["a", "b", "c"])
    return samples.cache(), spec


def _matrix(samples, spec):
    rows = samples.orderBy("entity", "period").collect()
    x = np.array([r["seq"] for r in rows])
    return x, np.array([r["y"] for r in rows])


def test_scaling_is_pooled_over_steps_with_population_deviation(built):
    samples, spec = built
    x, _ = _matrix(samples, spec)
    flat = x.reshape(-1, x.shape[2])
    mean, sd = models.scale_factors(samples, spec)
    assert mean == pytest.approx(flat.mean(axis=0))
    expected = flat.std(axis=0)
    assert sd == pytest.approx(np.where(expected > 0, expected, 1.0))
    z, _ = _matrix(models.standardise(samples, mean, sd), spec)
    assert z.reshape(-1, x.shape[2]).mean(axis=0) == pytest.approx(0, abs=1e-9)


def test_ridge_matches_the_closed_form_and_its_leave_one_out(built):
    samples, spec = built
    x, y = _matrix(samples, spec)
    flat = x.reshape(-1, x.shape[2])
    sd = flat.std(axis=0)
    z = (x / np.where(sd > 0, sd, 1.0)).reshape(len(x), -1)
    zc, yc, n = z - z.mean(axis=0), y - y.mean(), len(y)

    def loo(a):
        total = 0.0
        for i in range(0, n, 7):  # a few rows by explicit refit
            keep = np.arange(n) != i
            zi, yi = z[keep], y[keep]
            b = np.linalg.solve((zi - zi.mean(0)).T @ (zi - zi.mean(0)) + a * np.eye(z.shape[1]),
                                (zi - zi.mean(0)).T @ (yi - yi.mean()))
            total += (y[i] - yi.mean() - (z[i] - zi.mean(0)) @ b) ** 2
        return total

    ridge = models.Ridge(spec, (0.1, 1.0, 100.0))
    fitted = ridge.fit(samples)
    alpha = fitted.info["alpha"]
    gram = zc.T @ zc
    hat = lambda a: 1 / n + np.einsum(
        "ij,ji->i", zc, np.linalg.solve(gram + a * np.eye(len(gram)), zc.T))
    errors = {}
    for a in ridge.alphas:
        b = np.linalg.solve(gram + a * np.eye(len(gram)), zc.T @ yc)
        errors[a] = np.sum(((yc - zc @ b) / (1 - hat(a))) ** 2)
    assert alpha == min(errors, key=errors.get)
    a = 1.0
    b = np.linalg.solve(gram + a * np.eye(len(gram)), zc.T @ yc)
    e = ((yc - zc @ b) / (1 - hat(a)))[::7]
    assert np.sum(e**2) == pytest.approx(loo(a), rel=1e-6)
    coef = np.linalg.solve(gram + alpha * np.eye(len(gram)), zc.T @ yc)
    scale = np.tile(np.where(sd > 0, sd, 1.0), 3)
    assert fitted.coefficients * scale == pytest.approx(coef, abs=1e-8)
    assert fitted.transform(samples).agg(F.avg("prediction")).first()[0] == pytest.approx(y.mean())


def test_ridge_solves_all_folds_as_if_each_stood_alone(built, monkeypatch):
    """One pass of segment moments against a fit per fold, on features far from zero."""
    samples, spec = built
    far = samples.withColumn("seq", F.transform("seq", lambda r: F.transform(r, lambda x: x + 1e6)))
    cuts = folds.rolling_origin(samples, FOLDS, 1)
    assigned = folds.assign_folds(far, cuts)
    passes = []
    whole = models.segment_moments
    monkeypatch.setattr(models, "segment_moments", lambda rows: passes.append(1) or whole(rows))
    together = models.Ridge(spec).score(assigned, [0, 1], None)
    assert len(passes) == 1
    got = {(r.fold, r.entity, r.period): r.prediction for r in together.collect()}
    for k in (0, 1):
        rows = assigned.where(F.col("fold") == k)
        alone = models.Ridge(spec).fit(rows.where("role = 'fit'"))
        for r in alone.transform(rows.where("role <> 'fit'")).collect():
            assert got.pop((k, r.entity, r.period)) == pytest.approx(r.prediction, rel=1e-6, abs=1e-6)
    assert not got


def test_moments_merge_exactly_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(statistics, "BLOCK", 2)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)) + [1e8, -1e8, 0, 1e4, 1]
    rows = [(int(i % 3), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "segment int, v array<double>").repartition(7)
    found = statistics.fold_moments(statistics.segment_moments(df), [0, 1, 2])
    for k in range(3):
        part = x[np.arange(300) % 3 <= k]
        assert found[k].n == len(part) and found[k].mean == pytest.approx(part.mean(axis=0))
        want = (part - part.mean(axis=0)).T @ (part - part.mean(axis=0))
        assert found[k].products == pytest.approx(want, rel=1e-6, abs=1e-4)
    assert statistics.segment_moments(df.where("segment > 9")) == {}


def test_covered_moments_equal_those_of_the_exploded_windows(spark):
    panel = wave_panel(spark, ("a", "b"), 60)
    gaps = panel.withColumn("rainfall", F.when(F.month("period") != 7, F.col("rainfall")))
    p = FeatureParams(level_variables=("rainfall", "temperature"), include_lags=False, lags=(12,),
                      sequence_length=3, entity_identity=False)
    wide, spec = features.design(gaps, p, TARGET, calendar(60), 1)
    samples = features.window_sequences(wide, spec)
    for upto in (None, months(60)[40]):
        rows = samples if upto is None else samples.where(F.col("period") < F.lit(upto))
        x, _ = _matrix(rows, spec)
        flat = x.reshape(-1, x.shape[2])
        got = {r["column"]: r for r in models.covered_moments(
            wide, spec, None if upto is None else F.lit(upto)).collect()}
        sd = flat.std(axis=0)
        for i, c in enumerate(spec.columns):
            assert got[c]["mean"] == pytest.approx(flat[:, i].mean())
            assert got[c]["scale"] == pytest.approx(sd[i] if np.ptp(flat[:, i]) else 1.0)


def test_ordering_on_a_seasonal_series(built):
    samples, spec = built
    cuts = folds.rolling_origin(samples, FOLDS, 1)

    def mae(factory):
        scored = evaluate.score_folds(samples, cuts, FOLDS, factory).where("role = 'test'")
        return scored.agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]

    naive = mae(lambda: models.persistence(spec))
    seasonal = mae(lambda: models.seasonal_naive(spec, 12))
    ridge = mae(lambda: models.Ridge(spec))
    trees = mae(lambda: models.BoostedTrees(spec, n_trees=8))
    trend = mae(lambda: models.SeasonalTrend(spec, 12, SeasonalParams(anchor_step="origin")))
    assert ridge < seasonal < naive and trend < naive and trees < naive


def test_intervals_cover_about_the_nominal_share(built):
    samples, spec = built
    cuts = folds.rolling_origin(samples, FOLDS, 1)
    out = evaluate.run_experiment(samples, cuts, FOLDS, lambda: models.seasonal_naive(spec, 12),
                                  ConformalParams(), "log1p")
    rows = out["folds"].collect()
    assert len(rows) == 2
    assert all(0.6 <= r["coverage"] <= 1.0 and r["mean_width"] > 0 for r in rows)
    assert {r["metric"] for r in out["summary"].collect()} == set(evaluate.POINT_METRICS)


def test_unavailable_models_say_so(spark):
    x = spark.range(1).select(features.derived(F.lit(1.0), "x", "x", "identity")).schema
    spec = features.FeatureSpec(x, 2, 1)
    with pytest.raises(models.ModelUnavailable):
        models.persistence(spec)
    with pytest.raises(models.ModelUnavailable):
        models.SeasonalTrend(spec, 12, SeasonalParams())
    far = features.FeatureSpec(x, 2, 12)
    with pytest.raises(models.ModelUnavailable):
        models.seasonal_naive(far, 12)


def test_folds_never_overlap_and_keep_the_embargo(spark):
    axis = lambda n: spark.createDataFrame([(d,) for d in months(n)], "period date")
    periods = months(144)
    plan = folds.rolling_origin(axis(144), FoldParams(), 3).collect()
    assert len({(r.fold, r.period) for r in plan}) == len(plan)
    for k in range(4):
        at = {role: sorted(periods.index(r.period) for r in plan if (r.fold, r.role) == (k, role))
              for role in ("fit", "val", "test")}
        assert at["fit"][-1] + 1 == at["val"][0] and at["test"][0] - at["val"][-1] - 1 == 3
        assert len(at["test"]) == 12 and at["test"][0] == 90 + 12 * k
    with pytest.raises(folds.SplitError, match="support"):
        folds.rolling_origin(axis(100), FoldParams(), 1)


# -- intervals ----------------------------------------------------------------


def _scored(spark, residuals):
    return spark.createDataFrame([(float(r), 0.0) for r in residuals],
                                 "y double, prediction double")


def test_width_uses_the_finite_sample_level(spark):
    r = list(range(1, 21))
    res = intervals.calibration_residuals(_scored(spark, r), [])
    level = min(np.ceil(21 * 0.8) / 20, 1.0)
    got = intervals.conformal_width(res, [], 0.2).first()
    assert got["n"] == 20 and got["width"] == pytest.approx(np.quantile(r, level))


def test_too_few_residuals_are_refused(spark):
    with pytest.raises(ContractError):
        intervals.check_calibration(
            intervals.calibration_residuals(_scored(spark, range(5)), []), [], ConformalParams())


def test_coverage_width_and_crps(spark):
    rows = spark.createDataFrame([(float(y), lo, hi) for y in range(4)
                                  for lo, hi in ((1.5, 2.5),)],
                                 "y double, lower double, upper double")
    r = rows.agg(intervals.coverage().alias("c"), intervals.interval_width().alias("w")).first()
    assert (r["c"], r["w"]) == (0.25, 1.0)
    perfect = spark.createDataFrame([(2.0, q, 2.0) for q in intervals.QUANTILE_LEVELS],
                                    "y double, level double, quantile double")
    assert perfect.agg(intervals.crps()).first()[0] == 0.0


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_pooled_quantiles_match_numpy_on_skewed_groups(spark, keys):
    rng = np.random.default_rng(1)
    # One value holds a third of all rows, one group most of them.
    values = {"big": np.concatenate([np.full(400, 0.5), rng.normal(size=800)]),
              "small": rng.normal(size=7), "one": np.array([3.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    levels = [0.0, 0.05, 0.5, 0.8, 0.95, 1.0]
    got = pooled_quantiles(df, keys, "v", levels).collect()
    groups = values if keys else {None: np.concatenate(list(values.values()))}
    assert len(got) == len(levels) * len(groups)
    for r in got:
        expected = np.quantile(groups[r["g"] if keys else None], r["level"])
        assert r["quantile"] == pytest.approx(expected)


def test_global_row_number_is_a_dense_numbering(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 37 % 1000).alias("k")).repartition(7)
    rows = global_row_number(df, ["k"]).collect()
    assert all(r["row_number"] == r["k"] + 1 for r in rows) and len(rows) == 1000


# -- attribution --------------------------------------------------------------


def test_sampled_attribution_recovers_a_linear_model(built):
    samples, spec = built
    fitted = models.Ridge(spec).fit(samples)
    coef = attribution.linear_coefficients(fitted)
    rows = attribution.rows_to_explain(samples, 4).cache()
    assert rows.count() == 4
    exact = {(r["entity"], r["period"], r["column"]): r["value"]
             for r in attribution.explain_linear(rows, spec, coef, samples).collect()}
    sampled = {(r["entity"], r["period"], r["column"]): r["value"]
               for r in attribution.explain_sampled(rows, spec, fitted, samples, 150).collect()}
    assert exact.keys() == sampled.keys()
    a, b = (np.array([m[k] for k in sorted(exact)]) for m in (exact, sampled))
    assert np.corrcoef(a, b)[0, 1] > 0.97
    # Exact values add up to the distance from the mean prediction.
    mean = fitted.transform(samples).agg(F.avg("prediction")).first()[0]
    for r in fitted.transform(rows).collect():
        total = sum(v for k, v in exact.items() if k[:2] == (r["entity"], r["period"]))
        assert total == pytest.approx(r["prediction"] - mean)


def test_selection_leaves_indicators_out(built, spark):
    samples, spec = built
    coef = np.ones(len(features.flat_names(spec)))
    values = attribution.explain_linear(samples, spec, coef, samples)
    chosen = attribution.select_features(values, spec.provenance(spark), 50).collect()
    assert chosen and not any(r["column"].startswith("entity_is_") for r in chosen)


def test_positions_are_evenly_spaced():
    assert attribution.spaced_positions(10, 4) == [0, 3, 6, 9]
    assert attribution.spaced_positions(3, 60) == [0, 1, 2]
    assert attribution.spaced_positions(5, 1) == [0]


def test_registered_trees_have_all_their_rounds(monkeypatch):
    from panelcore.catalog import evaluation

    seen = []

    def scored_by(spark, d, factory):
        seen.append(factory(None).args["maxIter"])
        raise InterruptedError

    monkeypatch.setattr(evaluation, "scored_by", scored_by)
    session = type("S", (), {"sparkContext": type("C", (), {"applicationId": "none"})})
    with pytest.raises(InterruptedError):
        evaluation.gradient_boosting_metrics(session, "nowhere")
    assert seen == [models.BoostedTrees(None).args["maxIter"]] == [400]
