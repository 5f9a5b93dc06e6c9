"""Exact tree attributions against all subsets, and against sampled permutations."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from conftest import TARGET, calendar, wave_panel
from pyspark.sql import functions as F

from panelcore.operators import attribution, features, models, tree_attribution
from panelcore.params import FeatureParams, ParamError

P = FeatureParams(level_variables=("rainfall", "temperature"), include_lags=False, lags=(12,),
                  sequence_length=2, entity_identity=False)


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    panel = wave_panel(spark, ("a", "b"), 60, trend=0.002)
    samples, spec = features.build_samples(panel, P, TARGET, calendar(60), 1)
    samples = samples.cache()
    model = models.BoostedTrees(spec, n_trees=12, max_depth=4, learning_rate=0.3).fit(samples)
    path = str(tmp_path_factory.mktemp("trees") / "m")
    model.save(path)
    return samples, spec, model, tree_attribution.stored_leaves(spark, path, spec)


def test_leaves_give_the_forecasts(fitted):
    samples, spec, model, leaves = fitted
    rows = model.transform(samples).collect()
    x = np.array([np.ravel(r.seq) for r in rows])
    whole = (1 << leaves.width) - 1
    got = (leaves.patterns(x) == whole) @ leaves.value
    assert got == pytest.approx([r.prediction for r in rows])


def test_equal_to_all_subsets(fitted):
    samples, spec, model, leaves = fitted
    n = len(spec.columns)
    assert n >= 6
    some, background = samples.orderBy("period", "entity").limit(4), samples.orderBy("entity", "period").limit(9)
    got = {(r.entity, r.period, r.column): r.value
           for r in tree_attribution.explain_trees(some, spec, leaves, background).collect()}
    base = np.array([r.seq for r in background.collect()])
    whole = (1 << leaves.width) - 1

    def value(row, subset):
        mixed = base.copy()
        mixed[:, :, list(subset)] = row[None][:, :, list(subset)]
        return float(((leaves.patterns(mixed.reshape(len(base), -1)) == whole) @ leaves.value).mean())

    for r in some.collect():
        row = np.array(r.seq)
        known = {s: value(row, s) for k in range(n + 1) for s in combinations(range(n), k)}
        for i in range(n):
            want = sum(
                factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n)
                * (known[tuple(sorted((*s, i)))] - known[s]) for s in known if i not in s)
            assert got[r.entity, r.period, spec.columns[i]] == pytest.approx(want, abs=1e-9)


def test_limit_of_sampled_permutations(fitted):
    samples, spec, model, leaves = fitted
    rows = attribution.rows_to_explain(samples, 3).cache()
    background = samples.orderBy("entity", "period").limit(6).cache()
    key = lambda df: {(r.entity, r.period, r.column): r.value for r in df.collect()}
    exact = key(tree_attribution.explain_trees(rows, spec, leaves, background))
    sampled = key(attribution.explain_sampled(rows, spec, model, background, permutations=600))
    a, b = (np.array([m[k] for k in sorted(exact)]) for m in (exact, sampled))
    assert np.abs(a - b).max() < 0.1 * np.abs(a).max()


def test_edges(fitted, spark):
    samples, spec, _, leaves = fitted
    assert tree_attribution.explain_trees(samples.limit(0), spec, leaves, samples).count() == 0
    with pytest.raises(ParamError):
        tree_attribution.explain_trees(samples, spec, leaves, samples.limit(0))
    constant = tree_attribution._arrays([(2.5, {})], len(spec.columns))
    values = tree_attribution.explain_trees(samples, spec, constant, samples)
    assert values.agg(F.max(F.abs("value"))).first()[0] == 0.0
