import math
import random
import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelcore.params import Calendar, FeatureParams, TargetParams  # noqa: E402
from panelcore.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def months(n: int, start_year: int = 2010) -> list[date]:
    return [date(start_year + i // 12, i % 12 + 1, 1) for i in range(n)]


TARGET = TargetParams("cases", "population")
COLUMNS = ("cases", "rainfall", "temperature", "humidity", "search_interest", "population",
           "population_density")


def wave_rows(entities, n, seed=3, trend=0.0, noise=0.05, start_year=2010):
    """An annual wave per entity with seeded noise, exposure 3e7."""
    rng = random.Random(seed)
    rows = []
    for k, e in enumerate(entities):
        for i, d in enumerate(months(n, start_year)):
            s = math.sin(2 * math.pi * (i - 3 + k) / 12)
            j = lambda scale: 1 + noise * rng.gauss(0, 1) * scale
            cases = max(0.0, (800 + 500 * s) * (1 + trend) ** i * j(1))
            rows.append((e, d, cases, (100 + 80 * s) * j(1), (25 + 5 * s) * j(0.2),
                         (60 + 15 * s) * j(0.2), (40 + 20 * s) * j(1), 3.0e7, 850.0))
    return rows


SCHEMA = "entity string, period date, " + ", ".join(f"{c} double" for c in COLUMNS)


def wave_panel(spark, entities=("a", "b", "c"), n=48, **kw):
    return spark.createDataFrame(wave_rows(entities, n, **kw), SCHEMA)


def calendar(n: int, start_year: int = 2010) -> Calendar:
    m = months(n, start_year)
    return Calendar(m[0], m[-1])


SHIPPED = FeatureParams(
    level_variables=("cases", "rainfall", "temperature", "humidity", "search_interest"),
    lag_variables=("cases", "rainfall", "temperature", "humidity", "search_interest"),
    rolling_variables=("rainfall", "temperature", "humidity"),
    include_spatial=True,
    spatial_variable="cases",
    static_variables=("population_density",),
)


def series(spark, values, entity="a", column="cases", n0=2015):
    rows = [(entity, d, None if v is None else float(v))
            for d, v in zip(months(len(values), n0), values)]
    return spark.createDataFrame(rows, f"entity string, period date, {column} double")
