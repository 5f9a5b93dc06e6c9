"""Parameters of every stage, with the rules that change results."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

PERIODS_PER_YEAR = {"monthly": 12, "weekly": 52}
TRANSFORMS = ("log1p", "none")
ROLLING_AGGS = ("mean", "sum", "min", "max", "std")
FILL_METHODS = ("linear", "time", "nearest")


class ParamError(ValueError):
    """A parameter combination that cannot give a meaningful result."""


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise ParamError(message)


def _one_of(name: str, value: str, allowed) -> None:
    _require(value in allowed, f"{name} must be one of {sorted(allowed)}, got {value!r}")


def _ascending(name: str, values, positive: bool = False) -> None:
    _require(
        all(a < b for a, b in zip(values, values[1:])), f"{name} must be strictly ascending"
    )
    if positive:
        _require(all(v > 0 for v in values), f"{name} must be positive")


@dataclass(frozen=True)
class Calendar:
    """The regular period axis and the inclusive study window."""

    start: date
    end: date
    granularity: str = "monthly"

    def __post_init__(self) -> None:
        _one_of("granularity", self.granularity, PERIODS_PER_YEAR)
        _require(self.start <= self.end, "the study window ends before it starts")

    @property
    def per_year(self) -> int:
        return PERIODS_PER_YEAR[self.granularity]

    @property
    def unit(self) -> str:
        """Truncation unit; weeks start on Monday."""
        return "month" if self.granularity == "monthly" else "week"


@dataclass(frozen=True)
class TargetParams:
    """What is forecast and on which scale."""

    target: str = "cases"
    exposure: str = "population"
    per: float = 100_000.0
    transform: str = "log1p"

    def __post_init__(self) -> None:
        _one_of("transform", self.transform, TRANSFORMS)
        _require(self.per > 0, "per must be positive")


@dataclass(frozen=True)
class FeatureParams:
    """Which columns are derived from the panel, and how samples are cut."""

    sources: tuple[str, ...] = ()
    variable_source: dict[str, str] = field(default_factory=dict)
    level_variables: tuple[str, ...] = ()
    include_lags: bool = True
    lags: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 12)
    lag_variables: tuple[str, ...] = ()
    windows: tuple[int, ...] = (3, 6)
    rolling_variables: tuple[str, ...] = ()
    rolling_aggs: tuple[str, ...] = ("mean",)
    include_spatial: bool = False
    spatial_lags: tuple[int, ...] = (1, 2)
    spatial_variable: str = ""
    weight_scheme: str = "uniform"
    static_variables: tuple[str, ...] = ()
    cyclic: bool = True
    include_target_lags: bool = True
    entity_identity: bool = True
    sequence_length: int = 12
    selected_columns: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _ascending("lags", self.lags, positive=True)
        _ascending("windows", self.windows, positive=True)
        _ascending("spatial_lags", self.spatial_lags, positive=True)
        for agg in self.rolling_aggs:
            _one_of("rolling_aggs", agg, ROLLING_AGGS)
        _one_of("weight_scheme", self.weight_scheme, ("uniform", "exposure"))
        both = set(self.level_variables) & set(self.static_variables)
        _require(not both, f"{sorted(both)} listed as level and as static variable")
        _require(self.sequence_length >= 1, "sequence_length must be at least 1")

    def check_against(self, per_year: int, loaded_sources=None) -> None:
        """Rules that need the calendar or the loaded sources."""
        if self.include_lags:
            _require(per_year in self.lags, f"lags must contain the seasonal period {per_year}")
        if loaded_sources is not None:
            extra = set(self.sources) - set(loaded_sources)
            _require(not extra, f"sources {sorted(extra)} are used but not loaded")


@dataclass(frozen=True)
class FoldParams:
    """Rolling-origin geometry in distinct periods."""

    n_folds: int = 4
    initial_train: int = 90
    test_size: int = 12
    step: int = 12
    validation_fraction: float = 0.15

    def __post_init__(self) -> None:
        _require(self.n_folds >= 2, "at least 2 folds are needed for a spread")
        _require(min(self.initial_train, self.test_size, self.step) > 0, "sizes must be positive")
        _require(0 < self.validation_fraction < 1, "validation_fraction must lie in (0, 1)")

    def check_horizons(self, horizons) -> None:
        _require(max(horizons) <= self.test_size, "the longest horizon exceeds the test size")


@dataclass(frozen=True)
class ConformalParams:
    alpha: float = 0.2
    min_residuals: int = 20

    def __post_init__(self) -> None:
        _require(0 < self.alpha < 1, "alpha must lie in (0, 1)")
        _require(self.min_residuals >= 1, "min_residuals must be at least 1")


@dataclass(frozen=True)
class SeasonalParams:
    trailing_years: int = 10
    use_level_anchor: bool = True
    use_trend: bool = True
    trend_damping: float = 0.9
    max_projection_periods: int = 24
    climatology_max_years: int = 25
    anchor_step: str = "oldest"

    def __post_init__(self) -> None:
        _require(self.trailing_years >= 1, "trailing_years must be at least 1")
        _require(0 <= self.trend_damping <= 1, "trend_damping must lie in [0, 1]")
        _one_of("anchor_step", self.anchor_step, ("oldest", "origin"))


@dataclass(frozen=True)
class RiskParams:
    method: str = "quantile"
    quantiles: tuple[float, ...] = (0.75, 0.90)
    tiers: tuple[str, ...] = ("LOW", "MEDIUM", "HIGH")
    alert_on: str = "upper"
    ewma_alpha: float = 0.3
    ewma_sigma: float = 2.0
    actions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "LOW": ("Keep routine monitoring",),
            "MEDIUM": ("Review stock levels", "Brief regional staff"),
            "HIGH": ("Escalate to the duty lead", "Report daily until the alert clears"),
        }
    )

    def __post_init__(self) -> None:
        _one_of("method", self.method, ("quantile", "ewma"))
        _one_of("alert_on", self.alert_on, ("upper", "point"))
        _ascending("quantiles", self.quantiles)
        _require(all(0 < q < 1 for q in self.quantiles), "quantiles must lie in (0, 1)")
        _require(len(self.tiers) == len(self.quantiles) + 1, "need one tier more than quantiles")
        _require(0 < self.ewma_alpha <= 1, "ewma_alpha must lie in (0, 1]")
        bare = [t for t in self.tiers if not self.actions.get(t)]
        _require(not bare, f"tiers {bare} have no actions")
        unknown = sorted(set(self.actions) - set(self.tiers))
        _require(not unknown, f"actions for unknown tiers {unknown}")


@dataclass(frozen=True)
class ClampParams:
    strategy: str = "sigma"
    n_sigma: float = 2.0

    def __post_init__(self) -> None:
        _one_of("strategy", self.strategy, ("sigma", "minmax"))
        _require(self.n_sigma > 0, "n_sigma must be positive")


@dataclass(frozen=True)
class Scenario:
    """A change to one variable for some entities over an inclusive span."""

    variable: str
    change: float
    mode: str = "percent"
    start: date | None = None
    end: date | None = None
    entities: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        _one_of("mode", self.mode, ("percent", "absolute"))
        reversed_span = self.start is not None and self.end is not None and self.end < self.start
        _require(not reversed_span, f"the span ends {self.end}, before it starts {self.start}")


@dataclass(frozen=True)
class QualityParams:
    outlier_threshold: float = 5.0
    min_coverage: float = 0.8
    min_periods_per_entity: int = 80
    fill_variables: tuple[str, ...] = ()
    fill_method: str = "linear"
    max_gap: int = 2

    def __post_init__(self) -> None:
        _one_of("fill_method", self.fill_method, FILL_METHODS)
        _require(self.max_gap >= 0, "max_gap may not be negative")
        _require(self.outlier_threshold > 0, "outlier_threshold must be positive")


@dataclass(frozen=True)
class ProjectionParams:
    horizons: tuple[int, ...] = (1, 3)
    max_recursive_steps: int = 6

    def __post_init__(self) -> None:
        _ascending("horizons", self.horizons, positive=True)
        _require(self.max_recursive_steps >= 0, "max_recursive_steps may not be negative")
