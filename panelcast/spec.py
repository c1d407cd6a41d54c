"""Contracts for keyed daily panels and the feature configuration."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SeriesSpec:
    """Describes a keyed panel: one series per ``keys`` value, ordered by
    ``order_col``; ``value_col`` is the measure (target).

    ``keys=()`` means the whole frame is one series; every order-sensitive
    operator then runs in a single window partition, which is only sensible
    for a single series.
    """

    keys: tuple[str, ...] = ("store", "item")
    order_col: str = "date"
    value_col: str = "sales"
    tiebreak: tuple[str, ...] = ()   # extra order columns for rows sharing a date

    def __post_init__(self):
        object.__setattr__(self, "keys", tuple(self.keys))
        object.__setattr__(self, "tiebreak", tuple(self.tiebreak))

    @property
    def window_order(self):
        """Order for window operators: the order column plus tie-breakers."""
        return (self.order_col, *self.tiebreak) if self.tiebreak else self.order_col


# Fixed values that must equal the reference's defaults (feature lists,
# switches, categorical columns, boosting parameters, folds, horizon).
DEFAULT_LAGS = [91, 98, 105, 112, 119, 126, 182, 364, 546, 728]
DEFAULT_ROLLING_WINDOWS = [91, 182, 365, 546]
DEFAULT_ROLLING_AGGS = ["mean", "std", "min", "max"]
DEFAULT_EWM_SPANS = [7, 14, 28, 91]
DEFAULT_CATEGORICAL = ["store", "item", "month", "dayofweek", "quarter", "is_holiday", "year"]
DEFAULT_CV_FOLDS = 5
DEFAULT_HORIZON = 90
MAX_HORIZON = 365
BOOSTING_PARAMS = {
    "objective": "regression_l1",
    "n_estimators": 1000,
    "learning_rate": 0.05,
    "feature_fraction": 0.8,
    "bagging_fraction": 0.8,
    "bagging_freq": 1,
    "lambda_l1": 0.1,
    "lambda_l2": 0.1,
    "num_leaves": 31,
    "seed": 42,
    "early_stopping_rounds": 50,
}
BASE_DATE_FEATURES = ["year", "month", "day", "dayofweek", "dayofyear", "weekofyear",
                      "quarter", "is_month_end", "is_quarter_end"]
CYCLICAL_DATE_FEATURES = ["month_sin", "month_cos", "dow_sin", "dow_cos"]


@dataclass
class FeatureConfig:
    """Switches and parameter lists of the config-driven feature build."""

    date_features: bool = True
    cyclical: bool = True
    business: bool = False
    holidays: bool = True
    lags: list[int] = field(default_factory=lambda: list(DEFAULT_LAGS))
    lag_fill: str | None = None
    rolling_windows: list[int] = field(default_factory=lambda: list(DEFAULT_ROLLING_WINDOWS))
    rolling_aggs: list[str] = field(default_factory=lambda: list(DEFAULT_ROLLING_AGGS))
    rolling_fill: str | None = None
    ewm_spans: list[int] = field(default_factory=lambda: list(DEFAULT_EWM_SPANS))
    create_lags: bool = True
    create_rolling: bool = True
    create_ewm: bool = False
    create_interactions: bool = False
    categorical: list[str] = field(default_factory=lambda: list(DEFAULT_CATEGORICAL))
    # split series into chunks of this many rows (with look-back halos) for the
    # lag/rolling windows, so one very long series runs as many tasks; "auto"
    # splits only when the longest series exceeds a threshold
    split_rows: int | str | None = None

    def feature_names(self, spec: SeriesSpec, available: list[str] | None = None) -> list[str]:
        """Feature list assembly (B11): names by switch, keys added,
        de-duplicated and sorted, restricted to existing columns."""
        t = spec.value_col
        names: list[str] = []
        if self.date_features:
            names += BASE_DATE_FEATURES
            if self.cyclical:
                names += CYCLICAL_DATE_FEATURES
            if self.holidays:
                names.append("is_holiday")
        if self.create_lags:
            names += [f"{t}_lag_{k}" for k in self.lags]
        if self.create_rolling:
            names += [f"{t}_roll_{a}_{w}d" for w in self.rolling_windows for a in self.rolling_aggs]
        if self.create_ewm:
            names += [f"{t}_ewm_{s}" for s in self.ewm_spans]
        if self.create_interactions:
            names += [f"{t}_diff_{k}" for k in self.lags]
            names += [f"{t}_ratio_{k}" for k in self.lags]
        names += [k for k in spec.keys if k not in names]
        names = sorted(set(names))
        if available is not None:
            names = [n for n in names if n in available]
        return [n for n in names if n not in (t, spec.order_col)]
