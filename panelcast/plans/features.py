"""Config-driven feature build (E16) shared by training, display and prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelcast.functions import calendar as cal
from panelcast.operators import windows as win
from panelcast.spec import FeatureConfig, SeriesSpec

AUTO_SPLIT_THRESHOLD = 2_000_000   # rows in one series before windows are chunked
AUTO_CHUNK_ROWS = 1_000_000


def build_features(df: DataFrame, spec: SeriesSpec, cfg: FeatureConfig) -> DataFrame:
    """date -> lag -> rolling -> EWM -> interaction, each by switch.

    All keyed window features share one ``Exchange hashpartitioning(keys)``;
    nothing here triggers a job.
    """
    keys, t = list(spec.keys), spec.value_col
    out = df
    if cfg.date_features:
        out = cal.date_features(out, spec.order_col, cyclical_features=cfg.cyclical, holidays=cfg.holidays,
                                business=cfg.business)
    order = spec.window_order
    lags = cfg.lags if cfg.create_lags else []
    windows = cfg.rolling_windows if cfg.create_rolling else []

    def bounded(d, k, o):
        if lags:
            d = win.lag_features(d, k, o, t, lags)
        if windows:
            d = win.shifted_rolling(d, k, o, t, windows, cfg.rolling_aggs)
        return d

    split = cfg.split_rows
    if split == "auto" and (lags or windows):
        # one small job: split only when some series is longer than the threshold
        from panelcast.operators.ewm import max_series_length

        split = AUTO_CHUNK_ROWS if max_series_length(out, keys) > AUTO_SPLIT_THRESHOLD else None
    if split and (lags or windows):
        from panelcast.operators.longseries import chunked, lookback_of

        out = chunked(out, keys, order, bounded, lookback_of(lags, windows), 0, int(split))
    else:
        out = bounded(out, keys, order)
    # fills look back without bound: run on whole series
    if lags and cfg.lag_fill:
        out = win.fill_columns(out, keys, order, [f"{t}_lag_{k}" for k in lags], cfg.lag_fill)
    if windows and cfg.rolling_fill:
        names = [f"{t}_roll_{a}_{n}d" for n in windows for a in cfg.rolling_aggs if a in win.KNOWN_AGGS]
        out = win.fill_columns(out, keys, order, names, cfg.rolling_fill)
    if cfg.create_ewm and cfg.ewm_spans:
        from panelcast.operators.ewm import ewm_features

        out = ewm_features(out, keys, order, t, cfg.ewm_spans)
    if cfg.create_interactions and cfg.lags:
        out = win.interaction_features(out, keys, order, t, cfg.lags)
    return out
