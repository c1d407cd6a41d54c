"""Forecasting on a future date spine (K1-K5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import relational as rel
from panelcast.operators import windows as win
from panelcast.plans.features import build_features
from panelcast.spec import FeatureConfig, SeriesSpec


def extend_with_future(history: DataFrame, spec: SeriesSpec, horizon: int = 90, lookback: int | None = None) -> DataFrame:
    """History plus ``horizon`` future days per series (target null), in one
    pass: the last row of each series (found with ``lead`` on the same
    window order the features use) explodes into itself and the future
    dates.  No second scan of the history and no join; ``__is_future`` marks
    the added rows.  With ``lookback`` only the last so many rows of each
    series are kept, all that features of bounded reach can see from there."""
    if not 1 <= horizon <= 365:
        raise ValueError("horizon must be between 1 and 365 days")
    keys, d, t = list(spec.keys), spec.order_col, spec.value_col
    w = win.wspec(keys, d)
    place = [] if lookback is None else [F.row_number().over(w).alias("__rn"), F.count(F.lit(1)).over(win._pspec(keys)).alias("__n")]
    h = history.select(*keys, d, t, F.lead(F.col(d)).over(w).isNull().alias("__is_last"), *place)
    if lookback is not None:
        h = h.filter(F.col("__rn") > F.col("__n") - lookback)
    dates = F.when(F.col("__is_last"), F.concat(F.array(F.col(d)),
                                                F.sequence(F.date_add(F.col(d), 1), F.date_add(F.col(d), horizon))))
    dates = dates.otherwise(F.array(F.col(d)))
    g = h.select(*keys, t, F.posexplode(dates).alias("__ahead", d))
    future = F.col("__ahead") > 0
    return g.select(*keys, d, F.when(~future, F.col(t)).cast(history.schema[t].dataType).alias(t), future.alias("__is_future"))


def reach_of(cfg: FeatureConfig) -> int | None:
    """Rows that the configured features look back, None if without bound."""
    from panelcast.operators.longseries import lookback_of

    unbounded = (cfg.create_ewm and cfg.ewm_spans) or (cfg.create_lags and cfg.lag_fill) or (cfg.create_rolling and cfg.rolling_fill)
    if unbounded:
        return None
    lags = [*(cfg.lags if cfg.create_lags or cfg.create_interactions else [])]
    return max(1, lookback_of(lags, cfg.rolling_windows if cfg.create_rolling else []))


#: Rolling statistics that :func:`future_rows` works out from a series' last values.
TAIL_AGGS = ("mean", "std", "min", "max")


def _squares_about(values, mean):
    return F.aggregate(F.transform(values, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v)


def future_rows(history: DataFrame, spec: SeriesSpec, cfg: FeatureConfig, horizon: int) -> DataFrame | None:
    """The prediction features of lags and shifted rolling windows from one
    row per series, its last values in order: no window runs over history.

    A future row sees the history only (targets of future rows are null): a
    lag is one of the last values, a frame a suffix of them.  None where the
    configuration asks for more."""
    reach, windows = reach_of(cfg), cfg.rolling_windows if cfg.create_rolling else []
    aggs = list(cfg.rolling_aggs)
    if reach is None or cfg.create_interactions or spec.tiebreak or (windows and not set(aggs) <= set(TAIL_AGGS)):
        return None
    keys, d, t = list(spec.keys), spec.order_col, spec.value_col
    floats = history.schema[t].dataType.simpleString() in ("double", "float")
    held = F.when(~F.isnan(t), F.col(t)) if floats else F.col(t)
    newest = win.wspec(keys, d, desc=True)
    tail = (history.select(*keys, F.col(d).alias("__d"), held.alias("__t"), F.row_number().over(newest).alias("__back"))
            .where(F.col("__back") <= reach))                  # Spark cuts a series to that before the shuffle
    last = tail.groupBy(*keys).agg(F.max("__d").alias("__end"), F.sort_array(F.collect_list(F.struct(-F.col("__back"), "__t")))["__t"].alias("__v"))
    rows = last.select(*keys, "__end", "__v", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("__h"))
    size, h = F.size("__v"), F.col("__h")
    lags = [F.get("__v", size + h - 1 - k).alias(f"{t}_lag_{k}") if k >= 1 else F.lit(None).alias(f"{t}_lag_{k}")
            for k in (cfg.lags if cfg.create_lags else [])]
    # F.get counts from 0 and gives null outside; places from size on are future rows
    out = rows.select(*keys, F.date_add("__end", h).alias(d), F.lit(None).cast(history.schema[t].dataType).alias(t), "__v", "__h", *lags)
    for n in windows:
        seen = F.filter(F.slice("__v", F.greatest(F.lit(1), size + h - n), F.greatest(F.lit(0), F.least(size, n - h + 1))), lambda v: v.isNotNull())
        out = out.withColumn(f"__w{n}", F.transform(seen, lambda v: v.cast("double")))
    means = [F.try_divide(F.aggregate(f"__w{n}", F.lit(0.0), lambda s, v: s + v), F.size(f"__w{n}")).alias(f"__m{n}") for n in windows]
    out = out.select("*", *means)
    named = []
    for n in windows:
        w, m, count = F.col(f"__w{n}"), F.col(f"__m{n}"), F.size(f"__w{n}")
        ssd = _squares_about(w, m)
        stat = {"mean": m, "min": F.array_min(w), "max": F.array_max(w), "std": F.when(count >= 2, F.sqrt(ssd / (count - 1)))}
        named += [F.when(count >= max(1, n // 2), stat[a]).alias(f"{t}_roll_{a}_{n}d") for a in aggs]
    drop = ["__v", "__h", *[f"__w{n}" for n in windows], *[f"__m{n}" for n in windows]]
    out = out.select("*", *named).drop(*drop)
    if not cfg.date_features:
        return out
    from panelcast.functions import calendar as cal

    return cal.date_features(out, d, cyclical_features=cfg.cyclical, holidays=cfg.holidays, business=cfg.business)


def prediction_features(history: DataFrame, spec: SeriesSpec, cfg: FeatureConfig, horizon: int = 90,
                        spine: DataFrame | None = None) -> DataFrame:
    """History + future rows (target null) -> feature build -> future rows
    only (K2), for every series at once.  With an explicit ``spine`` the
    future rows are those (keys, date) pairs (semi join, B13); otherwise
    lags and rolling windows come from each series' last values
    (:func:`future_rows`), other features from the whole build."""
    keys, d, t = list(spec.keys), spec.order_col, spec.value_col
    if not 1 <= horizon <= 365:
        raise ValueError("horizon must be between 1 and 365 days")
    if spine is not None:
        fut = spine.select(*keys, d).withColumn(t, F.lit(None).cast(history.schema[t].dataType))
        both = rel.union_history_future(history, fut, keys + [d, t])
        return rel.semi_join_keys_dates(build_features(both, spec, cfg), spine, keys, d)
    direct = future_rows(history, spec, cfg, horizon)
    if direct is not None:
        return direct
    both = extend_with_future(history, spec, horizon, reach_of(cfg))
    return build_features(both, spec, cfg).filter("__is_future").drop("__is_future")


def carry_forward(df: DataFrame, spec: SeriesSpec, cols) -> DataFrame:
    """Direct forecasts leave horizon-dependent features null; carry the last
    available value forward per series and flag it (``<f>_imputed``)."""
    keys, d = list(spec.keys), spec.order_col
    flagged = df.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}_imputed") for c in cols])
    return win.fill_columns(flagged, keys, d, cols, "ffill")


def align_columns(df: DataFrame, input_cols) -> DataFrame:
    """Column alignment with the model (K3): every model input must exist."""
    missing = [c for c in input_cols if c not in df.columns]
    if missing:
        raise ValueError(f"features missing for the model: {missing}")
    return df


def forecast(model, history: DataFrame, spec: SeriesSpec, cfg: FeatureConfig, horizon: int = 90,
             input_cols=None) -> DataFrame:
    """Predict every series' next ``horizon`` days (K2-K4):
    features -> alignment -> ``transform`` -> round half-even, clip 0, int."""
    keys, d, t = list(spec.keys), spec.order_col, spec.value_col
    feats = _future_features(history, spec, cfg, horizon, input_cols)
    if input_cols:
        align_columns(feats, input_cols)
    pred = model.transform(feats)
    return pred.select(*keys, d, rel.format_forecast(F.col("prediction")).alias("forecast"))


def _future_features(history, spec, cfg, horizon, input_cols):
    keys, d, t = list(spec.keys), spec.order_col, spec.value_col
    feats = build_features(extend_with_future(history, spec, horizon, None if input_cols else reach_of(cfg)), spec, cfg)
    fill = [c for c in (input_cols or []) if c.startswith(f"{t}_")]
    if fill:
        feats = carry_forward(feats, spec, fill)
    return feats.filter("__is_future").drop("__is_future")


def history_and_forecast(history: DataFrame, fc: DataFrame, spec: SeriesSpec, tail: int = 365) -> DataFrame:
    """History (last ``tail`` rows per series, B7) and forecast in one frame
    with a ``kind`` column (K5)."""
    keys, d, t = list(spec.keys), spec.order_col, spec.value_col
    h = rel.last_n(history, keys, d, tail).select(*keys, d, F.col(t).cast("bigint").alias("value"),
                                                  F.lit("history").alias("kind"))
    f = fc.select(*keys, d, F.col("forecast").alias("value"), F.lit("forecast").alias("kind"))
    return h.unionByName(f)
