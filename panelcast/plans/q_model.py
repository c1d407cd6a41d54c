"""Catalog: validation folds, metrics, ensemble, prediction features."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import windows as win
from panelcast.plans import validation as val
from panelcast.plans.catalog import KEYS, PART, float_cols, register, round_cols
from panelcast.plans.forecast import prediction_features
from panelcast.plans.sqlgen import date_features_sql, r6, shifted_roll_sql
from panelcast.sources.tables import DAILY_SALES_SQL, daily_sales, with_sql
from panelcast.spec import DEFAULT_LAGS, DEFAULT_ROLLING_AGGS, DEFAULT_ROLLING_WINDOWS, FeatureConfig, SeriesSpec

DS = with_sql(DAILY_SALES_SQL)
K = 5


def _r(df):
    return round_cols(df, float_cols(df))


FOLD_SQL = DS + f""", idx AS (SELECT store, item, date, sales,
  CAST(row_number() OVER (ORDER BY date, store, item) - 1 AS BIGINT) AS row_index,
  COUNT(*) OVER () AS n FROM daily_sales),
f AS (SELECT *, n // {K + 1} AS t, n - {K} * (n // {K + 1}) AS first FROM idx)
SELECT store, item, date, sales, row_index, row_index AS split_index,
  CAST(CASE WHEN t > 0 AND row_index >= first THEN (row_index - first) // t + 1 END AS INTEGER) AS val_fold,
  CAST(t AS BIGINT) AS fold_size, CAST(first AS BIGINT) AS first_val_index FROM f"""


@register("time_series_folds", FOLD_SQL)
def time_series_folds(spark, sf):
    """L2: global date order index and 5-fold expanding-window validation
    blocks (row borders; ``boundary="date"`` snaps them to whole dates)."""
    return val.time_series_folds(daily_sales(spark, sf), ["date", "store", "item"], K)


SCORED_SQL = DS + f""", scored AS (SELECT store, item, date, CAST(sales AS DOUBLE) AS y,
  CAST(lag(sales, 7) OVER w AS DOUBLE) AS p7, CAST(lag(sales, 14) OVER w AS DOUBLE) AS p14
  FROM daily_sales WINDOW w AS (PARTITION BY {PART} ORDER BY date))"""


def _scored(spark, sf):
    f = win.lag_features(daily_sales(spark, sf), KEYS, "date", "sales", [7, 14])
    return f.select("store", "item", "date", F.col("sales").cast("double").alias("y"),
                    F.col("sales_lag_7").cast("double").alias("p7"),
                    F.col("sales_lag_14").cast("double").alias("p14"))


def _metric_sql(p, by=""):
    grp = f" GROUP BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"""SELECT {sel}{r6(f'AVG(ABS(y - {p}))')} AS mae, {r6(f'SQRT(AVG((y - {p}) * (y - {p})))')} AS rmse,
  {r6(f'AVG(CASE WHEN (ABS(y) + ABS({p})) / 2 <> 0 THEN ABS({p} - y) / ((ABS(y) + ABS({p})) / 2) ELSE 0 END) * 100')} AS smape,
  {r6(f'AVG(ABS(y - {p}) / GREATEST(ABS(y), {val.EPS!r}))')} AS mape, CAST(COUNT(*) AS BIGINT) AS n
FROM scored WHERE {p} IS NOT NULL{grp}"""


@register("naive_metrics", SCORED_SQL + _metric_sql("p7"))
def naive_metrics(spark, sf):
    """MAE, RMSE, SMAPE, MAPE of the lag-7 naive forecast."""
    s = _scored(spark, sf).filter(F.col("p7").isNotNull())
    return _r(val.metrics(s, "y", "p7"))


@register("naive_metrics_by_series", SCORED_SQL + _metric_sql("p7", "store, item"))
def naive_metrics_by_series(spark, sf):
    """L5-L7 per series."""
    s = _scored(spark, sf).filter(F.col("p7").isNotNull())
    return _r(val.metrics(s, "y", "p7", by=KEYS))


CV_SQL = SCORED_SQL + f""", idx AS (SELECT *, row_number() OVER (ORDER BY date, store, item) - 1 AS row_index,
  COUNT(*) OVER () AS n FROM scored WHERE p7 IS NOT NULL),
f AS (SELECT *, n // {K + 1} AS t, n - {K} * (n // {K + 1}) AS first FROM idx),
v AS (SELECT *, CAST((row_index - first) // t + 1 AS INTEGER) AS val_fold FROM f WHERE t > 0 AND row_index >= first),
per AS (SELECT val_fold, AVG(ABS(y - p7)) AS mae, SQRT(AVG((y - p7) * (y - p7))) AS rmse,
  AVG(CASE WHEN (ABS(y) + ABS(p7)) / 2 <> 0 THEN ABS(p7 - y) / ((ABS(y) + ABS(p7)) / 2) ELSE 0 END) * 100 AS smape,
  COUNT(*) AS n FROM v GROUP BY val_fold)
SELECT val_fold, {r6('mae')} AS mae, {r6('rmse')} AS rmse, {r6('smape')} AS smape, CAST(n AS BIGINT) AS n FROM per
UNION ALL SELECT 0, {r6('AVG(mae)')}, {r6('AVG(rmse)')}, {r6('AVG(smape)')}, CAST(SUM(n) AS BIGINT) FROM per"""


@register("cv_fold_metrics", CV_SQL)
def cv_fold_metrics(spark, sf):
    """Per-fold and averaged metrics of the naive forecast on the 5
    time-ordered validation blocks."""
    s = _scored(spark, sf).filter(F.col("p7").isNotNull())
    folded = val.time_series_folds(s, ["date", "store", "item"], K)
    return _r(val.fold_metrics(folded, "y", "p7"))


@register("ensemble_predictions", SCORED_SQL + f"""SELECT store, item, date, y, {r6('0.5 * p7 + 0.5 * p14')} AS ensemble
FROM scored WHERE p14 IS NOT NULL""")
def ensemble_predictions(spark, sf):
    """Equal-weight ensemble of two prediction columns."""
    s = _scored(spark, sf).filter(F.col("p14").isNotNull())
    return _r(val.weighted_ensemble(s, ["p7", "p14"]).select("store", "item", "date", "y", "ensemble"))


def _pred_sql():
    lags = ",\n  ".join(f"lag(sales, {k}) OVER (PARTITION BY {PART} ORDER BY date) AS sales_lag_{k}"
                        for k in DEFAULT_LAGS)
    rolls = ",\n  ".join(f"{shifted_roll_sql('sales', n, a, PART, 'date')} AS sales_roll_{a}_{n}d"
                         for n in DEFAULT_ROLLING_WINDOWS for a in DEFAULT_ROLLING_AGGS)
    return DS + f""", future AS (
  SELECT store, item, CAST(unnest(generate_series(hi + INTERVAL 1 DAY, hi + INTERVAL 90 DAY, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT {PART}, MAX(date) AS hi FROM daily_sales GROUP BY {PART})),
u AS (SELECT store, item, date, sales FROM daily_sales
      UNION ALL SELECT store, item, date, CAST(NULL AS BIGINT) FROM future),
feat AS (SELECT store, item, date, sales,
  {date_features_sql('date')},
  {lags},
  {rolls}
FROM u)
SELECT feat.* FROM feat SEMI JOIN future f ON f.store = feat.store AND f.item = feat.item AND f.date = feat.date"""


@register("prediction_features", _pred_sql())
def prediction_features_q(spark, sf):
    """K2: history + 90-day future spine, full default feature build, future
    rows kept by a semi join on (keys, date)."""
    f = prediction_features(daily_sales(spark, sf), SeriesSpec(), FeatureConfig(), horizon=90)
    return _r(f)


FOLD_DATE_SQL = DS + f""", idx AS (SELECT store, item, date, sales,
  CAST(row_number() OVER (ORDER BY date, store, item) - 1 AS BIGINT) AS row_index,
  COUNT(*) OVER () AS n FROM daily_sales),
s AS (SELECT *, MIN(row_index) OVER (PARTITION BY date) AS split_index FROM idx),
f AS (SELECT *, n // {K + 1} AS t, n - {K} * (n // {K + 1}) AS first FROM s)
SELECT store, item, date, sales, row_index, split_index,
  CAST(CASE WHEN t > 0 AND split_index >= first THEN (split_index - first) // t + 1 END AS INTEGER) AS val_fold,
  CAST(t AS BIGINT) AS fold_size, CAST(first AS BIGINT) AS first_val_index FROM f"""


@register("time_series_folds_by_date", FOLD_DATE_SQL)
def time_series_folds_by_date(spark, sf):
    """L2 with fold borders snapped to whole dates (no date in two folds)."""
    return val.time_series_folds(daily_sales(spark, sf), ["date", "store", "item"], K, boundary="date")
