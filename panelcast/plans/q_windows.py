"""Catalog: window features and calendar features (E1-E16 without E6, F13-F15, C2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions import calendar as cal
from panelcast.operators import windows as win
from panelcast.plans.catalog import KEYS, PART, float_cols, register, round_cols
from panelcast.plans.features import build_features
from panelcast.plans.sqlgen import date_features_sql, holiday_sql, r6, shifted_roll_sql, trailing_roll_sql
from panelcast.sources.tables import (DAILY_SALES_DENSE_SQL, DAILY_SALES_SQL, daily_sales,
                                      daily_sales_dense, with_sql)
from panelcast.spec import DEFAULT_LAGS, DEFAULT_ROLLING_AGGS, DEFAULT_ROLLING_WINDOWS, FeatureConfig, SeriesSpec

DS = with_sql(DAILY_SALES_SQL)
DSD = with_sql(DAILY_SALES_SQL, DAILY_SALES_DENSE_SQL)
W = f"(PARTITION BY {PART} ORDER BY date)"
RUN = f"(PARTITION BY {PART} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
REV = f"(PARTITION BY {PART} ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _r(df):
    return round_cols(df, float_cols(df))


def _lags_sql(lags, v="sales"):
    return ",\n  ".join(f"lag({v}, {k}) OVER {W} AS {v}_lag_{k}" for k in lags)


@register("lag_features", DS + f"SELECT store, item, date, sales,\n  {_lags_sql(DEFAULT_LAGS)}\nFROM daily_sales")
def lag_features(spark, sf):
    """Keyed lags with the default lag list (91 ... 728 rows)."""
    return win.lag_features(daily_sales(spark, sf), KEYS, "date", "sales", DEFAULT_LAGS)


@register("lag_ffill", DSD + f"""SELECT store, item, date, sales,
  last_value(l1 IGNORE NULLS) OVER {RUN} AS sales_lag_1 FROM (
  SELECT *, lag(sales, 1) OVER {W} AS l1 FROM daily_sales_dense)""")
def lag_ffill(spark, sf):
    """E1f: lag 1 on the densified panel, forward-filled within each series."""
    return win.lag_features(daily_sales_dense(spark, sf), KEYS, "date", "sales", [1], fill="ffill")


@register("shifted_rolling_ffill", DSD + f"""SELECT store, item, date, sales,
  last_value(r IGNORE NULLS) OVER {RUN} AS sales_roll_mean_7d FROM (
  SELECT *, {shifted_roll_sql('sales', 7, 'mean', PART, 'date')} AS r FROM daily_sales_dense)""")
def shifted_rolling_ffill(spark, sf):
    """E3f: shifted rolling mean on the densified panel, forward-filled within each series."""
    cfg = FeatureConfig(date_features=False, create_lags=False, rolling_windows=[7], rolling_aggs=["mean"], rolling_fill="ffill")
    return _r(build_features(daily_sales_dense(spark, sf), SeriesSpec(), cfg))


_INTER_LAGS = [7, 28]


@register("feature_build_interactions", DS + "SELECT store, item, date, sales,\n  " + ",\n  ".join(
    f"l{k} AS sales_lag_{k}, CAST(sales - l{k} AS DOUBLE) AS sales_diff_{k}, {r6(f'sales / nullif(CAST(l{k} AS DOUBLE), 0)')} AS sales_ratio_{k}"
    for k in _INTER_LAGS) + " FROM (SELECT *, " + ", ".join(f"lag(sales, {k}) OVER {W} AS l{k}" for k in _INTER_LAGS) + " FROM daily_sales)")
def feature_build_interactions(spark, sf):
    """E16 with the interaction switch on (lags, differences, ratios)."""
    cfg = FeatureConfig(date_features=False, lags=_INTER_LAGS, create_rolling=False, create_interactions=True)
    return _r(build_features(daily_sales(spark, sf), SeriesSpec(), cfg))


SINGLE_LAGS = [1, 2, 3, 7, 14, 30]


@register("single_series_lags", DS + f"SELECT store, item, date, sales,\n  {_lags_sql(SINGLE_LAGS)}\nFROM daily_sales")
def single_series_lags(spark, sf):
    """The exploration lag set 1, 2, 3, 7, 14, 30 (per series)."""
    return win.lag_features(daily_sales(spark, sf), KEYS, "date", "sales", SINGLE_LAGS)


def _shifted_sql(windows, aggs):
    return ",\n  ".join(f"{shifted_roll_sql('sales', n, a, PART, 'date')} AS sales_roll_{a}_{n}d"
                        for n in windows for a in aggs)


@register("shifted_rolling", DS + f"""SELECT store, item, date, sales,
  {_shifted_sql(DEFAULT_ROLLING_WINDOWS, DEFAULT_ROLLING_AGGS)} FROM daily_sales""")
def shifted_rolling(spark, sf):
    """Leak-free rolling mean/std/min/max over 91, 182, 365, 546 rows."""
    f = win.shifted_rolling(daily_sales(spark, sf), KEYS, "date", "sales",
                            DEFAULT_ROLLING_WINDOWS, DEFAULT_ROLLING_AGGS)
    return _r(f)


@register("shifted_rolling_frames", DS + f"""SELECT store, item, date, sales,
  {_shifted_sql([7, 30], ['mean', 'std', 'min', 'max', 'sum'])} FROM daily_sales""")
def shifted_rolling_frames(spark, sf):
    """E3 with plain sliding frames (method="frame"), the cross-check of the
    table method."""
    f = win.shifted_rolling(daily_sales(spark, sf), KEYS, "date", "sales", [7, 30],
                            ["mean", "std", "min", "max", "sum"], method="frame")
    return _r(f)


TR_WINDOWS = [3, 7, 14, 30]
TR_STATS = ["mean", "std", "min", "max", "median", "skew"]


@register("trailing_rolling", DS + "SELECT store, item, date, sales,\n  " + ",\n  ".join(
    f"{trailing_roll_sql('sales', n, s, PART, 'date')} AS sales_rolling_{n}_{s}"
    for n in TR_WINDOWS for s in TR_STATS) + "\nFROM daily_sales")
def trailing_rolling(spark, sf):
    """Trailing windows 3, 7, 14, 30 incl. the current row; full window
    required; mean, std, min, max, median, skew."""
    return _r(win.trailing_rolling(daily_sales(spark, sf), KEYS, "date", "sales", TR_WINDOWS, TR_STATS))


EXP_AGGS = ["mean", "std", "min", "max", "sum", "count", "median"]


def _expanding_sql():
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum"}
    cols = []
    for a in EXP_AGGS:
        if a == "count":
            e = f"CAST(count(sales) OVER {RUN} AS DOUBLE)"
        elif a == "median":
            e = r6(f"quantile_cont(sales, 0.5) OVER {RUN}")
        else:
            e = r6(f"{fn[a]}(sales) OVER {RUN}")
        cols.append(f"{e} AS sales_expanding_{a}")
    return ",\n  ".join(cols)


@register("expanding", DS + f"SELECT store, item, date, sales,\n  {_expanding_sql()}\nFROM daily_sales")
def expanding(spark, sf):
    """E5: expanding statistics including the current row, min_periods 1."""
    return _r(win.expanding(daily_sales(spark, sf), KEYS, "date", "sales", EXP_AGGS))


@register("interaction", DS + f"""SELECT store, item, date, sales,
  CAST(sales - l7 AS DOUBLE) AS sales_diff_7, {r6('sales / NULLIF(CAST(l7 AS DOUBLE), 0)')} AS sales_ratio_7,
  CAST(sales - l28 AS DOUBLE) AS sales_diff_28, {r6('sales / NULLIF(CAST(l28 AS DOUBLE), 0)')} AS sales_ratio_28
FROM (SELECT *, lag(sales, 7) OVER {W} AS l7, lag(sales, 28) OVER {W} AS l28 FROM daily_sales)""")
def interaction(spark, sf):
    """Target minus / over its lags 7 and 28 (zero lag -> null)."""
    return _r(win.interaction_features(daily_sales(spark, sf), KEYS, "date", "sales", [7, 28]))


DIFF_P = [1, 7, 30]


@register("difference_pct_change", DSD + "SELECT store, item, date, sales,\n  " + ",\n  ".join(
    f"CAST(sales - lag(sales, {p}) OVER {W} AS DOUBLE) AS sales_diff_{p},\n  "
    f"{r6(f'ff / NULLIF(lag(ff, {p}) OVER {W}, 0) - 1')} AS sales_pct_change_{p}" for p in DIFF_P)
    + f"\nFROM (SELECT *, CAST(last_value(sales IGNORE NULLS) OVER {RUN} AS DOUBLE) AS ff FROM daily_sales_dense)")
def difference_pct_change(spark, sf):
    """E8/E9 on the densified panel: differences and padded percent change."""
    return _r(win.difference_features(daily_sales_dense(spark, sf), KEYS, "date", "sales", DIFF_P))


@register("ffill_bfill", DSD + f"""SELECT store, item, date, sales,
  last_value(sales IGNORE NULLS) OVER {RUN} AS sales_ffill,
  first_value(sales IGNORE NULLS) OVER {REV} AS sales_bfill FROM daily_sales_dense""")
def ffill_bfill(spark, sf):
    """Forward and backward fill within each series."""
    d = daily_sales_dense(spark, sf)
    return d.select("*", win.ffill("sales", KEYS, "date").alias("sales_ffill"),
                    win.bfill("sales", KEYS, "date").alias("sales_bfill"))


@register("interpolate_linear", DSD + f"""SELECT store, item, date, sales, {r6('''CASE
    WHEN sales IS NOT NULL THEN sales
    WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * (rn - pp) / (np - pp)
    WHEN pv IS NOT NULL THEN pv END''')} AS sales_interp FROM (
  SELECT *, CAST(last_value(sales IGNORE NULLS) OVER {RUN} AS DOUBLE) AS pv,
         last_value(CASE WHEN sales IS NOT NULL THEN rn END IGNORE NULLS) OVER {RUN} AS pp,
         CAST(first_value(sales IGNORE NULLS) OVER {REV} AS DOUBLE) AS nv,
         first_value(CASE WHEN sales IS NOT NULL THEN rn END IGNORE NULLS) OVER {REV} AS np
  FROM (SELECT *, row_number() OVER {W} AS rn FROM daily_sales_dense))""")
def interpolate_linear(spark, sf):
    """Linear interpolation by row position on the densified panel."""
    d = daily_sales_dense(spark, sf)
    return _r(win.interpolate_linear(d, KEYS, "date", "sales", out="sales_interp"))


@register("moving_average_display", DS + f"""SELECT store, item, date, sales,
  CASE WHEN COUNT(*) OVER (PARTITION BY {PART}) > 7 THEN {trailing_roll_sql('sales', 7, 'mean', PART, 'date')} END AS ma_7,
  CASE WHEN COUNT(*) OVER (PARTITION BY {PART}) > 30 THEN {trailing_roll_sql('sales', 30, 'mean', PART, 'date')} END AS ma_30
FROM daily_sales""")
def moving_average_display(spark, sf):
    """7- and 30-row moving averages for display."""
    return _r(win.moving_average_display(daily_sales(spark, sf), KEYS, "date", "sales"))


@register("centered_ma", DS + f"""SELECT store, item, date, sales,
  CASE WHEN count(sales) OVER c = 7 THEN {r6('avg(sales) OVER c')} END AS trend
FROM daily_sales WINDOW c AS (PARTITION BY {PART} ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def centered_ma(spark, sf):
    """Centred 7-row moving average."""
    return _r(win.centered_mean(daily_sales(spark, sf), KEYS, "date", "sales", 7, "trend"))


@register("clean_fill", DSD + f"""SELECT store, item, date,
  COALESCE(last_value(sales IGNORE NULLS) OVER {RUN}, first_value(sales IGNORE NULLS) OVER {REV}) AS sales
FROM daily_sales_dense""")
def clean_fill(spark, sf):
    """Forward then backward fill of every non-key column."""
    return win.clean_fill(daily_sales_dense(spark, sf), KEYS, "date")


def _build_sql():
    lags = _lags_sql(DEFAULT_LAGS)
    rolls = _shifted_sql(DEFAULT_ROLLING_WINDOWS, DEFAULT_ROLLING_AGGS)
    return DS + f"""SELECT store, item, date, sales,
  {date_features_sql('date')},
  {lags},
  {rolls}
FROM daily_sales"""


@register("feature_build_default", _build_sql())
def feature_build_default(spark, sf):
    """The config-driven feature build with the default switches
    (date + lag + rolling; EWM and interactions off)."""
    f = build_features(daily_sales(spark, sf), SeriesSpec(), FeatureConfig())
    return _r(f)


@register("feature_build_split", _build_sql())
def feature_build_split(spark, sf):
    """E16 with long-series splitting: lag/rolling windows on chunks of
    10,000 rows with look-back halos (same result as the default build)."""
    cfg = FeatureConfig(split_rows=10_000)
    return _r(build_features(daily_sales(spark, sf), SeriesSpec(), cfg))


def _time_sql():
    d = "date"
    cols = [
        "CAST(year(date) AS INTEGER) AS year", "CAST(month(date) AS INTEGER) AS month",
        "CAST(day(date) AS INTEGER) AS day", "CAST(isodow(date) - 1 AS INTEGER) AS dayofweek",
        "CAST(dayofyear(date) AS INTEGER) AS dayofyear", "CAST(weekofyear(date) AS INTEGER) AS weekofyear",
        "CAST(quarter(date) AS INTEGER) AS quarter",
    ]
    for name, expr, period in [("month", "month(date)", 12), ("day", "day(date)", 31),
                               ("dayofweek", "(isodow(date) - 1)", 7), ("dayofyear", "dayofyear(date)", 365)]:
        cols.append(f"{r6(f'sin(2 * pi() * {expr} / {period})')} AS {name}_sin")
        cols.append(f"{r6(f'cos(2 * pi() * {expr} / {period})')} AS {name}_cos")
    cols += [
        "CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend",
        "CAST(day(date) = 1 AS INTEGER) AS is_month_start",
        f"CAST({d} = last_day({d}) AS INTEGER) AS is_month_end",
        "CAST(day(date) = 1 AND month(date) % 3 = 1 AS INTEGER) AS is_quarter_start",
        f"CAST({d} = last_day({d}) AND month({d}) % 3 = 0 AS INTEGER) AS is_quarter_end",
        "CAST(date_diff('day', MIN(date) OVER (), date) AS INTEGER) AS days_since_start",
    ]
    return DS + "SELECT store, item, date, sales,\n  " + ",\n  ".join(cols) + "\nFROM daily_sales"


@register("time_features", _time_sql())
def time_features(spark, sf):
    """F1-F13 / F15 exploration path: full cyclical set, business flags,
    days since the frame's first date."""
    return _r(cal.time_features(daily_sales(spark, sf, shared=True), "date"))


@register("holiday_calendar_join", DS + f"""SELECT store, item, date, {holiday_sql('date')} AS is_holiday
FROM daily_sales""")
def holiday_calendar_join(spark, sf):
    """Holiday flag by a (size-checked) broadcast join against a
    calendar table derived from the panel's own date extent."""
    ds = daily_sales(spark, sf, shared=True)
    ext = ds.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = ext.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    calendar = days.filter(cal.us_federal_holiday("date") == 1)
    return cal.holiday_flag(ds.select("store", "item", "date"), "date", calendar)


ONE_SQL = """, daily_sales_one AS (SELECT date, sales FROM daily_sales WHERE store = 1 AND item = 'STANDARD')"""


def _one(spark, sf):
    """FIXTURES' single-series view: store 1, item STANDARD (keys = [])."""
    return daily_sales(spark, sf).filter((F.col("store") == 1) & (F.col("item") == "STANDARD")).select("date", "sales")


@register("single_series_features", DS + ONE_SQL + """SELECT date, sales,
  """ + ",\n  ".join(
    [f"lag(sales, {k}) OVER (ORDER BY date) AS sales_lag_{k}" for k in SINGLE_LAGS]
    + [f"{trailing_roll_sql('sales', n, s_, '1', 'date')} AS sales_rolling_{n}_{s_}"
       for n in [3, 7, 14, 30] for s_ in ["mean", "std", "min", "max"]]
    + [f"CAST(sales - lag(sales, {p}) OVER (ORDER BY date) AS DOUBLE) AS sales_diff_{p}" for p in DIFF_P]
    + [f"{r6(f'ff / NULLIF(lag(ff, {p}) OVER (ORDER BY date), 0) - 1')} AS sales_pct_change_{p}" for p in DIFF_P])
    + """ FROM (SELECT *, CAST(last_value(sales IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS DOUBLE)
       AS ff FROM daily_sales_one)""")
def single_series_features(spark, sf):
    """E2/E4/E8/E9 single-series helpers (keys = []): lags 1..30, trailing
    rolling 3..30 (mean, std, min, max), differences and percent change."""
    f = win.lag_features(_one(spark, sf), [], "date", "sales", SINGLE_LAGS)
    f = win.trailing_rolling(f, [], "date", "sales", [3, 7, 14, 30], ["mean", "std", "min", "max"])
    f = win.difference_features(f, [], "date", "sales", DIFF_P)
    return _r(f)
