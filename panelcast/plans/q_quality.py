"""Catalog: imputation, scaling and outlier detection."""

from __future__ import annotations

from panelcast.operators import impute as imp
from panelcast.operators import outliers as out
from panelcast.operators import windows as win
from panelcast.plans.catalog import KEYS, PART, float_cols, register, round_cols
from panelcast.plans.sqlgen import r2, r6
from panelcast.sources.tables import (DAILY_SALES_DENSE_SQL, DAILY_SALES_SQL, daily_sales,
                                      daily_sales_dense, table, with_sql)

DS = with_sql(DAILY_SALES_SQL)
DSD = with_sql(DAILY_SALES_SQL, DAILY_SALES_DENSE_SQL)
GRP = f"(PARTITION BY {PART})"


def _r(df):
    return round_cols(df, float_cols(df))


@register("impute_remove", DSD + "SELECT store, item, date, sales FROM daily_sales_dense WHERE sales IS NOT NULL")
def impute_remove(spark, sf):
    """Drop rows whose value is missing."""
    return imp.impute(daily_sales_dense(spark, sf), "sales", "remove", KEYS)


@register("impute_mean", DSD + f"""SELECT store, item, date,
  {r6(f'COALESCE(CAST(sales AS DOUBLE), AVG(CAST(sales AS DOUBLE)) OVER {GRP})')} AS sales FROM daily_sales_dense""")
def impute_mean(spark, sf):
    """Per-series mean fill."""
    return _r(imp.impute(daily_sales_dense(spark, sf), "sales", "mean", KEYS))


@register("impute_median", DSD + f"""SELECT d.store, d.item, d.date,
  {r6('COALESCE(CAST(d.sales AS DOUBLE), m.med)')} AS sales FROM daily_sales_dense d
JOIN (SELECT {PART}, QUANTILE_CONT(CAST(sales AS DOUBLE), 0.5) AS med FROM daily_sales_dense GROUP BY {PART}) m
  ON d.store = m.store AND d.item = m.item""")
def impute_median(spark, sf):
    """Per-series exact median fill."""
    return _r(imp.impute(daily_sales_dense(spark, sf), "sales", "median", KEYS))


@register("impute_mode", DSD + f""", cnt AS (
  SELECT {PART}, sales, COUNT(*) AS c FROM daily_sales_dense WHERE sales IS NOT NULL GROUP BY {PART}, sales),
mode AS (SELECT {PART}, sales AS mode_value FROM (
  SELECT *, row_number() OVER (PARTITION BY {PART} ORDER BY c DESC, sales ASC) AS rn FROM cnt) WHERE rn = 1)
SELECT d.store, d.item, d.date, {r6('COALESCE(CAST(d.sales AS DOUBLE), CAST(m.mode_value AS DOUBLE))')} AS sales
FROM daily_sales_dense d JOIN mode m ON d.store = m.store AND d.item = m.item""")
def impute_mode(spark, sf):
    """I4: per-series mode fill (smallest value on ties)."""
    return _r(imp.impute(daily_sales_dense(spark, sf), "sales", "mode", KEYS))


@register("impute_feature_means", DS + f"""SELECT store, item, date,
  {r6(f'COALESCE(CAST(l7 AS DOUBLE), AVG(CAST(l7 AS DOUBLE)) OVER {GRP})')} AS sales_lag_7,
  {r6(f'COALESCE(CAST(l28 AS DOUBLE), AVG(CAST(l28 AS DOUBLE)) OVER {GRP})')} AS sales_lag_28
FROM (SELECT store, item, date, lag(sales, 7) OVER (PARTITION BY {PART} ORDER BY date) AS l7,
             lag(sales, 28) OVER (PARTITION BY {PART} ORDER BY date) AS l28 FROM daily_sales)""")
def impute_feature_means(spark, sf):
    """I8: mean fill of several feature columns at once."""
    f = win.lag_features(daily_sales(spark, sf, shared=True), KEYS, "date", "sales", [7, 28])
    f = f.select("store", "item", "date", "sales_lag_7", "sales_lag_28")
    return _r(imp.mean_fill(f, ["sales_lag_7", "sales_lag_28"], KEYS))


@register("standard_scale", DS + f"""SELECT store, item, date, sales,
  {r6(f'(sales - AVG(CAST(sales AS DOUBLE)) OVER {GRP}) / COALESCE(NULLIF(STDDEV_POP(CAST(sales AS DOUBLE)) OVER {GRP}, 0), 1)')} AS sales_scaled
FROM daily_sales""")
def standard_scale(spark, sf):
    """Per-series standard scaling with the population std."""
    return _r(imp.standard_scale(daily_sales(spark, sf, shared=True), ["sales"], KEYS))


IQR_SQL = f""", q AS (SELECT {PART}, QUANTILE_CONT(CAST(sales AS DOUBLE), 0.25) AS q1,
  QUANTILE_CONT(CAST(sales AS DOUBLE), 0.75) AS q3 FROM daily_sales GROUP BY {PART}),
iqr AS (SELECT d.*, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound
  FROM daily_sales d JOIN q ON d.store = q.store AND d.item = q.item)"""


@register("outliers_iqr", DS + IQR_SQL + f"""
SELECT store, item, date, sales, {r6('lower_bound')} AS lower_bound, {r6('upper_bound')} AS upper_bound,
  COALESCE(sales < lower_bound OR sales > upper_bound, FALSE) AS is_outlier FROM iqr""")
def outliers_iqr(spark, sf):
    """IQR rule per series."""
    return _r(out.iqr_outliers(daily_sales(spark, sf, shared=True), "sales", KEYS))


@register("outliers_events_iqr", """SELECT event_id, value,
  COALESCE(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), FALSE) AS is_outlier
FROM events, (SELECT QUANTILE_CONT(value, 0.25) AS q1, QUANTILE_CONT(value, 0.75) AS q3 FROM events)""")
def outliers_events_iqr(spark, sf):
    """J1 on a skewed global measure (events.value), keys = []."""
    ev = table(spark, sf, "events").select("event_id", "value")
    return out.iqr_outliers(ev, "value", []).select("event_id", "value", "is_outlier")


ZS_SQL = f""", z AS (SELECT *, ABS(sales - AVG(CAST(sales AS DOUBLE)) OVER {GRP})
  / NULLIF(STDDEV_POP(CAST(sales AS DOUBLE)) OVER {GRP}, 0) AS zscore FROM daily_sales)"""


@register("outliers_zscore", DS + ZS_SQL + f"""
SELECT store, item, date, sales, {r6('zscore')} AS zscore, COALESCE(zscore > 3.0, FALSE) AS is_outlier FROM z""")
def outliers_zscore(spark, sf):
    """Z-score rule per series (threshold 3.0)."""
    return _r(out.zscore_outliers(daily_sales(spark, sf, shared=True), "sales", KEYS, 3.0))


MZ_SQL = f""", med AS (SELECT {PART}, QUANTILE_CONT(CAST(sales AS DOUBLE), 0.5) AS med FROM daily_sales GROUP BY {PART}),
dev AS (SELECT d.*, m.med FROM daily_sales d JOIN med m ON d.store = m.store AND d.item = m.item),
mad AS (SELECT {PART}, QUANTILE_CONT(ABS(sales - med), 0.5) AS mad FROM dev GROUP BY {PART}),
mz AS (SELECT d.*, a.mad, ABS(0.6745 * (d.sales - d.med)) AS dv FROM dev d JOIN mad a ON d.store = a.store AND d.item = a.item)"""


@register("outliers_modified_zscore", DS + MZ_SQL + f"""
SELECT store, item, date, sales, {r6('CASE WHEN mad <> 0 THEN dv / mad END')} AS modified_zscore,
  COALESCE(CASE WHEN mad = 0 THEN sales <> med ELSE dv / mad > 3.5 END, FALSE) AS is_outlier FROM mz""")
def outliers_modified_zscore(spark, sf):
    """Modified z-score per series (threshold 3.5)."""
    return _r(out.modified_zscore_outliers(daily_sales(spark, sf, shared=True), "sales", KEYS, 3.5))


METHODS = ["iqr", "zscore", "modified_zscore"]
FLAGS_SQL = DS + IQR_SQL + ZS_SQL + MZ_SQL + f""",
flags AS (SELECT i.store, i.item, i.date, i.sales,
  COALESCE(i.sales < i.lower_bound OR i.sales > i.upper_bound, FALSE) AS f_iqr,
  COALESCE(z.zscore > 3.0, FALSE) AS f_z,
  COALESCE(CASE WHEN m.mad = 0 THEN m.sales <> m.med ELSE m.dv / m.mad > 3.5 END, FALSE) AS f_mz
  FROM iqr i JOIN z ON i.store = z.store AND i.item = z.item AND i.date = z.date
  JOIN mz m ON i.store = m.store AND i.item = m.item AND i.date = m.date)
"""


@register("outlier_comparison", FLAGS_SQL + f"""SELECT {PART}, method, CAST(n AS BIGINT) AS outliers_found,
  {r2('n * 100.0 / total')} AS percentage FROM (
  SELECT {PART}, COUNT(*) AS total, COUNT(*) FILTER (WHERE f_iqr) AS c_iqr, COUNT(*) FILTER (WHERE f_z) AS c_z,
         COUNT(*) FILTER (WHERE f_mz) AS c_mz FROM flags GROUP BY {PART})
  UNPIVOT (n FOR method IN (c_iqr AS 'iqr', c_z AS 'zscore', c_mz AS 'modified_zscore'))""")
def outlier_comparison(spark, sf):
    """Count and % of rows flagged by each method, per series."""
    flagged = out.flag_all(daily_sales(spark, sf, shared=True), "sales", KEYS, METHODS)
    return out.method_comparison(flagged, METHODS, KEYS)


@register("outlier_rows", FLAGS_SQL + """SELECT store, item, date, CAST(sales AS DOUBLE) AS value, 'iqr' AS method FROM flags WHERE f_iqr
UNION ALL SELECT store, item, date, CAST(sales AS DOUBLE), 'zscore' FROM flags WHERE f_z
UNION ALL SELECT store, item, date, CAST(sales AS DOUBLE), 'modified_zscore' FROM flags WHERE f_mz""")
def outlier_rows(spark, sf):
    """(keys, date, value, method) for every flagged row."""
    flagged = out.flag_all(daily_sales(spark, sf, shared=True), "sales", KEYS, METHODS)
    return out.outlier_rows(flagged, "sales", METHODS, KEYS)



@register("outliers_isolation_forest")
def outliers_isolation_forest(spark, sf):
    """1-D isolation forest per series (100 trees of <= 256 values, seed
    42, contamination 0.1, mean-filled); rows only (seeded own sampling)."""
    from panelcast.operators.isoforest import isolation_forest_outliers

    return _r(isolation_forest_outliers(daily_sales(spark, sf, shared=True), "sales", KEYS))


@register("outlier_comparison_all")
def outlier_comparison_all(spark, sf):
    """J5 with all four methods including the isolation forest; rows only."""
    methods = METHODS + ["isolation_forest"]
    flagged = out.flag_all(daily_sales(spark, sf, shared=True), "sales", KEYS, methods)
    return out.method_comparison(flagged, methods, KEYS)
