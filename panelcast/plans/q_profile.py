"""Catalog: profiling and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import profile as prof
from panelcast.plans.catalog import KEYS, PART, float_cols, register, round_cols
from panelcast.plans.sqlgen import r2, r6
from panelcast.sources.tables import (DAILY_SALES_DENSE_SQL, DAILY_SALES_SQL, daily_sales,
                                      daily_sales_dense, table, with_sql)

DS = with_sql(DAILY_SALES_SQL)
DSD = with_sql(DAILY_SALES_SQL, DAILY_SALES_DENSE_SQL)
LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _r(df):
    return round_cols(df, float_cols(df))


@register("overview", DSD + f"""SELECT {PART}, CAST(COUNT(*) AS BIGINT) AS total_records,
  CAST(4 AS INTEGER) AS n_columns,
  CAST(COUNT(*) FILTER (WHERE store IS NULL) + COUNT(*) FILTER (WHERE item IS NULL)
     + COUNT(*) FILTER (WHERE date IS NULL) + COUNT(*) FILTER (WHERE sales IS NULL) AS BIGINT) AS null_cells,
  CAST(date_diff('day', MIN(date), MAX(date)) AS INTEGER) AS date_range_days,
  {r2('(COUNT(*) FILTER (WHERE sales IS NULL)) * 100.0 / (COUNT(*) * 4)')} AS missing_pct
FROM daily_sales_dense GROUP BY {PART}""")
def overview(spark, sf):
    """D1 per series of the densified panel."""
    return prof.overview(daily_sales_dense(spark, sf), "date", KEYS)


def _profile_sql():
    parts = []
    for c, t in [("store", "int"), ("item", "string"), ("date", "date"), ("sales", "bigint")]:
        parts.append(f"""SELECT '{c}' AS "column", '{t}' AS dtype, CAST(COUNT({c}) AS BIGINT) AS non_null,
  CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS nulls, CAST(COUNT(DISTINCT {c}) AS BIGINT) AS "distinct",
  {r2(f'(COUNT(*) - COUNT({c})) * 100.0 / COUNT(*)')} AS null_pct FROM daily_sales_dense""")
    return DSD + "\nUNION ALL\n".join(parts)


@register("column_profile", _profile_sql())
def column_profile(spark, sf):
    """D2 over the densified panel."""
    return prof.column_profile(daily_sales_dense(spark, sf))


def _describe_sql(src, cols, keys):
    kp = (", ".join(keys) + ", ") if keys else ""
    gb = f" GROUP BY {', '.join(keys)}" if keys else ""
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT {kp}'{c}' AS feature, CAST(COUNT({x}) AS BIGINT) AS count,
  {r6(f'AVG({x})')} AS mean, {r6(f'STDDEV_SAMP({x})')} AS std, {r6(f'MIN({x})')} AS min,
  {r6(f'QUANTILE_CONT({x}, 0.25)')} AS p25, {r6(f'QUANTILE_CONT({x}, 0.5)')} AS p50,
  {r6(f'QUANTILE_CONT({x}, 0.75)')} AS p75, {r6(f'MAX({x})')} AS max FROM {src}{gb}""")
    return "\nUNION ALL\n".join(parts)


@register("describe_sales", DS + _describe_sql("daily_sales", ["sales"], KEYS))
def describe_sales(spark, sf):
    """D3 per series."""
    return _r(prof.describe(daily_sales(spark, sf), ["sales"], KEYS))


@register("describe_lineitem", _describe_sql("lineitem", LI_COLS, []))
def describe_lineitem(spark, sf):
    """Multi-feature describe, one row per feature."""
    return _r(prof.describe(table(spark, sf, "lineitem"), LI_COLS))


@register("moments", DS + f"""SELECT d.store, d.item,
  {r6('AVG(x)')} AS mean, {r6('QUANTILE_CONT(x, 0.5)')} AS median, {r6('STDDEV_SAMP(x)')} AS std,
  {r6('VAR_SAMP(x)')} AS variance,
  {r6('CASE WHEN VAR_POP(x) = 0 THEN NULL ELSE AVG(POWER(x - m, 3)) / POWER(VAR_POP(x), 1.5) END')} AS skewness,
  {r6('CASE WHEN VAR_POP(x) = 0 THEN NULL ELSE AVG(POWER(x - m, 4)) / POWER(VAR_POP(x), 2) - 3 END')} AS kurtosis
FROM (SELECT store, item, CAST(sales AS DOUBLE) AS x, AVG(CAST(sales AS DOUBLE)) OVER (PARTITION BY {PART}) AS m
      FROM daily_sales) d GROUP BY d.store, d.item""")
def moments(spark, sf):
    """D5 per series (biased skewness and excess kurtosis)."""
    return _r(prof.moments(daily_sales(spark, sf), "sales", KEYS))


@register("percentile_set", DS + f"""SELECT {PART}, """ + ", ".join(
    f"{r6(f'QUANTILE_CONT(CAST(sales AS DOUBLE), {p / 100})')} AS p{p}" for p in prof.PCTS)
    + f" FROM daily_sales GROUP BY {PART}")
def percentile_set(spark, sf):
    """D6 per series."""
    return _r(prof.percentile_set(daily_sales(spark, sf), "sales", KEYS))


@register("missing_summary", DSD + f"""SELECT {PART}, CAST(COUNT(*) - COUNT(sales) AS BIGINT) AS missing_count,
  {r2('(COUNT(*) - COUNT(sales)) * 100.0 / COUNT(*)')} AS missing_pct,
  CAST(COUNT(sales) AS BIGINT) AS complete_cases FROM daily_sales_dense GROUP BY {PART}""")
def missing_summary(spark, sf):
    """D7 per series of the densified panel."""
    return prof.missing_summary(daily_sales_dense(spark, sf), "sales", KEYS)


@register("missing_pattern", DSD + """SELECT store, item, date, CAST(sales IS NULL AS INTEGER) AS is_missing
FROM daily_sales_dense""")
def missing_pattern(spark, sf):
    """(keys, date, 0/1) missing indicator."""
    return prof.missing_pattern(daily_sales_dense(spark, sf), "sales", "date", KEYS)


def _corr_sql(cols):
    parts = []
    for i, a in enumerate(cols):
        for b in cols:
            expr = "1.0" if a == b else f"CORR(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
            src = "" if a == b else " FROM lineitem"
            parts.append(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {r6(expr)} AS correlation{src}")
    return "\nUNION ALL\n".join(parts)


@register("correlation_matrix", _corr_sql(LI_COLS))
def correlation_matrix(spark, sf):
    """Pearson matrix (long form) over the numeric order-line columns."""
    return _r(prof.correlation_long(table(spark, sf, "lineitem"), LI_COLS))


PAIR_COLS = LI_COLS + ["l_linenumber"]


def _pairs_sql():
    parts = []
    for i, a in enumerate(PAIR_COLS):
        for b in PAIR_COLS[i + 1:]:
            parts.append(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, "
                         f"CORR(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM lineitem")
    return f"""WITH p AS ({' UNION ALL '.join(parts)}),
s AS (SELECT *, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sign FROM p WHERE r <> 0)
SELECT feature_1, feature_2, {r6('r')} AS correlation, sign, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY sign ORDER BY abs(r) DESC, feature_1, feature_2) AS rank FROM s)
WHERE rank <= 5"""


@register("strongest_pairs", _pairs_sql())
def strongest_pairs(spark, sf):
    """Top-5 positive and top-5 negative pairs by |r| (upper triangle)."""
    corr = prof.correlation_long(table(spark, sf, "lineitem"), PAIR_COLS)
    out = prof.strongest_pairs(corr, PAIR_COLS, 5)
    return _r(out.withColumn("rank", F.col("rank").cast("int")))


@register("ols_trend", DS + f"""SELECT {PART}, {r6('REGR_SLOPE(y, x)')} AS slope,
  {r6('REGR_INTERCEPT(y, x)')} AS intercept, {r6('REGR_R2(y, x)')} AS r2, CAST(REGR_COUNT(y, x) AS BIGINT) AS n
FROM (SELECT store, item, CAST(sales AS DOUBLE) AS y,
        CAST(date_diff('day', MIN(date) OVER (PARTITION BY {PART}), date) AS DOUBLE) AS x FROM daily_sales)
GROUP BY {PART}""")
def ols_trend(spark, sf):
    """OLS line sales ~ days since the series start."""
    from panelcast.operators.relational import with_group_stat

    ds = with_group_stat(daily_sales(spark, sf, shared=True), KEYS, F.min("date").alias("__s"))
    ds = ds.withColumn("t", F.datediff("date", "__s"))
    return _r(prof.ols_trend(ds, "sales", "t", KEYS))


@register("histogram", DS + f"""SELECT {PART}, bin, {r6('lo + bin * w')} AS bin_start,
  {r6('lo + (bin + 1) * w')} AS bin_end, CAST(COUNT(*) AS BIGINT) AS count FROM (
  SELECT {PART}, lo, w, CAST(CASE WHEN w = 0 THEN 0 ELSE LEAST(FLOOR((x - lo) / w), 29) END AS INTEGER) AS bin
  FROM (SELECT store, item, CAST(sales AS DOUBLE) AS x,
               MIN(CAST(sales AS DOUBLE)) OVER (PARTITION BY {PART}) AS lo,
               (MAX(CAST(sales AS DOUBLE)) OVER (PARTITION BY {PART})
                - MIN(CAST(sales AS DOUBLE)) OVER (PARTITION BY {PART})) / 30 AS w FROM daily_sales))
GROUP BY {PART}, bin, lo, w""")
def histogram(spark, sf):
    """30 equal-width bins per series."""
    return _r(prof.histogram(daily_sales(spark, sf, shared=True), "sales", KEYS, 30))


@register("box_summary", DS + f""", q AS (
  SELECT {PART}, QUANTILE_CONT(CAST(sales AS DOUBLE), 0.25) AS q1, QUANTILE_CONT(CAST(sales AS DOUBLE), 0.5) AS median,
         QUANTILE_CONT(CAST(sales AS DOUBLE), 0.75) AS q3 FROM daily_sales GROUP BY {PART}),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT f.store, f.item, {r6('q1')} AS q1, {r6('median')} AS median, {r6('q3')} AS q3, {r6('iqr')} AS iqr,
  {r6('lf')} AS lower_fence, {r6('uf')} AS upper_fence,
  {r6('MIN(CASE WHEN d.sales BETWEEN lf AND uf THEN d.sales END)')} AS lower_whisker,
  {r6('MAX(CASE WHEN d.sales BETWEEN lf AND uf THEN d.sales END)')} AS upper_whisker,
  CAST(COUNT(*) FILTER (WHERE NOT (d.sales BETWEEN lf AND uf)) AS BIGINT) AS n_outside
FROM f JOIN daily_sales d ON d.store = f.store AND d.item = f.item
GROUP BY f.store, f.item, q1, median, q3, iqr, lf, uf""")
def box_summary(spark, sf):
    """Quartiles, fences, whiskers, points outside, per series."""
    return _r(prof.box_summary(daily_sales(spark, sf, shared=True), "sales", KEYS))


@register("kde_density", DS + f""", vals AS (
  SELECT {PART}, CAST(sales AS DOUBLE) AS x, COUNT(*) AS c FROM daily_sales GROUP BY {PART}, sales),
st AS (SELECT {PART}, MIN(CAST(sales AS DOUBLE)) AS lo, MAX(CAST(sales AS DOUBLE)) AS hi,
        STDDEV_SAMP(CAST(sales AS DOUBLE)) * POWER(CAST(COUNT(*) AS DOUBLE), -0.2) AS h,
        CAST(COUNT(*) AS DOUBLE) AS n FROM daily_sales GROUP BY {PART}),
g AS (SELECT st.*, CAST(range AS INTEGER) AS point, lo + (hi - lo) * range / 99 AS gx FROM st, range(100))
SELECT g.store, g.item, g.point, {r6('g.gx')} AS x,
  {r6('SUM(v.c * EXP(-0.5 * ((g.gx - v.x) / g.h) * ((g.gx - v.x) / g.h)) / (g.n * g.h * SQRT(2 * PI())))')} AS density
FROM g JOIN vals v ON v.store = g.store AND v.item = g.item
GROUP BY g.store, g.item, g.point, g.gx""")
def kde_density(spark, sf):
    """Gaussian KDE on 100 grid points per series."""
    out = prof.kde_grid(daily_sales(spark, sf, shared=True), "sales", KEYS, 100)
    return _r(out.withColumn("point", F.col("point").cast("int")))


def _qq_sql():
    from panelcast.plans.sqlgen import norm_ppf_sql

    return DS + f""", v AS (SELECT store, item, CAST(sales AS DOUBLE) AS value,
    row_number() OVER (PARTITION BY {PART} ORDER BY sales) AS rank,
    COUNT(*) OVER (PARTITION BY {PART}) AS n FROM daily_sales),
pp AS (SELECT *, CASE WHEN rank = 1 THEN 1 - POWER(0.5, 1.0 / n) WHEN rank = n THEN POWER(0.5, 1.0 / n)
                      ELSE (rank - 0.3175) / (n + 0.365) END AS pos FROM v)
SELECT store, item, CAST(rank AS BIGINT) AS rank, {r6('value')} AS value, {r6(norm_ppf_sql('pos'))} AS theoretical
FROM pp"""


@register("qq_points", _qq_sql())
def qq_points(spark, sf):
    """Normal Q-Q points per series (Filliben positions, AS 241 inverse
    normal; the oracle spells the same published formula in SQL)."""
    return _r(prof.qq_points(daily_sales(spark, sf, shared=True), "sales", KEYS))


@register("stage_counts", DS + """SELECT 'lineitem' AS stage, CAST(COUNT(*) AS BIGINT) AS rows FROM lineitem
UNION ALL SELECT 'daily_panel', CAST(COUNT(*) AS BIGINT) FROM daily_sales
UNION ALL SELECT 'features_complete', CAST(COUNT(*) AS BIGINT) FROM (
  SELECT lag(sales, 28) OVER (PARTITION BY store, item ORDER BY date) AS l28 FROM daily_sales) WHERE l28 IS NOT NULL""")
def stage_counts(spark, sf):
    """Row counts by stage (fact rows, daily panel, complete feature rows)."""
    from panelcast.operators import windows as win

    ds = daily_sales(spark, sf, shared=True)
    feats = win.lag_features(ds, KEYS, "date", "sales", [28]).na.drop(subset=["sales_lag_28"])
    return prof.stage_counts({"lineitem": table(spark, sf, "lineitem"), "daily_panel": ds, "features_complete": feats})
