"""Catalog: EWM and per-series diagnostics (E6, H1, H3, H4, Jarque-Bera)."""

from __future__ import annotations

from panelcast.operators import diagnostics as diag
from panelcast.operators.ewm import ewm_features
from panelcast.plans.catalog import KEYS, PART, float_cols, register, round_cols
from panelcast.plans.sqlgen import r6
from panelcast.sources.tables import (DAILY_SALES_DENSE_SQL, DAILY_SALES_SQL, daily_sales,
                                      daily_sales_dense, with_sql)
from panelcast.spec import DEFAULT_EWM_SPANS

DS = with_sql(DAILY_SALES_SQL)
DSD = with_sql(DAILY_SALES_SQL, DAILY_SALES_DENSE_SQL)


def _r(df):
    return round_cols(df, float_cols(df))


def _ewm_sql(spans):
    alphas = [2.0 / (s + 1.0) for s in spans]
    init = ", ".join(f"CAST(sales AS DOUBLE) AS y{i}" for i in range(len(spans)))
    step = ", ".join(f"{1 - a!r} * r.y{i} + {a!r} * n.sales AS y{i}" for i, a in enumerate(alphas))
    outs = ", ".join(f"{r6(f'y{i}')} AS sales_ewm_{s}" for i, s in enumerate(spans))
    return "WITH RECURSIVE " + DAILY_SALES_SQL + f""",
numbered AS (SELECT store, item, date, sales, row_number() OVER (PARTITION BY {PART} ORDER BY date) AS rn
             FROM daily_sales),
r AS (SELECT store, item, date, sales, rn, {init} FROM numbered WHERE rn = 1
      UNION ALL
      SELECT n.store, n.item, n.date, n.sales, n.rn, {step}
      FROM r JOIN numbered n ON n.store = r.store AND n.item = r.item AND n.rn = r.rn + 1)
SELECT store, item, date, sales, {outs} FROM r"""


@register("ewm", _ewm_sql(DEFAULT_EWM_SPANS))
def ewm(spark, sf):
    """EWM mean (adjust=False) for spans 7, 14, 28, 91 via the blocked
    affine scan."""
    return _r(ewm_features(daily_sales(spark, sf, shared=True), KEYS, "date", "sales", DEFAULT_EWM_SPANS))


def _ewm_gaps_sql(spans):
    alphas = [2.0 / (s + 1.0) for s in spans]
    init = ", ".join(f"CAST(sales AS DOUBLE) AS y{i}, 1.0::DOUBLE AS w{i}" for i in range(len(spans)))
    steps = []
    for i, a in enumerate(alphas):
        w = f"(r.w{i} * {1 - a!r})"
        steps.append(f"""CASE WHEN r.y{i} IS NULL THEN CAST(n.sales AS DOUBLE)
      WHEN n.sales IS NULL THEN r.y{i}
      ELSE ({w} * r.y{i} + {a!r} * n.sales) / ({w} + {a!r}) END AS y{i},
    CASE WHEN r.y{i} IS NULL OR n.sales IS NOT NULL THEN 1.0::DOUBLE ELSE {w} END AS w{i}""")
    outs = ", ".join(f"{r6(f'y{i}')} AS sales_ewm_{s}" for i, s in enumerate(spans))
    return "WITH RECURSIVE " + DAILY_SALES_SQL + ",\n" + DAILY_SALES_DENSE_SQL + f""",
numbered AS (SELECT store, item, date, sales, row_number() OVER (PARTITION BY {PART} ORDER BY date) AS rn
             FROM daily_sales_dense),
r AS (SELECT store, item, date, sales, rn, {init} FROM numbered WHERE rn = 1
      UNION ALL
      SELECT n.store, n.item, n.date, n.sales, n.rn, {", ".join(steps)}
      FROM r JOIN numbered n ON n.store = r.store AND n.item = r.item AND n.rn = r.rn + 1)
SELECT store, item, date, sales, {outs} FROM r"""


@register("ewm_gaps", _ewm_gaps_sql(DEFAULT_EWM_SPANS))
def ewm_gaps(spark, sf):
    """E6 on the densified panel (nulls on missing days): gap weighting of
    pandas' ignore_na=False (oracle: recursion over (value, weight) state)."""
    return _r(ewm_features(daily_sales_dense(spark, sf), KEYS, "date", "sales", DEFAULT_EWM_SPANS))


def _decomp_sql():
    return DSD + f""", interp AS (
  SELECT store, item, date, CASE
    WHEN sales IS NOT NULL THEN CAST(sales AS DOUBLE)
    WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * (rn - pp) / (np - pp)
    WHEN pv IS NOT NULL THEN pv END AS observed, rn FROM (
  SELECT *, CAST(last_value(sales IGNORE NULLS) OVER fw AS DOUBLE) AS pv,
         last_value(CASE WHEN sales IS NOT NULL THEN rn END IGNORE NULLS) OVER fw AS pp,
         CAST(first_value(sales IGNORE NULLS) OVER bw AS DOUBLE) AS nv,
         first_value(CASE WHEN sales IS NOT NULL THEN rn END IGNORE NULLS) OVER bw AS np
  FROM (SELECT *, row_number() OVER (PARTITION BY {PART} ORDER BY date) AS rn FROM daily_sales_dense)
  WINDOW fw AS (PARTITION BY {PART} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         bw AS (PARTITION BY {PART} ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))),
tr AS (SELECT *, (rn - 1) % 7 AS pos,
         CASE WHEN count(observed) OVER c = 7 THEN avg(observed) OVER c END AS trend,
         COUNT(*) OVER (PARTITION BY {PART}) AS n
       FROM interp WINDOW c AS (PARTITION BY {PART} ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
pm AS (SELECT {PART}, pos, AVG(observed - trend) AS m FROM tr WHERE n >= 14 GROUP BY {PART}, pos),
sea AS (SELECT {PART}, pos, m - AVG(m) OVER (PARTITION BY {PART}) AS seasonal FROM pm)
SELECT t.store, t.item, t.date, {r6('t.observed')} AS observed, {r6('t.trend')} AS trend,
  {r6('s.seasonal')} AS seasonal, {r6('t.observed - t.trend - s.seasonal')} AS resid
FROM tr t JOIN sea s ON t.store = s.store AND t.item = s.item AND t.pos = s.pos WHERE t.n >= 14"""


@register("seasonal_decompose", _decomp_sql())
def seasonal_decompose(spark, sf):
    """H4: additive weekly decomposition of every series."""
    return _r(diag.seasonal_decompose(daily_sales(spark, sf, shared=True), KEYS, "date", "sales", 7))


@register("jarque_bera", DS + f"""SELECT store, item, CAST(n AS BIGINT) AS n, {r6('jb')} AS jb_stat,
  {r6('EXP(-jb / 2)')} AS jb_p, EXP(-jb / 2) > 0.05 AS jb_normal FROM (
  SELECT store, item, COUNT(*) AS n,
    COUNT(*) / 6.0 * (POWER(AVG(POWER(x - m, 3)) / POWER(VAR_POP(x), 1.5), 2)
                      + POWER(AVG(POWER(x - m, 4)) / POWER(VAR_POP(x), 2) - 3, 2) / 4) AS jb
  FROM (SELECT store, item, CAST(sales AS DOUBLE) AS x, AVG(CAST(sales AS DOUBLE)) OVER (PARTITION BY {PART}) AS m
        FROM daily_sales) GROUP BY store, item)""")
def jarque_bera(spark, sf):
    """Jarque-Bera normality test per series (unlimited n)."""
    return _r(diag.jarque_bera(daily_sales(spark, sf), "sales", KEYS))


KPSS_L = 10


def _kpss_sql(L):
    terms = " + ".join(f"{1 - i / (L + 1)!r} * SUM(e * COALESCE(e{i}, 0))" for i in range(1, L + 1))
    lags = ", ".join(f"lag(e, {i}) OVER w AS e{i}" for i in range(1, L + 1))
    crit = [(0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]
    p = f"CASE WHEN stat <= {crit[0][0]} THEN {crit[0][1]} "
    for (c0, p0), (c1, p1) in zip(crit, crit[1:]):
        p += f"WHEN stat <= {c1} THEN {p0} + (stat - {c0}) * ({p1 - p0!r}) / ({c1 - c0!r}) "
    p += f"ELSE {crit[-1][1]} END"
    return DS + f""", c AS (SELECT store, item, date, CAST(sales AS DOUBLE) - AVG(CAST(sales AS DOUBLE))
  OVER (PARTITION BY {PART}) AS e FROM daily_sales),
l AS (SELECT *, {lags}, SUM(e) OVER (PARTITION BY {PART} ORDER BY date ROWS UNBOUNDED PRECEDING) AS s
      FROM c WINDOW w AS (PARTITION BY {PART} ORDER BY date)),
a AS (SELECT store, item, COUNT(*) AS n, SUM(s * s) / (COUNT(*) * COUNT(*)) AS eta,
        (SUM(e * e) + 2 * ({terms})) / COUNT(*) AS s2 FROM l GROUP BY store, item HAVING COUNT(*) >= 10),
k AS (SELECT store, item, n, eta / s2 AS stat FROM a)
SELECT store, item, CAST(n AS BIGINT) AS n, CAST({L} AS BIGINT) AS kpss_lags, {r6('stat')} AS kpss_stat,
  {r6(p)} AS kpss_p, ({p}) > 0.05 AS kpss_stationary FROM k"""


@register("kpss_fixed_lag", _kpss_sql(KPSS_L))
def kpss_fixed_lag(spark, sf):
    """H3 with a fixed Bartlett lag of 10 (SQL-checkable form)."""
    return _r(diag.kpss(daily_sales(spark, sf, shared=True), "sales", "date", KEYS, nlags=KPSS_L))


def _kpss_auto_sql(cmax=10):
    crit = [(0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]
    p = f"CASE WHEN stat <= {crit[0][0]} THEN {crit[0][1]} "
    for (c0, p0), (c1, p1) in zip(crit, crit[1:]):
        p += f"WHEN stat <= {c1} THEN {p0} + (stat - {c0}) * ({p1 - p0!r}) / ({c1 - c0!r}) "
    p += f"ELSE {crit[-1][1]} END"
    lags = ", ".join(f"COALESCE(lag(e, {i}) OVER w, 0) AS e{i}" for i in range(1, cmax + 1))
    gam = ", ".join(f"SUM(e * e{i}) AS g{i}" for i in range(1, cmax + 1))
    s0 = " + ".join(f"CASE WHEN {i} <= FLOOR(POWER(n, 2.0 / 9.0)) THEN g{i} / (n / 2.0) ELSE 0 END"
                    for i in range(1, cmax + 1))
    s1 = " + ".join(f"CASE WHEN {i} <= FLOOR(POWER(n, 2.0 / 9.0)) THEN {i} * g{i} / (n / 2.0) ELSE 0 END"
                    for i in range(1, cmax + 1))
    return DS + f""", c AS (SELECT store, item, date,
    CAST(sales AS DOUBLE) - AVG(CAST(sales AS DOUBLE)) OVER (PARTITION BY {PART}) AS e,
    row_number() OVER (PARTITION BY {PART} ORDER BY date) AS t,
    COUNT(*) OVER (PARTITION BY {PART}) AS n FROM daily_sales),
l AS (SELECT *, {lags}, SUM(e) OVER (PARTITION BY {PART} ORDER BY date ROWS UNBOUNDED PRECEDING) AS s
      FROM c WINDOW w AS (PARTITION BY {PART} ORDER BY date)),
a AS (SELECT store, item, MIN(n) AS n, SUM(e * e) AS see, SUM(s * s) AS eta, {gam} FROM l GROUP BY store, item
      HAVING MIN(n) >= 10),
lg AS (SELECT store, item, n, see, eta,
    CAST(LEAST(FLOOR(1.1447 * POWER(POWER(({s1}) / (see / n + {s0}), 2), 1.0 / 3.0) * POWER(n, 1.0 / 3.0)), n - 1)
         AS BIGINT) AS L FROM a),
b AS (SELECT x.store, x.item, SUM(x.e * y.e * (1 - (x.t - y.t) / (g.L + 1.0))) AS bart
      FROM c x JOIN lg g ON x.store = g.store AND x.item = g.item
      JOIN c y ON y.store = x.store AND y.item = x.item AND y.t < x.t AND y.t >= x.t - g.L
      GROUP BY x.store, x.item),
k AS (SELECT lg.store, lg.item, lg.n, lg.L, (lg.eta / (lg.n * lg.n)) / ((lg.see + 2 * COALESCE(b.bart, 0)) / lg.n) AS stat
      FROM lg LEFT JOIN b ON b.store = lg.store AND b.item = lg.item)
SELECT store, item, CAST(n AS BIGINT) AS n, L AS kpss_lags, {r6('stat')} AS kpss_stat,
  {r6(p)} AS kpss_p, ({p}) > 0.05 AS kpss_stationary FROM k"""


@register("kpss_auto", _kpss_auto_sql())
def kpss_auto(spark, sf):
    """H3 with the per-series automatic lag (Hobijn et al.); the oracle
    spells the Bartlett sum as a bounded self-join."""
    return _r(diag.kpss(daily_sales(spark, sf, shared=True), "sales", "date", KEYS))


def _shapiro_sql():
    from panelcast.operators.diagnostics import SW_C1, SW_C2, SW_C3, SW_C4, SW_C5, SW_C6, SW_G
    from panelcast.plans.sqlgen import _poly_sql, norm_ppf_sql, norm_sf_sql

    u = "(1.0 / SQRT(CAST(n AS DOUBLE)))"
    nd = "CAST(n AS DOUBLE)"
    return DS + f""", f AS (SELECT store, item, CAST(sales AS DOUBLE) AS x FROM daily_sales),
k AS (SELECT store, item, x, row_number() OVER (PARTITION BY {PART} ORDER BY x) AS i,
    COUNT(*) OVER (PARTITION BY {PART}) AS n FROM f),
mm AS (SELECT *, (i - 0.375) / (n + 0.25) AS pr FROM k),
m AS (SELECT *, {norm_ppf_sql('pr')} AS m FROM mm),
c AS (SELECT store, item, MIN(n) AS n, SUM(m * m) AS summ, MAX(CASE WHEN i = n THEN m END) AS mn,
        MAX(CASE WHEN i = n - 1 THEN m END) AS mn1 FROM m GROUP BY store, item),
c2 AS (SELECT *, mn / SQRT(summ) + {_poly_sql(SW_C1, u)} AS an, mn1 / SQRT(summ) + {_poly_sql(SW_C2, u)} AS an1 FROM c),
c3 AS (SELECT *, CASE WHEN n > 5 THEN (summ - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * an * an - 2 * an1 * an1)
                      ELSE (summ - 2 * mn * mn) / (1 - 2 * an * an) END AS phi FROM c2),
w AS (SELECT m.store, m.item, c3.n,
        SUM(m.x * CASE WHEN m.i = c3.n THEN c3.an WHEN m.i = 1 THEN -c3.an
                       WHEN c3.n > 5 AND m.i = c3.n - 1 THEN c3.an1 WHEN c3.n > 5 AND m.i = 2 THEN -c3.an1
                       ELSE m.m / SQRT(c3.phi) END) AS ax,
        VAR_POP(m.x) * COUNT(*) AS ss
      FROM m JOIN c3 ON m.store = c3.store AND m.item = c3.item GROUP BY m.store, m.item, c3.n),
ws AS (SELECT store, item, n, CASE WHEN n >= 4 AND ss > 0 THEN LEAST(ax * ax / ss, 1.0) END AS w FROM w),
zz AS (SELECT *, CASE WHEN w < 1 THEN LN(1 - w) END AS w1 FROM ws),
pv AS (SELECT *, CASE WHEN w IS NULL THEN NULL WHEN w >= 1 THEN 1.0
    WHEN n <= 11 THEN CASE WHEN w1 >= {_poly_sql(SW_G, nd)} THEN 1e-99
         ELSE {norm_sf_sql(f"(-LN({_poly_sql(SW_G, nd)} - w1) - {_poly_sql(SW_C3, nd)}) / EXP({_poly_sql(SW_C4, nd)})")} END
    ELSE {norm_sf_sql(f"(w1 - {_poly_sql(SW_C5, f'LN({nd})')}) / EXP({_poly_sql(SW_C6, f'LN({nd})')})")} END AS p FROM zz)
SELECT store, item, CAST(n AS BIGINT) AS n, {r6('w')} AS shapiro_stat, {r6('p')} AS shapiro_p,
  COALESCE(p > 0.05, FALSE) AS is_normal FROM pv"""


@register("shapiro_wilk", _shapiro_sql())
def shapiro_wilk(spark, sf):
    """H1: Shapiro-Wilk (Royston 1995) on the first 5,000 values of every
    series; the oracle spells the same published formulas in SQL."""
    return _r(diag.shapiro_wilk(daily_sales(spark, sf, shared=True), "sales", KEYS))



@register("adf_test")
def adf_test(spark, sf):
    """H2: ADF (constant, AIC lag) per series from distributed cross-product
    moments; rows only (checked against a NumPy brute force in the tests)."""
    from panelcast.operators.adf import adf

    return _r(adf(daily_sales(spark, sf, shared=True), "sales", "date", KEYS, critical_values=True))


@register("dickey_fuller_lag0", DS + f""", c AS (SELECT store, item, CAST(sales AS DOUBLE) AS x,
    lag(CAST(sales AS DOUBLE)) OVER (PARTITION BY {PART} ORDER BY date) AS xl,
    COUNT(*) OVER (PARTITION BY {PART}) AS n FROM daily_sales),
r AS (SELECT store, item, MIN(n) AS n, REGR_SLOPE(x - xl, xl) AS b, REGR_SXX(x - xl, xl) AS sxx,
        REGR_SYY(x - xl, xl) AS syy, REGR_SXY(x - xl, xl) AS sxy, REGR_COUNT(x - xl, xl) AS m
      FROM c WHERE xl IS NOT NULL GROUP BY store, item HAVING MIN(n) >= 10)
SELECT store, item, CAST(n AS BIGINT) AS n, {r6('b / SQRT((syy - b * sxy) / (m - 2) / sxx)')} AS adf_stat,
  CAST(0 AS INTEGER) AS adf_lags, CAST(m AS BIGINT) AS adf_nobs FROM r""")
def dickey_fuller_lag0(spark, sf):
    """H2 with the lag fixed at 0 (plain Dickey-Fuller t statistic): the
    distributed moment-matrix regression checked against a SQL simple
    regression; the p-value is in ``adf_test``."""
    from panelcast.operators.adf import adf

    res = adf(daily_sales(spark, sf, shared=True), "sales", "date", KEYS, lags=0)
    return _r(res.select(*KEYS, "n", "adf_stat", "adf_lags", "adf_nobs"))


@register("stationarity_tests")
def stationarity_tests(spark, sf):
    """H2 + H3 in one row per series (ADF and KPSS side by side)."""
    from panelcast.operators.adf import stationarity

    return _r(stationarity(daily_sales(spark, sf, shared=True), "sales", "date", KEYS))
