import math
import statistics

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelcast.functions.normal import norm_cdf, norm_ppf
from panelcast.operators import diagnostics as diag
from panelcast.operators.adf import adf, adf_maxlag, mackinnon_p


def test_norm_functions(spark):
    ps = [1e-10, 1e-4, 0.01, 0.02425, 0.3, 0.5, 0.77, 0.975, 0.9999]
    df = spark.createDataFrame([(p,) for p in ps], "p DOUBLE")
    got = df.select("p", norm_ppf(F.col("p")).alias("z"), norm_cdf(F.col("p") * 4 - 2).alias("c")).collect()
    nd = statistics.NormalDist()
    for r in got:
        assert abs(r["z"] - nd.inv_cdf(r["p"])) < 1e-9 * max(1, abs(r["z"]))
        assert abs(r["c"] - nd.cdf(r["p"] * 4 - 2)) < 2e-7


def _panel(spark, gens):
    rows, series = [], {}
    for k, x in enumerate(gens):
        series[k] = x
        rows += [(k, i, float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k INT, t INT, v DOUBLE"), series


def test_decomposition_identity(spark):
    rng = np.random.default_rng(0)
    import datetime as dt
    base = dt.date(2020, 1, 1)
    rows = []
    for k in range(2):
        for i in range(60):
            if i % 9 == 4:
                continue   # gaps: densified and interpolated
            rows.append((k, base + dt.timedelta(days=i), float(10 + (i % 7) * 3 + rng.normal())))
    rows.append((5, base, 1.0))   # too short: dropped
    df = spark.createDataFrame(rows, "k INT, date DATE, v DOUBLE")
    d = diag.seasonal_decompose(df, ["k"], "date", "v").orderBy("k", "date").toPandas()
    assert set(d.k) == {0, 1} and len(d) == 120
    full = d.dropna()
    assert np.allclose(full.trend + full.seasonal + full.resid, full.observed)
    s = d.groupby(["k"]).apply(lambda g: g.seasonal.iloc[:7].sum(), include_groups=False)
    assert np.allclose(s, 0.0)
    assert d.groupby("k").trend.apply(lambda x: x.isna().sum()).tolist() == [6, 6]


def _kpss_ref(x):
    n = len(x)
    e = x - x.mean()
    cov = int(n ** (2 / 9))
    s0, s1 = e @ e / n, 0.0
    for i in range(1, cov + 1):
        p = (e[i:] @ e[:n - i]) / (n / 2)
        s0 += p
        s1 += i * p
    L = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    s = e @ e
    for i in range(1, L + 1):
        s += 2 * (e[i:] @ e[:n - i]) * (1 - i / (L + 1))
    return L, (np.cumsum(e) ** 2).sum() / n ** 2 / (s / n)


def test_kpss_matches_reference_formulas(spark):
    rng = np.random.default_rng(1)
    df, series = _panel(spark, [rng.normal(0, 1, 200), np.cumsum(rng.normal(0, 1, 900)), rng.normal(0, 1, 9)])
    got = {r["k"]: r for r in diag.kpss(df, "v", "t", ["k"]).collect()}
    assert set(got) == {0, 1}       # the 9-row series is below the minimum of 10
    for k in (0, 1):
        L, stat = _kpss_ref(series[k])
        assert got[k]["kpss_lags"] == L
        assert abs(got[k]["kpss_stat"] - stat) < 1e-9 * max(1, stat)
    assert got[1]["kpss_p"] == 0.01 and not got[1]["kpss_stationary"]


def _adf_ref(x):
    n = len(x)
    P = adf_maxlag(n)
    dx = np.diff(x)

    def design(p, start):
        X = np.array([[1.0, x[t - 2]] + [dx[t - 2 - i] for i in range(1, p + 1)] for t in range(start, n + 1)])
        Y = np.array([dx[t - 2] for t in range(start, n + 1)])
        return X, Y

    best = None
    for p in range(P + 1):
        X, Y = design(p, P + 2)
        b, *_ = np.linalg.lstsq(X, Y, rcond=None)
        r = Y - X @ b
        m = len(Y)
        aic = -2 * (-m / 2 * (math.log(2 * math.pi) + math.log(r @ r / m) + 1)) + 2 * (p + 2)
        if best is None or aic < best[0]:
            best = (aic, p)
    p = best[1]
    X, Y = design(p, p + 2)
    b, *_ = np.linalg.lstsq(X, Y, rcond=None)
    r = Y - X @ b
    cov = np.linalg.inv(X.T @ X) * (r @ r) / (len(Y) - X.shape[1])
    return p, b[1] / math.sqrt(cov[1, 1])


def test_adf_matches_bruteforce(spark):
    rng = np.random.default_rng(5)
    n = 500
    e = rng.normal(0, 1, n)
    d = np.zeros(n)
    for i in range(3, n):
        d[i] = 0.6 * d[i - 1] - 0.3 * d[i - 2] + 0.25 * d[i - 3] + e[i]
    gens = [np.cumsum(d) + 50, rng.normal(0, 1, 300), np.cumsum(rng.normal(0, 1, 80))]
    df, series = _panel(spark, gens)
    got = {r["k"]: r for r in adf(df, "v", "t", ["k"]).collect()}
    for k, x in series.items():
        p, stat = _adf_ref(x)
        assert got[k]["adf_lags"] == p
        assert abs(got[k]["adf_stat"] - stat) < 1e-7 * max(1, abs(stat))
        assert abs(got[k]["adf_p"] - mackinnon_p(stat)) < 1e-12
    assert got[0]["adf_lags"] > 0
    assert got[1]["adf_stationary"] and not got[0]["adf_stationary"]


def test_shapiro_and_jb(spark):
    rng = np.random.default_rng(2)
    df, _ = _panel(spark, [rng.normal(0, 1, 400), rng.exponential(1, 400), rng.normal(0, 1, 3), np.ones(20)])
    sw = {r["k"]: r for r in diag.shapiro_wilk(df, "v", ["k"]).collect()}
    assert 0.98 < sw[0]["shapiro_stat"] <= 1.0 and sw[0]["is_normal"]
    assert sw[1]["shapiro_stat"] < 0.9 and sw[1]["shapiro_p"] < 1e-6 and not sw[1]["is_normal"]
    assert 0.75 <= sw[2]["shapiro_stat"] <= 1.0 and sw[3]["shapiro_stat"] is None
    jb = {r["k"]: r for r in diag.jarque_bera(df, "v", ["k"]).collect()}
    x = pd.Series(rng.normal(0, 1, 10))
    assert jb[1]["jb_p"] < 0.01 and x.size == 10
