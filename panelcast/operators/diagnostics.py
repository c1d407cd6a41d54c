"""Per-series statistical and time-series diagnostics (H1, H3, H4, Jarque-Bera).

Each diagnostic is one Spark job over all series (output: one row per key)
built from windows and keyed aggregates; the closed forms come from the
published papers (Royston 1995 for Shapiro-Wilk, Kwiatkowski et al. 1992 with
the Hobijn et al. 1998 lag rule for KPSS).  ADF lives in ``adf``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.normal import norm_ppf, norm_sf
from panelcast.functions.numeric import numeric
from panelcast.operators import windows as win
from panelcast.operators.relational import densify_daily, join_on_keys, with_group_stat

UNB = Window.unboundedPreceding


def _w(keys, order):
    return win.wspec(list(keys), order)


# ---------------------------------------------------------------- H4

def seasonal_decompose(df: DataFrame, keys, date_col: str, value: str, period: int = 7,
                       min_rows: int = 14) -> DataFrame:
    """Additive decomposition with an odd period (H4).

    Densify to daily, interpolate, drop series shorter than ``min_rows``;
    trend = centred moving average (null in the first/last period//2 rows);
    seasonal = mean of (x - trend) per position mod period, centred to sum
    zero; resid = x - trend - seasonal.  Output columns: observed, trend,
    seasonal, resid.
    """
    if period % 2 == 0:
        raise ValueError("only odd periods are supported")
    keys = list(keys)
    dense = densify_daily(df.select(*keys, date_col, value), keys, date_col)
    dense = win.interpolate_linear(dense, keys, date_col, value, out="observed").drop(value)
    dense = with_group_stat(dense, keys, F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_rows)
    w = _w(keys, date_col)
    h = period // 2
    fw = w.rowsBetween(-h, h)
    x = F.col("observed")
    step = dense.select(*keys, date_col, "observed",
                        ((F.row_number().over(w) - 1) % period).alias("__pos"),
                        F.when(F.count(x).over(fw) == period, F.avg(x).over(fw)).alias("trend"))
    step = step.withColumn("__det", F.col("observed") - F.col("trend"))
    means = step.groupBy(*keys, "__pos").agg(F.avg("__det").alias("__pm"))
    mw = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    means = means.withColumn("seasonal", F.col("__pm") - F.avg("__pm").over(mw)).drop("__pm")
    out = join_on_keys(step, means, [*keys, "__pos"], "left")
    return out.select(*keys, date_col, "observed", "trend", "seasonal",
                      (F.col("observed") - F.col("trend") - F.col("seasonal")).alias("resid"))


# ---------------------------------------------------------------- Jarque-Bera

def jarque_bera(df: DataFrame, value: str, keys=()) -> DataFrame:
    """JB = n/6 (S^2 + K^2/4) from the biased moments, p = exp(-JB/2)."""
    keys = list(keys)
    x = numeric(value)
    aggs = [F.count(x).alias("n"), F.skewness(x).alias("__s"), F.kurtosis(x).alias("__k")]
    out = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    jb = F.col("n") / 6.0 * (F.col("__s") * F.col("__s") + F.col("__k") * F.col("__k") / 4.0)
    return out.select(*keys, F.col("n").cast("bigint").alias("n"), jb.alias("jb_stat"),
                      F.exp(-jb / 2.0).alias("jb_p"), (F.exp(-jb / 2.0) > 0.05).alias("jb_normal"))


# ---------------------------------------------------------------- H1 Shapiro-Wilk

# Royston (1995) polynomial coefficients, lowest order first.
SW_C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
SW_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SW_G = [-2.273, 0.459]
SW_C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
SW_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
SW_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
SW_C6 = [-0.4803, -0.082676, 0.0030302]


def _poly(coefs, x):
    acc = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        acc = acc * x + F.lit(c)
    return acc


def shapiro_wilk(df: DataFrame, value: str, keys=()) -> DataFrame:
    """Shapiro-Wilk W and p per series (H1) over all of its values (null and
    NaN left out).  Fewer than 3 values give null.  Royston's fit of p was
    made for up to 5,000 values; beyond that W is exact and p extrapolated."""
    keys = list(keys)
    x = numeric(value)
    nn = df.filter(x.isNotNull()).select(*keys, x.alias("__x"))
    if keys:
        nn = nn.withColumn("__i", F.row_number().over(_w(keys, "__x")))
    else:
        from panelcast.plans.validation import global_row_index

        nn = global_row_index(nn, ["__x"], out="__r").withColumn("__i", F.col("__r") + 1).drop("__r")
    nn = with_group_stat(nn, keys, F.count(F.lit(1)).alias("__n"))
    n = F.col("__n").cast("double")
    i = F.col("__i").cast("double")
    nn = nn.withColumn("__m", norm_ppf((i - 0.375) / (n + 0.25)))
    # per-series constants on the small per-key table, joined back once
    aggs = [F.first("__n").alias("__n"), F.sum(F.col("__m") * F.col("__m")).alias("__summ"),
            F.max(F.when(F.col("__i") == F.col("__n"), F.col("__m"))).alias("__mn"),
            F.max(F.when(F.col("__i") == F.col("__n") - 1, F.col("__m"))).alias("__mn1")]
    const = nn.groupBy(*keys).agg(*aggs) if keys else nn.agg(*aggs)
    u = 1.0 / F.sqrt(n)
    # three values: the exact weights are -1, 0 and 1 over the root of 2
    const = const.withColumn("__an", F.when(n == 3, F.lit(math.sqrt(0.5))).otherwise(F.try_divide(F.col("__mn"), F.sqrt("__summ")) + _poly(SW_C1, u))) \
        .withColumn("__an1", F.try_divide(F.col("__mn1"), F.sqrt("__summ")) + _poly(SW_C2, u))
    an, an1, mn, mn1 = F.col("__an"), F.col("__an1"), F.col("__mn"), F.col("__mn1")
    phi = F.when(n > 5, F.try_divide(F.col("__summ") - 2 * mn * mn - 2 * mn1 * mn1, 1 - 2 * an * an - 2 * an1 * an1)) \
        .otherwise(F.try_divide(F.col("__summ") - 2 * mn * mn, 1 - 2 * an * an))
    const = const.withColumn("__phi", phi).select(*keys, "__an", "__an1", "__phi")
    nn = join_on_keys(nn, const, keys, "inner") if keys else nn.crossJoin(F.broadcast(const))
    ii = F.col("__i")
    a = (F.when(ii == F.col("__n"), an).when(ii == 1, -an)
         .when((n > 5) & (ii == F.col("__n") - 1), an1).when((n > 5) & (ii == 2), -an1)
         .otherwise(F.try_divide(F.col("__m"), F.sqrt("__phi"))))
    agg = [F.first("__n").alias("n"), F.sum(a * F.col("__x")).alias("__ax"),
           (F.var_pop("__x") * F.count("__x")).alias("__ss")]
    res = nn.groupBy(*keys).agg(*agg) if keys else nn.agg(*agg)
    # zero range (constant values) -> null, like the reference's failure branch
    W = F.when(F.col("__ss") > 0, F.least(F.col("__ax") * F.col("__ax") / F.col("__ss"), F.lit(1.0)))
    res = res.withColumn("w", F.when(F.col("n") == 3, F.greatest(W, F.lit(0.75))).when(F.col("n") > 3, W))
    nd = F.col("n").cast("double")
    w1 = F.log(1 - F.col("w"))
    small_gamma = _poly(SW_G, nd)
    y_small = -F.log(small_gamma - w1)
    z_small = (y_small - _poly(SW_C3, nd)) / F.exp(_poly(SW_C4, nd))
    ln = F.log(nd)
    z_large = (w1 - _poly(SW_C5, ln)) / F.exp(_poly(SW_C6, ln))
    p = F.when(F.col("n") == 3, 6 / math.pi * (F.asin(F.sqrt(F.col("w"))) - math.asin(math.sqrt(0.75)))).when(F.col("n") <= 11, F.when(w1 >= small_gamma, F.lit(1e-99)).otherwise(norm_sf(z_small))) \
        .otherwise(norm_sf(z_large))
    p = F.when(F.col("w") >= 1.0, F.lit(1.0)).otherwise(p)
    return res.select(*keys, F.col("n").cast("bigint").alias("n"), F.col("w").alias("shapiro_stat"),
                      F.when(F.col("w").isNotNull(), p).alias("shapiro_p"),
                      F.coalesce(F.when(F.col("w").isNotNull(), p) > 0.05, F.lit(False)).alias("is_normal"))


# ---------------------------------------------------------------- H3 KPSS

# KPSS level-stationarity critical values and their p-values.
KPSS_CRIT = [0.347, 0.463, 0.574, 0.739]
KPSS_P = [0.10, 0.05, 0.025, 0.01]


def _kpss_p(stat):
    expr = F.when(stat <= KPSS_CRIT[0], F.lit(KPSS_P[0]))
    for (c0, p0), (c1, p1) in zip(zip(KPSS_CRIT, KPSS_P), zip(KPSS_CRIT[1:], KPSS_P[1:])):
        expr = expr.when(stat <= c1, F.lit(p0) + (stat - c0) * (p1 - p0) / (c1 - c0))
    return expr.otherwise(F.lit(KPSS_P[-1]))


def kpss(df: DataFrame, value: str, order_col: str, keys=(), nlags: int | None = None,
         min_rows: int = 10, critical_values: bool = False) -> DataFrame:
    """KPSS level test per series (H3) on the values in order (null and NaN
    left out); ``critical_values`` adds ``kpss_crit_10, _5, _2_5, _1``.

    ``nlags=None`` picks the lag per series with the Hobijn et al. rule; the
    Bartlett-weighted autocovariance sum for any per-series lag L is computed
    from running sums P_t = sum e_s and Q_t = sum s*e_s and one equi-join to
    row t-L-1, so the cost is linear in the series length.
    """
    import math

    keys = list(keys)
    x = numeric(value)
    d = df.filter(x.isNotNull()).select(*keys, order_col, x.alias("__x"))
    d = d.withColumn("__t", F.row_number().over(_w(keys, order_col)))
    d = with_group_stat(d, keys, F.count(F.lit(1)).alias("__n"), F.avg("__x").alias("__mu"))
    d = d.filter(F.col("__n") >= min_rows).withColumn("__e", F.col("__x") - F.col("__mu"))
    w = _w(keys, "__t")
    run = w.rowsBetween(UNB, 0)
    d = d.select("*", F.sum("__e").over(run).alias("__P"), F.sum(F.col("__t") * F.col("__e")).over(run).alias("__Q"))
    if nlags is None:
        from panelcast.operators.ewm import max_series_length

        max_len = max_series_length(d, keys)
        cmax = max(1, int(math.pow(max(max_len, 1), 2.0 / 9.0)))
        # autocovariances for lags 1..cmax (per series only i <= floor(n^(2/9)) count)
        lagged = d.select(*keys, "__n", "__e",
                          *[(F.col("__e") * F.coalesce(F.lag("__e", i).over(w), F.lit(0.0))).alias(f"__p{i}")
                            for i in range(1, cmax + 1)])
        aggs = [F.first("__n").alias("__n"), F.sum(F.col("__e") * F.col("__e")).alias("__see")] + [
            F.sum(f"__p{i}").alias(f"__c{i}") for i in range(1, cmax + 1)]
        cov = lagged.groupBy(*keys).agg(*aggs) if keys else lagged.agg(*aggs)
        nn = F.col("__n").cast("double")
        s0e = F.col("__see") / nn
        s1e = F.lit(0.0)
        for i in range(1, cmax + 1):
            q = F.when(F.lit(i) <= F.floor(F.pow(nn, 2.0 / 9.0)), F.col(f"__c{i}") / (nn / 2.0)).otherwise(0.0)
            s0e = s0e + q
            s1e = s1e + i * q
        ratio = F.try_divide(s1e, s0e)
        gamma_hat = 1.1447 * F.pow(ratio * ratio, 1.0 / 3.0)
        lag_expr = F.least(F.floor(gamma_hat * F.pow(nn, 1.0 / 3.0)), nn - 1).cast("long")
        lags = cov.select(*keys, lag_expr.alias("__L"))
        d = join_on_keys(d, lags, keys, "inner") if keys else d.crossJoin(F.broadcast(lags))
    else:
        d = d.withColumn("__L", F.lit(int(nlags)).cast("long"))
    # row t-L-1 of the same series: P and Q there (0 before the start)
    back = d.select(*keys, (F.col("__t") + F.col("__L") + 1).alias("__t"),
                    F.col("__P").alias("__Pb"), F.col("__Q").alias("__Qb"))
    j = join_on_keys(d, back, [*keys, "__t"], "left")
    prevP = F.lag("__P", 1, 0.0).over(w)
    prevQ = F.lag("__Q", 1, 0.0).over(w)
    j = j.select("*", prevP.alias("__P1"), prevQ.alias("__Q1"))
    Pb, Qb = F.coalesce(F.col("__Pb"), F.lit(0.0)), F.coalesce(F.col("__Qb"), F.lit(0.0))
    L = F.col("__L").cast("double")
    sum_e = F.col("__P1") - Pb                       # sum_{i=1..L} e_{t-i}
    sum_ie = F.col("__t") * sum_e - (F.col("__Q1") - Qb)  # sum_{i=1..L} i e_{t-i}
    inner = sum_e - sum_ie / (L + 1)
    aggs = [F.first("__n").alias("n"), F.first("__L").alias("lags"),
            F.sum(F.col("__e") * F.col("__e")).alias("__see"), F.sum(F.col("__e") * inner).alias("__bart"),
            F.sum(F.col("__P") * F.col("__P")).alias("__eta")]
    r = j.groupBy(*keys).agg(*aggs) if keys else j.agg(*aggs)
    nd = F.col("n").cast("double")
    s2 = (F.col("__see") + 2 * F.col("__bart")) / nd
    stat = F.try_divide(F.col("__eta") / (nd * nd), s2)
    crit = [F.lit(c).alias(f"kpss_crit_{name}") for c, name in zip(KPSS_CRIT, ("10", "5", "2_5", "1"))] if critical_values else []
    return r.select(*keys, F.col("n").cast("bigint").alias("n"), F.col("lags").cast("bigint").alias("kpss_lags"),
                    stat.alias("kpss_stat"), _kpss_p(stat).alias("kpss_p"), (_kpss_p(stat) > 0.05).alias("kpss_stationary"), *crit)
