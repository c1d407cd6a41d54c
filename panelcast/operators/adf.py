"""Augmented Dickey-Fuller test with a constant, lag chosen by AIC (H2).

Regression for lag p: dx_t = c + g x_{t-1} + sum_{i<=p} b_i dx_{t-i} + e_t.
The lag is chosen by AIC over p = 0..P (P = min(ceil(12 (n/100)^(1/4)),
n//2 - 2)) on the common sample t >= P + 2, then the chosen model is refit on
its longest sample t >= p + 2 and the t statistic of g is reported with
MacKinnon's (1994) approximate p-value.

Distribution of the work: Spark windows build the lagged regressors per row;
``mapInPandas`` turns each Arrow batch into partial cross-product matrices
per series (NumPy inside the task); Spark sums the partials per series with a
map-side-combined aggregate; only the per-series normal equations (size
(P+3)^2, independent of n) and the at most P head rows that the refit adds
are solved in Python.  No series is collected whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.numeric import numeric
from panelcast.operators.relational import join_on_keys, with_group_stat
from panelcast.operators.windows import wspec
from panelcast.session import ship_package

# MacKinnon (2010) critical values of the same regression, as
# polynomials in 1 / observations, lowest order first.
TAU_CRIT = {"1": [-3.43035, -6.5393, -16.786, -79.433],
            "5": [-2.86154, -2.8903, -4.234, -40.040],
            "10": [-2.56677, -1.5384, -2.809, 0.0]}
# MacKinnon (1994) approximate p-value coefficients for the
# constant-only Dickey-Fuller regression with one variable.
TAU_MAX = 2.74
TAU_MIN = -18.83
TAU_STAR = -1.61
TAU_SMALLP = [2.1659, 1.4412, 0.038269]
TAU_LARGEP = [1.7339, 0.93202, -0.12745, -0.010368]


def mackinnon_p(stat: float) -> float:
    if stat > TAU_MAX:
        return 1.0
    if stat < TAU_MIN:
        return 0.0
    coefs = TAU_SMALLP if stat <= TAU_STAR else TAU_LARGEP
    z = sum(c * stat ** i for i, c in enumerate(coefs))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def adf_maxlag(n: int) -> int:
    return min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)


def _ols(xtx, xty, yty, nobs):
    beta = np.linalg.solve(xtx, xty)
    ssr = float(yty - beta @ xty)
    if ssr <= 1e-13 * yty:      # nothing is left but rounding: no test on an exact fit
        raise np.linalg.LinAlgError("exact fit")
    return beta, ssr


def _solve_series(n: int, P: int, G: np.ndarray, head: list, fixed: bool = False) -> dict:
    """G: cross products of [1, x_{t-1}, dx_{t-1..t-P}, dx_t] over t >= P+2;
    head: rows (t, vector) for 2 <= t <= P+1.  ``fixed``: use lag P as given
    (no AIC search)."""
    y_idx = G.shape[0] - 1
    nobs = n - 1 - P
    best = (0.0, P) if fixed else None
    for p in ([] if fixed else range(P + 1)):
        cols = list(range(0, 2 + p))
        xtx = G[np.ix_(cols, cols)]
        xty = G[cols, y_idx]
        try:
            _, ssr = _ols(xtx, xty, G[y_idx, y_idx], nobs)
        except np.linalg.LinAlgError:
            continue
        llf = -nobs / 2.0 * (math.log(2 * math.pi) + math.log(ssr / nobs) + 1.0)
        aic = -2.0 * llf + 2.0 * (p + 2)
        if best is None or aic < best[0]:
            best = (aic, p)
    if best is None:
        return {}
    p = best[1]
    Gp = G.copy()
    for t, vec in head:
        if t >= p + 2:
            v = np.asarray(vec, dtype=float)
            v = np.where(np.isnan(v), 0.0, v)
            Gp += np.outer(v, v)
    cols = list(range(0, 2 + p))
    nobs2 = n - 1 - p
    xtx = Gp[np.ix_(cols, cols)]
    xty = Gp[cols, y_idx]
    try:
        beta, ssr = _ols(xtx, xty, Gp[y_idx, y_idx], nobs2)
    except np.linalg.LinAlgError:
        return {}
    sigma2 = ssr / (nobs2 - len(cols))
    cov = np.linalg.inv(xtx) * sigma2
    stat = float(beta[1] / math.sqrt(cov[1, 1]))
    return {"adf_stat": stat, "adf_p": mackinnon_p(stat), "adf_lags": p, "adf_nobs": nobs2}


def adf(df: DataFrame, value: str, order_col: str, keys=(), min_rows: int = 10,
        lags: int | None = None, critical_values: bool = False) -> DataFrame:
    """ADF per series on the values in order (null and NaN left out), one row
    per key; ``critical_values`` adds ``adf_crit_1, _5, _10``.
    ``lags=None`` chooses the lag by AIC; an integer fixes it (``lags=0`` is
    the plain Dickey-Fuller regression)."""
    from panelcast.operators.ewm import max_series_length

    ship_package(df.sparkSession)
    keys = list(keys)
    x = numeric(value)
    d = df.filter(x.isNotNull()).select(*keys, order_col, x.alias("__x"))
    d = with_group_stat(d, keys, F.count(F.lit(1)).alias("__n"), F.avg("__x").alias("__mu"))
    d = d.filter(F.col("__n") >= min_rows)
    if lags is not None:
        pmax = int(lags)
    else:
        n_max = max_series_length(d, keys)
        pmax = max(adf_maxlag(max(n_max, min_rows)), 0)
    w = wspec(keys, order_col)
    d = d.select(*keys, "__n", F.row_number().over(w).alias("__t"),
                 (F.col("__x") - F.lag("__x", 1).over(w)).alias("__dx"),
                 (F.lag("__x", 1).over(w) - F.col("__mu")).alias("__lvl"))
    d = d.select("*", *[F.lag("__dx", i).over(wspec(keys, "__t")).alias(f"__d{i}") for i in range(1, pmax + 1)])
    d = d.filter(F.col("__t") >= 2)
    pcol = F.lit(int(lags)) if lags is not None else \
        F.least(F.ceil(12.0 * F.pow(F.col("__n") / 100.0, 0.25)), F.floor(F.col("__n") / 2) - 2)
    d = d.withColumn("__P", pcol.cast("int"))
    vec = F.array(F.lit(1.0), F.col("__lvl"), *[F.col(f"__d{i}") for i in range(1, pmax + 1)], F.col("__dx"))
    rows = d.select(*keys, "__n", "__P", "__t", vec.alias("__v"))
    width = pmax + 3

    key_fields = [f for f in rows.schema.fields if f.name in keys]
    part_schema = T.StructType(key_fields + [
        T.StructField("__n", T.LongType()), T.StructField("__P", T.IntegerType()),
        T.StructField("__tag", T.IntegerType()), T.StructField("__g", T.ArrayType(T.DoubleType()))])
    iu = np.triu_indices(width)

    def partials(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            head = pdf["__t"] < pdf["__P"] + 2
            out = []
            # head rows travel individually (at most P per series)
            h = pdf[head]
            if len(h):
                hh = h[keys + ["__n", "__P", "__t"]].copy()
                hh["__tag"] = hh["__t"].astype("int32")
                hh["__g"] = [np.where(np.isnan(np.asarray(v, dtype=float)), 0.0,
                                      np.asarray(v, dtype=float)).tolist() for v in h["__v"]]
                out.append(hh.drop(columns=["__t"]))
            body = pdf[~head]
            if len(body):
                for kv, g in body.groupby(keys + ["__n", "__P"], sort=False, dropna=False):
                    V = np.vstack([np.asarray(v, dtype=float) for v in g["__v"]])
                    V = np.where(np.isnan(V), 0.0, V)
                    M = V.T @ V
                    rec = dict(zip(keys + ["__n", "__P"], kv if isinstance(kv, tuple) else (kv,)))
                    rec["__tag"] = 0
                    rec["__g"] = M[iu].tolist()
                    out.append(pd.DataFrame([rec]))
            if out:
                res = pd.concat(out, ignore_index=True)
                res["__tag"] = res["__tag"].astype("int32")
                res["__P"] = res["__P"].astype("int32")
                res["__n"] = res["__n"].astype("int64")
                yield res[[f.name for f in part_schema.fields]]

    parts = rows.mapInPandas(partials, part_schema)
    body = parts.filter(F.col("__tag") == 0).select(*keys, "__n", "__P", F.posexplode("__g").alias("__i", "__val"))
    body = body.groupBy(*keys, "__n", "__P", "__i").agg(F.sum("__val").alias("__val"))
    body = body.groupBy(*keys, "__n", "__P").agg(F.sort_array(F.collect_list(F.struct("__i", "__val"))).alias("__G"))
    heads = parts.filter(F.col("__tag") > 0)
    heads = (heads.groupBy(*keys) if keys else heads.groupBy()).agg(
        F.collect_list(F.struct("__tag", "__g")).alias("__H"))
    per = join_on_keys(body, heads, keys, "left") if keys else body.crossJoin(F.broadcast(heads))

    out_fields = key_fields + [T.StructField("n", T.LongType()), T.StructField("adf_stat", T.DoubleType()),
                               T.StructField("adf_p", T.DoubleType()), T.StructField("adf_lags", T.IntegerType()),
                               T.StructField("adf_nobs", T.LongType()),
                               T.StructField("adf_stationary", T.BooleanType())]
    out_schema = T.StructType(out_fields)

    def solve(batches):
        for pdf in batches:
            recs = []
            for _, r in pdf.iterrows():
                n, P = int(r["__n"]), int(r["__P"])
                G = np.zeros((width, width))
                vals = np.zeros(len(iu[0]))
                for e in r["__G"]:
                    vals[int(e["__i"])] = e["__val"]
                G[iu] = vals
                G = G + G.T - np.diag(np.diag(G))
                # restrict to this series' P: columns const, level, lags 1..P, y
                sel = list(range(0, 2 + P)) + [width - 1]
                Gs = G[np.ix_(sel, sel)]
                head = []
                hs = r["__H"] if r["__H"] is not None else []
                for e in hs:
                    v = np.asarray(e["__g"], dtype=float)[sel]
                    head.append((int(e["__tag"]), v))
                res = _solve_series(n, P, Gs, head, fixed=lags is not None)
                rec = {k: r[k] for k in keys}
                rec.update({"n": n, "adf_stat": res.get("adf_stat"), "adf_p": res.get("adf_p"),
                            "adf_lags": res.get("adf_lags"), "adf_nobs": res.get("adf_nobs")})
                rec["adf_stationary"] = bool(res.get("adf_p") is not None and res["adf_p"] < 0.05)
                recs.append(rec)
            if recs:
                out = pd.DataFrame(recs)
                out["adf_lags"] = out["adf_lags"].astype("Int32")
                out["adf_nobs"] = out["adf_nobs"].astype("Int64")
                yield out[[f.name for f in out_schema.fields]]

    solved = per.mapInPandas(solve, out_schema)
    if not critical_values:
        return solved
    inverse = 1.0 / F.col("adf_nobs")
    return solved.select("*", *[sum((F.lit(c) * F.pow(inverse, F.lit(float(i))) for i, c in enumerate(coefs)), F.lit(0.0)).alias(f"adf_crit_{name}")
                                for name, coefs in TAU_CRIT.items()])


def stationarity(df: DataFrame, value: str, order_col: str, keys=()) -> DataFrame:
    """ADF and KPSS side by side, one row per series (H2 + H3)."""
    from panelcast.operators.diagnostics import kpss

    keys = list(keys)
    a = adf(df, value, order_col, keys, critical_values=True)
    k = kpss(df, value, order_col, keys, critical_values=True).drop("n")
    return join_on_keys(a, k, keys, "left") if keys else a.crossJoin(k)
