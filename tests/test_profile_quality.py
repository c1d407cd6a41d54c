import numpy as np
import pandas as pd

from panelcast.operators import impute as imp
from panelcast.operators import outliers as out
from panelcast.operators import profile as prof


def _vals(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, i, float(v)) for k in range(2) for i, v in enumerate(rng.exponential(10, 300).round(1))]
    rows.append((0, 300, None))
    pdf = pd.DataFrame(rows, columns=["k", "t", "v"])
    return pdf, spark.createDataFrame(rows, "k INT, t INT, v DOUBLE")


def test_describe_percentiles_moments(spark):
    pdf, df = _vals(spark)
    d = {r["k"]: r for r in prof.describe(df, ["v"], ["k"]).collect()}
    p = {r["k"]: r for r in prof.percentile_set(df, "v", ["k"]).collect()}
    m = {r["k"]: r for r in prof.moments(df, "v", ["k"]).collect()}
    for k, g in pdf.groupby("k"):
        x = g.v.dropna().to_numpy()
        assert d[k]["count"] == len(x)
        assert np.isclose(d[k]["std"], x.std(ddof=1))
        assert np.isclose(d[k]["p75"], np.percentile(x, 75))
        assert np.isclose(p[k]["p5"], np.percentile(x, 5))
        mu, s = x.mean(), x.std()
        assert np.isclose(m[k]["skewness"], ((x - mu) ** 3).mean() / s ** 3)
        assert np.isclose(m[k]["kurtosis"], ((x - mu) ** 4).mean() / s ** 4 - 3)


def test_histogram_kde_box(spark):
    pdf, df = _vals(spark)
    h = prof.histogram(df, "v", ["k"], 30).toPandas()
    assert h.groupby("k")["count"].sum().tolist() == [300, 300]
    assert h.bin.max() == 29
    kde = prof.kde_grid(df, "v", ["k"], 100).toPandas().sort_values(["k", "point"])
    for _, g in kde.groupby("k"):
        assert 0.8 < np.trapezoid(g.density, g.x) < 1.05
    box = {r["k"]: r for r in prof.box_summary(df, "v", ["k"]).collect()}
    x = pdf[pdf.k == 0].v.dropna().to_numpy()
    q1, q3 = np.percentile(x, [25, 75])
    up = q3 + 1.5 * (q3 - q1)
    assert np.isclose(box[0]["upper_whisker"], x[x <= up].max())
    assert box[0]["n_outside"] == int((x > up).sum() + (x < q1 - 1.5 * (q3 - q1)).sum())


def test_correlation_pairwise_nulls(spark):
    rows = [(1.0, 2.0, None), (2.0, 4.1, 1.0), (3.0, 6.2, 0.0), (4.0, 7.9, 5.0), (5.0, None, 2.0)]
    df = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c DOUBLE")
    c = {(r["feature_1"], r["feature_2"]): r["correlation"] for r in prof.correlation_long(df, ["a", "b", "c"]).collect()}
    pdf = pd.DataFrame(rows, columns=["a", "b", "c"]).astype(float)
    exp = pdf.corr()
    assert np.isclose(c[("a", "b")], exp.loc["a", "b"]) and np.isclose(c[("c", "a")], exp.loc["c", "a"])
    assert c[("b", "b")] == 1.0 and len(c) == 9


def test_outliers_against_numpy(spark):
    pdf, df = _vals(spark)
    iq = out.iqr_outliers(df, "v", ["k"]).toPandas()
    zs = out.zscore_outliers(df, "v", ["k"], 3.0).toPandas()
    mz = out.modified_zscore_outliers(df, "v", ["k"], 3.5).toPandas()
    for k, g in pdf.groupby("k"):
        x = g.v.to_numpy()
        q1, q3 = np.nanpercentile(x, [25, 75])
        e = (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))
        assert iq[iq.k == k].sort_values("t").is_outlier.tolist() == e.tolist()
        ez = np.abs(x - np.nanmean(x)) / np.nanstd(x) > 3.0
        assert zs[zs.k == k].sort_values("t").is_outlier.tolist() == np.nan_to_num(ez, nan=0).astype(bool).tolist()
        med = np.nanmedian(x)
        mad = np.nanmedian(np.abs(x - med))
        em = np.abs(0.6745 * (x - med) / mad) > 3.5
        assert mz[mz.k == k].sort_values("t").is_outlier.tolist() == np.nan_to_num(em, nan=0).astype(bool).tolist()


def test_mad_zero_and_comparison(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([5.0] * 8 + [6.0, None])], "k INT, t INT, v DOUBLE")
    m = out.modified_zscore_outliers(df, "v", ["k"]).orderBy("t").collect()
    assert [r["is_outlier"] for r in m] == [False] * 8 + [True, False]
    flagged = out.flag_all(df, "v", ["k"])
    comp = {r["method"]: r for r in out.method_comparison(flagged, ["iqr", "zscore", "modified_zscore"], ["k"]).collect()}
    assert comp["modified_zscore"]["outliers_found"] == 1 and comp["modified_zscore"]["percentage"] == 10.0


def test_imputation_methods(spark):
    rows = [(0, 0, 1.0), (0, 1, None), (0, 2, 3.0), (0, 3, 3.0), (0, 4, 1.0), (0, 5, None), (1, 0, None), (1, 1, 7.0)]
    df = spark.createDataFrame(rows, "k INT, t INT, v DOUBLE")
    get = lambda d: [r["v"] for r in d.orderBy("k", "t").collect()]
    assert get(imp.impute(df, "v", "mean", ["k"], order_col="t"))[:6] == [1.0, 2.0, 3.0, 3.0, 1.0, 2.0]
    assert get(imp.impute(df, "v", "median", ["k"], order_col="t"))[1] == 2.0
    assert get(imp.impute(df, "v", "mode", ["k"], order_col="t"))[1] == 1.0          # tie 1 vs 3 -> smallest
    assert get(imp.impute(df, "v", "interpolate", ["k"], order_col="t"))[:6] == [1.0, 2.0, 3.0, 3.0, 1.0, 1.0]
    assert get(imp.impute(df, "v", "remove", ["k"], order_col="t")) == [1.0, 3.0, 3.0, 1.0, 7.0]
    assert get(imp.impute(df, "v", "Backward Fill", ["k"], order_col="t"))[6] == 7.0
    sc = imp.standard_scale(df, ["v"], ["k"]).filter("k = 1").collect()
    assert sc[1]["v_scaled"] == 0.0      # single value: std 0 -> divide by 1


def test_flag_all_fused_equals_single_methods(spark):
    pdf, df = _vals(spark, seed=3)
    methods = ["iqr", "zscore", "modified_zscore"]
    for keys in (["k"], []):
        fused = out.flag_all(df, "v", keys, methods).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
        for m in methods:
            single = out.METHODS[m](df, "v", keys).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
            assert fused[f"is_outlier_{m}"].tolist() == single.is_outlier.tolist()


def test_kde_prebinned_close_to_exact(spark):
    pdf, df = _vals(spark, seed=5)
    exact = prof.kde_grid(df, "v", ["k"], 50).toPandas().sort_values(["k", "point"])
    binned = prof.kde_grid(df, "v", ["k"], 50, bins=2000).toPandas().sort_values(["k", "point"])
    assert np.allclose(exact.x.to_numpy(), binned.x.to_numpy())
    assert np.max(np.abs(exact.density.to_numpy() - binned.density.to_numpy())) < 1e-3


def test_advanced_statistics(spark):
    pdf, df = _vals(spark)
    a = {r["k"]: r for r in prof.advanced_statistics(df, "v", "t", ["k"]).collect()}
    g = prof.advanced_statistics(df, "v", "t", []).first()
    x = pdf.v.dropna().to_numpy()
    assert np.isclose(g["p90"], np.percentile(x, 90)) and np.isclose(g["median"], np.median(x))
    assert set(a) == {0, 1} and 0 < a[0]["shapiro_stat"] < 1 and not a[0]["is_normal"]
