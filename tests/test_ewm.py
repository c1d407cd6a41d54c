import numpy as np
import pandas as pd

from panelcast.operators import ewm as ewm_mod


def _data(spark, seed=1, n=700):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(3):
        v = rng.normal(50, 10, n)
        v[rng.random(n) < 0.3] = np.nan
        v[100:260] = np.nan
        if k == 1:
            v[:40] = np.nan
        rows += [(k, i, None if np.isnan(x) else float(x)) for i, x in enumerate(v)]
    pdf = pd.DataFrame(rows, columns=["k", "t", "v"])
    return pdf, spark.createDataFrame(pdf, "k INT, t INT, v DOUBLE")


def _check(pdf, out, spans):
    out = out.toPandas().sort_values(["k", "t"])
    for s in spans:
        exp = pdf.sort_values(["k", "t"]).groupby("k")["v"].transform(
            lambda x: x.ewm(span=s, adjust=False).mean()).to_numpy()
        got = out[f"v_ewm_{s}"].to_numpy(dtype=float)
        assert (np.isnan(got) == np.isnan(exp)).all()
        m = ~np.isnan(exp)
        assert np.allclose(got[m], exp[m], rtol=1e-10, atol=1e-10)


def test_ewm_matches_pandas(spark):
    pdf, df = _data(spark)
    spans = [1, 2, 7, 91]
    _check(pdf, ewm_mod.ewm_features(df, ["k"], "t", "v", spans), spans)


def test_ewm_deep_recursion(spark, monkeypatch):
    # tiny blocks force three scan levels
    monkeypatch.setattr(ewm_mod, "MAX_BLOCK", 5)
    pdf, df = _data(spark, seed=2, n=400)
    _check(pdf, ewm_mod.ewm_features(df, ["k"], "t", "v", [3, 14]), [3, 14])


def test_ewm_shift_excludes_current_row(spark):
    df = spark.createDataFrame([(0, i, float(i)) for i in range(10)], "k INT, t INT, v DOUBLE")
    a = ewm_mod.ewm_features(df, ["k"], "t", "v", [3], shift=1).orderBy("t").collect()
    b = ewm_mod.ewm_features(df, ["k"], "t", "v", [3]).orderBy("t").collect()
    assert a[0]["v_ewm_3"] is None
    assert abs(a[5]["v_ewm_3"] - b[4]["v_ewm_3"]) < 1e-12
