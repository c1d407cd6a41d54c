import numpy as np
import pandas as pd
import pytest

from panelcast.operators import windows as win


def _panel(n=120, keys=3, null_frac=0.2, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(keys):
        v = rng.integers(0, 50, n).astype(float)
        v[rng.random(n) < null_frac] = np.nan
        v[:3] = np.nan if k == 1 else v[:3]
        for t in range(n):
            rows.append((k, t, None if np.isnan(v[t]) else float(v[t])))
    return pd.DataFrame(rows, columns=["k", "t", "v"])


def _spark(spark, pdf):
    return spark.createDataFrame(pdf.astype({"v": "float64"}), "k INT, t INT, v DOUBLE")


def _close(a, b, tol=1e-9):
    a, b = np.asarray(a, float), np.asarray(b, float)
    assert (np.isnan(a) == np.isnan(b)).all()
    m = ~np.isnan(a)
    assert np.allclose(a[m], b[m], rtol=tol, atol=tol)


@pytest.mark.parametrize("method", ["table", "frame"])
def test_shifted_rolling_matches_pandas_per_key(spark, method):
    pdf = _panel()
    aggs = ["mean", "std", "min", "max", "sum", "median", "skew"]
    out = win.shifted_rolling(_spark(spark, pdf), ["k"], "t", "v", [4, 9], aggs, method=method)
    got = out.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    for n in [4, 9]:
        for a in aggs:
            exp = pdf.sort_values(["k", "t"]).groupby("k")["v"].transform(
                lambda s: getattr(s.shift(1).rolling(n, min_periods=max(1, n // 2)), a)())
            _close(got[f"v_roll_{a}_{n}d"], exp.reset_index(drop=True), 1e-8)


def test_trailing_rolling_and_borders(spark):
    pdf = _panel(null_frac=0.0)
    out = win.trailing_rolling(_spark(spark, pdf), ["k"], "t", "v", [3, 7], ["mean", "std", "min", "max", "skew"])
    got = out.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    for n in [3, 7]:
        for a in ["mean", "std", "min", "max", "skew"]:
            exp = pdf.sort_values(["k", "t"]).groupby("k")["v"].transform(lambda s: getattr(s.rolling(n), a)())
            _close(got[f"v_rolling_{n}_{a}"], exp.reset_index(drop=True), 1e-8)


def test_no_leak_between_series(spark):
    df = spark.createDataFrame([(1, i, float(i + 1)) for i in range(3)] + [(2, i, float(10 * (i + 1))) for i in range(3)],
                               "k INT, t INT, v DOUBLE")
    out = win.shifted_rolling(df, ["k"], "t", "v", [2], ["mean"])
    first = {r["k"]: r["v_roll_mean_2d"] for r in out.filter("t = 0").collect()}
    assert first == {1: None, 2: None}
    lag = win.lag_features(df, ["k"], "t", "v", [1], fill="ffill").filter("t = 0").collect()
    assert all(r["v_lag_1"] is None for r in lag)


def test_shifted_rolling_ignores_current_value(spark):
    pdf = _panel(null_frac=0.0)
    a = win.shifted_rolling(_spark(spark, pdf), ["k"], "t", "v", [5], ["mean", "max"]).toPandas()
    pdf2 = pdf.copy()
    pdf2.loc[pdf2.t == 50, "v"] = 9999.0
    b = win.shifted_rolling(_spark(spark, pdf2), ["k"], "t", "v", [5], ["mean", "max"]).toPandas()
    a, b = a.sort_values(["k", "t"]), b.sort_values(["k", "t"])
    sel = (a.t == 50).to_numpy()
    _close(a["v_roll_mean_5d"].to_numpy()[sel], b["v_roll_mean_5d"].to_numpy()[sel])


def test_expanding_and_fills(spark):
    pdf = _panel()
    df = _spark(spark, pdf)
    out = win.expanding(df, ["k"], "t", "v", ["mean", "std", "max", "count"]).toPandas().sort_values(["k", "t"])
    g = pdf.sort_values(["k", "t"]).groupby("k")["v"]
    _close(out["v_expanding_mean"], g.transform(lambda s: s.expanding(min_periods=1).mean()))
    _close(out["v_expanding_std"], g.transform(lambda s: s.expanding(min_periods=1).std()))
    _close(out["v_expanding_count"], g.transform(lambda s: s.expanding(min_periods=1).count()))
    f = win.fill_columns(df, ["k"], "t", ["v"], "ffill").toPandas().sort_values(["k", "t"])
    _close(f["v"], g.transform(lambda s: s.ffill()))
    b = win.fill_columns(df, ["k"], "t", ["v"], "bfill").toPandas().sort_values(["k", "t"])
    _close(b["v"], g.transform(lambda s: s.bfill()))


def test_interpolate_and_pct_change(spark):
    pdf = _panel()
    pdf.loc[(pdf.k == 0) & (pdf.t > 115), "v"] = np.nan   # trailing nulls
    df = _spark(spark, pdf)
    g = pdf.sort_values(["k", "t"]).groupby("k")["v"]
    i = win.interpolate_linear(df, ["k"], "t", "v", out="vi").toPandas().sort_values(["k", "t"])
    _close(i["vi"], g.transform(lambda s: s.interpolate()))
    d = win.difference_features(df, ["k"], "t", "v", [1, 7]).toPandas().sort_values(["k", "t"])
    _close(d["v_diff_7"], g.transform(lambda s: s.diff(7)))
    exp = g.transform(lambda s: s.ffill().pct_change(7, fill_method=None)).replace([np.inf, -np.inf], np.nan)
    _close(d["v_pct_change_7"], exp)


def test_zero_base_ratio_is_null(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, 1.0, None, 2.0, 0.0, 0.0])],
                               "k INT, t INT, v DOUBLE")
    out = win.interaction_features(df, ["k"], "t", "v", [1]).orderBy("t").collect()
    assert out[1]["v_ratio_1"] is None          # 1 / 0 -> null, not inf
    assert out[5]["v_ratio_1"] is None          # 0 / 0 -> null
    assert out[4]["v_ratio_1"] == 0.0


def test_keyed_equals_union_of_single_series_and_partition_invariance(spark):
    from panelcast.operators.ewm import ewm_features

    pdf = _panel(n=200, keys=4)
    df = _spark(spark, pdf)

    def build(d, keys):
        f = win.shifted_rolling(d, keys, "t", "v", [5, 30], ["mean", "std", "min", "max"])
        f = win.lag_features(f, keys, "t", "v", [3])
        return ewm_features(f, keys, "t", "v", [7])

    full = build(df, ["k"]).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    parts = [build(df.filter(f"k = {k}"), []).toPandas() for k in range(4)]
    union = pd.concat(parts).sort_values(["k", "t"]).reset_index(drop=True)
    for c in full.columns:
        _close(full[c].astype(float), union[c].astype(float), 1e-9)
    shuffled = build(df.repartition(7, "t"), ["k"]).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    one = build(df.coalesce(1), ["k"]).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    for c in full.columns:
        _close(full[c].astype(float), shuffled[c].astype(float), 1e-9)
        _close(full[c].astype(float), one[c].astype(float), 1e-9)


def test_forecast_alignment_raises(spark):
    from panelcast.plans.forecast import align_columns

    df = spark.createDataFrame([(1, 2.0)], "a INT, b DOUBLE")
    with pytest.raises(ValueError, match="c"):
        align_columns(df, ["a", "c"])


def test_chunked_long_series_equals_plain(spark):
    from panelcast.operators.longseries import chunked, lookback_of

    pdf = _panel(n=300, keys=3)
    df = _spark(spark, pdf)

    def build(d, keys, order):
        f = win.lag_features(d, keys, order, "v", [1, 9])
        f = win.shifted_rolling(f, keys, order, "v", [4, 20], ["mean", "std", "min", "max", "count"])
        f = win.trailing_rolling(f, keys, order, "v", [7], ["mean", "max"])
        return win.centered_mean(f, keys, order, "v", 7, "trend")

    plain = build(df, ["k"], "t").toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    lb = lookback_of([1, 9], [4, 20])
    split = chunked(df, ["k"], "t", build, lookback=lb, lookahead=3, chunk_rows=64)
    split = split.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    assert len(split) == len(plain)
    for c in plain.columns:
        _close(plain[c].astype(float), split[c].astype(float), 1e-9)


def test_feature_build_auto_split(spark, monkeypatch):
    import panelcast.plans.features as feat
    from panelcast.spec import FeatureConfig, SeriesSpec

    pdf = _panel(n=150, keys=2, null_frac=0.0)
    df = _spark(spark, pdf).withColumnRenamed("k", "store").withColumnRenamed("t", "date")
    spec = SeriesSpec(keys=("store",), order_col="date", value_col="v")
    cfg = FeatureConfig(date_features=False, lags=[2, 5], rolling_windows=[4, 10], rolling_aggs=["mean", "max"])
    plain = feat.build_features(df, spec, cfg).toPandas().sort_values(["store", "date"]).reset_index(drop=True)
    monkeypatch.setattr(feat, "AUTO_SPLIT_THRESHOLD", 100)
    monkeypatch.setattr(feat, "AUTO_CHUNK_ROWS", 40)
    cfg.split_rows = "auto"
    auto = feat.build_features(df, spec, cfg)
    assert "__chunk" not in auto.columns
    auto = auto.toPandas().sort_values(["store", "date"]).reset_index(drop=True)
    for c in plain.columns:
        _close(plain[c].astype(float), auto[c].astype(float), 1e-9)


def test_ties_fixture_with_tiebreak(spark):
    """Demo frame: every (group, date) occurs twice; a tie-breaker column makes
    lags and rolling statistics deterministic and equal to a stable sort."""
    import datetime as dt

    rng = np.random.default_rng(7)
    rows = []
    for g in ("A", "B"):
        for d in range(50):
            for r in range(2):
                rows.append((g, dt.date(2023, 1, 1) + dt.timedelta(days=d), r, float(rng.integers(0, 100))))
    pdf = pd.DataFrame(rows, columns=["group", "date", "seq", "value"])
    df = spark.createDataFrame(pdf)
    out = win.lag_features(df, ["group"], ["date", "seq"], "value", [1, 3])
    out = win.shifted_rolling(out, ["group"], ["date", "seq"], "value", [4], ["mean", "max"]).toPandas()
    out = out.sort_values(["group", "date", "seq"]).reset_index(drop=True)
    srt = pdf.sort_values(["group", "date", "seq"], kind="stable").reset_index(drop=True)
    g = srt.groupby("group")["value"]
    _close(out["value_lag_3"], g.shift(3))
    _close(out["value_roll_mean_4d"], g.transform(lambda s: s.shift(1).rolling(4, min_periods=2).mean()))
    _close(out["value_roll_max_4d"], g.transform(lambda s: s.shift(1).rolling(4, min_periods=2).max()))


def test_build_features_with_tiebreak_and_split(spark):
    import datetime as dt

    from panelcast.plans.features import build_features
    from panelcast.spec import FeatureConfig, SeriesSpec

    rng = np.random.default_rng(8)
    rows = [(g, dt.date(2023, 1, 1) + dt.timedelta(days=d), r, float(rng.integers(0, 50)))
            for g in ("A", "B") for d in range(60) for r in range(2)]
    df = spark.createDataFrame(rows, "group STRING, date DATE, seq INT, value DOUBLE")
    spec = SeriesSpec(("group",), "date", "value", tiebreak=("seq",))
    cfg = FeatureConfig(lags=[1, 5], rolling_windows=[6], rolling_aggs=["mean", "min"], create_ewm=True,
                        ewm_spans=[3])
    a = build_features(df, spec, cfg).toPandas().sort_values(["group", "date", "seq"]).reset_index(drop=True)
    cfg.split_rows = 30
    b = build_features(df, spec, cfg).toPandas().sort_values(["group", "date", "seq"]).reset_index(drop=True)
    for c in ["value_lag_5", "value_roll_mean_6d", "value_roll_min_6d", "value_ewm_3"]:
        _close(a[c].astype(float), b[c].astype(float), 1e-9)
    srt = pd.DataFrame(rows, columns=["group", "date", "seq", "value"]).sort_values(["group", "date", "seq"])
    _close(a["value_lag_5"], srt.groupby("group")["value"].shift(5).reset_index(drop=True))


def test_table_skew_kurt_match_pandas(spark):
    pdf = _panel(n=200, keys=3, null_frac=0.15)
    pdf.loc[(pdf.k == 2) & (pdf.t.between(50, 80)), "v"] = 7.0      # constant stretch
    df = _spark(spark, pdf)
    out = win.trailing_rolling(df, ["k"], "t", "v", [5, 12], ["skew", "kurt"]).toPandas().sort_values(["k", "t"])
    sh = win.shifted_rolling(df, ["k"], "t", "v", [9], ["skew", "kurt"]).toPandas().sort_values(["k", "t"])
    g = pdf.sort_values(["k", "t"]).groupby("k")["v"]
    for n in (5, 12):
        _close(out[f"v_rolling_{n}_skew"], g.transform(lambda s: s.rolling(n).skew()), 1e-7)
        _close(out[f"v_rolling_{n}_kurt"], g.transform(lambda s: s.rolling(n).kurt()), 1e-7)
    _close(sh["v_roll_skew_9d"], g.transform(lambda s: s.shift(1).rolling(9, min_periods=4).skew()), 1e-7)
    _close(sh["v_roll_kurt_9d"], g.transform(lambda s: s.shift(1).rolling(9, min_periods=4).kurt()), 1e-7)


def test_moments_survive_level_shifts_and_nan(spark):
    values = [float(i % 3) for i in range(1200)] + [1e9 + i % 3 for i in range(1200)] + [float(i % 5) for i in range(200)]
    values[10], values[500], values[1300] = float("nan"), None, float("nan")
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, t int, v double")
    aggs = ["mean", "std", "var", "sum", "count", "skew", "kurt", "min", "max"]
    windows = [1, 3, 7, 21, 64, 100]
    got = win.shifted_rolling(df, ["k"], "t", "v", windows, aggs).orderBy("t").toPandas()
    for n in windows:
        want = {a: [] for a in aggs}
        for t in range(len(values)):
            x = pd.Series(values[max(0, t - n):t], dtype=float).dropna()
            x = x - (shift := x.iloc[0] if len(x) else 0.0)       # exact here, and moments don't move with it
            enough = len(x) >= max(1, n // 2)
            for a in aggs:
                if a == "count":
                    v = float(len(x)) if min(t, n) >= max(1, n // 2) else np.nan
                else:
                    v = getattr(x, a)() if enough else np.nan
                    v += {"mean": shift, "min": shift, "max": shift, "sum": shift * len(x)}.get(a, 0.0)
                want[a].append(v)
        for a in aggs:
            np.testing.assert_allclose(got[f"v_roll_{a}_{n}d"].to_numpy(float), np.array(want[a], float), rtol=1e-9, atol=1e-9, err_msg=f"{a} {n}")
    assert len(got) == len(values)
