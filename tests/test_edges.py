"""Null keys, empty frames, exact fits, small samples."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import adf, diagnostics, profile, quantiles, relational
from panelcast.operators.ewm import ewm_features
from panelcast.operators.isoforest import isolation_forest_scores
from panelcast.plans import validation


def test_null_keys_keep_their_statistics(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    rows = relational.with_group_stat(df, ["k"], F.max("v").alias("top")).collect()
    assert sorted((r.k or "", r.v, r.top) for r in rows) == [("", 1.0, 3.0), ("", 3.0, 3.0), ("a", 5.0, 5.0)]
    box = {r.k: r.median for r in profile.box_summary(df, "v", ["k"]).collect()}
    assert box == {None: 2.0, "a": 5.0}


def test_densify_and_membership_with_null_keys(spark):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(None, day, 1), (None, day + dt.timedelta(2), 3), ("a", day, 4)], "k string, date date, v int")
    dense = relational.densify_daily(df, ["k"])
    assert dense.columns == ["k", "date", "v"]
    assert sorted((r.k or "", r.date.day, r.v or 0) for r in dense.collect()) == [("", 1, 1), ("", 2, 0), ("", 3, 3), ("a", 1, 4)]
    assert relational.semi_join_keys_dates(df, df, ["k"]).count() == 3


def test_empty_frames(spark):
    df = spark.createDataFrame([], "date date, v double")
    assert profile.overview(df).first().missing_pct is None
    assert profile.missing_summary(df, "v").first().missing_pct is None
    assert [r.null_pct for r in profile.column_profile(df).collect()] == [None, None]
    assert quantiles.quantile_table(df, "v", [0.5]).first()[0] == [None]
    assert quantiles.multi_column_quantiles(df, ["v"], [0.1, 0.9]).first()["__q"] == [None, None]


def test_no_correlation_has_no_sign(spark):
    df = spark.createDataFrame([("a", "b", 0.0), ("a", "c", 0.5), ("b", "c", -0.1)], "feature_1 string, feature_2 string, correlation double")
    signs = {(r.feature_1, r.feature_2): r.sign for r in profile.strongest_pairs(df, ["a", "b", "c"]).collect()}
    assert signs == {("a", "c"): "positive", ("b", "c"): "negative"}


def test_quantiles_of_few_hot_values_and_nan(spark):
    values = [1.0] * 5000 + [2.0] * 3000 + np.linspace(3, 4, 1000).tolist() + [float("nan")] * 50 + [None] * 20
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    probs = [0.0, 0.3, 0.5551, 0.5556, 0.8, 0.95, 0.999, 1.0]
    got = quantiles.quantile_table(df, "v", probs).first()[0]
    assert np.allclose(got, np.quantile([v for v in values if v is not None and v == v], probs))


def test_adf_gives_nothing_on_an_exact_fit(spark):
    df = spark.createDataFrame([(t, float((-1) ** t)) for t in range(60)], "t int, v double")
    row = adf.adf(df, "v", "t", lags=0).first()
    assert row is None or row["adf_stat"] is None


def test_shapiro_of_three_values(spark):
    # published exact case: p is a function of W alone
    row = diagnostics.shapiro_wilk(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double"), "v").first()
    assert row.shapiro_stat == pytest.approx(0.9642857142857142) and row.shapiro_p == pytest.approx(0.6368868, abs=1e-6)


def test_forest_trees_have_their_own_full_samples(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(np.append(rng.normal(size=300), 9.0))], "t int, v double")
    rows = isolation_forest_scores(df, "v").collect()
    scores = {r.t: r.anomaly_score for r in rows}
    inner = [scores[t] for t in range(300)]
    assert scores[300] == max(scores.values()) and scores[300] > 0.7
    assert np.median(inner) < 0.5 and len(rows) == 301       # a full sample of 256 of them lies deep


def test_ewm_of_a_long_series(spark):
    n = 3000
    rng = np.random.default_rng(2)
    x = rng.normal(size=n).round(3)
    x[7] = np.nan
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, t int, v double")
    got = ewm_features(df, ["k"], "t", "v", [10]).orderBy("t").toPandas().v_ewm_10.to_numpy()
    import pandas as pd

    want = pd.Series(x).ewm(span=10, adjust=False).mean().to_numpy()
    assert np.allclose(got, want, rtol=1e-9)


def test_folds_count_earlier_dates(spark):
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=d)) for d in range(17) for k in range(d % 4 + 1)]
    df = spark.createDataFrame(rows, "k int, date date").repartition(4)
    got = validation.time_series_folds(df, ["date", "k"], 3).orderBy("date", "k").collect()
    n = len(rows)
    size = n // 4
    start = n - 3 * size
    assert [r.row_index for r in got] == list(range(n))
    assert [r.val_fold for r in got] == [None if i < start else (i - start) // size + 1 for i in range(n)]
