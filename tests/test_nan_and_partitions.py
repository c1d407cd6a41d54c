"""NaN counts as null everywhere; results do not depend on partitions or on
the working folder."""

import math
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import diagnostics as diag
from panelcast.operators import impute, outliers, profile
from panelcast.operators import windows as win
from panelcast.operators.adf import adf, stationarity
from panelcast.operators.isoforest import isolation_forest_outliers, isolation_forest_scores


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, float(v)) for k in (1, 2) for i, v in enumerate(rng.normal(20, 3, 60).round(2))]
    rows = [(k, i, None if i in (0, 17, 18, 59) else v) for k, i, v in rows]
    null = spark.createDataFrame(rows, "k int, t int, v double").cache()
    return null, null.withColumn("v", F.coalesce("v", F.lit(float("nan"))))


def values(df):
    return sorted((tuple("null" if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else str(v)
                         for v in r) for r in df.collect()), key=str)


OPERATORS = {
    "kpss": lambda d: diag.kpss(d, "v", "t", ["k"]),
    "jarque_bera": lambda d: diag.jarque_bera(d, "v", ["k"]),
    "adf": lambda d: adf(d, "v", "t", ["k"]),
    "moments": lambda d: profile.moments(d, "v", ["k"]),
    "moments of all": lambda d: profile.moments(d, "v"),
    "describe": lambda d: profile.describe(d, ["v"], ["k"]),
    "percentiles": lambda d: profile.percentile_set(d, "v", ["k"]),
    "box": lambda d: profile.box_summary(d, "v", ["k"]),
    "kde": lambda d: profile.kde_grid(d, "v", ["k"], points=5),
    "qq": lambda d: profile.qq_points(d, "v", ["k"]),
    "trend": lambda d: profile.ols_trend(d, "v", "t", ["k"]),
    "correlation": lambda d: profile.correlation_long(d, ["v", "t"]),
    "mean fill": lambda d: impute.mean_fill(d, ["v"], ["k"]),
    "median fill": lambda d: impute.median_fill(d, ["v"]),
    "mode fill": lambda d: impute.mode_fill(d, ["v"], ["k"]),
    "scale": lambda d: impute.standard_scale(d, ["v"], ["k"]).drop("v"),
    "ffill": lambda d: win.fill_columns(d, ["k"], "t", ["v"], "ffill"),
    "bfill": lambda d: win.fill_columns(d, ["k"], "t", ["v"], "bfill"),
    "interpolate": lambda d: win.interpolate_linear(d, ["k"], "t", "v"),
    "differences": lambda d: win.difference_features(d, ["k"], "t", "v").drop("v"),
    "interaction": lambda d: win.interaction_features(d, ["k"], "t", "v", [1, 7]).drop("v"),
    "iqr": lambda d: outliers.iqr_outliers(d, "v", ["k"]).drop("v"),
    "all masks": lambda d: outliers.flag_all(d, "v", ["k"], ("iqr", "zscore", "modified_zscore", "isolation_forest")).drop("v"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_nan_is_null(frames, name):
    null, nan = frames
    got = values(OPERATORS[name](nan))
    assert got == values(OPERATORS[name](null)) and got


def test_isolation_forest_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(rng.normal(size=1200).round(1))] + [(0, 7.0)] * 20, "k int, v double")
    for keys in (["k"], []):
        one, many = (isolation_forest_outliers(df.repartition(n), "v", keys).groupBy("k", "v", "is_outlier", F.round("anomaly_score", 9).alias("s"))
                     .count() for n in (1, 7))
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert isolation_forest_scores(df.limit(0), "v").collect() == []
    same = isolation_forest_scores(df.withColumn("v", F.lit(2.0)), "v").select("anomaly_score").distinct().collect()
    assert len(same) == 1


def test_critical_values(spark, frames):
    row = stationarity(frames[0], "v", "t", ["k"]).first()
    assert row.adf_crit_1 < row.adf_crit_5 < row.adf_crit_10 < -2.5 and row.adf_crit_5 == pytest.approx(-2.8615, abs=0.12)
    assert (row.kpss_crit_10, row.kpss_crit_5, row.kpss_crit_1) == (0.347, 0.463, 0.739)
    # published: 5 % at 100 observations
    n = 100
    assert -2.86154 - 2.8903 / n - 4.234 / n ** 2 - 40.040 / n ** 3 == pytest.approx(-2.8909, abs=1e-3)


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = """
import sys; sys.path.insert(0, sys.argv[1])
from panelcast.session import build_session
from panelcast.operators.adf import adf
from panelcast.operators.isoforest import isolation_forest_scores
spark = build_session(master="local[2]", shuffle_partitions=2)
df = spark.range(40).selectExpr("cast(id as int) t", "cast((id * 7919) % 13 as double) v")
print("rows", adf(df, "v", "t").count(), isolation_forest_scores(df, "v").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code, str(Path(__file__).parent.parent)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1 40" in out.stdout, out.stderr[-2000:]


@pytest.mark.parametrize("n", [1, 2, 3, 50, 30_000])
def test_bracketed_quantiles(spark, n):
    from panelcast.operators.quantiles import multi_column_quantiles

    rng = np.random.default_rng(n)
    probs = [0.0, 0.05, 0.25, 0.5, 0.751, 0.99, 1.0]
    a, b = rng.normal(size=n), rng.integers(0, 3, n).astype(float)
    rows = [(float(x), float(y), None) for x, y in zip(a, b)] + [(None, float("nan"), None)] * 7
    got = {r.feature: r["__q"] for r in multi_column_quantiles(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], probs).collect()}
    assert np.allclose(got["a"], np.quantile(a, probs), atol=1e-12) and np.allclose(got["b"], np.quantile(b, probs), atol=1e-12)
    assert got["c"] == [None] * len(probs)


def test_prediction_features_equal_the_whole_build(spark):
    import datetime as dt

    from panelcast.plans import forecast as fc
    from panelcast.plans.features import build_features
    from panelcast.spec import FeatureConfig, SeriesSpec

    rng = np.random.default_rng(3)
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i * 2), None if rng.random() < 0.1 else float(rng.integers(0, 50)))
            for k, n in (("a", 60), ("b", 9), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, date date, v double")
    spec = SeriesSpec(("k",), "date", "v")
    cfg = FeatureConfig(lags=[1, 5, 20, 64], rolling_windows=[3, 10, 40], categorical=[])
    direct = fc.prediction_features(df, spec, cfg, 30)
    whole = build_features(fc.extend_with_future(df, spec, 30), spec, cfg).filter("__is_future").select(*direct.columns)
    assert values(direct) == values(whole) and direct.count() == 90
