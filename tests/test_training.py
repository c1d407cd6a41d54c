import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from panelcast.plans import forecast as fc
from panelcast.plans import training as tr
from panelcast.plans import validation as val
from panelcast.sources import models as reg
from panelcast.sources.io import scratch_table_path
from panelcast.spec import FeatureConfig, SeriesSpec


def _seasonal_panel(spark, days=400):
    rng = np.random.default_rng(0)
    base = dt.date(2019, 1, 1)
    rows = []
    for store in (1, 2):
        for item in ("A", "B"):
            lvl = 20 + 10 * store + (5 if item == "B" else 0)
            for i in range(days):
                d = base + dt.timedelta(days=i)
                v = lvl + 8 * (d.weekday() >= 5) + 4 * (d.weekday() == 0) + rng.normal(0, 3)
                rows.append((store, item, d, int(round(v))))
    return spark.createDataFrame(rows, "store INT, item STRING, date DATE, sales BIGINT")


def test_train_beats_naive_and_roundtrip(spark):
    df = _seasonal_panel(spark)
    cfg = FeatureConfig(lags=[7, 14], rolling_windows=[7, 28], rolling_aggs=["mean", "std"])
    # every tree is shrunk by the step, the first one too: 15 steps of 0.05 would go half of the way only
    tcfg = tr.TrainConfig(max_iter=15, n_splits=3, step_size=0.2)
    model_dir = scratch_table_path(spark, "models-test")
    res = tr.train_pipeline(spark, df, SeriesSpec(), cfg, tcfg, model_dir=model_dir)
    cv = {r["fold"]: r for r in res.cv_metrics.collect()}
    assert set(cv) == {0, 1, 2, 3}
    oof = res.oof.toPandas()
    assert oof.row_index.is_unique and len(oof) == sum(cv[i]["n"] for i in (1, 2, 3))
    # naive lag-7 error on the same validation rows
    from panelcast.operators.windows import lag_features
    nv = lag_features(df, ["store", "item"], "date", "sales", [7]).join(
        res.oof.select("store", "item", "date"), ["store", "item", "date"])
    naive = val.metrics(nv.withColumn("y", F.col("sales").cast("double")), "y", "sales_lag_7").first()["mae"]
    assert cv[0]["mae"] < naive
    # registry + reload gives identical predictions
    path = reg.latest_model_path(spark, model_dir)
    assert path and reg.list_models(spark, model_dir).count() == 1
    loaded = reg.load_model(path)
    cols = tr.model_input_columns(loaded)
    f1 = fc.forecast(res.model, df, SeriesSpec(), cfg, 30, input_cols=cols).orderBy("store", "item", "date")
    f2 = fc.forecast(loaded, df, SeriesSpec(), cfg, 30, input_cols=cols).orderBy("store", "item", "date")
    a, b = f1.collect(), f2.collect()
    assert len(a) == 4 * 30 and a == b
    assert all(r["forecast"] >= 0 for r in a)
    imp = tr.top_importances(spark, res.model, 5).collect()
    assert len(imp) == 5 and imp[0]["importance"] >= imp[-1]["importance"]


def test_category_indexer_reused(spark):
    df = _seasonal_panel(spark, 60)
    pipe = tr.make_pipeline(["store", "item"], ["store", "item"],
                            __import__("pyspark.ml.regression", fromlist=["x"]).LinearRegression(labelCol="sales"))
    m = pipe.fit(df.withColumn("sales", F.col("sales").cast("double")))
    unseen = spark.createDataFrame([(9, "Z", dt.date(2020, 1, 1), 0.0)], "store INT, item STRING, date DATE, sales DOUBLE")
    assert m.transform(unseen).count() == 1       # handleInvalid="keep"


def test_features_are_worked_out_once(spark, monkeypatch):
    """Folds read their table twice: it holds finished features, no windows."""
    seen, folds = [], val.time_series_folds

    def spy(df, *args):
        seen.append(df._jdf.queryExecution().toString())
        return folds(df, *args)

    monkeypatch.setattr(val, "time_series_folds", spy)
    cfg = FeatureConfig(lags=[7], rolling_windows=[7], rolling_aggs=["mean"])
    res = tr.train_pipeline(spark, _seasonal_panel(spark, 60), SeriesSpec(), cfg, tr.TrainConfig(max_iter=1, n_splits=2))
    assert len(seen) == 1 and "Window" not in seen[0]
    assert res.oof.count() == 2 * (4 * 53 // 3)
