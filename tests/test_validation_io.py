import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.plans import validation as val
from panelcast.sources import io
from panelcast.sources.io import scratch_table_path


def test_global_index_and_folds(spark):
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=d), float(d)) for k in range(7) for d in range(50)]
    df = spark.createDataFrame(rows, "k INT, date DATE, v DOUBLE").repartition(5)
    folded = val.time_series_folds(df, ["date", "k"], 5)
    path = scratch_table_path(spark, "folds")
    folded.write.parquet(path)
    f = spark.read.parquet(path).toPandas()
    assert sorted(f.row_index) == list(range(350))
    f = f.sort_values("row_index")
    assert (f[["date", "k"]].to_records(index=False).tolist()
            == sorted(f[["date", "k"]].to_records(index=False).tolist()))
    t = 350 // 6
    assert f.val_fold.value_counts().to_dict() == {i: t for i in range(1, 6)}
    tf = spark.read.parquet(path)
    for i in range(1, 6):
        tr, va = val.fold_split(tf, i)
        assert tr.agg(F.max("row_index")).first()[0] < va.agg(F.min("row_index")).first()[0]
        assert tr.count() == 350 - (6 - i) * t


def test_metrics(spark):
    y = np.array([0.0, 2.0, 4.0, 0.0, 5.0])
    p = np.array([0.0, 1.0, 5.0, 1.0, 5.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y DOUBLE, p DOUBLE")
    m = val.metrics(df, "y", "p").first()
    assert np.isclose(m["mae"], np.abs(y - p).mean())
    assert np.isclose(m["rmse"], np.sqrt(((y - p) ** 2).mean()))
    den = (np.abs(y) + np.abs(p)) / 2
    sm = np.where(den != 0, np.abs(p - y) / np.where(den == 0, 1, den), 0).mean() * 100
    assert np.isclose(m["smape"], sm)
    assert np.isclose(m["mape"], (np.abs(y - p) / np.maximum(np.abs(y), np.finfo(float).eps)).mean())
    e = val.weighted_ensemble(df, ["y", "p"]).first()
    assert e["ensemble"] == 0.0


def test_ingest_gate_rejects(spark):
    raw = spark.createDataFrame([("2020-01-01", "1", "A", "5"), ("not a date", "1", "A", "3"),
                                 ("2020-01-03", "1", "A", "lots"), ("2020-01-04", "1", "A", None)],
                                "date STRING, store STRING, item STRING, sales STRING")
    valid, rejected = io.ingest_gate(raw)
    assert valid.count() == 1
    reasons = sorted(r["reject_reason"] for r in rejected.collect())
    assert reasons == ["invalid date", "invalid sales", "missing sales"]
    with pytest.raises(ValueError, match="sales"):
        io.ingest_gate(raw.drop("sales"))


def test_csv_roundtrip(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 1, "A", 5)], "date DATE, store INT, item STRING, sales BIGINT")
    path = scratch_table_path(spark, "csv")
    io.write_csv(df, path)
    back = io.load_panel_csv(spark, path, io.COUNT_SCHEMA)
    assert back.dtypes == df.dtypes and back.collect() == df.collect()


def test_folds_snap_to_dates(spark):
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=d), 1.0) for k in range(3) for d in range(20)]
    df = spark.createDataFrame(rows, "k INT, date DATE, v DOUBLE")
    f = val.time_series_folds(df, ["date", "k"], 4, boundary="date").toPandas()
    assert sorted(f.row_index) == list(range(60))
    folded = spark.createDataFrame(f)
    sizes = [sum(x.count() for x in val.fold_split(folded, i)) for i in range(1, 5)]
    assert all(s == sizes[0] or s >= 1 for s in sizes)
    per_date = f.groupby("date").val_fold.nunique(dropna=False)
    assert (per_date == 1).all()
    for i in range(1, 5):
        tr, va = val.fold_split(folded, i)
        if va.count():
            assert tr.agg(F.max("date")).first()[0] < va.agg(F.min("date")).first()[0]
            # every row before the validation block is trained on
            assert tr.count() == f[f.split_index < va.agg(F.min("split_index")).first()[0]].shape[0]


def test_last_n_global_and_keyed(spark):
    from panelcast.operators.relational import last_n

    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=d)) for k in range(3) for d in range(10)]
    df = spark.createDataFrame(rows, "k INT, date DATE")
    assert last_n(df, ["k"], "date", 4).count() == 12
    g = last_n(df, [], "date", 4).collect()
    assert len(g) == 4 and min(r["date"] for r in g) == dt.date(2020, 1, 9)


def test_model_registry_newest_first(spark):
    import time as _time

    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from panelcast.sources import models as reg

    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x DOUBLE, y DOUBLE")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y")])
    m1, m2 = pipe.fit(df), pipe.fit(df)
    base = scratch_table_path(spark, "registry")
    p1 = reg.save_model(spark, m1, base, {"mae": 1.0}, ["x"])
    _time.sleep(1.1)
    p2 = reg.save_model(spark, m2, base, {"mae": 0.5}, ["x"])
    listed = [r["model_path"] for r in reg.list_models(spark, base).collect()]
    assert listed == [p2, p1] and reg.latest_model_path(spark, base) == p2
    loaded = reg.load_model(p2)
    a = [r["prediction"] for r in m2.transform(df).orderBy("x").collect()]
    b = [r["prediction"] for r in loaded.transform(df).orderBy("x").collect()]
    assert a == b


def test_csv_load_loses_no_row(spark):
    path = scratch_table_path(spark, "csv")
    spark.createDataFrame([("2020-01-01", "1", "A", "12.5"), ("2020-01-02", "1", "A", "7"), ("no date", "1", "A", "3"), ("2020-01-04", "1", "A", None)],
                          "date STRING, store STRING, item STRING, sales STRING").write.option("header", True).csv(path)
    valid, rejected = io.load_panel_csv(spark, path, rejects="return")
    assert sorted(r["sales"] for r in valid.collect()) == [7.0, 12.5]
    assert sorted(r["reject_reason"] for r in rejected.collect()) == ["invalid date", "missing sales"]
    with pytest.raises(Exception, match="row rejected"):
        io.load_panel_csv(spark, path).collect()
