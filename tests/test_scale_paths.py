"""Isolation forest, global rank quantiles, streaming ingest, registry order."""

import datetime as dt
import time

import numpy as np

from panelcast.operators.isoforest import c_factor, isolation_forest_outliers
from panelcast.operators.profile import describe, percentile_set
from panelcast.operators.quantiles import multi_column_quantiles, quantile_table
from panelcast.sources.io import scratch_table_path
from panelcast.streaming.ingest import ingest_available


def test_isolation_forest_flags_planted_anomalies(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(2):
        v = rng.normal(0, 1, 2000)
        v[:20] = rng.normal(9, 0.3, 20)
        rows += [(k, i, float(x)) for i, x in enumerate(v)]
    rows.append((0, 9999, None))                      # mean-filled, never the most anomalous
    df = spark.createDataFrame(rows, "k INT, t INT, v DOUBLE")
    out = isolation_forest_outliers(df, "v", ["k"]).toPandas()
    assert len(out) == len(rows)
    rate = out.groupby("k").is_outlier.mean()
    assert ((rate > 0.08) & (rate < 0.12)).all()      # contamination 0.1
    assert out[out.t < 20].is_outlier.all()
    again = isolation_forest_outliers(df, "v", ["k"]).toPandas()
    a = out.sort_values(["k", "t"]).anomaly_score.to_numpy()
    b = again.sort_values(["k", "t"]).anomaly_score.to_numpy()
    assert np.allclose(a, b)                          # deterministic
    assert c_factor(256) > c_factor(2) == 1.0


def test_global_rank_quantiles(spark):
    rng = np.random.default_rng(1)
    a, b = rng.exponential(5, 3001).round(1), rng.normal(0, 1, 997)
    rows = [(float(x), float(b[i]) if i < len(b) else None) for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE").repartition(6)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    q = quantile_table(df, "a", probs).first()["__q"]
    assert np.allclose(q, np.percentile(a, [p * 100 for p in probs]))
    multi = {r["feature"]: r["__q"] for r in multi_column_quantiles(df, ["a", "b"], probs).collect()}
    assert np.allclose(multi["b"], np.percentile(b, [p * 100 for p in probs]))
    d = {r["feature"]: r for r in describe(df, ["a", "b"]).collect()}
    assert np.isclose(d["b"]["p75"], np.percentile(b, 75)) and d["b"]["count"] == 997
    p = percentile_set(df, "a").first()
    assert np.isclose(p["p95"], np.percentile(a, 95))


def test_streaming_ingest_gate(spark):
    src = scratch_table_path(spark, "drop")
    rows = [("2020-01-01", "1", "A", "5"), ("bad", "1", "A", "2"), ("2020-01-02", "2", "B", "x")]
    spark.createDataFrame(rows, "date STRING, store STRING, item STRING, sales STRING") \
        .coalesce(1).write.option("header", True).csv(src)
    table, rejects = scratch_table_path(spark, "tbl"), scratch_table_path(spark, "rej")
    ckpt = scratch_table_path(spark, "ck")
    out = ingest_available(spark, src, table, rejects, checkpoint=ckpt)
    assert out.collect()[0]["date"] == dt.date(2020, 1, 1) and out.count() == 1
    assert spark.read.parquet(rejects).count() == 2
    # a new file is picked up by the same stream checkpoint; old files are not re-read
    spark.createDataFrame([("2020-01-03", "1", "A", "7")], "date STRING, store STRING, item STRING, sales STRING") \
        .write.mode("append").option("header", True).csv(src)
    time.sleep(1)
    out2 = ingest_available(spark, src, table, rejects, checkpoint=ckpt)
    assert out2.count() == 2


def test_isolation_forest_global_lookup_equals_window(spark):
    from panelcast.operators.isoforest import isolation_forest_scores

    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, 3000)
    v[:10] = 7.0
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "t INT, v DOUBLE")
    a = isolation_forest_scores(df, "v", [], global_scoring="lookup").toPandas().sort_values("t")
    b = isolation_forest_scores(df, "v", [], global_scoring="window").toPandas().sort_values("t")
    assert np.allclose(a.anomaly_score.to_numpy(), b.anomaly_score.to_numpy(), rtol=1e-12)


def test_global_paths_match_keyed_single_series(spark):
    """keys=[] paths (ordered top-k, global rank, distributed mode) give the
    same answer as the keyed paths on a single series."""
    from pyspark.sql import functions as F

    from panelcast.operators.diagnostics import shapiro_wilk
    from panelcast.operators.impute import mode_fill
    from panelcast.operators.profile import qq_points

    rng = np.random.default_rng(4)
    rows = [(0, i, float(v) if i % 17 else None) for i, v in enumerate(rng.integers(0, 9, 600))]
    df = spark.createDataFrame(rows, "k INT, t INT, v DOUBLE")
    g = shapiro_wilk(df, "v", []).first()
    k = shapiro_wilk(df, "v", ["k"]).first()
    assert g["n"] == k["n"] == 564 and abs(g["shapiro_stat"] - k["shapiro_stat"]) < 1e-12
    qg = qq_points(df, "v", []).orderBy("rank").toPandas()
    qk = qq_points(df, "v", ["k"]).orderBy("rank").toPandas()
    assert np.allclose(qg.theoretical, qk.theoretical) and (qg.value.to_numpy() == qk.value.to_numpy()).all()
    mg = mode_fill(df, ["v"]).filter(F.col("t") == 0).first()["v"]
    mk = mode_fill(df, ["v"], ["k"]).filter(F.col("t") == 0).first()["v"]
    assert mg == mk
    empty = mode_fill(df.filter("v > 100"), ["v"])
    assert empty.count() == 0 and "v" in empty.columns
