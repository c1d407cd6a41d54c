"""Catalog: sources, projections, filters, joins, set operations (A, B, C, G, K0, K1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import relational as rel
from panelcast.operators import windows as win
from panelcast.plans.catalog import KEYS, PART, register
from panelcast.sources import io
from panelcast.sources.tables import (DAILY_SALES_DENSE_SQL, DAILY_SALES_SQL, daily_sales,
                                      daily_sales_dense, with_sql)

DS = with_sql(DAILY_SALES_SQL)
DSD = with_sql(DAILY_SALES_SQL, DAILY_SALES_DENSE_SQL)


@register("csv_roundtrip", DS + "SELECT store, item, date, sales FROM daily_sales")
def csv_roundtrip(spark, sf):
    """Export the panel as CSV, scan it back with an explicit
    schema and the presence/type gate."""
    path = io.scratch_table_path(spark, "csv_roundtrip")
    io.write_csv(daily_sales(spark, sf), path)
    return io.load_panel_csv(spark, path, io.COUNT_SCHEMA, io.REQUIRED_TRAIN_COLS)


@register("ingest_gate_counts", DS + """, up AS (SELECT CASE
    WHEN day(date) = 1 THEN 'invalid date' WHEN day(date) = 2 THEN 'missing store'
    WHEN day(date) = 3 THEN 'invalid sales' ELSE 'valid' END AS outcome FROM daily_sales)
SELECT outcome, CAST(COUNT(*) AS BIGINT) AS n_rows FROM up GROUP BY outcome""")
def ingest_gate_counts(spark, sf):
    """A3: validate an upload-shaped (all-string) copy of the panel in which
    some days have a bad date, no store, sales that are no number, or sales
    with decimals (which are fine); rows by outcome."""
    day = F.dayofmonth("date")
    raw = daily_sales(spark, sf, shared=True).select(
        F.when(day == 1, F.lit("first of month")).otherwise(F.col("date").cast("string")).alias("date"),
        F.when(day != 2, F.col("store").cast("string")).alias("store"), "item",
        F.when(day == 3, F.lit("lots")).when(day == 4, F.concat(F.col("sales").cast("string"), F.lit(".5")))
        .otherwise(F.col("sales").cast("string")).alias("sales"))
    valid, rejected = io.ingest_gate(raw)
    outcomes = valid.select(F.lit("valid").alias("outcome")).union(rejected.select("reject_reason"))
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@register("series_slice", DS + """SELECT store, item, date, sales FROM daily_sales
WHERE store = 1 AND item = 'STANDARD' AND date >= DATE '1996-01-01' AND date <= DATE '1997-12-31'""")
def series_slice(spark, sf):
    """B1: one (store, item) series within an inclusive date range."""
    return rel.series_slice(daily_sales(spark, sf), {"store": 1, "item": "STANDARD"}, "date",
                            "1996-01-01", "1997-12-31")


@register("date_range_filter", DS + """SELECT store, item, date, sales FROM daily_sales
WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""")
def date_range_filter(spark, sf):
    """B2: inclusive date-range filter over all series."""
    return rel.date_range_filter(daily_sales(spark, sf), "date", "1998-01-01", "1998-12-31")


@register("distinct_items", DS + "SELECT DISTINCT item FROM daily_sales")
def distinct_items(spark, sf):
    """Distinct sorted key values."""
    return rel.distinct_values(daily_sales(spark, sf), "item")


@register("date_extent", DS + f"""SELECT {PART}, MIN(date) AS min_date, MAX(date) AS max_date
FROM daily_sales GROUP BY {PART}""")
def date_extent(spark, sf):
    """First and last date of every series."""
    return rel.date_extent(daily_sales(spark, sf), "date", KEYS)


@register("preview_first20", DS + """SELECT store, item, date, sales FROM daily_sales
ORDER BY date, store, item LIMIT 20""")
def preview_first20(spark, sf):
    """First 20 rows in (date, keys) order (a top-k, not a full sort)."""
    return rel.preview(daily_sales(spark, sf), ["store", "item", "date", "sales"], ["date", "store", "item"], 20)


@register("timeline_long", DS + f"""SELECT store, item, date, feature, value FROM (
  SELECT store, item, date, CAST(sales AS DOUBLE) AS sales,
         CAST(lag(sales, 7) OVER (PARTITION BY {PART} ORDER BY date) AS DOUBLE) AS sales_lag_7
  FROM daily_sales)
UNPIVOT INCLUDE NULLS (value FOR feature IN (sales, sales_lag_7))""")
def timeline_long(spark, sf):
    """(keys, date, feature, value) long form of chosen features."""
    f = win.lag_features(daily_sales(spark, sf), KEYS, "date", "sales", [7])
    return rel.timeline(f, ["sales", "sales_lag_7"], "date", KEYS)


@register("last_365_rows", DS + f"""SELECT store, item, date, sales FROM (
  SELECT *, row_number() OVER (PARTITION BY {PART} ORDER BY date DESC) AS rn FROM daily_sales)
WHERE rn <= 365""")
def last_365_rows(spark, sf):
    """Last min(365, n) rows of every series."""
    return rel.last_n(daily_sales(spark, sf), KEYS, "date", 365)


@register("dropna_counts", DS + f"""SELECT CAST(COUNT(*) AS BIGINT) AS rows_before,
  CAST(COUNT(*) FILTER (WHERE l7 IS NOT NULL AND l28 IS NOT NULL) AS BIGINT) AS rows_after,
  CAST(COUNT(*) FILTER (WHERE l7 IS NULL OR l28 IS NULL) AS BIGINT) AS rows_dropped
FROM (SELECT lag(sales, 7) OVER w AS l7, lag(sales, 28) OVER w AS l28 FROM daily_sales
      WINDOW w AS (PARTITION BY {PART} ORDER BY date))""")
def dropna_counts(spark, sf):
    """Rows before and after dropping rows with null features."""
    f = win.lag_features(daily_sales(spark, sf), KEYS, "date", "sales", [7, 28])
    return rel.drop_incomplete_counts(f, ["sales_lag_7", "sales_lag_28", "sales"])


FUTURE_SQL = f"""future AS (
  SELECT store, item, CAST(unnest(generate_series(hi + INTERVAL 1 DAY, hi + INTERVAL 90 DAY, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT {PART}, MAX(date) AS hi FROM daily_sales GROUP BY {PART}))"""


@register("future_spine", with_sql(DAILY_SALES_SQL, FUTURE_SQL) + "SELECT store, item, date FROM future")
def future_spine(spark, sf):
    """K1: the 90 days after each series' last date."""
    return rel.future_spine(daily_sales(spark, sf), KEYS, "date", 90)


@register("history_future_union", with_sql(DAILY_SALES_SQL, FUTURE_SQL) + """
SELECT store, item, date, sales FROM daily_sales
UNION ALL SELECT store, item, date, CAST(NULL AS BIGINT) AS sales FROM future""")
def history_future_union(spark, sf):
    """G1: history rows plus future rows with a null target."""
    ds = daily_sales(spark, sf, shared=True)
    fut = rel.future_spine(ds, KEYS, "date", 90).withColumn("sales", F.lit(None).cast("bigint"))
    return rel.union_history_future(ds, fut, ["store", "item", "date", "sales"])


@register("future_semi_join", with_sql(DAILY_SALES_SQL, FUTURE_SQL) + f"""
SELECT c.store, c.item, c.date, c.sales_lag_91 FROM (
  SELECT u.*, lag(sales, 91) OVER (PARTITION BY {PART} ORDER BY date) AS sales_lag_91 FROM (
    SELECT store, item, date, sales FROM daily_sales
    UNION ALL SELECT store, item, date, NULL FROM future) u) c
WHERE EXISTS (SELECT 1 FROM future f WHERE f.store = c.store AND f.item = c.item AND f.date = c.date)""")
def future_semi_join(spark, sf):
    """Features computed on history + future, keep the future
    (keys, date) pairs by a left-semi join."""
    ds = daily_sales(spark, sf, shared=True)
    fut = rel.future_spine(ds, KEYS, "date", 90)
    both = rel.union_history_future(ds, fut.withColumn("sales", F.lit(None).cast("bigint")),
                                    ["store", "item", "date", "sales"])
    feats = win.lag_features(both, KEYS, "date", "sales", [91])
    return rel.semi_join_keys_dates(feats, fut, KEYS, "date").select("store", "item", "date", "sales_lag_91")


@register("densify_daily", DSD + "SELECT store, item, date, sales FROM daily_sales_dense")
def densify_daily(spark, sf):
    """K0: every calendar day of every series, null target on added days."""
    return daily_sales_dense(spark, sf)


@register("days_since_start", DS + f"""SELECT store, item, date,
  CAST(date_diff('day', MIN(date) OVER (PARTITION BY {PART}), date) AS INTEGER) AS days_since_series_start,
  CAST(date_diff('day', MIN(date) OVER (), date) AS INTEGER) AS days_since_start
FROM daily_sales""")
def days_since_start(spark, sf):
    """Distance to the first date of the series and of the frame
    (keyed aggregate joined back; global one-row aggregate broadcast)."""
    ds = daily_sales(spark, sf, shared=True).select("store", "item", "date")
    a = rel.with_group_stat(ds, KEYS, F.min("date").alias("__s"))
    a = rel.with_group_stat(a, [], F.min("date").alias("__g"))
    return a.select("store", "item", "date",
                    F.datediff("date", "__s").alias("days_since_series_start"),
                    F.datediff("date", "__g").alias("days_since_start"))


@register("forecast_format", DS + f"""SELECT store, item, date,
  CAST(GREATEST(ROUND_EVEN(p, 0), 0) AS BIGINT) AS forecast FROM (
  SELECT store, item, date, (lag(sales, 7) OVER w - 40) / 2.0 AS p
  FROM daily_sales WINDOW w AS (PARTITION BY {PART} ORDER BY date)) WHERE p IS NOT NULL""")
def forecast_format(spark, sf):
    """Round half to even, clip at 0, integer; on a naive prediction
    with many .5 and negative values."""
    f = win.lag_features(daily_sales(spark, sf), KEYS, "date", "sales", [7])
    p = (F.col("sales_lag_7") - 40) / 2.0
    return f.filter(p.isNotNull()).select("store", "item", "date", rel.format_forecast(p).alias("forecast"))



@register("stream_ingest", DS + "SELECT date, store, item, sales FROM daily_sales")
def stream_ingest(spark, sf):
    """A3 as Structured Streaming: the panel is dropped as CSV upload files,
    a file-source stream validates every micro-batch and appends valid rows
    to the training table (rejects to their own table)."""
    from panelcast.streaming.ingest import ingest_available

    drop = io.scratch_table_path(spark, "uploads")
    daily_sales(spark, sf).select(*[F.col(c).cast("string") for c in ["date", "store", "item", "sales"]]) \
        .write.option("header", True).csv(drop)
    return ingest_available(spark, drop, io.scratch_table_path(spark, "train_table"),
                            io.scratch_table_path(spark, "rejects")).withColumn("sales", F.col("sales").cast("bigint"))


@register("forecast_csv_export", with_sql(DAILY_SALES_SQL, FUTURE_SQL) + """
SELECT store, item, COUNT(*) AS n_rows, MIN(date) AS first_date, MAX(date) AS last_date, COUNT(*) AS n_whole,
  store || '_' || item || '_' || strftime(MIN(date), '%Y%m%d') || '_' || strftime(MAX(date), '%Y%m%d') AS name
FROM future GROUP BY store, item""")
def forecast_csv_export(spark, sf):
    """The model's forecast exported as CSV, one folder per series named
    by store, item, first and last date, read back and summarised."""
    from panelcast.plans.q_train import forecast_90d

    path = io.scratch_table_path(spark, "forecast_export")
    io.write_forecast_csv(forecast_90d(spark, sf), path, KEYS, "date")
    back = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return back.groupBy(F.col("store").cast("int").alias("store"), F.col("item"), F.col("name")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.to_date("date")).alias("first_date"),
        F.max(F.to_date("date")).alias("last_date"), F.count_if(F.col("forecast").rlike("^[0-9]+$")).alias("n_whole"))


_EXPORT_LAGS = [7, 28]


@register("feature_csv_export", DS + f"""SELECT store, item, COUNT(*) AS n_rows, {", ".join(
    f"COUNT(l{k}) AS n_lag_{k}, CAST(SUM(l{k}) AS BIGINT) AS sum_lag_{k}" for k in _EXPORT_LAGS)} FROM (
  SELECT store, item, {", ".join(f"lag(sales, {k}) OVER (PARTITION BY store, item ORDER BY date) AS l{k}" for k in _EXPORT_LAGS)}
  FROM daily_sales) GROUP BY store, item""")
def feature_csv_export(spark, sf):
    """A5: the feature frame exported as CSV, read back and summed up by series."""
    from panelcast.plans.features import build_features
    from panelcast.spec import FeatureConfig, SeriesSpec

    path = io.scratch_table_path(spark, "feature_export")
    io.write_csv(build_features(daily_sales(spark, sf), SeriesSpec(), FeatureConfig(lags=_EXPORT_LAGS, rolling_windows=[7])), path)
    back = spark.read.option("header", True).csv(path)
    return back.groupBy(F.col("store").cast("int").alias("store"), "item").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[a for k in _EXPORT_LAGS for a in (F.count(f"sales_lag_{k}").alias(f"n_lag_{k}"),
                                            F.sum(F.col(f"sales_lag_{k}").cast("bigint")).alias(f"sum_lag_{k}"))])


@register("grain_check", """SELECT CAST(n_regionkey AS INTEGER) AS store, p_type AS item,
  CAST(l_shipdate AS DATE) AS date, COUNT(*) AS n_rows
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2, 3 HAVING COUNT(*) > 1""")
def grain_check(spark, sf):
    """Panel grain rule on un-aggregated input: every order line mapped to
    the panel keys, reporting (store, item, date) pairs that occur more than
    once (the aggregation step is what brings the data to panel grain)."""
    from panelcast.sources.tables import table

    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate")
    sup, nat, part = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "part")
    lines = li.join(sup, li.l_suppkey == sup.s_suppkey).join(F.broadcast(nat), F.col("s_nationkey") == nat.n_nationkey) \
        .join(part, li.l_partkey == part.p_partkey) \
        .select(F.col("n_regionkey").cast("int").alias("store"), F.col("p_type").alias("item"),
                F.to_date("l_shipdate").alias("date"))
    return rel.grain_violations(lines, KEYS, "date")


@register("partitioned_panel_pruning", DS + "SELECT store, item, date, sales FROM daily_sales WHERE store = 2")
def partitioned_panel_pruning(spark, sf):
    """A7 / partition pruning: the panel written as parquet partitioned by
    store; a store filter reads only that partition directory."""
    path = io.scratch_table_path(spark, "panel_by_store")
    io.write_table(daily_sales(spark, sf), path, partition_by=["store"])
    panel = io.load_panel_parquet(spark, path)
    return panel.filter(F.col("store") == 2).select("store", "item", "date", "sales")
