"""Projections, filters, limits, joins and set operations on panels (B, C, G, K0, K1).

Conventions: ``keys`` is a list of series key columns (``[]`` = whole frame),
dates are ``DateType``.  Nothing here collects data to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null matches null; one set of key columns.

    ``right``'s other columns follow ``left``'s.  Null-safe equality is still
    a hashed join key, so the plan is that of an ordinary equi-join."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    for c in cond[1:]:
        cond[0] = cond[0] & c
    return left.join(renamed, cond[0], how).drop(*[f"__r_{k}" for k in keys])


def with_group_stat(df: DataFrame, keys: list[str], *stats: Column) -> DataFrame:
    """Scalar broadcast (C3): attach per-key (or global) aggregates to every row.

    Keyed: aggregate by key, then join on the key (the stats table has one row
    per key, the planner/AQE chooses broadcast or shuffle by its size).  Global:
    the one-row aggregate is cross-joined with a broadcast hint, which is
    always safe (exactly one row).  No unpartitioned window is used.
    """
    if keys:
        agg = df.groupBy(*keys).agg(*stats)
        return join_on_keys(df, agg, keys, "left")
    agg = df.agg(*stats)
    return df.crossJoin(F.broadcast(agg))


def series_slice(df: DataFrame, key_values: dict, date_col: str = "date", lo=None, hi=None) -> DataFrame:
    """Series slice (B1): equality on keys, inclusive date range, date order."""
    cond = F.lit(True)
    for k, v in key_values.items():
        cond = cond & (F.col(k) == F.lit(v))
    out = df.filter(cond)
    if lo is not None or hi is not None:
        out = date_range_filter(out, date_col, lo, hi)
    return out.orderBy(date_col)


def date_range_filter(df: DataFrame, date_col: str, lo=None, hi=None) -> DataFrame:
    """Date-range filter (B2), inclusive on both ends; pushed to the scan."""
    c = F.col(date_col)
    if lo is not None:
        df = df.filter(c >= F.to_date(F.lit(str(lo))))
    if hi is not None:
        df = df.filter(c <= F.to_date(F.lit(str(hi))))
    return df


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct sorted key values."""
    return df.select(col).distinct().orderBy(col)


def date_extent(df: DataFrame, date_col: str = "date", keys: list[str] | None = None) -> DataFrame:
    """Date extent (B4): min and max date, per key or global."""
    aggs = [F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def preview(df: DataFrame, cols: list[str], order: list[str], n: int = 20) -> DataFrame:
    """Column projection preview (B5) / first-N (B6) with an explicit order
    (TakeOrderedAndProject, no full sort)."""
    return df.select(*cols).orderBy(*order).limit(n)


def timeline(df: DataFrame, features: list[str], date_col: str = "date",
             keys: list[str] | None = None) -> DataFrame:
    """Timeline projection (B5a): long form ``(keys, date, feature, value)``."""
    ids = list(keys or []) + [date_col]
    cast = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    return cast.unpivot(ids, features, "feature", "value")


def last_n(df: DataFrame, keys: list[str], order_col: str, n: int) -> DataFrame:
    """Last-N rows of every series (B7); one series (``keys=[]``) is an
    ordered top-k, not a whole-table window."""
    if not keys:
        return df.orderBy(F.col(order_col).desc()).limit(n)
    w = Window.partitionBy(*keys).orderBy(F.col(order_col).desc())
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows with a null in any of ``cols``."""
    return df.na.drop(subset=cols)


def drop_incomplete_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Row counts before/after the null drop (B8, D16), one aggregate pass."""
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("rows_before"),
        F.count_if(complete).cast("bigint").alias("rows_after"),
        F.count_if(~complete).cast("bigint").alias("rows_dropped"),
    )


def semi_join_keys_dates(df: DataFrame, spine: DataFrame, keys: list[str], date_col: str = "date") -> DataFrame:
    """Membership filter on future (keys, date) pairs."""
    pairs = spine.select(*[F.col(k).alias(f"__r_{k}") for k in [*keys, date_col]])
    cond = F.col(date_col) == F.col(f"__r_{date_col}")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return df.join(pairs, cond, "left_semi")


def format_forecast(pred: Column) -> Column:
    """Round half to even, clip at 0, integer."""
    return F.greatest(F.bround(pred, 0), F.lit(0.0)).cast("bigint")


def union_history_future(history: DataFrame, future: DataFrame, cols: list[str]) -> DataFrame:
    """Union-all of history and future rows with a fixed column list (G1)."""
    return history.select(*cols).unionByName(future.select(*cols))


def densify_daily(df: DataFrame, keys: list[str], date_col: str = "date") -> DataFrame:
    """Daily densify (K0): every day from each series' first to last date.

    The spine per series is ``explode(sequence(min, max))`` (bounded by the
    calendar span of that series), then left-joined with the data on
    (keys, date).  Non-key columns are null on the added days.
    """
    ext = df.groupBy(*keys).agg(F.min(date_col).alias("__lo"), F.max(date_col).alias("__hi"))
    spine = ext.select(*keys, F.explode(F.sequence("__lo", "__hi")).alias(date_col))
    cols = [*keys, date_col, *[c for c in df.columns if c not in {*keys, date_col}]]
    return join_on_keys(spine, df, [*keys, date_col], "left").select(*cols)


def future_spine(df: DataFrame, keys: list[str], date_col: str = "date", horizon: int = 90) -> DataFrame:
    """Future spine (K1): last date + 1 ... + horizon for every series."""
    if not 1 <= horizon <= 365:
        raise ValueError("horizon must be between 1 and 365 days")
    last = df.groupBy(*keys).agg(F.max(date_col).alias("__last"))
    return last.select(
        *keys,
        F.explode(F.sequence(F.date_add("__last", 1), F.date_add("__last", horizon))).alias(date_col),
    )


def grain_violations(df: DataFrame, keys, date_col: str = "date") -> DataFrame:
    """Panel grain check: (keys, date) pairs that occur more than once, with
    their count.  A daily panel has one row per key and day, which is what
    bounds every per-series window partition by the calendar."""
    return df.groupBy(*keys, date_col).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
