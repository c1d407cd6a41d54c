"""Imputation and scaling.

Group statistics are computed with a keyed aggregate and attached with a join
on the keys (C3); the aggregate pre-combines per partition, and AQE's skew
join splits a hot key on the large side.  Fills along time (I5-I7) are the
window operators of ``windows``.  NaN counts as null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from panelcast.functions.numeric import numeric
from panelcast.operators import windows as win
from panelcast.operators.relational import with_group_stat


def _is_numeric(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, NumericType)


def _fill_with(df: DataFrame, cols, keys, stat_fn) -> DataFrame:
    cols = [c for c in cols if _is_numeric(df, c)]
    if not cols:
        return df
    stats = [stat_fn(numeric(c)).alias(f"__s_{i}") for i, c in enumerate(cols)]
    joined = with_group_stat(df, list(keys), *stats)
    idx = {c: i for i, c in enumerate(cols)}
    out = [F.coalesce(numeric(c), F.col(f"__s_{idx[c]}")).alias(c) if c in idx else F.col(c)
           for c in df.columns]
    return joined.select(*out)


def drop_missing(df: DataFrame, col: str) -> DataFrame:
    """Remove rows with a null in ``col``."""
    return df.na.drop(subset=[col])


def mean_fill(df: DataFrame, cols, keys=()) -> DataFrame:
    """Fill nulls with the mean of the column (I2; several columns: I8)."""
    return _fill_with(df, cols, keys, F.avg)


def median_fill(df: DataFrame, cols, keys=()) -> DataFrame:
    """Fill nulls with the exact median (I3); a global median is rank-based
    (bounded memory)."""
    if keys:
        return _fill_with(df, cols, keys, lambda x: F.percentile(x, 0.5))
    from panelcast.operators.quantiles import attach_quantiles

    out = df
    for c in [c for c in cols if _is_numeric(df, c)]:
        out = attach_quantiles(out, c, [0.5], [], out="__medq")
        out = out.withColumn(c, F.coalesce(numeric(c), F.col("__medq")[0])).drop("__medq")
    return out


def mode_fill(df: DataFrame, cols, keys=()) -> DataFrame:
    """Fill nulls with the most frequent value, smallest on ties (I4).  A
    global mode is a distributed count per value and an ordered top-1 (no
    single value->count map)."""
    if keys:
        return _fill_with(df, cols, keys, lambda x: F.mode(x, deterministic=True))
    out = df
    for c in [c for c in cols if _is_numeric(df, c)]:
        x = numeric(c)
        counts = df.filter(x.isNotNull()).groupBy(x.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
        top = counts.orderBy(F.col("__c").desc(), F.col("__v").asc()).limit(1).select(F.col("__v").alias("__mode"))
        one = df.sparkSession.range(1).join(top, F.lit(True), "left").drop("id")   # exactly one row
        out = out.crossJoin(F.broadcast(one)).withColumn(c, F.coalesce(x, F.col("__mode"))).drop("__mode")
    return out


def impute(df: DataFrame, col: str, method: str, keys=(), order_col: str = "date") -> DataFrame:
    """One entry point for the seven methods of the reference."""
    m = method.lower().replace(" ", "_")
    if m == "remove":
        return drop_missing(df, col)
    if not _is_numeric(df, col) and m in ("mean", "median", "mode"):
        return df
    if m == "mean":
        return mean_fill(df, [col], keys)
    if m == "median":
        return median_fill(df, [col], keys)
    if m == "mode":
        return mode_fill(df, [col], keys)
    if m in ("forward_fill", "ffill"):
        return win.fill_columns(df, list(keys), order_col, [col], "ffill")
    if m in ("backward_fill", "bfill"):
        return win.fill_columns(df, list(keys), order_col, [col], "bfill")
    if m in ("interpolate", "linear"):
        return win.interpolate_linear(df, list(keys), order_col, col)
    raise ValueError(f"unknown imputation method {method!r}")


def standard_scale(df: DataFrame, cols, keys=(), suffix: str = "_scaled") -> DataFrame:
    """Standard scaling (I9): (x - mean) / population std, null-skipping, a
    zero std divides by 1."""
    stats = []
    for i, c in enumerate(cols):
        x = numeric(c)
        stats += [F.avg(x).alias(f"__m{i}"), F.stddev_pop(x).alias(f"__s{i}")]
    joined = with_group_stat(df, list(keys), *stats)
    scaled = [((numeric(c) - F.col(f"__m{i}")) /
               F.coalesce(F.nullif(F.col(f"__s{i}"), F.lit(0.0)), F.lit(1.0))).alias(f"{c}{suffix}")
              for i, c in enumerate(cols)]
    return joined.select(*[F.col(c) for c in df.columns], *scaled)
