"""Outlier detection.

Each detector returns the input rows with a boolean mask column (null
values and NaN are never flagged) plus the per-group bounds it used.  Group
statistics are keyed aggregates joined back on the keys (C3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.numeric import numeric, round_dec
from panelcast.operators.quantiles import attach_quantiles
from panelcast.operators.relational import with_group_stat


def iqr_outliers(df: DataFrame, col: str, keys=(), k: float = 1.5, out: str = "is_outlier") -> DataFrame:
    """IQR rule (J1): x < Q1 - k*IQR or x > Q3 + k*IQR (strict)."""
    x = numeric(col)
    j = attach_quantiles(df, x, [0.25, 0.75], list(keys))
    q1, q3 = F.col("__q")[0], F.col("__q")[1]
    lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
    j = j.withColumn("lower_bound", lo).withColumn("upper_bound", hi)
    mask = F.coalesce((x < F.col("lower_bound")) | (x > F.col("upper_bound")), F.lit(False))
    return j.withColumn(out, mask).drop("__q")


def zscore_outliers(df: DataFrame, col: str, keys=(), threshold: float = 3.0, out: str = "is_outlier") -> DataFrame:
    """Z-score rule (J2): |x - mean| / population std > threshold."""
    if not 2.0 <= threshold <= 4.0:
        raise ValueError("threshold must be within [2.0, 4.0]")
    x = numeric(col)
    j = with_group_stat(df, list(keys), F.avg(x).alias("__m"), F.stddev_pop(x).alias("__s"))
    z = F.abs(x - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))
    return j.withColumn("zscore", z).withColumn(out, F.coalesce(z > threshold, F.lit(False))).drop("__m", "__s")


def modified_zscore_outliers(df: DataFrame, col: str, keys=(), threshold: float = 3.5,
                             out: str = "is_outlier") -> DataFrame:
    """Modified z-score (J3): |0.6745 (x - median) / MAD| > threshold, MAD =
    median |x - median| (null-skipping); MAD = 0 flags every x != median."""
    if not 2.0 <= threshold <= 4.0:
        raise ValueError("threshold must be within [2.0, 4.0]")
    keys = list(keys)
    x = numeric(col)
    j = attach_quantiles(df, x, [0.5], keys, out="__medq").withColumn("__med", F.col("__medq")[0]).drop("__medq")
    j = attach_quantiles(j, F.abs(x - F.col("__med")), [0.5], keys, out="__madq") \
        .withColumn("__mad", F.col("__madq")[0]).drop("__madq")
    dev = F.abs(F.lit(0.6745) * (x - F.col("__med")))
    flagged = F.when(F.col("__mad") == 0, x != F.col("__med")).otherwise(dev / F.col("__mad") > threshold)
    score = F.when(F.col("__mad") != 0, dev / F.col("__mad"))
    return j.withColumn("modified_zscore", score).withColumn(out, F.coalesce(flagged, F.lit(False))) \
        .drop("__med", "__mad")


METHODS = {"iqr": iqr_outliers, "zscore": zscore_outliers, "modified_zscore": modified_zscore_outliers}


def _flag_keyed_fused(df: DataFrame, col: str, keys, methods) -> DataFrame:
    """IQR, z-score and modified z-score masks from two keyed aggregate
    passes (quartiles + median + mean + population std, then MAD) instead of
    one pass per method; same formulas as the single-method operators."""
    x = numeric(col)
    j = with_group_stat(df, keys, F.percentile(x, [0.25, 0.5, 0.75]).alias("__q"), F.avg(x).alias("__m"),
                        F.stddev_pop(x).alias("__s"))
    j = j.withColumn("__med", F.col("__q")[1])
    if "modified_zscore" in methods:
        j = with_group_stat(j, keys, F.percentile(F.abs(x - F.col("__med")), 0.5).alias("__mad"))
    masks = []
    if "iqr" in methods:
        q1, q3 = F.col("__q")[0], F.col("__q")[2]
        cond = (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))
        masks.append(F.coalesce(cond, F.lit(False)).alias("is_outlier_iqr"))
    if "zscore" in methods:
        z = F.abs(x - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))
        masks.append(F.coalesce(z > 3.0, F.lit(False)).alias("is_outlier_zscore"))
    if "modified_zscore" in methods:
        dev = F.abs(F.lit(0.6745) * (x - F.col("__med")))
        flagged = F.when(F.col("__mad") == 0, x != F.col("__med")).otherwise(dev / F.col("__mad") > 3.5)
        masks.append(F.coalesce(flagged, F.lit(False)).alias("is_outlier_modified_zscore"))
    return j.select(*[F.col(c) for c in df.columns], *masks)


def flag_all(df: DataFrame, col: str, keys=(), methods=("iqr", "zscore", "modified_zscore")) -> DataFrame:
    """All selected masks side by side: ``is_outlier_<method>`` (default
    thresholds).  Keyed classical methods share their aggregate passes; the
    isolation forest always sees the input rows as given."""
    keys = list(keys)
    out = df
    if "isolation_forest" in methods:
        from panelcast.operators.isoforest import isolation_forest_outliers

        out = isolation_forest_outliers(df, col, keys, out="is_outlier_isolation_forest").drop("anomaly_score")
    classical = [m for m in methods if m in METHODS]
    if keys and classical:
        return _flag_keyed_fused(out, col, keys, classical)
    for m in classical:
        base_cols = out.columns
        out = METHODS[m](out, col, keys, out=f"is_outlier_{m}")
        out = out.select(*base_cols, f"is_outlier_{m}")
    return out


def method_comparison(flagged: DataFrame, methods, keys=()) -> DataFrame:
    """Method comparison (J5): outliers found and % of all rows (2 dp)."""
    keys = list(keys)
    aggs = [F.count(F.lit(1)).alias("__n")] + [
        F.count_if(F.col(f"is_outlier_{m}")).alias(f"__c{i}") for i, m in enumerate(methods)]
    wide = flagged.groupBy(*keys).agg(*aggs) if keys else flagged.agg(*aggs)
    structs = [F.struct(F.lit(m).alias("method"), F.col(f"__c{i}").cast("bigint").alias("outliers_found"),
                        round_dec(F.try_divide(F.col(f"__c{i}") * 100.0, F.col("__n")), 2).alias("percentage"))
               for i, m in enumerate(methods)]
    return wide.select(*keys, F.explode(F.array(*structs)).alias("s")).select(*keys, "s.*")


def outlier_rows(flagged: DataFrame, col: str, methods, keys=(), date_col: str = "date") -> DataFrame:
    """Outlier rows per method (J6): (keys, date, value, method)."""
    keys = list(keys)
    structs = [F.struct(F.lit(m).alias("method"), F.col(f"is_outlier_{m}").alias("__f")) for m in methods]
    long = flagged.select(*keys, date_col, F.col(col).cast("double").alias("value"),
                          F.explode(F.array(*structs)).alias("s"))
    return long.filter(F.col("s.__f")).select(*keys, date_col, "value", F.col("s.method").alias("method"))
