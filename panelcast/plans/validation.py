"""Time-ordered validation and error metrics.

Global row numbering without a single-partition sort: ``orderBy`` range-
partitions the rows into sorted partitions; ``monotonically_increasing_id``
carries (partition, position); per-partition counts (one row per partition)
give the offsets, which are broadcast back.  This is the distributed form of
"sort by date, then take contiguous index ranges".  The sorted, tagged rows
are checkpointed once (reliable checkpoint in ``spark.checkpoint.dir``):
the counts and the join must see the same physical partitioning, which a
second evaluation of the sort does not guarantee.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16  # float64 machine epsilon (MAPE denominator floor)
POS_BITS = 33


def global_row_index(df: DataFrame, order_cols, out: str = "row_index") -> DataFrame:
    """0-based index of every row in ``order_cols`` order (ties broken by the
    later columns; pass a unique combination for a deterministic index)."""
    from panelcast.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    s = df.orderBy(*order_cols).select(
        "*", F.spark_partition_id().alias("__pid"),
        (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << POS_BITS) - 1))).alias("__pos"))
    s = s.checkpoint(eager=True)
    counts = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))
    offs = counts.select("__pid", F.coalesce(F.sum("__c").over(
        Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    # one row per partition: a proven small broadcast
    j = s.join(F.broadcast(offs), "__pid")
    return j.withColumn(out, (F.col("__off") + F.col("__pos")).cast("long")).drop("__pid", "__pos", "__off")


def time_series_folds(df: DataFrame, order_cols, n_splits: int = 5, boundary: str = "row") -> DataFrame:
    """TimeSeriesSplit (L2): adds ``row_index`` and ``val_fold`` (1-based fold
    whose validation block holds the row; null for rows only ever trained on).
    Fold i trains on ``row_index < fold_start(i)``.

    ``boundary="date"`` snaps fold borders to whole values of the first order
    column: every row takes the index of the first row of its date, so one
    date never straddles train and validation.

    The index is the count of rows on earlier dates (a running sum over one
    row per date) plus the place among the rows of the date: one exchange by
    date, no sort of the whole table."""
    first, rest = order_cols[0], list(order_cols[1:])
    # rows before each value of the first order column: a running sum over its counts (one row per date)
    counts = df.groupBy(first).agg(F.count(F.lit(1)).alias("__c"))
    run = Window.orderBy(first)
    before = counts.select(F.col(first).alias("__first"),
                           F.coalesce(F.sum("__c").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("split_index"),
                           F.sum("__c").over(Window.partitionBy()).alias("__n"))
    j = df.join(before, F.col(first).eqNullSafe(F.col("__first"))).drop("__first")
    within = Window.partitionBy(first).orderBy(*(rest or [first]))
    j = j.withColumn("row_index", (F.col("split_index") + F.row_number().over(within) - 1).cast("long"))
    if boundary != "date":
        j = j.withColumn("split_index", F.col("row_index"))
    t = F.floor(F.col("__n") / (n_splits + 1))
    start = F.col("__n") - n_splits * t
    fold = F.when((t > 0) & (F.col("split_index") >= start),
                  F.floor((F.col("split_index") - start) / t) + 1)
    return j.withColumn("val_fold", fold.cast("int")).withColumn(
        "fold_size", t.cast("long")).withColumn("first_val_index", start.cast("long")).drop("__n")


def fold_split(folded: DataFrame, fold: int):
    """(train, validation) frames of fold ``fold`` (1-based)."""
    start = F.col("first_val_index") + (fold - 1) * F.col("fold_size")
    train = folded.filter(F.col("split_index") < start)
    val = folded.filter(F.col("val_fold") == fold)
    return train, val


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def smape(y: Column, p: Column) -> Column:
    den = (F.abs(y) + F.abs(p)) / 2.0
    return F.avg(F.when(den != 0, F.abs(p - y) / den).otherwise(F.lit(0.0))) * 100.0


def mape(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPS)))


def metrics(df: DataFrame, y: str, p: str, by=()) -> DataFrame:
    """MAE, RMSE, SMAPE (percent) and MAPE (fraction)."""
    yy, pp = F.col(y).cast("double"), F.col(p).cast("double")
    aggs = [mae(yy, pp).alias("mae"), rmse(yy, pp).alias("rmse"), smape(yy, pp).alias("smape"),
            mape(yy, pp).alias("mape"), F.count(F.lit(1)).cast("bigint").alias("n")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def fold_metrics(scored: DataFrame, y: str, p: str, fold_col: str = "val_fold") -> DataFrame:
    """Per-fold metrics plus their unweighted average (L8), fold 0 = average."""
    per = metrics(scored.filter(F.col(fold_col).isNotNull()), y, p, by=[fold_col]).drop("mape")
    avg = per.agg(F.lit(0).alias(fold_col), F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"),
                  F.avg("smape").alias("smape"), F.sum("n").cast("bigint").alias("n"))
    return per.select(F.col(fold_col).cast("int").alias(fold_col), "mae", "rmse", "smape", "n").unionByName(
        avg.select(F.col(fold_col).cast("int").alias(fold_col), "mae", "rmse", "smape", "n"))


def weighted_ensemble(df: DataFrame, pred_cols, weights: dict | None = None, out: str = "ensemble") -> DataFrame:
    """Weighted sum of prediction columns (L14); default weights 1/n, not normalised."""
    weights = weights or {c: 1.0 / len(pred_cols) for c in pred_cols}
    expr = sum((F.lit(float(weights[c])) * F.col(c).cast("double") for c in pred_cols), F.lit(0.0))
    return df.withColumn(out, expr)
