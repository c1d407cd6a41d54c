"""Exact quantiles with bounded memory (linear interpolation, the numpy /
``quantile_cont`` definition).

Keyed groups use Spark's ``percentile`` aggregate: its buffer is a
value->count map combined per partition, bounded here by the group size (a
daily series has at most one row per day).  A global group (``keys=[]``) over
a fact table has no such bound.  There one pass of quantile sketches gives a
bracket per rank, certain by the sketch's error; a second pass counts the
values below each bracket and, by value, those inside, a few rows in
``ACCURACY``.  Nothing else is shuffled, and rows are never sorted.
``method="approx"`` uses ``percentile_approx``; ``method="map"`` forces the
aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.numeric import numeric
from panelcast.operators.relational import with_group_stat


ACCURACY = 10_000      # a sketch's ranks are off by at most one row in so many


def multi_column_quantiles(df: DataFrame, cols, probs) -> DataFrame:
    """Exact global quantiles of several columns: ``(feature, __q)``.  NaN
    counts as null; a column without values has null quantiles."""
    probs, cols = [float(p) for p in probs], list(cols)
    values = df.select(*[numeric(c).alias(f"__x{i}") for i, c in enumerate(cols)])
    margin = 2.0 / ACCURACY
    asked = [(f, i) for f in range(len(cols)) for i in range(len(probs))]
    ends = [e for p in probs for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    # one row: a bracket of two values for every rank
    bracket = values.agg(*[F.percentile_approx(f"__x{f}", ends, ACCURACY).alias(f"__b{f}") for f in range(len(cols))])
    joined = values.crossJoin(F.broadcast(bracket))

    def ends_of(f, i):
        return F.col(f"__x{f}"), F.col(f"__b{f}")[2 * i], F.col(f"__b{f}")[2 * i + 1]

    sides, inside = [], []
    for f, i in asked:
        x, lo, hi = ends_of(f, i)
        sides += [F.count_if(x < lo).alias(f"__u{f}_{i}"), F.min(F.when(x > hi, x)).alias(f"__o{f}_{i}"),
                  F.max(F.when(x < lo, x)).alias(f"__v{f}_{i}")]
        inside.append(F.when(x.between(lo, hi), F.struct(F.lit(f).alias("__f"), F.lit(i).alias("__i"), x.alias("__x"))))
    # one row: per rank the rows below its bracket and the values next to it, per column its rows
    around = joined.agg(*[F.count(f"__x{f}").alias(f"__n{f}") for f in range(len(cols))], *sides)
    per = around.select(F.explode(F.array(*[F.struct(
        F.lit(f).alias("__f"), F.lit(i).alias("__i"), F.col(f"__n{f}").alias("__n"), F.lit(probs[i]).alias("__p"),
        F.col(f"__u{f}_{i}").alias("__below"), F.col(f"__o{f}_{i}").alias("__above"),
        F.col(f"__v{f}_{i}").alias("__under")) for f, i in asked])).alias("s")).select("s.*")
    per = per.withColumn("__pos", F.col("__p") * (F.col("__n") - 1))
    near = (joined.select(F.explode(F.filter(F.array(*inside), lambda s: s.isNotNull())).alias("s")).select("s.*")
            .groupBy("__f", "__i", "__x").agg(F.count(F.lit(1)).alias("__c")))
    order = Window.partitionBy("__f", "__i").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    # per has a row per column and rank
    ranked = near.withColumn("__to", F.sum("__c").over(order)).join(F.broadcast(per), ["__f", "__i"])
    to = F.col("__to") + F.col("__below")
    low, high = F.floor("__pos"), F.ceil("__pos")
    picked = ranked.groupBy("__f", "__i").agg(
        F.first("__pos").alias("__pos"), F.first("__above").alias("__above"), F.first("__under").alias("__under"), F.first("__below").alias("__below"),
        F.min(F.when(to > low, F.col("__x"))).alias("__lo"), F.min(F.when(to > high, F.col("__x"))).alias("__hi"))
    # sketches count ranks from another end, so the value wanted may be the one next to the bracket
    lo = F.when(F.floor("__pos") < F.col("__below"), F.col("__under")).otherwise(F.coalesce("__lo", "__above"))
    hi = F.when(F.ceil("__pos") < F.col("__below"), F.col("__under")).otherwise(F.coalesce("__hi", "__above"))
    found = picked.groupBy("__f").agg(F.map_from_entries(F.collect_list(F.struct(
        "__i", (lo + (hi - lo) * (F.col("__pos") - F.floor("__pos"))).alias("v")))).alias("__m"))
    names = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in cols])).alias("__f", "feature"))
    return names.join(found, "__f", "left").select("feature", F.array(*[F.col("__m")[i] for i in range(len(probs))]).alias("__q"))


def quantile_table(df: DataFrame, x, probs, keys=(), method: str = "auto", out: str = "__q") -> DataFrame:
    """One row per key (or one row) with ``out`` = array of quantiles."""
    keys = list(keys)
    x = F.col(x) if isinstance(x, str) else x
    probs = [float(p) for p in probs]
    if method == "approx":
        agg = F.percentile_approx(x.cast("double"), probs, 100_000).alias(out)
    elif keys or method == "map":
        agg = F.percentile(x.cast("double"), probs).alias(out)
    else:
        return multi_column_quantiles(df.select(x.alias("__x")), ["__x"], probs).select(F.col("__q").alias(out))
    return df.groupBy(*keys).agg(agg) if keys else df.agg(agg)


def attach_quantiles(df: DataFrame, x, probs, keys=(), method: str = "auto", out: str = "__q") -> DataFrame:
    """Every row with its group's quantile array."""
    keys = list(keys)
    if keys or method in ("map", "approx"):
        xx = F.col(x) if isinstance(x, str) else x
        agg = (F.percentile_approx(xx.cast("double"), [float(p) for p in probs], 100_000) if method == "approx"
               else F.percentile(xx.cast("double"), [float(p) for p in probs]))
        return with_group_stat(df, keys, agg.alias(out))
    q = quantile_table(df, x, probs, [], method, out)
    return df.crossJoin(F.broadcast(q))
