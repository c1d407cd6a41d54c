"""One-dimensional isolation forest (J4), Liu, Ting & Zhou (2008).

Per series: values are mean-filled (NaN counts as null); every tree draws its
own uniform sample of ``min(sample_size, n)`` rows, by the rank of a hash of
(seed, tree, key, value, occurrence) after a Bernoulli pre-filter, so no series
is sorted whole.  Rows with the same value are the same to a tree: they are
counted, and their occurrences numbered in pieces of ``PIECE``.  Each tree is
grown on its own small sample (a per-(key, tree) Python helper on <= 256
values).  A 1-D tree
is a step function of the value, so the forest's mean path length is one
step function per series: the per-tree jumps at every split point are
summed, and every row is scored with a running sum over the union of its
series' split points and values (sorted once).  The anomaly score is
``2^(-E[h]/c(psi))``; rows above the series' ``1 - contamination`` score
quantile are flagged.  Results depend on the seed and the values, not on
partitions or retried tasks (they do not reproduce another library's random
stream).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.numeric import numeric
from panelcast.operators.relational import join_on_keys, with_group_stat
from panelcast.session import ship_package

PIECE = 10_000          # occurrences of one value that a task numbers at a time

EULER = 0.5772156649015329


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _grow(values: np.ndarray, rng: np.random.Generator, limit: int):
    """Leaves of a 1-D isolation tree as (upper split bound, path length),
    left to right; the last leaf is unbounded above."""
    leaves = []

    def rec(v, depth):
        lo, hi = v.min(), v.max()
        if depth >= limit or len(v) <= 1 or lo == hi:
            leaves.append(depth + c_factor(len(v)))
            return None
        s = rng.uniform(lo, hi)
        left, right = v[v <= s], v[v > s]
        rec(left, depth + 1)
        splits.append(s)
        rec(right, depth + 1)
        return None

    splits: list[float] = []
    rec(values, 0)
    return splits, leaves


def isolation_forest_scores(df: DataFrame, col: str, keys=(), n_trees: int = 100, sample_size: int = 256,
                            seed: int = 42, out: str = "anomaly_score", global_scoring: str = "lookup") -> DataFrame:
    ship_package(df.sparkSession)
    keys = list(keys)
    x = numeric(col)
    base = with_group_stat(df, keys, F.avg(x).alias("__mu"), F.count(F.lit(1)).alias("__n"))
    base = base.withColumn("__xf", F.coalesce(x, F.col("__mu")))

    def draw(tree):
        h = F.xxhash64(F.lit(seed), tree, *keys, F.col("__xf"), F.col("__occ"))
        return F.struct(tree.alias("tree"), (F.pmod(h, F.lit(1 << 52)).cast("double") / float(1 << 52)).alias("u"))

    # twice the sample and more is let through: too few of a sample of 256 is a matter of 11 standard deviations
    share = F.least(F.lit(1.0), 2.0 * sample_size / F.col("__n") + 1e-9)
    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), draw), lambda d: d["u"] < share)
    counted = base.groupBy(*keys, "__xf").agg(F.first("__n").alias("__n"), F.count(F.lit(1)).alias("__c"))
    pieces = counted.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("__c") - 1) / PIECE))).alias("__piece")).repartition(*keys, "__xf", "__piece")
    from_ = F.col("__piece") * PIECE
    occ = pieces.select(*keys, "__xf", "__n", F.explode(F.sequence(from_, F.least(F.col("__c"), from_ + PIECE) - 1)).alias("__occ"))
    cand = occ.select(*keys, "__xf", "__n", F.explode(drawn).alias("__d")).select(
        *keys, "__xf", "__n", F.col("__d.tree").alias("__tree"), F.col("__d.u").alias("__u"))
    wk = Window.partitionBy(*keys, "__tree").orderBy("__u", "__xf")
    cand = cand.withColumn("__r", F.row_number().over(wk)).filter(F.col("__r") <= sample_size)
    per_tree = cand.withColumn("__psi", F.least(F.col("__n"), F.lit(sample_size)))

    key_fields = [f for f in df.schema.fields if f.name in keys]
    schema = T.StructType(key_fields + [T.StructField("__b", T.DoubleType()), T.StructField("__delta", T.DoubleType()),
                                        T.StructField("__base", T.DoubleType()), T.StructField("__psi", T.LongType())])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["__tree"].iloc[0])
        kv = [pdf[k].iloc[0] for k in keys]
        psi_v = int(pdf["__psi"].iloc[0])
        rng = np.random.default_rng([seed, tree] + [zlib.crc32(str(v).encode()) for v in kv])
        limit = int(math.ceil(math.log2(max(psi_v, 2))))
        splits, leaves = _grow(pdf["__xf"].to_numpy(dtype=float), rng, limit)
        rows = [{"__b": float("-inf"), "__delta": 0.0, "__base": leaves[0]}]
        for s, a, b in zip(splits, leaves[:-1], leaves[1:]):
            rows.append({"__b": float(s), "__delta": b - a, "__base": 0.0})
        res = pd.DataFrame(rows)
        for k, v in zip(keys, kv):
            res[k] = v
        res["__psi"] = psi_v
        return res[[f.name for f in schema.fields]]

    grouped = per_tree.select(*keys, "__tree", "__xf", "__psi")
    steps = grouped.groupBy(*keys, "__tree").applyInPandas(grow, schema) if keys else \
        grouped.groupBy("__tree").applyInPandas(grow, schema)
    bases = steps.groupBy(*keys).agg((F.sum("__base") / n_trees).alias("__h0"), F.first("__psi").alias("__psi")) \
        if keys else steps.agg((F.sum("__base") / n_trees).alias("__h0"), F.first("__psi").alias("__psi"))
    jumps = steps.filter(F.col("__b") > float("-inf")).select(*keys, F.col("__b").alias("__v"),
                                                              (F.col("__delta") / n_trees).alias("__d"),
                                                              F.lit(1).alias("__kind"))
    if not keys and global_scoring == "lookup":
        return _score_global(base, steps, bases, n_trees, out, df.columns)
    row_type = T.StructType(list(df.schema.fields))
    jumps = jumps.withColumn("__row", F.lit(None).cast(row_type))
    pts = base.select(*keys, F.col("__xf").alias("__v"), F.lit(0.0).alias("__d"), F.lit(0).alias("__kind"),
                      F.struct(*[F.col(c) for c in df.columns]).alias("__row"))
    both = pts.unionByName(jumps)
    # data rows sort before a split point of equal value: x <= split goes left
    ws = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))) \
        .orderBy("__v", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    scored = both.withColumn("__cum", F.sum("__d").over(ws)).filter(F.col("__kind") == 0)
    scored = join_on_keys(scored, bases, keys, "left") if keys else scored.crossJoin(F.broadcast(bases))
    cpsi = F.when(F.col("__psi") <= 2, F.lit(1.0)).otherwise(
        2.0 * (F.log(F.col("__psi") - 1.0) + EULER) - 2.0 * (F.col("__psi") - 1.0) / F.col("__psi"))
    score = F.pow(F.lit(2.0), -(F.col("__h0") + F.col("__cum")) / cpsi)
    return scored.select("__row.*", _settled(score).alias(out))


def _settled(score):
    """Without the last digits, which follow the order of a sum over trees."""
    return F.round(score, 12)


def _score_global(base: DataFrame, steps: DataFrame, bases: DataFrame, n_trees: int, out: str,
                  cols) -> DataFrame:
    """One global forest: its step function has at most n_trees x
    (sample_size - 1) breakpoints (a model-sized table), so it is collected,
    turned into Bucketizer splits and a small broadcast lookup; rows are
    scored by a JVM binary search, no whole-table sort."""
    from pyspark.ml.feature import Bucketizer

    spark = base.sparkSession
    jumps = steps.filter(F.col("__b") > float("-inf")).groupBy("__b") \
        .agg((F.sum("__delta") / n_trees).alias("__d")).orderBy("__b").collect()
    head = bases.first()
    h0, psi = float(head["__h0"] or 0.0), int(head["__psi"] or 1)
    b = [float(r["__b"]) for r in jumps]
    cum = [0.0]
    for r in jumps:
        cum.append(cum[-1] + float(r["__d"]))
    m = len(b)
    if not m:                   # no row, or all of one value
        return base.select(*cols, F.lit(round(2.0 ** -(h0 / (1.0 if psi <= 2 else c_factor(psi))), 12)).alias(out))
    # bucket k of -x  <->  exactly m - k split points lie strictly below x
    splits = [float("-inf")] + [-v for v in reversed(b)] + [float("inf")]
    lookup = spark.createDataFrame([(k, h0 + cum[m - k]) for k in range(m + 1)], "__k INT, __eh DOUBLE")
    neg = base.withColumn("__negx", -F.col("__xf"))
    bucket = Bucketizer(splits=splits, inputCol="__negx", outputCol="__kb", handleInvalid="keep").transform(neg)
    bucket = bucket.withColumn("__k", F.col("__kb").cast("int"))
    scored = bucket.join(F.broadcast(lookup), "__k", "left")
    cpsi = 1.0 if psi <= 2 else c_factor(psi)
    score = F.pow(F.lit(2.0), -F.col("__eh") / cpsi)
    return scored.select(*cols, _settled(score).alias(out))


def isolation_forest_outliers(df: DataFrame, col: str, keys=(), contamination: float = 0.1,
                              out: str = "is_outlier", **kw) -> DataFrame:
    """Flag rows whose anomaly score exceeds the series' (1 - contamination)
    score quantile (exact)."""
    keys = list(keys)
    scored = isolation_forest_scores(df, col, keys, **kw)
    from panelcast.operators.quantiles import attach_quantiles

    q = attach_quantiles(scored, "anomaly_score", [1.0 - contamination], keys, out="__thr")
    flag = F.coalesce(F.col("anomaly_score") > F.col("__thr")[0], F.lit(False))
    return q.withColumn(out, flag).drop("__thr")
