"""Profiling and descriptive statistics.

All operators are keyed: ``keys=[...]`` gives one result per series,
``keys=[]`` one global result.  Wide statistics are computed in a single
aggregate pass (map-side partial aggregation, so a hot key is combined
before the shuffle) and turned into long form afterwards with
``explode(array(struct...))`` on the small aggregated rows.

Exact quantiles use ``percentile`` (value->count maps, pre-combined per
partition); pass ``approx=True`` for ``percentile_approx`` when a single group
holds very many distinct doubles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from panelcast.functions.numeric import numeric, round_dec
from panelcast.operators.relational import join_on_keys, with_group_stat


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric column selection."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def _grouped(df: DataFrame, keys, *aggs):
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def quantiles(x: Column, probs, approx: bool = False, accuracy: int = 100_000) -> Column:
    if approx:
        return F.percentile_approx(x, list(probs), accuracy)
    return F.percentile(x, list(probs))


def _with_quantiles(wide: DataFrame, df: DataFrame, cols_probs, keys, approx: bool) -> DataFrame:
    """Attach quantile arrays ``name -> (column expr, probs)`` to the
    aggregated ``wide`` frame: inline for keyed groups, rank-based (bounded
    memory, exact) for a global group."""
    if keys or approx:
        return wide
    from panelcast.operators.quantiles import quantile_table

    for name, (x, probs) in cols_probs.items():
        wide = wide.crossJoin(F.broadcast(quantile_table(df, x, probs, [], out=name)))
    return wide


# ---------------------------------------------------------------- D1, D2, D7, D8, D16

def overview(df: DataFrame, date_col: str | None = "date", keys=()) -> DataFrame:
    """Dataset overview (D1): rows, columns, % null cells, date span in days."""
    cols = df.columns
    nulls = sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0))
    aggs = [F.count(F.lit(1)).cast("bigint").alias("total_records"),
            F.lit(len(cols)).cast("int").alias("n_columns"),
            nulls.cast("bigint").alias("null_cells")]
    if date_col:
        aggs.append(F.datediff(F.max(date_col), F.min(date_col)).alias("date_range_days"))
    out = _grouped(df, list(keys), *aggs)
    pct = round_dec(F.try_divide(F.col("null_cells") * 100.0, F.col("total_records") * F.lit(len(cols))), 2)
    return out.withColumn("missing_pct", pct)


def column_profile(df: DataFrame, cols=None, approx_distinct: bool = False) -> DataFrame:
    """Column profile (D2): dtype, non-null, null, null %, distinct values."""
    cols = cols or df.columns
    dtypes = dict(df.dtypes)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c)
        distinct = F.approx_count_distinct(x) if approx_distinct else F.count_distinct(x)
        aggs += [F.count(x).alias(f"n{i}"), F.count_if(x.isNull()).alias(f"z{i}"), distinct.alias(f"d{i}")]
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *aggs)
    structs = [F.struct(F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"),
                        F.col(f"n{i}").cast("bigint").alias("non_null"),
                        F.col(f"z{i}").cast("bigint").alias("nulls"),
                        F.col(f"d{i}").cast("bigint").alias("distinct")) for i, c in enumerate(cols)]
    long = wide.select("__rows", F.explode(F.array(*structs)).alias("s")).select("__rows", "s.*")
    return long.withColumn("null_pct", round_dec(F.try_divide(F.col("nulls") * 100.0, F.col("__rows")), 2)).drop("__rows")


def missing_summary(df: DataFrame, col: str, keys=()) -> DataFrame:
    """Missing summary (D7): count, % (2 dp), complete cases."""
    out = _grouped(df, list(keys), F.count(F.lit(1)).alias("__n"),
                   F.count_if(F.col(col).isNull()).cast("bigint").alias("missing_count"))
    return out.select(*keys, "missing_count",
                      round_dec(F.try_divide(F.col("missing_count") * 100.0, F.col("__n")), 2).alias("missing_pct"),
                      (F.col("__n") - F.col("missing_count")).cast("bigint").alias("complete_cases"))


def missing_pattern(df: DataFrame, col: str, date_col: str = "date", keys=()) -> DataFrame:
    """Missing pattern over time (D8): (keys, date, 0/1)."""
    return df.select(*keys, date_col, F.col(col).isNull().cast("int").alias("is_missing"))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Row counts by stage (D16), one small row per stage."""
    parts = [d.agg(F.count(F.lit(1)).cast("bigint").alias("rows")).select(F.lit(n).alias("stage"), "rows")
             for n, d in stages.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- D3-D6

def describe(df: DataFrame, cols, keys=(), approx: bool = False) -> DataFrame:
    """Describe (D3/D4): count, mean, std (n-1), min, 25/50/75 %, max, one row
    per (keys, feature).  A global describe takes its quartiles from one
    rank pass over all columns (bounded memory, exact)."""
    keys = list(keys)
    keyed = bool(keys) or approx
    aggs = []
    for i, c in enumerate(cols):
        x = numeric(c)
        aggs += [F.count(x).alias(f"c{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if keyed:
            aggs.append(quantiles(x, [0.25, 0.5, 0.75], approx).alias(f"q{i}"))
    wide = _grouped(df, keys, *aggs)
    qcol = (lambda i: F.col(f"q{i}")) if keyed else (lambda i: F.lit(None).cast("array<double>"))
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").cast("bigint").alias("count"),
                        F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                        F.col(f"lo{i}").alias("min"), qcol(i).alias("__q"),
                        F.col(f"hi{i}").alias("max")) for i, c in enumerate(cols)]
    long = wide.select(*keys, F.explode(F.array(*structs)).alias("s")).select(*keys, "s.*")
    if not keyed:
        from panelcast.operators.quantiles import multi_column_quantiles

        long = long.drop("__q").join(multi_column_quantiles(df, cols, [0.25, 0.5, 0.75]), "feature", "left")
    return long.select(*keys, "feature", "count", "mean", "std", "min", F.col("__q")[0].alias("p25"),
                       F.col("__q")[1].alias("p50"), F.col("__q")[2].alias("p75"), "max")


def moments(df: DataFrame, col: str, keys=(), approx: bool = False) -> DataFrame:
    """Extended moments (D5): mean, median, std, variance, skewness and
    excess kurtosis (biased, as SciPy's defaults); NaN counts as null."""
    x = numeric(col)
    keyed = bool(keys) or approx
    aggs = [F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.var_samp(x).alias("variance"),
            F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis")]
    if keyed:
        aggs.append(quantiles(x, [0.5], approx).alias("__med"))
    out = _with_quantiles(_grouped(df, list(keys), *aggs), df, {"__med": (x, [0.5])}, list(keys), approx)
    return out.select(*keys, "mean", F.col("__med")[0].alias("median"), "std", "variance", "skewness", "kurtosis")


PCTS = [5, 10, 25, 50, 75, 90, 95]


def percentile_set(df: DataFrame, col: str, keys=(), approx: bool = False) -> DataFrame:
    """Percentiles 5, 10, 25, 50, 75, 90, 95 (D6), linear interpolation."""
    x = numeric(col)
    probs = [p / 100 for p in PCTS]
    if keys or approx:
        out = _grouped(df, list(keys), quantiles(x, probs, approx).alias("__q"))
    else:
        from panelcast.operators.quantiles import quantile_table
        out = quantile_table(df, x, probs, [])
    return out.select(*keys, *[F.col("__q")[i].alias(f"p{p}") for i, p in enumerate(PCTS)])


# ---------------------------------------------------------------- D9, D10, D11

def correlation_long(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation matrix in long form (D9); pairwise-complete nulls.
    One aggregate computes the upper triangle; the mirror and the diagonal
    are added on the tiny result."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.corr(numeric(a), numeric(b)).alias(f"r{i}")
                    for i, (a, b) in enumerate(pairs)])
    structs = []
    for i, (a, b) in enumerate(pairs):
        structs.append(F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.col(f"r{i}").alias("correlation")))
        structs.append(F.struct(F.lit(b).alias("feature_1"), F.lit(a).alias("feature_2"), F.col(f"r{i}").alias("correlation")))
    for c in cols:
        structs.append(F.struct(F.lit(c).alias("feature_1"), F.lit(c).alias("feature_2"), F.lit(1.0).alias("correlation")))
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def strongest_pairs(corr_long: DataFrame, cols, n: int = 5) -> DataFrame:
    """Upper-triangle pairs ordered by |r|: top-n positive and top-n negative."""
    pos = {c: i for i, c in enumerate(cols)}
    order = F.create_map(*[x for c, i in pos.items() for x in (F.lit(c), F.lit(i))])
    upper = corr_long.filter(order[F.col("feature_1")] < order[F.col("feature_2")])
    # no correlation at all is neither positive nor negative
    ranked = upper.withColumn("sign", F.when(F.col("correlation") > 0, "positive").when(F.col("correlation") < 0, "negative"))
    ranked = ranked.filter(F.col("sign").isNotNull())
    w = Window.partitionBy("sign").orderBy(F.abs("correlation").desc(), "feature_1", "feature_2")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def ols_trend(df: DataFrame, y: str, x: str, keys=()) -> DataFrame:
    """OLS trend line y ~ x (D11): slope, intercept, R^2."""
    yy, xx = numeric(y), numeric(x)
    return _grouped(df, list(keys), F.regr_slope(yy, xx).alias("slope"),
                    F.regr_intercept(yy, xx).alias("intercept"), F.regr_r2(yy, xx).alias("r2"),
                    F.regr_count(yy, xx).cast("bigint").alias("n"))


# ---------------------------------------------------------------- D12-D15

def histogram(df: DataFrame, col: str, keys=(), bins: int = 30) -> DataFrame:
    """Equal-width histogram (D12): bins between min and max of each group;
    the maximum falls in the last bin."""
    keys = list(keys)
    x = numeric(col)
    st = with_group_stat(df.filter(x.isNotNull()), keys, F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((x - F.col("__lo")) / width), F.lit(bins - 1))).cast("int")
    binned = st.select(*keys, b.alias("bin"), "__lo", width.alias("__w"))
    out = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).cast("bigint").alias("count"),
                                         F.first("__lo").alias("__lo"), F.first("__w").alias("__w"))
    return out.select(*keys, "bin", (F.col("__lo") + F.col("bin") * F.col("__w")).alias("bin_start"),
                      (F.col("__lo") + (F.col("bin") + 1) * F.col("__w")).alias("bin_end"), "count")


def box_summary(df: DataFrame, col: str, keys=(), approx: bool = False) -> DataFrame:
    """Box summary (D13): quartiles, 1.5 IQR fences, whiskers at the most
    extreme values inside the fences, number of points outside."""
    keys = list(keys)
    x = numeric(col)
    if keys or approx:
        q = _grouped(df, keys, quantiles(x, [0.25, 0.5, 0.75], approx).alias("__q"))
    else:
        from panelcast.operators.quantiles import quantile_table
        q = quantile_table(df, x, [0.25, 0.5, 0.75], [])
    q = q.select(*keys, F.col("__q")[0].alias("q1"), F.col("__q")[1].alias("median"), F.col("__q")[2].alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
        .withColumn("lower_fence", F.col("q1") - 1.5 * F.col("iqr")) \
        .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr"))
    joined = join_on_keys(df, q, keys) if keys else df.crossJoin(F.broadcast(q))
    inside = x.between(F.col("lower_fence"), F.col("upper_fence"))
    agg = _grouped(joined, keys, F.min(F.when(inside, x)).alias("lower_whisker"),
                   F.max(F.when(inside, x)).alias("upper_whisker"),
                   F.count_if(x.isNotNull() & ~inside).cast("bigint").alias("n_outside"))
    return join_on_keys(q, agg, keys) if keys else q.crossJoin(agg)


def kde_grid(df: DataFrame, col: str, keys=(), points: int = 100, bins: int | None = None) -> DataFrame:
    """Gaussian kernel density on an equal grid between min and max (D14),
    Scott's bandwidth h = std * n^(-1/5).  Values are first combined per
    (key, value), then every distinct value contributes to every grid point
    and the contributions are summed with map-side partial aggregation.

    ``bins=N`` pre-bins the values into N equal-width bins per series (each
    bin's count placed at its centre), which bounds the work per series by
    ``N * points`` however many distinct values there are (approximate)."""
    keys = list(keys)
    x = numeric(col)
    st = _grouped(df.filter(x.isNotNull()), keys, F.min(x).alias("__lo"), F.max(x).alias("__hi"),
                  F.stddev_samp(x).alias("__sd"), F.count(x).alias("__n"))
    if bins:
        j0 = df.filter(x.isNotNull()).select(*keys, x.alias("__v"))
        j0 = join_on_keys(j0, st, keys, "inner") if keys else j0.crossJoin(F.broadcast(st))
        w = (F.col("__hi") - F.col("__lo")) / bins
        b = F.when(w == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("__v") - F.col("__lo")) / w), F.lit(bins - 1)))
        centre = F.when(w == 0, F.col("__lo")).otherwise(F.col("__lo") + (b + 0.5) * w)
        vals = j0.groupBy(*keys, centre.alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    else:
        vals = df.filter(x.isNotNull()).groupBy(*keys, x.alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    st = st.withColumn("__h", F.col("__sd") * F.pow(F.col("__n").cast("double"), -0.2))
    j = join_on_keys(vals, st, keys, "inner") if keys else vals.crossJoin(F.broadcast(st))
    g = j.select(*keys, "__x", "__c", "__lo", "__hi", "__h", "__n",
                 F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    gx = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("point") / (points - 1)
    z = F.try_divide(gx - F.col("__x"), F.col("__h"))
    contrib = F.try_divide(F.col("__c") * F.exp(-0.5 * z * z), F.col("__n") * F.col("__h") * math.sqrt(2 * math.pi))
    return g.groupBy(*keys, "point").agg(F.first(gx).alias("x"), F.sum(contrib).alias("density"))


def qq_points(df: DataFrame, col: str, keys=()) -> DataFrame:
    """Normal Q-Q points (D15): ordered values against standard normal
    quantiles at Filliben's plotting positions.  Ranks come from counts per
    distinct value and a running sum over the (smaller) distinct-value table,
    then each value's rank range is expanded."""
    from panelcast.functions.normal import norm_ppf

    keys = list(keys)
    x = numeric(col)
    if not keys:
        # one global ranking: range-partitioned sort + partition offsets
        from panelcast.plans.validation import global_row_index

        idx = global_row_index(df.filter(x.isNotNull()).select(x.alias("value")), ["value"], out="__r")
        ranks = idx.crossJoin(F.broadcast(idx.agg(F.count(F.lit(1)).alias("__n")))) \
            .select("value", "__n", (F.col("__r") + 1).alias("rank"))
    else:
        vals = df.filter(x.isNotNull()).groupBy(*keys, x.alias("value")).agg(F.count(F.lit(1)).alias("__c"))
        w = Window.partitionBy(*keys).orderBy("value")
        vals = vals.withColumn("__end", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        vals = vals.withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys)))
        ranks = vals.select(*keys, "value", "__n",
                            F.explode(F.sequence(F.col("__end") - F.col("__c") + 1, F.col("__end"))).alias("rank"))
    n = F.col("__n").cast("double")
    i = F.col("rank").cast("double")
    pos = (F.when(F.col("rank") == 1, 1 - F.pow(F.lit(0.5), 1 / n))
           .when(F.col("rank") == F.col("__n"), F.pow(F.lit(0.5), 1 / n))
           .otherwise((i - 0.3175) / (n + 0.365)))
    return ranks.select(*keys, "rank", "value", norm_ppf(pos).alias("theoretical")).drop("__n")


def advanced_statistics(df: DataFrame, col: str, order_col: str, keys=()) -> DataFrame:
    """The reference's one-call statistics: moments (D5), Shapiro-Wilk (H1) and the percentile set (D6), one row per series."""
    from panelcast.operators.diagnostics import shapiro_wilk

    keys = list(keys)
    m = moments(df, col, keys)
    sw = shapiro_wilk(df, col, keys).drop("n")
    pc = percentile_set(df, col, keys)
    if keys:
        return join_on_keys(join_on_keys(m, sw, keys, "left"), pc, keys, "left")
    return m.crossJoin(sw).crossJoin(pc)
