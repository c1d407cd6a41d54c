"""Exponentially weighted mean (E6) as a distributed affine scan.

pandas ``ewm(span, adjust=False)`` (``ignore_na=False``) is the recurrence
``y_t = a_t * y_{t-1} + b_t`` with, for a value after a gap of ``g`` rows
since the previous value, ``o = (1 - alpha)^g``, ``a = o / (o + alpha)`` and
``b = alpha * x / (o + alpha)``; a null row keeps ``y`` (``a = 1, b = 0``) and
the first value starts it (``a = 0, b = x``).

Scan: rows are cut into blocks of ``B`` rows per series.  Inside a block,
with ``La_t`` = running sum of ``log a``, the scan from a zero start is
``exp(La_t) * sum_{s<=t} b_s exp(-La_s)`` (two running-sum windows).  ``B`` is
chosen so that ``|La|`` stays below ``EXP_BUDGET`` (30), which bounds the
relative error of the exponentials near 1e-14; a ``log a`` below ``-CLAMP`` is
clamped (the carried value's weight is then below 1e-17).  The carry into
each block comes from composing the blocks' affine maps exactly (products,
no logs) in bounded groups of ``GROUP`` blocks, recursively on the group
maps, and is joined back on (keys, block).  Windows are partitioned by
(keys, block), which also spreads one long series over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.numeric import numeric
from panelcast.operators.relational import join_on_keys
from panelcast.operators.windows import UNB, _add, wspec

CLAMP = 40.0
EXP_BUDGET = 30.0   # |running log a| inside a level-1 block; bounds exp() error to ~1e-14
MAX_BLOCK = 4096
GROUP = 64          # block maps composed per group at the upper levels (bounded lists)


def _compose_level(tbl: DataFrame, keys, idx: str, maps, n_rows: int, level: int):
    """Carry-in of every row of affine-map tables: for each (A, C) column pair
    in ``maps``, y_idx = A_idx y_(idx-1) + C_idx from y_0 = 0.  Returns
    (keys, idx, Yin0, Yin1, ...).  Rows are composed exactly (products, no
    logs) in groups of at most GROUP consecutive rows with ``aggregate`` over
    a sorted ``collect_list``; the groups' own maps are composed the same way
    one level up, so every list is bounded."""
    p = f"__g{level}_"
    grp = f"{p}grp"
    k = len(maps)
    t = tbl.withColumn(grp, F.floor((F.col(idx) - 1) / GROUP).cast("long"))
    elem = [F.col(idx).alias("i")] + [F.col(a).alias(f"a{j}") for j, (a, _) in enumerate(maps)] + \
        [F.col(c).alias(f"c{j}") for j, (_, c) in enumerate(maps)]
    lists = t.groupBy(*keys, grp).agg(F.array_sort(F.collect_list(F.struct(*elem))).alias(f"{p}l"))
    out_type = "array<struct<i:long," + ",".join(f"pa{j}:double,pc{j}:double" for j in range(k)) + ">>"
    init = F.struct(*[F.lit(1.0).alias(f"A{j}") for j in range(k)], *[F.lit(0.0).alias(f"C{j}") for j in range(k)],
                    F.array().cast(out_type).alias("out"))

    def step(acc, e):
        rec = [e["i"].cast("long").alias("i")]
        for j in range(k):
            rec += [acc[f"A{j}"].alias(f"pa{j}"), acc[f"C{j}"].alias(f"pc{j}")]
        return F.struct(*[(acc[f"A{j}"] * e[f"a{j}"]).alias(f"A{j}") for j in range(k)],
                        *[(e[f"a{j}"] * acc[f"C{j}"] + e[f"c{j}"]).alias(f"C{j}") for j in range(k)],
                        F.array_append(acc["out"], F.struct(*rec)).alias("out"))

    comp = lists.select(*keys, grp, F.aggregate(f"{p}l", init, step).alias(f"{p}r"))
    comp = comp.select(*keys, grp, *[F.col(f"{p}r.A{j}").alias(f"{p}A{j}") for j in range(k)],
                       *[F.col(f"{p}r.C{j}").alias(f"{p}C{j}") for j in range(k)], F.col(f"{p}r.out").alias(f"{p}out"))
    if n_rows <= GROUP:
        carry = comp.select(*keys, grp, *[F.lit(0.0).alias(f"{p}Y{j}") for j in range(k)], f"{p}out")
    else:
        up = comp.select(*keys, grp, (F.col(grp) + 1).alias(f"{p}idx"), *[f"{p}A{j}" for j in range(k)],
                         *[f"{p}C{j}" for j in range(k)])
        ups = _compose_level(up, keys, f"{p}idx", [(f"{p}A{j}", f"{p}C{j}") for j in range(k)],
                             math.ceil(n_rows / GROUP), level + 1)
        ups = ups.select(*keys, (F.col(f"{p}idx") - 1).alias(grp),
                         *[F.col(f"Yin{j}").alias(f"{p}Y{j}") for j in range(k)])
        carry = join_on_keys(comp, ups, [*keys, grp], "left").select(
            *keys, grp, *[F.coalesce(F.col(f"{p}Y{j}"), F.lit(0.0)).alias(f"{p}Y{j}") for j in range(k)], f"{p}out")
    rows = carry.select(*keys, *[f"{p}Y{j}" for j in range(k)], F.explode(f"{p}out").alias("__e"))
    return rows.select(*keys, F.col("__e.i").alias(idx),
                       *[(F.col(f"__e.pa{j}") * F.col(f"{p}Y{j}") + F.col(f"__e.pc{j}")).alias(f"Yin{j}")
                         for j in range(k)])


def _scan(df: DataFrame, keys, idx: str, pairs, block: int, max_len: int) -> DataFrame:
    """Inclusive affine scan per series over ``idx`` (1-based, dense).

    ``pairs`` = [(loga_col, b_col, out_col)]; ``out = a*prev + b`` from 0.
    Level 1: log-space running sums inside blocks of ``block`` rows.  Upper
    levels: exact composition of the block maps (``_compose_level``).
    """
    p = "__l0_"
    blk = f"{p}blk"
    out = df.withColumn(blk, F.floor((F.col(idx) - 1) / block).cast("long"))
    wb = Window.partitionBy(*keys, blk).orderBy(idx).rowsBetween(UNB, 0)
    out = out.select("*", *[F.sum(F.col(la)).over(wb).alias(f"{p}La{i}") for i, (la, _, _) in enumerate(pairs)])
    out = out.select("*", *[(F.exp(F.col(f"{p}La{i}")) *
                             F.sum(F.col(b) * F.exp(-F.col(f"{p}La{i}"))).over(wb)).alias(f"{p}loc{i}")
                            for i, (_, b, _) in enumerate(pairs)])
    tmp = [blk] + [f"{p}La{i}" for i in range(len(pairs))] + [f"{p}loc{i}" for i in range(len(pairs))]
    if max_len <= block:
        res = _add(out, [(o, F.col(f"{p}loc{i}")) for i, (_, _, o) in enumerate(pairs)])
        return res.drop(*tmp)
    ends = out.groupBy(*keys, blk).agg(
        *[F.max_by(F.col(f"{p}La{i}"), F.col(idx)).alias(f"{p}A{i}") for i in range(len(pairs))],
        *[F.max_by(F.col(f"{p}loc{i}"), F.col(idx)).alias(f"{p}C{i}") for i in range(len(pairs))])
    n_blocks = math.ceil(max_len / block)
    maps = ends.select(*keys, (F.col(blk) + 1).alias("__bidx"),
                       *[F.exp(F.col(f"{p}A{i}")).alias(f"__A{i}") for i in range(len(pairs))],
                       *[F.col(f"{p}C{i}").alias(f"__C{i}") for i in range(len(pairs))])
    yin = _compose_level(maps, keys, "__bidx", [(f"__A{i}", f"__C{i}") for i in range(len(pairs))], n_blocks, 1)
    yin = yin.select(*keys, (F.col("__bidx") - 1).alias(blk),
                     *[F.col(f"Yin{i}").alias(f"{p}Yin{i}") for i in range(len(pairs))])
    joined = join_on_keys(out, yin, [*keys, blk], "left")
    res = _add(joined, [(o, F.exp(F.col(f"{p}La{i}")) * F.coalesce(F.col(f"{p}Yin{i}"), F.lit(0.0))
                         + F.col(f"{p}loc{i}")) for i, (_, _, o) in enumerate(pairs)])
    return res.drop(*tmp, *[f"{p}Yin{i}" for i in range(len(pairs))])


def max_series_length(df: DataFrame, keys) -> int:
    """Longest series (one small aggregate job): sizes the scan recursion."""
    counts = df.groupBy(*keys).count() if keys else df.groupBy().count()
    row = counts.agg(F.max("count")).first()
    return int(row[0] or 0)


def block_size(spans) -> int:
    b = MAX_BLOCK
    for s in spans:
        alpha = 2.0 / (s + 1.0)
        step = CLAMP if alpha >= 1 else -math.log(1 - alpha)
        b = min(b, int(EXP_BUDGET // step))
    return max(b, 2)


def ewm_features(df: DataFrame, keys, order_col: str, target: str, spans, shift: int = 0) -> DataFrame:
    """``{t}_ewm_{span}`` for each span (E6); ``shift=1`` uses only earlier rows."""
    keys = list(keys)
    w = wspec(keys, order_col)
    x = numeric(target)
    if shift:
        x = F.lag(x, shift).over(w)
    base = df.select("*", x.alias("__x"), F.row_number().over(w).alias("__rn"))
    w2 = wspec(keys, "__rn")
    base = base.select("*",
                       F.last(F.when(F.col("__x").isNotNull(), F.col("__rn")), True)
                       .over(w2.rowsBetween(UNB, -1)).alias("__pp"),
                       F.count("__x").over(w2.rowsBetween(UNB, 0)).alias("__seen"))
    g = (F.col("__rn") - F.col("__pp")).cast("double")
    pairs, named = [], []
    for i, s in enumerate(spans):
        alpha = 2.0 / (s + 1.0)
        l1a = -CLAMP if alpha >= 1 else math.log(1 - alpha)
        o = F.exp(g * l1a)
        loga = (F.when(F.col("__x").isNull(), F.lit(0.0))
                .when(F.col("__pp").isNull(), F.lit(-CLAMP))
                .otherwise(F.greatest(g * l1a - F.log(o + alpha), F.lit(-CLAMP))))
        b = (F.when(F.col("__x").isNull(), F.lit(0.0))
             .when(F.col("__pp").isNull(), F.col("__x"))
             .otherwise(F.lit(alpha) * F.col("__x") / (o + alpha)))
        named += [(f"__la{i}", loga), (f"__b{i}", b)]
        pairs.append((f"__la{i}", f"__b{i}", f"__y{i}"))
    base = _add(base, named)
    n = max_series_length(df, keys)
    scanned = _scan(base, keys, "__rn", pairs, block_size(spans), max(n, 1))
    outs = [(f"{target}_ewm_{s}", F.when(F.col("__seen") > 0, F.col(f"__y{i}"))) for i, s in enumerate(spans)]
    res = _add(scanned, outs)
    drop = ["__x", "__rn", "__pp", "__seen"] + [c for i in range(len(spans)) for c in (f"__la{i}", f"__b{i}", f"__y{i}")]
    return res.drop(*drop)
