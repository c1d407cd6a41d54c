"""Keyed window features.

Every operator takes ``keys`` (series key columns, ``[]`` = one series) and an
``order_col`` and adds all of its columns in one projection, so Catalyst puts
them behind a single ``Exchange hashpartitioning(keys)`` and sort.  Offsets
are rows, not days (parity with the reference); run ``densify_daily`` first
for calendar offsets.

Rolling frames.  Spark re-aggregates a sliding ROWS frame for every row, so a
frame of ``n`` rows costs O(n) per row.  The default ``method="table"`` builds,
on the same sort order (no extra sort or shuffle), base-4 tables: level k holds
the extremes or the moments (count, mean, second to fourth central moment) of
the 4^k rows up to each row, four of level k - 1 put together.  A frame is a
few such blocks.  Moments are merged about the merged mean, never by
differences of running sums, so a level shift elsewhere in the series does not
touch them.  ``method="frame"`` uses plain frames (median always does).
NaN counts as null.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.numeric import numeric

log = logging.getLogger(__name__)

UNB = Window.unboundedPreceding
UNF = Window.unboundedFollowing

KNOWN_AGGS = ("mean", "std", "var", "min", "max", "sum", "count", "median", "skew", "kurt")
MOMENT_AGGS = ("mean", "std", "var", "sum", "count", "skew", "kurt")
BLOCK_AGGS = ("min", "max")


def wspec(keys, order_col, desc: bool = False, extra_keys=()):
    """Window by series keys ordered by ``order_col``; a list/tuple of columns
    adds tie-breakers (rows sharing a date then have a deterministic order)."""
    parts = list(keys) + list(extra_keys)
    cols = [order_col] if isinstance(order_col, str) else list(order_col)
    order = [F.col(c).desc() if desc else F.col(c) for c in cols]
    return (Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))).orderBy(*order)


def _pspec(keys):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _add(df: DataFrame, named: list[tuple[str, Column]]) -> DataFrame:
    names = {n for n, _ in named}
    keep = [F.col(c) for c in df.columns if c not in names]
    return df.select(*keep, *[e.alias(n) for n, e in named])


# ---------------------------------------------------------------- lags

def lag_features(df: DataFrame, keys, order_col: str, target: str, lags, fill: str | None = None) -> DataFrame:
    """``{target}_lag_{k}`` for each k (E1/E2); ``fill`` = ffill/bfill per series (E1f)."""
    w = wspec(keys, order_col)
    named = [(f"{target}_lag_{k}", F.lag(F.col(target), k).over(w)) for k in lags]
    out = _add(df, named)
    if fill:
        out = fill_columns(out, keys, order_col, [n for n, _ in named], fill)
    return out


# ---------------------------------------------------------------- fills

def ffill(col: str, keys, order_col: str) -> Column:
    return F.last(F.col(col), ignorenulls=True).over(wspec(keys, order_col).rowsBetween(UNB, 0))


def bfill(col: str, keys, order_col: str) -> Column:
    # reversed order with a growing frame: O(1) per row (an UNBOUNDED FOLLOWING
    # frame would be re-aggregated for every row)
    return F.last(F.col(col), ignorenulls=True).over(wspec(keys, order_col, desc=True).rowsBetween(UNB, 0))


def _no_nan(df: DataFrame, cols) -> DataFrame:
    """NaN to null in the ``cols`` that can hold it; the others are not touched."""
    floats = [c for c, t in df.dtypes if c in set(cols) and t in ("double", "float")]
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]) if floats else df


def fill_columns(df: DataFrame, keys, order_col: str, cols, method: str) -> DataFrame:
    """Forward (E10) / backward (E11) fill of ``cols`` within each series."""
    df = _no_nan(df, cols)
    if method in ("ffill", "pad"):
        return _add(df, [(c, ffill(c, keys, order_col)) for c in cols])
    if method in ("bfill", "backfill"):
        return _add(df, [(c, bfill(c, keys, order_col)) for c in cols])
    raise ValueError(f"unknown fill method {method!r}")


def clean_fill(df: DataFrame, keys, order_col: str, cols=None) -> DataFrame:
    """Forward fill then backward fill every non-key column."""
    cols = cols or [c for c in df.columns if c not in set(keys) | {order_col}]
    return fill_columns(fill_columns(df, keys, order_col, cols, "ffill"), keys, order_col, cols, "bfill")


def interpolate_linear(df: DataFrame, keys, order_col: str, col: str, out: str | None = None) -> DataFrame:
    """Linear interpolation by row position (E12): inner gaps are blended
    between the neighbouring values, leading nulls stay null, trailing nulls
    take the last value."""
    out = out or col
    df = _no_nan(df, [col])
    w = wspec(keys, order_col)
    rn = F.row_number().over(w)
    step1 = df.withColumn("__rn", rn)
    fw = wspec(keys, order_col).rowsBetween(UNB, 0)
    bw = wspec(keys, order_col, desc=True).rowsBetween(UNB, 0)
    known_pos = F.when(F.col(col).isNotNull(), F.col("__rn"))
    step2 = step1.select(
        "*",
        F.last(F.col(col), True).over(fw).alias("__pv"),
        F.last(known_pos, True).over(fw).alias("__pp"),
        F.last(F.col(col), True).over(bw).alias("__nv"),
        F.last(known_pos, True).over(bw).alias("__np"),
    )
    x = F.col(col).cast("double")
    blend = F.col("__pv") + (F.col("__nv") - F.col("__pv")) * (F.col("__rn") - F.col("__pp")) / (
        F.col("__np") - F.col("__pp"))
    val = (F.when(F.col(col).isNotNull(), x)
           .when(F.col("__pv").isNotNull() & F.col("__nv").isNotNull(), blend)
           .when(F.col("__pv").isNotNull(), F.col("__pv").cast("double")))
    res = step2.withColumn(out, val)
    return res.drop("__rn", "__pv", "__pp", "__nv", "__np")


# ---------------------------------------------------------------- frame statistics

def _frame_agg(agg: str, x: Column, w) -> Column:
    if agg == "mean":
        return F.avg(x).over(w)
    if agg == "std":
        return F.stddev_samp(x).over(w)
    if agg == "var":
        return F.var_samp(x).over(w)
    if agg == "min":
        return F.min(x).over(w)
    if agg == "max":
        return F.max(x).over(w)
    if agg == "sum":
        return F.sum(x).over(w)
    if agg == "count":
        return F.count(x).over(w)
    if agg == "median":
        return F.percentile(x, 0.5).over(w)
    if agg == "skew":
        n = F.count(x).over(w).cast("double")
        g1 = F.skewness(x).over(w)
        corr = g1 * F.sqrt(n * (n - 1)) / (n - 2)
        return F.when(n < 3, None).otherwise(F.coalesce(corr, F.lit(0.0)))
    if agg == "kurt":
        n = F.count(x).over(w).cast("double")
        g2 = F.kurtosis(x).over(w)
        corr = ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))
        return F.when(n < 4, None).otherwise(F.coalesce(corr, F.lit(-3.0)))
    raise ValueError(agg)


class FrameSpec:
    """One output column: ``agg`` over rows [t+start, t+end], valid when the
    frame holds at least ``minp`` non-null values (or rows for ``count``)."""

    def __init__(self, name, agg, start, end, minp):
        self.name, self.agg, self.start, self.end, self.minp = name, agg, start, end, minp

    @property
    def length(self):
        return self.end - self.start + 1


def _lagged(c: Column, offset: int, w, default=None) -> Column:
    """Value of ``c`` ``offset`` rows back (offset 0 = current row)."""
    if offset == 0:
        return c
    if offset < 0:
        return F.lead(c, -offset, default).over(w) if default is not None else F.lead(c, -offset).over(w)
    return F.lag(c, offset, default).over(w) if default is not None else F.lag(c, offset).over(w)


class MomentTable:
    """Base-4 table of moments of a column along a window order.

    Columns are added to the frame level by level; a block ``(k, offset)`` is
    the 4^k rows that end ``offset`` rows before the current one.  A block's
    mean is held as its difference from a reference, the last value at or
    before the block's end, so large values lose no digits.  The expressions
    are SQL text: there are hundreds, and a call to the JVM for each of their
    parts would take longer than the query."""

    def __init__(self, keys, order_col, order: int):
        cols = [order_col] if isinstance(order_col, str) else list(order_col)
        by = ", ".join(f"`{k}`" for k in keys) or "0"
        self.over = f"OVER (PARTITION BY {by} ORDER BY {', '.join(f'`{c}`' for c in cols)}"
        self.letters, self.tmp = "kvqcf"[: order + 1], []

    def lagged(self, col: str, offset: int) -> str:
        if offset == 0:
            return col
        return f"{'lag' if offset > 0 else 'lead'}({col}, {abs(offset)}, 0D) {self.over})"

    def start(self, df: DataFrame, x: Column) -> DataFrame:
        self.tmp += ["__x", "__k0", "__ref"]
        return df.withColumn("__x", x).selectExpr(
            "*", "IF(__x IS NULL, 0D, 1D) AS __k0",
            f"coalesce(last(__x, true) {self.over} ROWS UNBOUNDED PRECEDING), 0D) AS __ref")

    def merged(self, df: DataFrame, wanted: dict[str, list[tuple[int, int]]]) -> DataFrame:
        """Add each list of blocks' merged moments: count ``__k``, mean
        ``__v`` from the first block's reference, central moments ``__q``,
        ``__c``, ``__f``; names end in the list's."""
        names, lagged = {}, {}
        for k, offset in sorted({b for bs in wanted.values() for b in bs}):
            tag = str(offset).replace("-", "m")
            names[k, offset] = {m: f"__b{m}{k}_{tag}" for m in (self.letters if k else "k")}
            lagged |= {n: self.lagged(f"__{m}{k}", offset) for m, n in names[k, offset].items()}
            lagged[f"__bref{tag}"] = self.lagged("__ref", offset)
        base = [f"`{c}`" for c in df.columns]
        df = df.selectExpr("*", *[f"{c} AS {n}" for n, c in lagged.items()])

        def ref(block):
            return f"__bref{str(block[1]).replace('-', 'm')}"

        def total(terms):
            return " + ".join(f"({t})" for t in terms)

        def from_first(bs, block):
            mean = names[block].get("v")
            return f"({ref(block)} - {ref(bs[0])}{' + ' + mean if mean else ''})"

        df = df.selectExpr("*", *[f"{total([names[b]['k'] for b in bs])} AS __k{name}" for name, bs in wanted.items()])
        df = df.selectExpr("*", *[
            f"IF(__k{name} > 0D, ({total([names[b]['k'] + ' * ' + from_first(bs, b) for b in bs])}) / __k{name}, 0D) AS __v{name}"
            for name, bs in wanted.items()])
        # each block's mean from the merged one
        apart = {(name, b): f"__d{name}_{j}" for name, bs in wanted.items() for j, b in enumerate(bs)}
        if len(self.letters) > 2:
            df = df.selectExpr("*", *[f"{from_first(bs, b)} - __v{name} AS {apart[name, b]}" for name, bs in wanted.items() for b in bs])
        higher = []
        for name, bs in wanted.items():
            for letter in self.letters[2:]:
                terms = []
                for b in bs:
                    d, n = apart[name, b], names[b]["k"]
                    q, c, f = (names[b].get(m) for m in "qcf")
                    own = {"q": [q], "c": [c, q and f"3D * {d} * {q}"],
                           "f": [f, c and f"4D * {d} * {c}", q and f"6D * {d} * {d} * {q}"]}[letter]
                    power = " * ".join([d] * {"q": 2, "c": 3, "f": 4}[letter])
                    terms.append(" + ".join([t for t in own if t] + [f"{n} * {power}"]))
                higher.append(f"{total(terms)} AS __{letter}{name}")
        made = [f"__{letter}{name}" for name in wanted for letter in "kv"]
        self.tmp += [f"__{letter}{name}" for name in wanted for letter in self.letters]
        return df.selectExpr(*base, *made, *higher)

    def build(self, df: DataFrame, levels: int) -> DataFrame:
        for k in range(1, levels + 1):
            df = self.merged(df, {str(k): [(k - 1, j * 4 ** (k - 1)) for j in range(4)]})
        return df


def _blocks(start: int, end: int) -> list[tuple[int, int]]:
    """The frame [t + start, t + end] as blocks, nearest first."""
    left, offset, out, k = end - start + 1, -end, [], 0
    sizes = []
    while left:
        sizes += [k] * (left % 4)
        left //= 4
        k += 1
    for k in sizes:
        out.append((k, offset))
        offset += 4 ** k
    return out


def frame_stats(df: DataFrame, keys, order_col: str, value: str, specs: list[FrameSpec],
                method: str = "table") -> DataFrame:
    """Compute a set of frame statistics over ordered rows of each series."""
    if not specs:
        return df
    if method not in ("table", "frame"):
        raise ValueError(f"method must be table or frame, not {method!r}")
    x = numeric(value)
    w = wspec(keys, order_col)
    plain = [s for s in specs if method == "frame" or s.agg not in MOMENT_AGGS + BLOCK_AGGS]
    pref = [s for s in specs if s not in plain and s.agg in MOMENT_AGGS]
    blk = [s for s in specs if s not in plain and s.agg in BLOCK_AGGS]
    out = df
    named: list[tuple[str, Column]] = []
    tmp: list[str] = []

    if pref or blk:
        out = out.select("*", F.row_number().over(w).alias("__rn"), F.count(x).over(w.rowsBetween(UNB, 0)).alias("__n"))
        tmp += ["__rn", "__n"]
    if pref:
        order = max({"skew": 3, "kurt": 4, "std": 2, "var": 2}.get(s.agg, 1) for s in pref)
        table = MomentTable(keys, order_col, order)
        frames = {(s.start, s.end): f"_{i}" for i, s in enumerate(pref)}
        wanted = {name: _blocks(*frame) for frame, name in frames.items()}
        out = table.merged(table.build(table.start(out, x), max(k for bs in wanted.values() for k, _ in bs)), wanted)
        tmp += table.tmp

    if blk:
        # base-4 table: M_k(i) = extreme over rows [i - 4^k + 1, i]; level k
        # combines four level-(k-1) values, one window operator per level
        top = 0
        while 4 ** (top + 1) <= max(s.length for s in blk):
            top += 1
        aggs_needed = sorted({s.agg for s in blk})
        out = out.select("*", *[x.alias(f"__m{agg}0") for agg in aggs_needed])
        for k in range(1, top + 1):
            level = []
            step = 4 ** (k - 1)
            for agg in aggs_needed:
                pick = F.greatest if agg == "max" else F.least
                prev = F.col(f"__m{agg}{k - 1}")
                level.append(pick(prev, *[F.lag(prev, j * step).over(w) for j in (1, 2, 3)]).alias(f"__m{agg}{k}"))
            out = out.select("*", *level)
        tmp += [f"__m{agg}{k}" for agg in aggs_needed for k in range(top + 1)]

    for s in plain:
        fw = w.rowsBetween(s.start, s.end)
        val = _frame_agg(s.agg, x, fw)
        if s.agg == "count":
            rows = F.count(F.lit(1)).over(fw)
            named.append((s.name, F.when(rows >= s.minp, val.cast("double"))))
        else:
            cnt = F.count(x).over(fw)
            named.append((s.name, F.when(cnt >= s.minp, val)))

    for s in pref:
        at = frames[s.start, s.end]
        n, m2, m3, m4 = (F.col(f"__{letter}{at}") for letter in "kqcf")
        mean = _lagged(F.col("__ref"), -s.end, w, 0.0) + F.col(f"__v{at}")
        if s.agg == "mean":
            val = mean
        elif s.agg == "sum":
            val = n * mean
        elif s.agg == "count":
            rows = F.least(F.greatest(F.col("__rn") + s.end, F.lit(0)), F.lit(s.length))
            named.append((s.name, F.when(rows >= s.minp, n)))
            continue
        elif s.agg == "skew":
            # a window of equal values gives 0, as pandas does (kurtosis -3)
            val = F.when(n < 3, None).when(m2 <= 0, F.lit(0.0)).otherwise(
                F.sqrt(n * (n - 1)) / (n - 2) * (m3 / n) / F.pow(m2 / n, 1.5))
        elif s.agg == "kurt":
            g2 = (m4 / n) / ((m2 / n) * (m2 / n)) - 3
            val = F.when(n < 4, None).when(m2 <= 0, F.lit(-3.0)).otherwise(
                ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))
        else:
            var = m2 / (n - 1)
            val = F.when(n >= 2, var if s.agg == "var" else F.sqrt(var))
        named.append((s.name, F.when(n >= F.greatest(F.lit(s.minp), F.lit(1)), val)))

    for s in blk:
        L = s.length
        k = 0
        while 4 ** (k + 1) <= L:
            k += 1
        size = 4 ** k
        pick = F.greatest if s.agg == "max" else F.least
        m = F.col(f"__m{s.agg}{k}")
        # frame [t+start, t+end] covered by <= 4 blocks of ``size`` rows: blocks
        # ending at t+end, t+end-size, ... and the block starting at t+start
        ends = [-s.end + j * size for j in range(4) if -s.end + j * size < -s.start - size + 1]
        ends.append(-(s.start + size - 1))
        val = pick(*[_lagged(m, off, w) for off in ends]) if len(ends) > 1 else _lagged(m, ends[0], w)
        n = (_lagged(F.col("__n"), -s.end, w, 0) - _lagged(F.col("__n"), 1 - s.start, w, 0))
        named.append((s.name, F.when(n >= F.greatest(F.lit(s.minp), F.lit(1)), val)))

    res = _add(out, named)
    return res.drop(*tmp) if tmp else res


def _check_aggs(aggs):
    good = []
    for a in aggs:
        if a in KNOWN_AGGS:
            good.append(a)
        else:
            log.warning("unknown rolling aggregate %r skipped", a)
    return good


def shifted_rolling(df: DataFrame, keys, order_col: str, target: str, windows, aggs,
                    fill: str | None = None, method: str = "table") -> DataFrame:
    """Leak-free rolling features (E3): ``{t}_roll_{agg}_{n}d`` over the n rows
    before the current one, valid from ``max(1, n // 2)`` values."""
    aggs = _check_aggs(aggs)
    specs = [FrameSpec(f"{target}_roll_{a}_{n}d", a, -n, -1, max(1, n // 2)) for n in windows for a in aggs]
    out = frame_stats(df, keys, order_col, target, specs, method)
    if fill:
        out = fill_columns(out, keys, order_col, [s.name for s in specs], fill)
    return out


def trailing_rolling(df: DataFrame, keys, order_col: str, target: str, windows=(3, 7, 14, 30),
                     stats=("mean", "std", "min", "max"), method: str = "table") -> DataFrame:
    """Trailing rolling features including the current row (E4):
    ``{t}_rolling_{n}_{stat}``; a full window of n values is required."""
    stats = _check_aggs(stats)
    specs = [FrameSpec(f"{target}_rolling_{n}_{s}", s, -(n - 1), 0, n) for n in windows for s in stats]
    return frame_stats(df, keys, order_col, target, specs, method)


def expanding(df: DataFrame, keys, order_col: str, target: str, aggs=("mean",), shift: int = 0) -> DataFrame:
    """Expanding statistics including the current row (E5), ``min_periods=1``:
    ``{t}_expanding_{agg}``.  ``shift=1`` excludes the current row (X15)."""
    aggs = _check_aggs(aggs)
    x = numeric(target)
    fw = wspec(keys, order_col).rowsBetween(UNB, -shift)
    named = []
    for a in aggs:
        val = _frame_agg(a, x, fw)
        if a == "count":
            named.append((f"{target}_expanding_{a}", val.cast("double")))
        else:
            named.append((f"{target}_expanding_{a}", F.when(F.count(x).over(fw) >= 1, val)))
    return _add(df, named)


def moving_average_display(df: DataFrame, keys, order_col: str, target: str) -> DataFrame:
    """7- and 30-row moving averages for display (E13); the 7-row line needs
    more than 7 rows in the series, the 30-row line more than 30."""
    out = trailing_rolling(df, keys, order_col, target, windows=(7, 30), stats=("mean",))
    n = F.count(F.lit(1)).over(_pspec(keys))
    return out.select(
        *[c for c in out.columns if c not in (f"{target}_rolling_7_mean", f"{target}_rolling_30_mean")],
        F.when(n > 7, F.col(f"{target}_rolling_7_mean")).alias("ma_7"),
        F.when(n > 30, F.col(f"{target}_rolling_30_mean")).alias("ma_30"),
    )


def centered_mean(df: DataFrame, keys, order_col: str, col: str, period: int = 7, out: str = "trend") -> DataFrame:
    """Centred moving average of an odd period (E14); null unless the full
    window is inside the series."""
    h = period // 2
    fw = wspec(keys, order_col).rowsBetween(-h, h)
    x = numeric(col)
    return df.withColumn(out, F.when(F.count(x).over(fw) == period, F.avg(x).over(fw)))


# ---------------------------------------------------------------- differences

def interaction_features(df: DataFrame, keys, order_col: str, target: str, lags) -> DataFrame:
    """``{t}_diff_{k}`` = t - lag_k and ``{t}_ratio_{k}`` = t / lag_k with a
    zero lag giving null (E7); missing lag columns are computed."""
    need = [k for k in lags if f"{target}_lag_{k}" not in df.columns]
    base = lag_features(df, keys, order_col, target, need) if need else df
    named = []
    t = numeric(target)
    for k in lags:
        lg = numeric(f"{target}_lag_{k}")
        named.append((f"{target}_diff_{k}", t - lg))
        named.append((f"{target}_ratio_{k}", t / F.nullif(lg, F.lit(0.0))))
    out = _add(base, named)
    return out.drop(*[f"{target}_lag_{k}" for k in need]) if need else out


def difference_features(df: DataFrame, keys, order_col: str, target: str, periods=(1, 7, 30)) -> DataFrame:
    """``{t}_diff_{p}`` = x - x[-p] (E8) and ``{t}_pct_change_{p}`` on the
    forward-filled series with a zero base giving null (E9, X4)."""
    w = wspec(keys, order_col)
    x = numeric(target)
    filled = df.withColumn("__ff", F.last(x, True).over(w.rowsBetween(UNB, 0)))
    named = []
    for p in periods:
        named.append((f"{target}_diff_{p}", x - F.lag(x, p).over(w)))
        base = F.lag(F.col("__ff"), p).over(w)
        named.append((f"{target}_pct_change_{p}", F.col("__ff") / F.nullif(base, F.lit(0.0)) - 1))
    return _add(filled, named).drop("__ff")
