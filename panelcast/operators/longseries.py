"""Bounded-lookback window features on series of any length.

Window functions partition by the series keys, so one series is one task.
For a daily panel that is bounded by the calendar (one row per key and
day), but a generic ordered series can be arbitrarily long.  ``chunked``
splits such series for features whose frame looks back (or ahead) at most a
fixed number of rows -- lags, shifted and trailing rolling statistics,
centred means, differences:

1. one range-partitioned sort gives every row its global position ``g`` in
   (keys, order) order (``global_row_index``, checkpointed);
2. rows are cut into chunks of ``chunk_rows`` consecutive positions; the
   last ``lookback`` rows of a chunk are also copied into the next chunk (and
   the first ``lookahead`` rows into the previous one) as context;
3. the feature builder runs with windows partitioned by (keys, chunk) and
   ordered by ``g``; context copies are dropped afterwards.

A series crossing chunk borders is thus spread over many tasks, and every
task holds at most ``chunk_rows + lookback + lookahead`` rows.  Unbounded
features (expanding, fills, EWM) are not chunkable this way; EWM has its own
blocked scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunked(df: DataFrame, keys, order_col: str, build: Callable[[DataFrame, list, str], DataFrame],
            lookback: int, lookahead: int = 0, chunk_rows: int = 1_000_000) -> DataFrame:
    """Run ``build(frame, partition_keys, order_col)`` on chunked series."""
    from panelcast.plans.validation import global_row_index

    if chunk_rows < max(lookback, lookahead, 1):
        raise ValueError("chunk_rows must be at least the lookback/lookahead")
    keys = list(keys)
    cols = df.columns
    order_cols = [order_col] if isinstance(order_col, str) else list(order_col)
    g = global_row_index(df, keys + order_cols, out="__g")
    c = F.floor(F.col("__g") / chunk_rows).cast("long")
    start = c * chunk_rows
    copies = [F.struct(c.alias("__chunk"), F.lit(True).alias("__own"))]
    if lookback:
        copies.append(F.when(F.col("__g") >= start + chunk_rows - lookback,
                             F.struct((c + 1).alias("__chunk"), F.lit(False).alias("__own"))))
    if lookahead:
        copies.append(F.when((F.col("__g") < start + lookahead) & (c > 0),
                             F.struct((c - 1).alias("__chunk"), F.lit(False).alias("__own"))))
    ex = g.select(*cols, "__g", F.explode(F.filter(F.array(*copies), lambda s: s.isNotNull())).alias("__cp"))
    ex = ex.select(*cols, "__g", "__cp.__chunk", "__cp.__own")
    built = build(ex, keys + ["__chunk"], "__g")
    return built.filter(F.col("__own")).drop("__g", "__chunk", "__own")


def lookback_of(lags=(), windows=(), shifted: bool = True) -> int:
    """Rows of context the prefix/doubling window features need."""
    need = [int(k) for k in lags]
    need += [int(n) + (1 if shifted else 0) + 1 for n in windows]
    return max(need, default=0)
