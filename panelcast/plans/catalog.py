"""Registered queries: one Spark builder per operator plus its DuckDB oracle.

Each builder takes ``(spark, sf_dir)``, reads the whole driver tables (or the
``daily_sales`` panel Spark derives from them) and returns a DataFrame whose
columns are named exactly like the oracle's.  Floating outputs are rounded to
6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions import calendar as cal
from panelcast.operators import windows as win
from panelcast.plans.sqlgen import date_features_sql, shifted_roll_sql
from panelcast.sources.tables import DAILY_SALES_SQL, daily_sales, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

KEYS = ["store", "item"]
PART = "store, item"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rnd(c) -> Column:
    from panelcast.functions.numeric import round_dec

    c = F.col(c) if isinstance(c, str) else c
    return round_dec(c, 6)


def round_cols(df: DataFrame, cols) -> DataFrame:
    cols = set(cols)
    return df.select(*[rnd(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def float_cols(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("double", "float")]


# ------------------------------------------------------------------ flagship

FLAGSHIP_LAGS = [7, 28]
FLAGSHIP_WINDOWS = [7, 28]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily_sales -> calendar features -> lags 7, 28 -> shifted rolling
    mean/std over 7 and 28 rows, all series in one plan."""
    ds = daily_sales(spark, sf_dir)
    f = cal.date_features(ds, "date", cyclical_features=True, holidays=True)
    f = win.lag_features(f, KEYS, "date", "sales", FLAGSHIP_LAGS)
    f = win.shifted_rolling(f, KEYS, "date", "sales", FLAGSHIP_WINDOWS, ["mean", "std"])
    return round_cols(f, float_cols(f))


def _flagship_sql() -> str:
    rolls = ",\n  ".join(
        f"{shifted_roll_sql('sales', n, a, PART, 'date')} AS sales_roll_{a}_{n}d"
        for n in FLAGSHIP_WINDOWS for a in ["mean", "std"])
    lags = ",\n  ".join(f"lag(sales, {k}) OVER (PARTITION BY {PART} ORDER BY date) AS sales_lag_{k}"
                        for k in FLAGSHIP_LAGS)
    return with_sql(DAILY_SALES_SQL) + f"""SELECT store, item, date, sales,
  {date_features_sql('date')},
  {lags},
  {rolls}
FROM daily_sales"""


register("feature_flagship", _flagship_sql())(flagship)
