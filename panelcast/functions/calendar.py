"""Calendar features (F1-F18) as Catalyst column expressions.

Everything here is a projection: no join, no aggregate, no Python.  The US
federal holiday flag is a rule expression on the row's own date, so it needs
no calendar table at all; ``holiday_flag`` joins a caller-supplied calendar
instead (C2).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def weekday0(d) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6 (F2)."""
    return F.weekday(_c(d))


def is_month_end(d) -> Column:
    d = _c(d)
    return (d == F.last_day(d)).cast("int")


def is_quarter_end(d) -> Column:
    d = _c(d)
    return ((d == F.last_day(d)) & (F.month(d) % 3 == 0)).cast("int")


def is_month_start(d) -> Column:
    return (F.dayofmonth(_c(d)) == 1).cast("int")


def is_quarter_start(d) -> Column:
    d = _c(d)
    return ((F.dayofmonth(d) == 1) & (F.month(d) % 3 == 1)).cast("int")


def is_weekend(d) -> Column:
    return (weekday0(d) >= 5).cast("int")


def cyclical(value: Column, period: float, fn: str) -> Column:
    arg = F.lit(TWO_PI) * value.cast("double") / F.lit(float(period))
    return F.sin(arg) if fn == "sin" else F.cos(arg)


# US federal holiday rules (month, day) for fixed-date holidays
# and (month, weekday with Monday = 0, first possible day, last possible day)
# for nth-weekday holidays.
FIXED_HOLIDAYS = [(1, 1), (7, 4), (11, 11), (12, 25)]
JUNETEENTH = (6, 19, 2021)  # month, day, first year
WEEKDAY_HOLIDAYS = [
    (1, 0, 15, 21),   # Martin Luther King Jr. Day: 3rd Monday of January
    (2, 0, 15, 21),   # Washington's Birthday: 3rd Monday of February
    (5, 0, 25, 31),   # Memorial Day: last Monday of May
    (9, 0, 1, 7),     # Labor Day: 1st Monday of September
    (10, 0, 8, 14),   # Columbus Day: 2nd Monday of October
    (11, 3, 22, 28),  # Thanksgiving: 4th Thursday of November
]


def _fixed_on(d: Column) -> Column:
    m, dd, y = F.month(d), F.dayofmonth(d), F.year(d)
    cond = F.lit(False)
    for mm, day in FIXED_HOLIDAYS:
        cond = cond | ((m == mm) & (dd == day))
    jm, jd, jy = JUNETEENTH
    return cond | ((m == jm) & (dd == jd) & (y >= jy))


def us_federal_holiday(d) -> Column:
    """1 when the date is a US federal holiday or the observed day of a
    fixed-date holiday (Saturday -> Friday before, Sunday -> Monday after)."""
    d = _c(d)
    m, dd, wd = F.month(d), F.dayofmonth(d), weekday0(d)
    cond = _fixed_on(d)
    for mm, wday, lo, hi in WEEKDAY_HOLIDAYS:
        cond = cond | ((m == mm) & (wd == wday) & dd.between(lo, hi))
    observed_fri = (wd == 4) & _fixed_on(F.date_add(d, 1))
    observed_mon = (wd == 0) & _fixed_on(F.date_sub(d, 1))
    return (cond | observed_fri | observed_mon).cast("int")


def holiday_flag(df: DataFrame, date_col: str, calendar: DataFrame,
                 calendar_date_col: str = "date", out: str = "is_holiday",
                 max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """Calendar membership lookup (C2) against any holiday table.

    The calendar is de-duplicated by date (so the join cannot multiply rows);
    it is broadcast only after its row count is checked, otherwise the join
    is left to the planner (shuffle join on date).
    """
    cal = calendar.select(F.to_date(F.col(calendar_date_col)).alias("__hdate")).distinct() \
        .withColumn("__hflag", F.lit(1))
    n = cal.count()
    side = F.broadcast(cal) if n <= max_broadcast_rows else cal
    joined = df.join(side, F.to_date(F.col(date_col)) == F.col("__hdate"), "left")
    return joined.withColumn(out, F.coalesce(F.col("__hflag"), F.lit(0))).drop("__hdate", "__hflag")


def _add(df: DataFrame, named: list[tuple[str, Column]]) -> DataFrame:
    """Add (or replace) columns in one projection."""
    names = {n for n, _ in named}
    keep = [F.col(c) for c in df.columns if c not in names]
    return df.select(*keep, *[e.alias(n) for n, e in named])


def date_features(df: DataFrame, date_col: str = "date", cyclical_features: bool = True,
                  holidays: bool = True, business: bool = False) -> DataFrame:
    """Training-path date features (F1-F10, F14; F7/F8 with ``business``).

    All columns are added in one ``select``.
    """
    if dict(df.dtypes).get(date_col) != "date":
        df = df.withColumn(date_col, F.to_date(F.col(date_col)))
    d = F.col(date_col)
    named = [
        ("year", F.year(d)), ("month", F.month(d)), ("day", F.dayofmonth(d)),
        ("dayofweek", weekday0(d)), ("dayofyear", F.dayofyear(d)),
        ("weekofyear", F.weekofyear(d)), ("quarter", F.quarter(d)),
        ("is_month_end", is_month_end(d)), ("is_quarter_end", is_quarter_end(d)),
    ]
    if cyclical_features:
        named += [
            ("month_sin", cyclical(F.month(d), 12, "sin")), ("month_cos", cyclical(F.month(d), 12, "cos")),
            ("dow_sin", cyclical(weekday0(d), 7, "sin")), ("dow_cos", cyclical(weekday0(d), 7, "cos")),
        ]
    if business:
        named += [("is_weekend", is_weekend(d)), ("is_month_start", is_month_start(d)),
                  ("is_quarter_start", is_quarter_start(d))]
    if holidays:
        named.append(("is_holiday", us_federal_holiday(d)))
    return _add(df, named)


def time_features(df: DataFrame, date_col: str = "date", keys: list[str] | None = None) -> DataFrame:
    """Exploration-path time features (F1-F13): full cyclical set, business
    flags and ``days_since_start`` (distance to the minimum date of the frame,
    or of each series when ``keys`` are given)."""
    from panelcast.operators.relational import with_group_stat

    if dict(df.dtypes).get(date_col) != "date":
        df = df.withColumn(date_col, F.to_date(F.col(date_col)))
    d = F.col(date_col)
    month, day, dow, doy = F.month(d), F.dayofmonth(d), weekday0(d), F.dayofyear(d)
    base = with_group_stat(df, keys or [], F.min(d).alias("__start"))
    named = [
        ("year", F.year(d)), ("month", month), ("day", day), ("dayofweek", dow),
        ("dayofyear", doy), ("weekofyear", F.weekofyear(d)), ("quarter", F.quarter(d)),
        ("month_sin", cyclical(month, 12, "sin")), ("month_cos", cyclical(month, 12, "cos")),
        ("day_sin", cyclical(day, 31, "sin")), ("day_cos", cyclical(day, 31, "cos")),
        ("dayofweek_sin", cyclical(dow, 7, "sin")), ("dayofweek_cos", cyclical(dow, 7, "cos")),
        ("dayofyear_sin", cyclical(doy, 365, "sin")), ("dayofyear_cos", cyclical(doy, 365, "cos")),
        ("is_weekend", is_weekend(d)), ("is_month_start", is_month_start(d)),
        ("is_month_end", is_month_end(d)), ("is_quarter_start", is_quarter_start(d)),
        ("is_quarter_end", is_quarter_end(d)),
        ("days_since_start", F.datediff(d, F.col("__start"))),
    ]
    return _add(base, named).drop("__start")


def parse_dates(df: DataFrame, date_col: str = "date", fmt: str | None = None) -> DataFrame:
    """Date parsing (F18): unparseable strings become NULL instead of failing."""
    c = F.col(date_col)
    parsed = F.try_to_date(c.cast("string"), F.lit(fmt)) if fmt else F.try_to_date(c.cast("string"))
    return df.withColumn(date_col, parsed)


def future_dates(last: Column, horizon: int) -> Column:
    """Date arithmetic (F17): the ``horizon`` days after ``last``."""
    return F.sequence(F.date_add(last, 1), F.date_add(last, horizon))
