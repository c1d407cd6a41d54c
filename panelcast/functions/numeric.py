"""Numeric helpers (F16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_dec(c: Column, digits: int) -> Column:
    """Round to ``digits`` decimals HALF_UP on the value's decimal form, in
    two steps (9 decimals, then ``digits``) so a result does not depend on
    last-bit differences such as the order of a distributed sum."""
    return F.round(F.round(c.cast("double"), 9), digits) + F.lit(0.0)


def numeric(value: str) -> Column:
    """The column as double, NaN as null."""
    x = F.col(value).cast("double")
    return F.when(~F.isnan(x), x)
