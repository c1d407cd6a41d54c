"""CSV/Parquet sources and sinks with the reference's validation gates.

Reading: CSV files are scanned as strings with their header, the required
columns are checked by name (A2, raising ``ValueError`` with the missing
names), then every column is converted with ``try_cast``/``try_to_date`` so
a bad value becomes NULL instead of failing the job; the ingest gate (A3)
splits such rows into a rejected table.  Parquet needs no gate beyond the
column check.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from panelcast.session import scratch_path

# Required columns of the training and scoring panels.
REQUIRED_TRAIN_COLS = ["date", "store", "item", "sales"]
REQUIRED_TEST_COLS = ["date", "store", "item", "id"]

TRAIN_SCHEMA = StructType([StructField("date", DateType()), StructField("store", IntegerType()),
                           StructField("item", StringType()), StructField("sales", DoubleType())])
# for panels whose sales are counts
COUNT_SCHEMA = StructType([StructField("date", DateType()), StructField("store", IntegerType()),
                           StructField("item", StringType()), StructField("sales", LongType())])
TEST_SCHEMA = StructType([StructField("date", DateType()), StructField("store", IntegerType()),
                          StructField("item", StringType()), StructField("id", LongType())])


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint directory."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def check_columns(df: DataFrame, required) -> None:
    """Schema gate (A2): every required column must be present."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"data is missing required columns: {missing}")


def _convert(c: str, field: StructField):
    col = F.col(c)
    if isinstance(field.dataType, DateType):
        return F.try_to_date(col.cast("string"))
    return F.expr(f"try_cast(`{c}` AS {field.dataType.simpleString()})")


def load_panel_csv(spark: SparkSession, path: str, schema: StructType = TRAIN_SCHEMA,
                   required=REQUIRED_TRAIN_COLS, rejects: str = "raise"):
    """CSV scan with date parsing and the column/type gate.

    No row is lost: ``rejects="raise"`` fails the job that meets a row the
    gate rejects, ``rejects="return"`` gives ``(valid, rejected)``."""
    if rejects not in ("raise", "return"):
        raise ValueError(f"rejects must be raise or return, not {rejects!r}")
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    check_columns(raw, required)
    if rejects == "return":
        return ingest_gate(raw, schema, required)
    conv = _judged(raw, schema, required)
    fail = F.raise_error(F.concat(F.lit("row rejected: "), F.col("reject_reason"))).cast("boolean")
    return conv.filter(F.when(F.col("reject_reason").isNull(), F.lit(True)).otherwise(fail)).select(*raw.columns)


def load_panel_parquet(spark: SparkSession, path: str, required=REQUIRED_TRAIN_COLS) -> DataFrame:
    df = spark.read.parquet(path)
    check_columns(df, required)
    if not isinstance(df.schema["date"].dataType, DateType):
        df = df.withColumn("date", F.to_date("date"))
    return df


def convert(raw: DataFrame, schema: StructType) -> DataFrame:
    names = {f.name: f for f in schema.fields}
    return raw.select(*[_convert(c, names[c]).alias(c) if c in names else F.col(c) for c in raw.columns])


def _judged(raw: DataFrame, schema: StructType, required) -> DataFrame:
    """The raw strings (``__raw_*``), the converted columns and the first
    reason to reject the row (null for none)."""
    names = {f.name: f for f in schema.fields}
    conv = raw.select(*[F.col(c).alias(f"__raw_{c}") for c in raw.columns],
                      *[_convert(c, names[c]).alias(c) if c in names else F.col(c).alias(c) for c in raw.columns])
    bad = None
    for c in required:
        cond = F.col(c).isNull()
        reason = F.when(cond & F.col(f"__raw_{c}").isNull(), F.lit(f"missing {c}")) \
            .when(cond, F.lit(f"invalid {c}"))
        bad = reason if bad is None else F.coalesce(bad, reason)
    conv = conv.withColumn("reject_reason", bad)
    return conv


def ingest_gate(raw: DataFrame, schema: StructType = TRAIN_SCHEMA, required=REQUIRED_TRAIN_COLS):
    """Ingest gate (A3): required columns present, dates and numbers parse.

    Returns ``(valid, rejected)``; ``rejected`` keeps the raw strings plus a
    ``reject_reason``.  Both come from one conversion projection; nothing is
    collected.
    """
    check_columns(raw, required)
    conv = _judged(raw, schema, required)
    valid = conv.filter(F.col("reject_reason").isNull()).select(*raw.columns)
    rejected = conv.filter(F.col("reject_reason").isNotNull()).select(
        *[F.col(f"__raw_{c}").alias(c) for c in raw.columns], "reject_reason")
    return valid, rejected


def write_csv(df: DataFrame, path: str, partition_by=None) -> None:
    """CSV export (A4, A5; A6 with ``partition_by=["store", "item"]``)."""
    w = df.write.mode("overwrite").option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_forecast_csv(df: DataFrame, path: str, keys, date_col: str) -> None:
    """Forecast export (A6): one folder per series, whose ``name`` carries the
    keys, the first and the last date."""
    from panelcast.operators.relational import join_on_keys

    span = df.groupBy(*keys).agg(F.min(date_col).alias("__lo"), F.max(date_col).alias("__hi"))
    day = lambda c: F.date_format(c, "yyyyMMdd")
    name = F.concat_ws("_", *[F.col(k).cast("string") for k in keys], day("__lo"), day("__hi"))
    named = join_on_keys(df, span, list(keys), "left").withColumn("name", name).drop("__lo", "__hi")
    write_csv(named, path, partition_by=["name"])


def write_table(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    """Parquet table sink (overwrite of the training table after ingest, X13)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def ingest_upload(spark: SparkSession, upload_path: str, table_path: str, rejects_path: str | None = None):
    """Upload flow (A3): validate a CSV upload and overwrite the training table."""
    raw = spark.read.option("header", True).csv(upload_path)
    valid, rejected = ingest_gate(raw)
    write_table(valid.select(*REQUIRED_TRAIN_COLS), table_path)
    if rejects_path:
        write_table(rejected, rejects_path)
    return spark.read.parquet(table_path)
