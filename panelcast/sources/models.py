"""Model persistence and registry.

Models (boosted trees, or ``pyspark.ml`` ``PipelineModel``s) are saved under a
base directory with a timestamped name; every save appends one row to a
parquet registry table next to them, so listing models is a query, not a
directory scan.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.plans.boosting import BoostedModel

REGISTRY_SCHEMA = T.StructType([
    T.StructField("model_path", T.StringType()), T.StructField("created_at", T.TimestampType()),
    T.StructField("mae", T.DoubleType()), T.StructField("rmse", T.DoubleType()),
    T.StructField("smape", T.DoubleType()), T.StructField("features", T.StringType()),
])


def save_model(spark: SparkSession, model: BoostedModel | PipelineModel, base_dir: str, scores: dict | None = None,
               features=None) -> str:
    """Save with a timestamped name and register it."""
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    name = f"model_{now.strftime('%Y%m%d_%H%M%S')}_{uuid.uuid4().hex[:6]}"
    path = f"{base_dir.rstrip('/')}/{name}"
    if isinstance(model, BoostedModel):
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)
    scores = scores or {}
    row = [(path, now, scores.get("mae"), scores.get("rmse"), scores.get("smape"), json.dumps(list(features or [])))]
    spark.createDataFrame(row, REGISTRY_SCHEMA).write.mode("append").parquet(f"{base_dir.rstrip('/')}/_registry")
    return path


def load_model(path: str) -> BoostedModel | PipelineModel:
    """Load a saved model (A9); a missing path raises."""
    if not path:
        raise ValueError("model path is empty")
    try:
        return BoostedModel.load(SparkSession.active(), path)
    except AnalysisException:              # no boosted trees there
        return PipelineModel.load(path)


def list_models(spark: SparkSession, base_dir: str) -> DataFrame:
    """Registered models, newest first (A10)."""
    reg = spark.read.schema(REGISTRY_SCHEMA).parquet(f"{base_dir.rstrip('/')}/_registry")
    return reg.orderBy(F.col("created_at").desc(), F.col("model_path").desc())


def latest_model_path(spark: SparkSession, base_dir: str) -> str | None:
    row = list_models(spark, base_dir).select("model_path").limit(1).collect()
    return row[0][0] if row else None
