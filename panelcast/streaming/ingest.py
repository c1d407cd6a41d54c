"""Incremental ingestion of uploaded panel files (A3 as a stream).

The reference validates one uploaded CSV and overwrites the training table.
As a Structured Streaming job the same gate runs on every new file dropped
into a folder: the file source tracks which files were processed in the
checkpoint (exactly-once per file, restartable after a failure), each
micro-batch is split by ``ingest_gate`` into valid and rejected rows, and both
are appended to parquet tables.  ``trigger="available_now"`` processes what
is there and stops (a scheduled batch); ``"continuous"`` polls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from panelcast.sources.io import REQUIRED_TRAIN_COLS, TRAIN_SCHEMA, ingest_gate, scratch_table_path

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in REQUIRED_TRAIN_COLS])


def start_ingest(spark: SparkSession, source_dir: str, table_path: str, rejects_path: str,
                 checkpoint: str | None = None, trigger: str = "available_now", interval: str = "30 seconds"):
    """Start the ingest stream; returns the ``StreamingQuery``."""
    # a stream's checkpoint belongs to one source; pass the same path to resume
    checkpoint = checkpoint or scratch_table_path(spark, "ingest-checkpoint")
    raw = (spark.readStream.schema(RAW_SCHEMA).option("header", True).option("mode", "PERMISSIVE")
           .option("maxFilesPerTrigger", 64).csv(source_dir))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again overwrites its own folder
        batch.persist()
        valid, rejected = ingest_gate(batch, TRAIN_SCHEMA, REQUIRED_TRAIN_COLS)
        valid.select(*REQUIRED_TRAIN_COLS).write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{rejects_path}/batch={batch_id}")
        batch.unpersist()

    w = raw.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger == "available_now" else w.trigger(processingTime=interval)
    return w.start()


def ingest_available(spark: SparkSession, source_dir: str, table_path: str, rejects_path: str,
                     checkpoint: str | None = None) -> DataFrame:
    """Process every file present now and return the ingested table."""
    q = start_ingest(spark, source_dir, table_path, rejects_path, checkpoint, "available_now")
    q.awaitTermination()
    return spark.read.schema(TRAIN_SCHEMA).parquet(table_path).select(*TRAIN_SCHEMA.names)
