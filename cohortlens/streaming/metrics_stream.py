"""Incremental discrimination / calibration metrics over a stream of scored rows.

The reference has no streaming; this module only lets the batch operators run
on data that arrives as files. The stateful part is the score histogram
``(keys, score) -> (pos, neg)`` (a streaming ``groupBy`` whose state size is the
number of distinct scores per key - small for calibrated or bucketed scores);
each micro-batch recomputes the metric table from the complete histogram with
the same code as the batch path (``metrics.metric_table``).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cohortlens.functions.scalar import finite
from cohortlens.operators.metrics import metric_table
from cohortlens.session import ensure_checkpoint_dir


def streaming_histogram(stream: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Stateful histogram of a streaming DataFrame (use with output mode ``complete``)."""
    yy = F.col(y).cast("double")
    return stream.where(finite(p) & F.col(y).isNotNull()) \
        .groupBy(*keys, F.col(p).cast("double").alias("score")) \
        .agg(F.sum(yy).alias("pos"), F.sum(F.lit(1.0) - yy).alias("neg"))


def run_metrics_stream(spark: SparkSession, source_dir: str, schema: T.StructType, keys: list[str],
                       on_metrics: Callable[[DataFrame, int], None], y: str = "y_true", p: str = "y_prob",
                       threshold: float = 0.5, available_now: bool = True,
                       checkpoint: str | None = None) -> StreamingQuery:
    """Read Parquet files from ``source_dir`` as they arrive, keep the histogram as
    state and hand the metric table of every micro-batch to ``on_metrics``.
    The stream checkpoint lives under the session's shared checkpoint folder."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    hist = streaming_histogram(stream, keys, y, p)
    ckpt = checkpoint or os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        on_metrics(metric_table(batch, keys, threshold), batch_id)

    w = hist.writeStream.outputMode("complete").option("checkpointLocation", ckpt).foreachBatch(per_batch)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def metrics_from_stream(spark: SparkSession, directory: str, schema: T.StructType,
                        transform: Callable[[DataFrame], DataFrame], keys: list[str],
                        y: str = "y_true", p: str = "y_prob", threshold: float = 0.5,
                        file_glob: str | None = None) -> DataFrame:
    """Run the stream to completion (``availableNow``) over the Parquet files in
    ``directory`` (optionally only those matching ``file_glob``) and return the metric
    table of the final micro-batch (one row per key group)."""
    reader = spark.readStream.schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    stream = transform(reader.parquet(directory))
    hist = streaming_histogram(stream, keys, y, p)
    ckpt = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    last: list = []

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        rows = metric_table(batch, keys, threshold).collect()   # one row per key group
        last[:] = [rows]

    q = hist.writeStream.outputMode("complete").option("checkpointLocation", ckpt) \
            .foreachBatch(per_batch).trigger(availableNow=True).start()
    q.awaitTermination()
    schema_out = metric_table(spark.createDataFrame([], hist.schema), keys, threshold).schema
    return spark.createDataFrame(last[0] if last else [], schema_out)
