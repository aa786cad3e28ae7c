"""File sinks that can be repeated batch by batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table was already written at ``path``; any other failure is raised."""
    try:
        spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def write_batches(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "append",
                  **trigger) -> StreamingQuery:
    """Write each micro-batch to ``batch_id=<id>``; a repeated batch replaces its folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.outputMode(output_mode).foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
