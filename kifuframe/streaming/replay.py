"""A replay table fed by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kifuframe.operators.replay_table import FIRST_PRIORITY, evict, update_priorities
from kifuframe.sources.files import filesystem_of
from kifuframe.streaming.sinks import has_rows


def _held(spark: SparkSession, path: str, errors: str | None, order: str | None) -> DataFrame:
    """Stored rows with the priorities that the error table gives them."""
    rows = spark.read.parquet(path)
    if errors and has_rows(spark, errors):
        rows = update_priorities(rows, spark.read.parquet(errors), order)
    return rows


def _expired(spark: SparkSession, path: str, before: int, capacity: int) -> list[int]:
    """Earlier micro-batches none of whose rows is in the ring any more: one count per stored batch."""
    counts = spark.read.parquet(path).where(F.col("batch_id") < before).groupBy("batch_id").count().collect()
    newer, gone = 0, []
    for row in sorted(counts, key=lambda r: -r["batch_id"]):
        if newer >= capacity:
            gone.append(row["batch_id"])
        newer += row["count"]
    return gone


def stream_replay(rows: DataFrame, path: str, checkpoint: str, capacity: int, errors: str | None = None,
                  order: str | None = None, **trigger) -> StreamingQuery:
    """Push each micro-batch: its rows take the largest priority in the ring before it.

    ``rows`` carry a growing ``seq``. ``errors`` is a Parquet table ``(seq, td_error)`` written by the training
    side, read again for each micro-batch; of several errors of a row the last in ``order`` counts.

    A micro-batch writes one folder named by its id and overwrites it when it is run again, so a retry
    neither loses nor doubles rows. Folders that were out of the ring before a micro-batch are deleted after it, so
    the cost of a micro-batch follows the ring and not the history.
    """
    def push_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        top, gone = F.lit(FIRST_PRIORITY), []
        if has_rows(spark, path):
            gone = _expired(spark, path, batch_id, capacity)
            live = _held(spark, path, errors, order).where((F.col("batch_id") < batch_id) & ~F.col("batch_id").isin(gone))
            top = evict(live, capacity).agg(F.coalesce(F.max("priority"), F.lit(FIRST_PRIORITY)).alias("top")).scalar()
        batch.withColumn("priority", top).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        files, base = filesystem_of(path)
        for old in gone:
            files.delete_dir(f"{base}/batch_id={old}")

    return rows.writeStream.foreachBatch(push_batch).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def read_replay(spark: SparkSession, path: str, capacity: int, errors: str | None = None,
                order: str | None = None) -> DataFrame:
    """The newest ``capacity`` rows of the streamed table with their current priorities."""
    return evict(_held(spark, path, errors, order).drop("batch_id"), capacity)
