"""Session set-up and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shuffle_partitions_for(input_bytes: int, target_bytes: int = 1 << 30, most: int = 100_000) -> int:
    """Shuffle partitions for an input of this size.

    AQE merges small partitions but does not split large ones outside of joins, so the
    number to start from has to fit the input: 100 TB at about 1 GB each.
    """
    return max(200, min(most, -(-input_bytes // target_bytes)))


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "kifuframe", **conf: str) -> SparkSession:
    """A session with the settings the operators are planned for.

    On a cluster leave ``master`` unset and take ``shuffle_partitions`` from
    :func:`shuffle_partitions_for`; AQE merges what turns out small. Rows get wide after the shuffle
    (a ply becomes a position, a position eight examples), so partitions are kept
    smaller than AQE would choose by the shuffled bytes.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32m")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # hash joins instead of sorts, but only where AQE has seen the build side to be small
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "32m")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    A temporary folder is made only on a local master (tests); on a cluster its executors could not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/kifuframe/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written below the shared folder and read again: cut lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the data survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
