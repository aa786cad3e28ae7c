"""Record files as a stream: each new file is parsed as it lands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kifuframe.operators.records import parse_games
from kifuframe.sources.records import RECORD_GLOB, decode_text

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_games(spark: SparkSession, path: str, board_size: int | None = None,
                 files_per_trigger: int | None = None) -> DataFrame:
    """Parsed games of new record files; the same columns as the batch scan."""
    reader = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
        .option("recursiveFileLookup", "true").option("pathGlobFilter", RECORD_GLOB)
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    texts = reader.load(path).select(
        F.col("path").alias("game_id"), F.col("path").alias("source"), F.lit("").alias("member"),
        decode_text(F.col("content")).alias("text"))
    return parse_games(texts, board_size=board_size)
