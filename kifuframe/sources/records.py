"""Scans and sinks for record files, archives, games and runs."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kifuframe.operators.ordering import number_rows
from kifuframe.operators.records import parse_headers, parse_moves
from kifuframe.sources.files import filesystem_of

# File names that are read, in any case.
RECORD_GLOB = "*.[sS][gG][fF]"
ARCHIVE_GLOB = "{*.[tT][gG][zZ],*.[tT][aA][rR].[gG][zZ]}"
REPLACEMENT = "\ufffd"
NONCHARACTER = "\ufdd0"
MEMBERS_PER_BATCH = 1_000
#: So many records may be sorted and merged by one task.
FEW_RECORDS = 10_000
RECORD_SCHEMA = "game_id string, source string, member string, place bigint, text string"
RECORD_COLUMNS = ["game_id", "source", "member", "place", "text"]


def decode_text(content: Column) -> Column:
    """UTF-8 bytes to text: malformed bytes are dropped, line ends become ``\\n``."""
    raw = content.cast("string")
    # a replacement character that is really in the text is set aside meanwhile
    aside = F.replace(raw, F.lit(REPLACEMENT), F.lit(NONCHARACTER))
    dropped = F.replace(F.make_valid_utf8(aside), F.lit(REPLACEMENT), F.lit(""))
    repaired = F.replace(dropped, F.lit(NONCHARACTER), F.lit(REPLACEMENT))
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(repaired)
    return F.regexp_replace(text, "\r\n?", "\n")


def _binary_files(spark: SparkSession, path: str, glob: str | None) -> DataFrame | None:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    try:
        return reader.load(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            return None
        raise


def read_record_files(spark: SparkSession, path: str, glob: str | None = RECORD_GLOB) -> DataFrame:
    """``game_id, source, member, text`` of loose record files; a missing path gives no rows."""
    files = _binary_files(spark, path, glob)
    if files is None:
        return spark.createDataFrame([], RECORD_SCHEMA)
    return files.select(
        F.col("path").alias("game_id"), F.col("path").alias("source"), F.lit("").alias("member"),
        F.lit(0).cast("bigint").alias("place"), decode_text(F.col("content")).alias("text"))


def _open_stream(path: str):
    filesystem, name = filesystem_of(path)
    return filesystem.open_input_stream(name, compression=None)


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of each archive, streamed member by member; an unreadable one is skipped.

    ``place`` counts the members of an archive, since a name can occur in it more than once.
    """
    for batch in batches:
        for path in batch["path"]:
            rows: list[tuple[str, str, str, int, str]] = []
            with _open_stream(path) as raw, tarfile.open(fileobj=raw, mode="r|gz") as tar:
                for place, info in enumerate(tar):
                    if not (info.isfile() and info.name.lower().endswith(".sgf")):
                        continue
                    try:
                        text = tar.extractfile(info).read().decode("utf-8", errors="ignore")
                    except Exception:
                        continue
                    rows.append((f"{path}#{info.name}", path, info.name, place, text))
                    if len(rows) == MEMBERS_PER_BATCH:
                        yield pd.DataFrame(rows, columns=RECORD_COLUMNS)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=RECORD_COLUMNS)


def read_record_archives(spark: SparkSession, path: str, glob: str | None = ARCHIVE_GLOB,
                         rebalance: bool = True) -> DataFrame:
    """Records inside ``.tgz``/``.tar.gz`` archives, without unpacking them to disk.

    gzip cannot be split, so an archive is the unit of reading; it is streamed, so its
    size does not matter. ``rebalance`` then evens out the records, since one archive
    may hold a large share of them and parsing costs more than moving the text.
    """
    files = _binary_files(spark, path, glob)
    if files is None:
        return spark.createDataFrame([], RECORD_SCHEMA)
    # only the path is read here; the file sizes still decide how files share tasks
    records = files.select("path").mapInPandas(_members, RECORD_SCHEMA)
    return records.hint("rebalance") if rebalance else records


def limit_games(records: DataFrame, n: int, few: int = FEW_RECORDS) -> DataFrame:
    """Exactly the first ``n`` rows by (source, member, place), 0 for all.

    Up to ``few`` rows each task keeps its own first ones, which are merged. Beyond, only the three columns are sorted and numbered by
    ranges, and the n-th of them is the cut up to which records are kept; the bodies are neither sorted nor merged.
    """
    if n <= 0:
        return records
    order = ["source", "member", "place"]
    if n <= few:
        return records.orderBy(*order).limit(n)
    numbered = number_rows(records.select(*order).withColumn("_all", F.lit(0)), "_all", order, "_at")
    last = numbered.where(F.col("_at") == n - 1).select(*order).first()
    if last is None:
        return records
    cut = F.struct(*[F.lit(last[c]).cast(records.schema[c].dataType).alias(c) for c in order])
    here = F.struct(*order)  # nulls first, as in the order
    before, same = numbered.agg(F.count_if(here < cut), F.count_if(here <= cut) - F.count_if(here < cut)).first()
    if before + same == n:
        return records.where(here <= cut)
    return records.where(here < cut).unionByName(records.where((here <= cut) & ~(here < cut)).limit(n - before))


def _games(texts: DataFrame, board_size: int | None, max_games: int = 0) -> DataFrame:
    """Records to games in one pass: header and size first, then the cut, moves only of what is left."""
    headed = parse_headers(texts, board_size=board_size)
    return parse_moves(limit_games(headed, max_games)).drop("place")


def read_game_dir(spark: SparkSession, path: str, board_size: int | None = None,
                  max_games: int = 0) -> DataFrame:
    """Parsed games of all record files below a folder."""
    return _games(read_record_files(spark, path), board_size, max_games)


def read_game_file(spark: SparkSession, path: str, board_size: int | None = None) -> DataFrame:
    """One file (or a glob of files, whatever their names end in); no row when the size differs."""
    return _games(read_record_files(spark, path, None), board_size)


def read_game_archive(spark: SparkSession, path: str, board_size: int | None = None,
                      max_games: int = 0) -> DataFrame:
    """Parsed games of one archive (or a glob of archives)."""
    return _games(read_record_archives(spark, path, None), board_size, max_games)


def read_game_archives(spark: SparkSession, path: str, board_size: int | None = None,
                       max_games: int = 0) -> DataFrame:
    """Parsed games of all archives below a folder, one scan."""
    return _games(read_record_archives(spark, path), board_size, max_games)


def write_games(games: DataFrame, path: str, by_board_size: bool = True, mode: str = "errorifexists") -> None:
    """Move lists and results as Parquet, one folder per board size."""
    writer = games.write.mode(mode)
    if by_board_size and "board_size" in games.columns:
        writer = writer.partitionBy("board_size")
    writer.parquet(path)


def read_games(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_run(model: PipelineModel, metadata: dict, path: str, spark: SparkSession) -> None:
    """Checkpoint of a model with free metadata (phase, epochs, loss, games, steps)."""
    model.write().overwrite().save(f"{path}/model")
    entries = [(str(key), str(value)) for key, value in metadata.items()]
    spark.createDataFrame(entries, "key string, value string").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/metadata")


def read_run(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/metadata")
