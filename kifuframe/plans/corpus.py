"""Writes the derived records as files and archives, so the scans have something to read."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kifuframe.functions.arrays import int_div
from kifuframe.plans import fixtures as fx
from kifuframe.session import scratch_path
from kifuframe.sources.files import filesystem_of


def file_name() -> Column:
    """``<game_id>-<part>.sgf``, upper-case ending for odd games."""
    ending = F.when(F.col("game_id") % 2 == 0, ".sgf").otherwise(".SGF")
    return F.concat(F.col("game_id").cast("string"), F.lit("-"), F.col("part").cast("string"), ending)


def write_record_files(records: DataFrame, folder: str) -> int:
    """One file per record in nested folders, written by the tasks."""
    named = records.select(
        F.concat(F.lit("d"), (F.col("game_id") % 10).cast("string"), F.lit("/"), file_name()).alias("name"), "text")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, base = filesystem_of(folder)
        for batch in batches:
            for name, text in zip(batch["name"], batch["text"]):
                target.create_dir(f"{base}/{name.rsplit('/', 1)[0]}")
                with target.open_output_stream(f"{base}/{name}") as out:
                    out.write(text.encode("utf-8"))
            yield pd.DataFrame({"files": [len(batch)]})

    return named.mapInPandas(write, "files bigint").agg(F.sum("files")).first()[0] or 0


def write_archives(records: DataFrame, folder: str) -> int:
    """One ``.tgz`` per ten games and record part, so an archive has at most ten members."""
    named = records.select(
        int_div(F.col("game_id"), 10).alias("shelf"), "part", file_name().alias("name"), "text")

    def pack(shelf: pd.DataFrame) -> pd.DataFrame:
        target, base = filesystem_of(folder)
        target.create_dir(base)
        packed = io.BytesIO()
        with tarfile.open(fileobj=packed, mode="w:gz") as tar:
            for name, text in sorted(zip(shelf["name"], shelf["text"])):
                data = text.encode("utf-8")
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        with target.open_output_stream(
                f"{base}/games-{shelf['shelf'].iloc[0]}-{shelf['part'].iloc[0]}.tgz", compression=None) as out:
            out.write(packed.getvalue())
        return pd.DataFrame({"files": [1]})

    return named.groupBy("shelf", "part").applyInPandas(pack, "files bigint").agg(F.sum("files")).first()[0] or 0


def file_corpus(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch_path(spark, "records")
    write_record_files(fx.records(spark, sf_dir), folder)
    return folder


def archive_corpus(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch_path(spark, "archives")
    write_archives(fx.records(spark, sf_dir), folder)
    return folder


def ids_of(name: str) -> list[Column]:
    """``game_id`` and ``part`` read back from a file or member name."""
    pattern = r"(\d+)-(\d+)\.[sS][gG][fF]$"
    return [
        F.regexp_extract(name, pattern, 1).cast("bigint").alias("game_id"),
        F.regexp_extract(name, pattern, 2).cast("int").alias("part"),
    ]
