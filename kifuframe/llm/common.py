"""Helpers shared by the training-data operators: stored stages, ranges of a key, Arrow output."""

from __future__ import annotations

import gc
import sys
import time
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kifuframe.session import scratch_path

# White space as the operators of this package define it, and the letters they fold.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEAST_LONG = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that clash with none of ``df``, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while f"_{name}" in taken:
            name = f"{name}_"
        out.append(f"_{name}")
        taken.add(f"_{name}")
    return out


def stored(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage, survives lost executors.

    Unless ``small``, Spark is asked to delete the shuffle files behind it now.
    """
    return _written(df, name, small)[0]


def _written(df: DataFrame, name: str, small: bool) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{name}")
    df.write.option("compression", "zstd").parquet(path)
    if not small:
        release(spark)
    return spark.read.schema(df.schema).parquet(path), path


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing will read again."""
    files = df.inputFiles()
    if files:
        _delete(df.sparkSession, files[0].rsplit("/", 1)[0])


class Scratch:
    """The stored tables of one run: each is deleted after its last reader, and the rest when the run is over.

    ``close`` spares the tables that the result reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def stored(self, df: DataFrame, name: str, small: bool = False) -> DataFrame:
        table, path = _written(df, name, small)
        self.paths[id(table)] = (table, path)
        return table

    def stored_with(self, df: DataFrame, name: str, **figures: str) -> tuple[DataFrame, dict]:
        """A small stored table and figures of it (SQL aggregates), taken while it was written."""
        seen = Observation()
        kept = self.stored(df.observe(seen, *[F.expr(figure).alias(key) for key, figure in figures.items()]), name, small=True)
        return kept, seen.get

    def stored_in_parts(self, parts: Iterable[DataFrame], name: str) -> DataFrame:
        """A stored table written part after part, so that the shuffle files of only one part are on disk at a time."""
        path = scratch_path(self.spark, f"llm/{name}")
        for part in parts:
            schema = part.schema
            part.write.mode("append").option("compression", "zstd").parquet(path)
            release(self.spark)
        table = self.spark.read.schema(schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            held = self.paths.pop(id(table), None)
            if held:
                _delete(self.spark, held[1])

    def close(self, *spared: DataFrame) -> None:
        keep = {id(t) for t in spared}
        self.drop(*[t for key, (t, _) in list(self.paths.items()) if key not in keep])


def release(spark: SparkSession) -> None:
    """Ask Python and the JVM to notice dropped shuffles, so that their files go now and not at the end.

    Spark's listeners hold the last query that has ended, so an empty one takes its place first.
    """
    spark.range(0).collect()
    time.sleep(0.2)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def kept_in_worker(name: str, make: Callable):
    """What ``make`` returns, made once per Python process.

    Functions travel to the workers by value, so the globals of a module do not last from task to task; a module that
    only holds such things does.
    """
    holder = sys.modules.setdefault("kifuframe_kept", types.ModuleType("kifuframe_kept")).__dict__
    if name not in holder:
        holder[name] = make()
    return holder[name]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: Column, parts: int, per_part: int = 32) -> list[int]:
    """Lower bounds of at most ``parts`` ranges of a long key; each bound is a key that exists.

    The bounds come from about ``parts * per_part`` distinct keys chosen by their hash, so they
    depend on the data alone, not on how it is laid out. The driver holds that many
    numbers, as for Spark's own range partitioning. The first bound is the smallest key;
    an empty table gives no bound.
    """
    keys = df.select(key.alias("k"))
    rows, least = keys.agg(F.count(F.lit(1)), F.min("k")).first()
    if not rows:
        return []
    share = min(1.0, parts * per_part / rows)
    cut = int(share * (1 << 32))
    drawn = (
        keys.where(F.pmod(F.xxhash64(F.lit(17), "k"), F.lit(1 << 32)) < cut)
        .groupBy("k").count().collect())
    pairs = sorted((r["k"], r["count"]) for r in drawn)
    if not pairs:
        return [least]
    values = np.array([p[0] for p in pairs], dtype=np.int64)
    weight = np.cumsum([p[1] for p in pairs])
    at = np.searchsorted(weight, weight[-1] * np.arange(1, parts) / parts, side="right")
    return sorted({least, *(int(v) for v in values[np.minimum(at, len(values) - 1)])})


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 2_000,
               most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded count and, by their texts and arrays, bounded size."""
    held: list[tuple] = []
    held_bytes = 0
    for row in rows:
        held.append(row)
        held_bytes += sum(len(v) for v in row if isinstance(v, (str, bytes, list, np.ndarray)))
        if len(held) >= size or held_bytes >= most_bytes:
            yield _batch(held, schema)
            held, held_bytes = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def with_columns(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns appended; a column of the same name, whatever its case, is replaced."""
    new = {name.lower() for name in added}
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n.lower() not in new]
    names = [n for n, _ in kept] + list(added)
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(added.values()), names=names)


def schema_with(df: DataFrame, added: str) -> str:
    """DDL of ``df`` followed by the added columns, without columns that they replace."""
    new = {part.strip().split()[0].lower() for part in added.split(",")}
    old = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name.lower() not in new]
    return ", ".join(old + [added])
