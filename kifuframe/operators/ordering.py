"""Row numbers and running sums that no single large group can stall.

A window over a key sorts the whole key in one task. Here a key is cut into
ranges of the order that one task can hold. The window runs inside a
range, and the sums of the earlier ranges, a small aggregate, are added.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kifuframe.session import stored

CHUNK = 65_536
#: So many rows may be sorted and merged by one task; more are found by counting in so many buckets.
FEW, BUCKETS = 65_536, 4_096


def number_rows(df: DataFrame, key: str, order: Sequence[str], out: str) -> DataFrame:
    """Zero-based position of each row inside its key.

    All rows are dealt into ranges of (key, order) and sorted, so a large key takes many ranges
    and none is special. A key's part in a range is numbered from the range's own count; the counts of its earlier
    ranges, one small row per key and range, are added. The sorted rows are stored, because
    both passes have to see the same ranges. Rows that agree in ``key`` and ``order`` share a range.
    """
    mark = F.monotonically_increasing_id()
    placed = stored(
        df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
        .withColumn("_range", F.shiftright(mark, 33).cast("int"))
        .withColumn("_at", mark.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    return _numbered(placed, key, out)


def _numbered(placed: DataFrame, key: str, out: str) -> DataFrame:
    """Positions inside the key from ``_range`` and ``_at``, the place in its task of a row that lies beside all others of its key and range."""
    earlier = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_of"))
        .agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
        .select("_key", "_of", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_skip")))
    return (
        placed.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")))
        .withColumn(out, F.col("_at") + F.col("_skip"))
        .drop("_range", "_at", "_key", "_of", "_skip")
    )


def first_rows(df: DataFrame, k: int, order: Sequence[str], few: int = FEW) -> DataFrame:
    """Exactly the first ``k`` rows in ascending order of some columns, which are finite numbers and not null.

    Beyond ``few`` rows nothing is merged in one task: counts in buckets of a column narrow the range that holds the last row to a few
    rows, or to one value, within which the next column goes on; what lies below is a filter. The driver sees count, least and largest
    value per bucket. ``df`` is read a few times, so it should be cheap or stored.
    """
    if k <= few:
        return df.orderBy(*order).limit(k)
    sure: list[DataFrame] = []
    held, wanted = df, k
    for name in order:
        column = F.col(name)
        total, low, high = held.agg(F.count(F.lit(1)), F.min(column), F.max(column)).first()
        if total <= wanted:
            return _together([*sure, held])
        while total > few and low < high and (width := (float(high) - float(low)) / BUCKETS) > 0:
            wide = isinstance(low, int) and high - low >= 1 << 53  # beyond what a double counts exactly, and perhaps beyond a long
            above = column.cast("double") - F.lit(float(low)) if wide else (column - F.lit(low)).cast("double")
            bucket = F.floor(above / F.lit(width))
            counts = held.where(column.between(low, high)).groupBy(bucket.alias("_bucket")).agg(
                F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy("_bucket").collect()
            for row in counts:
                if row["n"] > wanted:
                    break
                wanted -= row["n"]
            narrowed = (row["low"], row["high"]) != (low, high)
            total, low, high = row["n"], row["low"], row["high"]
            if not narrowed:
                break
        sure.append(held.where(column < low))
        held = held.where(column.between(low, high))
        if total <= few or not wanted:
            break
    return _together([*sure, held.orderBy(*order).limit(wanted)])


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def chunk_of(index: Column, chunk: int = CHUNK) -> Column:
    """Range of a dense index that one task handles."""
    return F.call_function("div", index, F.lit(chunk))


def running_sums(df: DataFrame, key: str, index: str, values: dict[str, Column],
                 chunk: int = CHUNK) -> DataFrame:
    """Inclusive running sums along a dense index, chunk by chunk."""
    staged = df.withColumn("_chunk", chunk_of(F.col(index), chunk))
    for name, value in values.items():
        staged = staged.withColumn(name, value)
    inside = (
        Window.partitionBy(key, "_chunk").orderBy(index)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sums = staged.groupBy(F.col(key).alias("_key"), F.col("_chunk").alias("_of")).agg(
        *[F.sum(name).alias(name) for name in values])
    offsets = sums.select(
        "_key", "_of", *[F.sum(name).over(before).alias(f"_skip_{name}") for name in values])
    local = staged.select(
        *df.columns, "_chunk", *[F.sum(name).over(inside).alias(name) for name in values])
    joined = local.join(offsets, (F.col(key) == F.col("_key")) & (F.col("_chunk") == F.col("_of")), "left")
    return joined.select(*df.columns, *[
        (F.col(name) + F.coalesce(F.col(f"_skip_{name}"), F.lit(0))).alias(name) for name in values])


def shuffled_positions(df: DataFrame, group: str, draw: str, ties: Sequence[str], out: str) -> DataFrame:
    """Zero-based position of each row of a group in the order of a uniform 32-bit ``draw``.

    Equal ranges of a uniform draw hold even shares of any input, so there is one per shuffle partition, and neither a hot
    key nor a sampled boundary is involved. ``df`` is read and exchanged once: the sorted ranges are stored, and their
    counts, one small row per group and range, are taken from there.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(
        df.withColumn("_range", F.shiftright(F.col(draw) * F.lit(ranges), 32).cast("int"))
        .repartitionById(ranges, F.col("_range")).sortWithinPartitions(group, draw, *ties)
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "shuffled")
    return _numbered(placed, group, out)
