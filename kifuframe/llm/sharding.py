"""Uniform shuffle into shards of exact size.

How many rows of each stored partition go to each shard is drawn from the multivariate
hypergeometric distribution, which is what a uniform shuffle of all rows would give. Each
partition permutes its rows to decide which ones go, the rows are exchanged, and each shard
permutes what it got.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kifuframe.llm.common import fresh, shuffle_width, stored, with_columns

MOST_PARTS = 4_000_000
#: numpy draws from populations below this size only.
NUMPY_ROWS = 1_000_000_000


def even_sizes(rows: int, cells: int) -> np.ndarray:
    """Sizes that differ by one at most and sum to ``rows``."""
    return rows // cells + (np.arange(cells) < rows % cells).astype(np.int64)


def hypergeometric(draw: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` rows drawn without replacement are good, for populations of any size.

    The sample is the rows with the smallest of independent uniform numbers. The k-th smallest number of the good
    rows is beta distributed, and given it the count of bad rows below is binomial; that tells on which side of it the
    sample ends, and the rows of that side are uniform again. A k just beyond the end leaves few rows.
    """
    found, sign = 0, 1
    while good + bad >= NUMPY_ROWS:
        if 2 * sample > good + bad:  # the rows that are not drawn
            found, sign, sample = found + sign * good, -sign, good + bad - sample
        if good < bad:
            found, sign, good, bad = found + sign * sample, -sign, bad, good
        if not sample or not bad:
            return found + sign * sample
        mean = sample * good / (good + bad)
        k = min(good, int(mean + 4 * mean ** 0.5) + 4)
        below = int(draw.binomial(bad, draw.beta(k, good + 1 - k)))
        if k + below > sample:
            good, bad = k - 1, below
        else:
            found, good, bad, sample = found + sign * k, good - k, bad - below, sample - k - below
    return found + sign * int(draw.hypergeometric(good, bad, sample))


def split_of_counts(draw: np.random.Generator, counts: np.ndarray, left: int) -> np.ndarray:
    """The cell counts of ``left`` rows drawn from ``counts``; cells are halved until numpy can draw a range of them."""
    if not left:
        return np.zeros_like(counts)
    if int(counts.sum()) < NUMPY_ROWS:
        return draw.multivariate_hypergeometric(counts, left, method="marginals")
    if len(counts) == 1:
        return np.array([left], counts.dtype)
    middle = len(counts) // 2
    first = hypergeometric(draw, int(counts[:middle].sum()), int(counts[middle:].sum()), left)
    return np.concatenate((split_of_counts(draw, counts[:middle], first), split_of_counts(draw, counts[middle:], left - first)))


def row_of_matrix(part: int, sizes: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix: rows of that partition for each cell.

    The matrix is drawn by halves: the cell counts of a range of partitions are split between
    its two halves by one draw whose generator is seeded by the range. Any task can so draw its
    own row, in log(partitions) steps, and all rows agree with each other.
    ``starts[i]`` is the number of rows before partition ``i``.
    """
    low, high, counts = 0, len(starts) - 1, sizes
    while high - low > 1:
        middle = (low + high) // 2
        left = int(starts[middle] - starts[low])
        draw = np.random.default_rng([seed, low, high])
        taken = split_of_counts(draw, counts, left)
        if part < middle:
            high, counts = middle, taken
        else:
            low, counts = middle, counts - taken
    return counts


def uniform_shards(rows: DataFrame, shards: int = 16, seed: int = 7, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``rows`` with the ``shard`` of each row and its ``slot`` there, gapless from 0.

    Every assignment with shard sizes that differ by one at most is equally likely. A shard is
    cut into cells of exact size, as many as the session has shuffle partitions, so that the
    second permutation needs no task larger than a cell.

    * Rows are moved whatever they hold: nulls, equal rows and long texts play no part in the draw.
    * An empty table gives an empty table; fewer rows than shards leave some shards empty.
    * Input columns with the names of the added ones are replaced.

    The input is stored first, because the counts and the rows have to come from the same
    partitions even if an executor is lost. The driver sees one count per stored partition
    (8 bytes each, at most 32 MB), never a row.
    """
    spark = rows.sparkSession
    given = [c for c in rows.columns if c.lower() not in (shard.lower(), slot.lower())]
    part, place, cell, draw, rank = fresh(rows, "part", "place", "cell", "draw", "rank")
    mark = F.monotonically_increasing_id()
    kept = stored(rows.select(*given, F.shiftright(mark, 33).cast("int").alias(part),
                              mark.bitwiseAND(F.lit((1 << 33) - 1)).alias(place)), "sharding")
    counted = sorted((r[part], r["count"]) for r in kept.groupBy(part).count().collect())
    if len(counted) > MOST_PARTS:
        raise ValueError(f"{len(counted)} partitions; store the input in at most {MOST_PARTS}")
    index_of = {p: i for i, (p, _) in enumerate(counted)}
    starts = np.concatenate([[0], np.cumsum([n for _, n in counted])]).astype(np.int64)
    total = int(starts[-1])
    per_shard = max(1, -(-shuffle_width(spark) // shards))
    sizes = np.concatenate([even_sizes(int(n), per_shard) for n in even_sizes(total, shards)])
    shard_starts = np.concatenate([[0], np.cumsum(even_sizes(total, shards))])
    base = np.cumsum(np.concatenate([[0], sizes[:-1]])) - np.repeat(shard_starts[:-1], per_shard)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: dict[int, np.ndarray] = {}
        for batch in batches:
            parts = batch.column(part).to_numpy()
            places = batch.column(place).to_numpy()
            got = np.empty(batch.num_rows, np.int32)
            for p in np.unique(parts):
                if p not in labels:
                    i = index_of[int(p)]
                    label = np.repeat(np.arange(len(sizes), dtype=np.int32), row_of_matrix(i, sizes, starts, seed))
                    np.random.default_rng([seed, 1, i]).shuffle(label)
                    labels = {int(p): label}  # rows come partition by partition
                here = parts == p
                got[here] = labels[int(p)][places[here]]
            yield with_columns(batch, {cell: pa.array(got, pa.int32())})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    labelled = kept.mapInArrow(run, f"{fields}, `{cell}` int") if total else kept.withColumn(cell, F.lit(0))
    order = Window.partitionBy(cell).orderBy(draw, part, place)
    first = F.get(F.array(*[F.lit(int(b)) for b in base]), F.col(cell)) if len(base) <= 256 else None
    moved = labelled.withColumn(draw, F.xxhash64(F.lit(seed), part, place)).repartitionById(len(sizes), F.col(cell))
    ranked = moved.withColumn(rank, F.row_number().over(order) - 1)
    if first is None:
        offsets = spark.createDataFrame([(i, int(b)) for i, b in enumerate(base)], f"{cell}_ int, {rank}_ bigint")
        ranked = ranked.join(offsets, F.col(cell) == F.col(f"{cell}_"))
        first = F.col(f"{rank}_")
    return ranked.select(
        *given, F.floor(F.col(cell) / per_shard).cast("int").alias(shard),
        (F.col(rank) + first).cast("bigint").alias(slot))
