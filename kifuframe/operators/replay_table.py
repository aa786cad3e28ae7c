"""Prioritized replay as operations on a table ``replay(seq, ..., priority)``.

``seq`` is the push counter: :func:`push` numbers its batch densely. Global figures (sum,
maximum) enter as scalar subqueries, so no window without a key is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kifuframe.functions.keyed_random import keyed_uniform
from kifuframe.operators.ordering import first_rows, number_rows

# Fixed values.
FIRST_PRIORITY = 1.0
PRIORITY_FLOOR = 1e-6

BUCKETS = 4_096
LARGEST_KEY = 1e300


def push(replay: DataFrame, batch: DataFrame, order: Sequence[str]) -> DataFrame:
    """Append rows with the current largest priority, 1.0 when the table is empty.

    The rows of the batch get the numbers that follow the largest ``seq``, without gaps, in the given order
    of their columns. An own ``seq`` of the batch is replaced.
    """
    held = replay.agg(
        F.coalesce(F.max("priority"), F.lit(FIRST_PRIORITY)).alias("top"), F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))
    numbered = number_rows(batch.withColumn("_all", F.lit(0)), "_all", order, "_place").drop("_all")
    placed = numbered.withColumn("seq", F.col("_place") + held.select("last").scalar() + 1).drop("_place")
    return replay.unionByName(placed.withColumn("priority", held.select("top").scalar()))


def _bounds_of_newest(replay: DataFrame, capacity: int) -> tuple[int, int] | None:
    """The ``capacity``-th largest ``seq`` and how many rows of that value are kept; None keeps all.

    Counts in at most BUCKETS buckets narrow the range of values, so the driver sees those counts and no row.
    """
    column = replay.select(F.col("seq").cast("bigint").alias("seq"))
    rows, low, high = column.agg(F.count("*"), F.min("seq"), F.max("seq")).first()
    if rows <= capacity:
        return None
    if low is None:
        return None if capacity else (0, 0)
    wanted = capacity
    while low < high:
        width = -(-(high - low + 1) // BUCKETS)
        counts = (
            column.where(F.col("seq").between(low, high))
            .groupBy(F.call_function("div", F.col("seq") - F.lit(low), F.lit(width)).alias("bucket")).count().collect())
        for row in sorted(counts, key=lambda r: -r["bucket"]):
            if row["count"] >= wanted:
                low, high = low + row["bucket"] * width, min(high, low + (row["bucket"] + 1) * width - 1)
                break
            wanted -= row["count"]
        else:  # fewer numbered rows than the capacity
            return low - 1, 0
    return low, wanted


def evict(replay: DataFrame, capacity: int) -> DataFrame:
    """Ring buffer: keep exactly the newest ``capacity`` rows by ``seq``, whatever gaps it has.

    Of rows that share the last ``seq`` in the ring as many stay as fit; rows without a ``seq`` are the oldest.
    """
    bounds = _bounds_of_newest(replay, capacity)
    if bounds is None:
        return replay
    last, of_last = bounds
    newer = replay.where(F.col("seq") > last)
    return newer.unionByName(replay.where(F.col("seq") == last).limit(of_last)) if of_last else newer


def sampling_probs(replay: DataFrame, alpha: float = 0.6) -> DataFrame:
    """``priority^alpha``, normalised over the table."""
    scaled = F.pow(F.col("priority"), F.lit(alpha))
    return replay.withColumn("prob", scaled / replay.agg(F.sum(scaled)).scalar())


def sample(replay: DataFrame, k: int, seed: int, alpha: float = 0.6) -> DataFrame:
    """Weighted draw of ``k`` rows without replacement.

    Exponential keys ``-ln(u)/w``: the k smallest keys are such a draw. For a large k the k-th smallest
    key is found by counting, and the draw is a filter. A row without a priority comes first, one of priority 0 last.
    """
    u = 1.0 - keyed_uniform(seed, F.col("seq"))
    weight = F.pow(F.col("priority"), F.lit(alpha))
    key = F.when(weight > 0, F.least(-F.log(u) / weight, F.lit(LARGEST_KEY))).when(weight.isNotNull(), F.lit(LARGEST_KEY)).otherwise(F.lit(-1.0))
    return _first(replay.withColumn("_key", key), k)


def _first(keyed: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of the smallest ``_key``, of equal ones the smallest ``seq``; a null ``seq`` comes first."""
    place = F.coalesce(F.col("seq").cast("bigint"), F.lit(-(1 << 63)))
    return first_rows(keyed.withColumn("_place", place), k, ["_key", "_place"]).drop("_key", "_place")


def sample_uniform(replay: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` rows with equal chance; every weight is 1."""
    return _first(replay.withColumn("_key", keyed_uniform(seed, F.col("seq"))), k).withColumn("weight", F.lit(1.0))


def importance_weights(sampled: DataFrame, replay: DataFrame, beta: float = 0.4) -> DataFrame:
    """``(N * prob)^-beta`` over the largest of the batch; ``sampled`` carries ``prob``."""
    rows = replay.agg(F.count("*")).scalar()
    raw = sampled.withColumn("_raw", F.pow(rows * F.col("prob"), F.lit(-beta)))
    return raw.withColumn("weight", F.col("_raw") / raw.agg(F.max("_raw")).scalar()).drop("_raw")


def update_priorities(replay: DataFrame, td: DataFrame, order: str | None = None) -> DataFrame:
    """New priority ``|td_error| + 1e-6`` for the rows in ``td(seq, td_error)``.

    Of several errors of one row the last in ``order`` counts, without an order the largest by size.
    """
    size = F.abs("td_error")
    fresh = td.groupBy("seq").agg(
        ((F.max_by(size, order) if order else F.max(size)) + PRIORITY_FLOOR).alias("_fresh"))
    return (
        replay.join(fresh, "seq", "left")
        .withColumn("priority", F.coalesce(F.col("_fresh"), F.col("priority"))).drop("_fresh")
    )
