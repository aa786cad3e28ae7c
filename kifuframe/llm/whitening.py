"""Whitening of embeddings by shifted CholeskyQR.

The centred rows A are made orthogonal without ever being gathered: a pass sums the Gram matrix of the rows, the driver
takes its Cholesky factor (of the Gram matrix plus a small shift where it is too close to singular), and
the next pass divides every row by the factors so far with triangular solves. The factors compose to R with A = QR, and the
singular vectors and values of R are the components and deviations of A.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kifuframe.llm.common import fresh, stored, with_columns

COMPONENTS = 32
SCALE, OFFSET = 64.0, 1_000_000
#: Entries from here on have no place in a long after scaling.
LARGEST = float(1 << 46)
MOST_PASSES = 8
#: Rows are orthogonal when their Gram matrix is this close to the identity.
CLOSE = 1e-10
#: Components below this share of the largest deviation are rounding and have no direction.
RANK_SHARE = 1e-12
BLOCK = 4_096


def within(entry: Column) -> Column:
    """Finite and not immense; NaN compares as the largest number."""
    return entry.isNotNull() & (entry.cast("double") > -LARGEST) & (entry.cast("double") < LARGEST)


def grid(entry: Column) -> Column:
    """An entry on the integer grid; null outside of it, as Spark may try it before the row is dropped."""
    return F.when(within(entry), F.floor(F.lit(SCALE) * entry.cast("double")) + F.lit(OFFSET))


def usable(vector: Column) -> Column:
    """Not null and without null, non-finite or immense entries."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, within), F.lit(False))


def divided(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """X with ``X @ upper = rows``, by substitution."""
    out = np.empty_like(rows)
    for j in range(len(upper)):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def centred(numbers: np.ndarray, count: int, sums: np.ndarray) -> np.ndarray:
    """``x - S / n`` from the whole numbers ``n x - S``."""
    return _lifted(numbers, count, sums).astype(np.float64) / count


def _lifted(numbers: np.ndarray, count: int, sums: np.ndarray) -> np.ndarray:
    wide = float(np.abs(numbers).max(initial=0)) * count >= 2.0 ** 62 or float(np.abs(sums.astype(np.float64)).max(initial=0)) >= 2.0 ** 62
    if wide:
        return numbers.astype(object) * count - sums.astype(object)
    return numbers * count - sums


def deviations(numbers: np.ndarray, count: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of ``(n x - S) ** 2``; None for what no long holds."""
    lifted = _lifted(numbers, count, sums)
    largest = max((abs(int(v)) for v in (lifted.max(initial=0), lifted.min(initial=0))), default=0)
    if largest * largest * max(1, lifted.shape[1]) < 1 << 63:
        return (lifted * lifted).sum(axis=1).tolist()
    exact = [sum(int(v) * int(v) for v in row) for row in lifted]
    return [v if v < 1 << 63 else None for v in exact]


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, width)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            yield whole.slice(at, BLOCK)


def _gram(rows: DataFrame, x: str, width: int, make: Callable[[np.ndarray], np.ndarray], columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrix and sums of the rows that ``make`` gives for blocks of numbers; each task adds its own first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((columns, columns)), np.zeros(columns)
        for batch in _blocks(batches):
            part = make(_matrix(batch, x, width))
            total += part.T @ part
            sums += part.sum(axis=0)
        i, j = np.triu_indices(columns)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((i, np.arange(columns))).astype(np.int32)),
             pa.array(np.concatenate((j, np.full(columns, -1))).astype(np.int32)), pa.array(np.concatenate((total[i, j], sums)))],
            names=["i", "j", "v"])

    gram, means = np.zeros((columns, columns)), np.zeros(columns)
    parts = rows.select(x).mapInArrow(run, "i int, j int, v double")
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # columns ** 2 / 2 numbers
        if r["j"] < 0:
            means[r["i"]] = r["v"]
        else:
            gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["v"]
    return gram, means


def _sums(rows: DataFrame, x: str, width: int) -> tuple[int, np.ndarray]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = 0, np.zeros(width, np.int64)
        for batch in _blocks(batches):
            count += batch.num_rows
            sums += _matrix(batch, x, width).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, width, dtype=np.int32)), pa.array(np.concatenate(([count], sums)))], names=["i", "v"])

    found = {r["i"]: int(r["v"]) for r in rows.select(x).mapInArrow(run, "i int, v bigint").groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    sums = [found.get(i, 0) for i in range(width)]
    fits = all(abs(s) < 1 << 62 for s in sums)
    return found.get(-1, 0), np.array(sums, np.int64 if fits else object)


def _root(gram: np.ndarray, shifted: bool) -> np.ndarray:
    """Upper triangular factor of a Gram matrix, of a shifted one where it has no factor of its own."""
    width = len(gram)
    shift = 11 * width * (width + 1) * np.finfo(float).eps * np.trace(gram)
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(width)).T
        except np.linalg.LinAlgError:
            shift *= 10


def _triangle(rows: DataFrame, x: str, count: int, sums: np.ndarray) -> np.ndarray:
    """R with ``A = Q R`` for the centred rows A."""
    width = len(sums)
    factors: list[np.ndarray] = []

    def make(numbers: np.ndarray) -> np.ndarray:
        out = centred(numbers, count, sums)
        for factor in factors:
            out = divided(out, factor)
        return out

    for turn in range(MOST_PASSES):
        gram, _ = _gram(rows, x, width, make, width)
        if not gram.any():
            return np.zeros((width, width))
        if turn and np.abs(gram - np.eye(width)).max() < CLOSE:
            break
        factors.append(_root(gram, shifted=not turn))
    else:
        factors.pop()  # the last Gram matrix is that of the rows before it
    # rows without a direction leave a Gram matrix short of the identity: its root by eigenvalues closes the product
    values, vectors = np.linalg.eigh(gram)
    whole = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
    for factor in reversed(factors):
        whole = whole @ factor
    return whole


def whiten(vectors: DataFrame, embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The usable rows of ``vectors`` with ``n``, ``deviation``, ``whitened`` (array), ``explained`` (array) and ``identity_error``.

    Entries are put on an integer grid; the covariance is that of all remaining rows, divided by their number ``n``.
    ``whitened`` holds the projections on the components of largest variance, over the root of that; ``deviation`` is the exact
    sum of ``(n x - S) ** 2``. ``identity_error`` is the largest absolute entry of the covariance of
    ``whitened`` minus the identity, summed over all rows.

    * Rows drop out when the vector is null, holds null or non-finite entries or such of 2**46 or more, or
      is not as long as most are (of equally common lengths, the larger); so do empty vectors.
    * Components without variance have no direction and are left out: equal rows give empty arrays, error 0.
    * A deviation beyond a long is null. Repeated rows count each. An empty table gives an empty table.
    * Input columns with the names of the added ones are replaced.

    The driver holds some matrices of width x width, and so does each task; rows stay where they are.
    """
    added = ("n", "deviation", "whitened", "explained", "identity_error")
    given = [c for c in vectors.columns if c.lower() not in added]
    (x,) = fresh(vectors, "x")
    rows = vectors.where(usable(F.col(embedding))).select(*given, F.transform(embedding, grid).alias(x))
    widths = rows.groupBy(F.size(x).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = widths["width"] if widths else 0
    kept = stored(rows.where((F.size(x) == width) & (F.size(x) > 0)), "whitening", small=True)
    count, sums = _sums(kept, x, width) if width else (0, np.zeros(0, np.int64))
    triangle = _triangle(kept, x, count, sums) if count else np.zeros((0, 0))
    _, sizes, directions = np.linalg.svd(triangle) if triangle.size else (None, np.zeros(0), np.zeros((0, 0)))
    chosen = int((sizes[:components] > RANK_SHARE * sizes.max(initial=0)).sum())
    directions = directions[:chosen]
    signs = np.sign(directions[np.arange(chosen), np.abs(directions).argmax(axis=1)]) if chosen else np.zeros(0)
    variances = sizes[:chosen] ** 2 / max(1, count)
    turn = (directions * signs[:, None]).T / np.sqrt(variances)
    explained = (sizes[:chosen] ** 2 / (sizes ** 2).sum()).tolist() if chosen else []

    def projected(numbers: np.ndarray) -> np.ndarray:
        return centred(numbers, count, sums) @ turn

    error = 0.0
    if chosen:
        gram, total = _gram(kept, x, width, projected, chosen)
        error = float(np.abs(gram / count - np.outer(total / count, total / count) - np.eye(chosen)).max())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            numbers = _matrix(batch, x, width)
            values = projected(numbers) if chosen else np.zeros((batch.num_rows, 0))
            offsets = pa.array(np.arange(0, batch.num_rows * chosen + 1, chosen) if chosen else np.zeros(batch.num_rows + 1), pa.int32())
            yield with_columns(batch.select([c for c in batch.schema.names if c != x]), {
                "n": pa.array(np.full(batch.num_rows, count)), "deviation": pa.array(deviations(numbers, count, sums), pa.int64()),
                "whitened": pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1), pa.float64()))})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != x)
    made = kept.mapInArrow(run, f"{fields}, n bigint, deviation bigint, whitened array<double>")
    return made.select("*", F.array(*[F.lit(v) for v in explained]).cast("array<double>").alias("explained"),
                       F.lit(error).alias("identity_error"))
