"""Document fingerprints by winnowing.

Every run of GRAM code points is hashed, and of every WINDOW neighbouring hashes the smallest is
kept, the rightmost of equal ones. Two texts that share a run of WINDOW + GRAM - 1 code points
therefore share a fingerprint, and the kept positions say where.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from kifuframe.llm.common import LEAST_LONG, batches_of, fresh, range_bounds, schema_with, shuffle_width, with_columns

GRAM = 16
WINDOW = 48
HASH_BITS = 44
PLACE_BITS = 64 - HASH_BITS
_BASE = 0x9E3779B97F4A7C15
_PLACES = (1 << PLACE_BITS) - 1


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """44-bit hashes of all runs of ``gram`` code points: a rolling polynomial, then mixed.

    Runs of 2m come from runs of m, so the cost is log(gram) passes over the text.
    """
    n = len(codes) - gram + 1
    power, done, total = codes.astype(np.uint64) + np.uint64(1), 0, None
    size, base = 1, _BASE
    left = gram
    while left:
        if left & 1:
            part = power[done:done + n]
            total = part if total is None else total * np.uint64(base) + part
            done += size
        left >>= 1
        if left:
            power = power[:-size] * np.uint64(base) + power[size:]
            base = base * base & 0xFFFFFFFFFFFFFFFF
            size *= 2
    x = total ^ (total >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x >> np.uint64(PLACE_BITS)


def winnow(codes: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept positions and their hashes, by position.

    A text shorter than a gram is one gram; fewer grams than a window are one window; an empty text
    keeps nothing. Long texts go through in pieces that overlap by a window.
    """
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(codes, min(gram, len(codes)))
    window = min(window, len(hashes))
    starts = len(hashes) - window + 1
    stride = _PLACES - window
    found = []
    for at in range(0, starts, stride):
        part = hashes[at:min(at + stride, starts) + window - 1]
        # a later place gives a smaller value, so the minimum is the rightmost smallest hash
        least = (part << np.uint64(PLACE_BITS)) | (np.uint64(_PLACES) - np.arange(len(part), dtype=np.uint64))
        size = 1
        while size * 2 <= window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < window:
            n = len(part) - window + 1
            least = np.minimum(least[:n], least[window - size:window - size + n])
        change = np.ones(len(least), bool)
        np.not_equal(least[1:], least[:-1], out=change[1:])
        found.append(at + _PLACES - (least[change] & np.uint64(_PLACES)).astype(np.int64))
    places = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
    return places, hashes[places]


def written(places: np.ndarray, hashes: np.ndarray) -> str:
    """``position:hash`` in order of position."""
    return " ".join([f"{p}:{h:x}" for p, h in zip(places.tolist(), hashes.tolist(), strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted sets of hashes; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprints") -> DataFrame:
    """Adds the kept ``(position, hash)`` pairs of each text; null counts as empty. No shuffle."""
    kind = pa.list_(pa.struct([("position", pa.int64()), ("hash", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 1_000):
                part = batch.slice(at, 1_000)
                pairs = (winnow(codes_of(t.as_py() or "")) for t in part.column(text))
                rows = [[{"position": p, "hash": h} for p, h in zip(a.tolist(), b.tolist(), strict=True)] for a, b in pairs]
                yield with_columns(part, {out: pa.array(rows, kind)})

    return docs.mapInArrow(run, schema_with(docs, f"{out} array<struct<position:bigint,hash:bigint>>"))


def next_in_order(docs: DataFrame, doc_id: str, text: str, parts: int | None = None) -> DataFrame:
    """``id, text, ahead`` dealt into ranges of the id and sorted, one range per task.

    The first rows of each range are also sent, marked ``ahead``, to the end of the range before it
    (those of the first range to the last one), so every row finds its successor in its own task
    after one exchange of the texts.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(doc_id), F.lit(LEAST_LONG))
    bounds = range_bounds(docs, key, parts or shuffle_width(spark))
    count = max(1, len(bounds))

    @F.pandas_udf(ArrayType(IntegerType()))
    def places(ids):
        own = np.searchsorted(bounds, ids.to_numpy(), side="right") - 1
        first = np.asarray(bounds)[own] == ids.to_numpy()
        out = [[p, -((p - 1) % count) - 1] if f else [p] for p, f in zip(own.tolist(), first.tolist(), strict=True)]
        return type(ids)(out, dtype=object)

    part, = fresh(docs, "part")
    return (
        docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), key.alias("key"))
        .select("id", "text", "key", F.explode(places("key")).alias(part))
        .select("id", "text", "key", (F.col(part) < 0).alias("ahead"),
                F.when(F.col(part) < 0, -F.col(part) - 1).otherwise(F.col(part)).alias(part))
        .repartitionById(count, F.col(part))
        .sortWithinPartitions("ahead", "key", "text"))


SUCCESSOR_COLUMNS = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                     "near_edited double, near_next double")
_SUCCESSOR_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each text, of its edited text, and how alike they are to each other and to the next text.

    The edited text has its last quarter (rounded down, in code points) replaced by as much of the
    beginning of the next document in order of ``doc_id``; after the last comes the first.

    * A null text is empty; two empty fingerprints are alike (1), an empty and another are not (0).
    * A null ``doc_id`` sorts first; rows of equal ``doc_id`` follow each other in order of their texts.
      A single row is its own successor.
    * Other columns are ignored; an empty table gives an empty table.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            before = None
            for batch in batches:
                for i in range(batch.num_rows):
                    ident, ahead = batch.column(0)[i].as_py(), batch.column(3)[i].as_py()
                    if ahead and before is None:
                        return
                    here = batch.column(1)[i].as_py() or ""
                    codes = codes_of(here)
                    places, hashes = winnow(codes)
                    marks = np.unique(hashes)
                    if before is not None:
                        last, its_text, its_codes, its_places, its_hashes, its_marks = before
                        n = len(its_codes)
                        edited = its_text[:n - n // 4] + here[:n // 4]
                        new_places, new_hashes = winnow(codes_of(edited))
                        yield (last, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(),
                               written(its_places, its_hashes), written(new_places, new_hashes),
                               likeness(its_marks, np.unique(new_hashes)), likeness(its_marks, marks))
                    if ahead:
                        return
                    before = (ident, here, codes, places, hashes, marks)

        yield from batches_of(rows(), _SUCCESSOR_SCHEMA)

    return next_in_order(docs, doc_id, text).mapInArrow(run, SUCCESSOR_COLUMNS)
