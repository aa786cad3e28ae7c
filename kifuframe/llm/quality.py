"""Quality rules: zstandard compression bands over whole documents and fixed chunks.

Repetitive text compresses far below, random text far above what prose of the same length does.
The limits depend on the length, because a short text carries no history to refer to. Texts of other
scripts than the Latin one are recoded to one byte per letter first, so that the limits hold for them too.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kifuframe.llm.common import BLANKS, schema_with, with_columns

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEVEL = 3
CHUNK_BYTES = 4_096
#: Up to so many bytes: lowest and highest ratio of compressed to raw size that prose of that length has.
BANDS = (
    (64, 0.0, 9.0),
    (128, 0.45, 1.10),
    (200, 0.55, 1.00),
    (400, 0.52, 0.92),
    (800, 0.50, 0.80),
    (1_600, 0.465, 0.70),
    (3_200, 0.45, 0.62),
    (6_400, 0.425, 0.57),
    (12_800, 0.41, 0.54),
    (25_600, 0.38, 0.52),
    (51_200, 0.36, 0.52),
    (102_400, 0.345, 0.52),
    (204_800, 0.335, 0.52),
    (409_600, 0.325, 0.52),
    (819_200, 0.315, 0.52),
    (1 << 62, 0.30, 0.52),
)
#: The same for full chunks of CHUNK_BYTES, and the share of them that may lie outside.
CHUNK_BAND = (0.425, 0.58)
CHUNKS_OUTSIDE = 0.25
#: Up to so many bytes a character a text is Latin script and measured as it is.
LATIN_BYTES = 1.2
#: Letters beyond ASCII that get a byte of their own; the byte 255 marks all others.
OWN_BYTES = 127
#: A text with more others than this share is ideographic: it is measured in UTF-8, against wider limits.
MOST_OTHERS = 0.05
WIDE_BANDS = (
    (64, 0.0, 9.0),
    (128, 0.45, 1.15),
    (200, 0.55, 1.08),
    (400, 0.52, 1.00),
    (800, 0.50, 0.88),
    (1_600, 0.465, 0.78),
    (3_200, 0.45, 0.71),
    (6_400, 0.425, 0.66),
    (12_800, 0.41, 0.64),
    *((most, low, 0.62) for most, low, _ in BANDS[9:]),
)
WIDE_CHUNK_BAND = (0.40, 0.68)
HANGUL = re.compile("[\uac00-\ud7a3]")

ADDED = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
         "base_failed boolean, kept boolean, ratio double, n_chunks bigint, n_chunks_outside bigint")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of eight words that occur twice or more in the text.

    Windows get exact numbers by doubling: a run of 2m words is the pair of the
    numbers of its halves, so nothing depends on a hash.
    """
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    number = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    step = 1
    while step < window:
        pairs = number[:-step] * (int(number.max()) + 1) + number[step:]
        _, number = np.unique(pairs, return_inverse=True)
        step *= 2
    again = np.flatnonzero(np.bincount(number)[number] > 1)
    if not len(again):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:n]) > 0))


def coded(text: str, raw: bytes) -> tuple[bytes, bool]:
    """The bytes to measure and whether they are ideographic.

    Outside Latin script the most frequent letters beyond ASCII get one byte each, by rank; Hangul syllables are
    taken apart into their letters first.
    """
    if len(raw) <= LATIN_BYTES * len(text):
        return raw, False
    if HANGUL.search(text):
        text = unicodedata.normalize("NFD", text)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    far = np.flatnonzero(points > 127)
    kinds, where, times = np.unique(points[far], return_inverse=True, return_counts=True)
    rank = np.empty(len(kinds), np.int64)
    rank[np.argsort(-times, kind="stable")] = np.arange(len(kinds))
    rank = rank[where]
    others = rank >= OWN_BYTES
    if np.count_nonzero(others) > MOST_OTHERS * len(points):
        return raw, True
    one = points.astype(np.uint8)
    one[far] = np.where(others, 255, 128 + np.minimum(rank, OWN_BYTES - 1))
    return one.tobytes(), False


def compression(raw: bytes, squeeze: zstandard.ZstdCompressor, wide: bool = False) -> tuple[bool, float, int, int]:
    """Verdict of the bands, ratio of the whole, number of full chunks, and of those outside their band."""
    if not raw:
        return False, 0.0, 0, 0
    ratio = len(squeeze.compress(raw)) / len(raw)
    low, high = next((lo, hi) for most, lo, hi in (WIDE_BANDS if wide else BANDS) if len(raw) <= most)
    least, most = WIDE_CHUNK_BAND if wide else CHUNK_BAND
    chunks = len(raw) // CHUNK_BYTES
    outside = 0
    for i in range(chunks):
        part = len(squeeze.compress(raw[i * CHUNK_BYTES:(i + 1) * CHUNK_BYTES])) / CHUNK_BYTES
        outside += not least <= part <= most
    return low <= ratio <= high and outside <= CHUNKS_OUTSIDE * chunks, ratio, chunks, outside


def measure(text: str | None, squeeze: zstandard.ZstdCompressor) -> tuple:
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    blanks = len(raw) - len(raw.translate(None, BLANKS.encode()))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    again = repeated_words(words)
    failed = n < 20 or 100 * again > 30 * n
    body, wide = coded(text or "", raw)
    good, ratio, chunks, outside = compression(body, squeeze, wide)
    return (n, len(text or "") - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            again, failed, good and not failed, ratio, chunks, outside)


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts, ``base_failed``, ``kept`` and what the bands measured to each row.

    * A null text is empty: all counts are 0, it fails the base rule and is not kept.
    * Words are runs of anything but ASCII blanks; lines are cut at ``\\n`` only.
    * ``ratio`` and chunks are of the bytes that are measured: UTF-8 in Latin and ideographic script, else one byte per letter.
    * Rows are judged alone, so repeated rows get equal verdicts and an empty table stays empty.
    * Input columns with the names of the added ones are replaced.

    No shuffle. Texts pass through in Arrow batches, which Spark bounds by bytes.
    """
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64(), pa.int64()]
    names = [part.split()[0] for part in ADDED.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows = [measure(t.as_py(), squeeze) for t in batch.column(text)]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield with_columns(batch, {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return docs.mapInArrow(run, schema_with(docs, ADDED))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that the rules keep, with the columns of ``docs``."""
    names = docs.columns
    fixed = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    kept = judge(fixed, f"c{names.index(text)}").where("kept")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
