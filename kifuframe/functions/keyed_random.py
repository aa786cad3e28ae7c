"""Repeatable pseudo-random numbers.

``rand()`` depends on the partition a row lands in, so a retried task would draw
again. These draws depend on the row's own key only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_u32(seed: int | Column, *ids: Column) -> Column:
    """First eight hex digits of ``md5(id:...:seed)`` as a bigint below 2**32."""
    parts = [c.cast("string") for c in ids]
    parts.append(F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string"))
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")


def keyed_uniform(seed: int | Column, *ids: Column) -> Column:
    """Uniform double in [0, 1)."""
    return keyed_u32(seed, *ids) / F.lit(4294967296.0)
