"""Deterministic, engine-independent pseudo-random draws.

A draw is the first 15 hex digits of ``md5(k1|k2|...|seed)`` read as an
unsigned 60-bit integer (enough to address any table without a visible
modulo bias).  The same value comes out of Spark, DuckDB or Python
for the same key text, on any partitioning and after any task retry, so
samples are repeatable and checkable (unlike a process-salted ``hash``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 60
DRAW_RANGE = 1 << DRAW_BITS


def _text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def md5_draw(*parts, seed: int | str = 42) -> Column:
    """Uniform integer in ``[0, 2^60)`` from the key parts and the seed."""
    key = F.concat_ws("|", *[_text(p) for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, DRAW_BITS // 4), 16, 10).cast("long")


def randint(lo: int, hi: int, *parts, seed: int | str = 42) -> Column:
    """G5 ``randint(lo, hi)``: integer in ``[lo, hi)`` (upper bound exclusive)."""
    return (F.lit(lo) + F.pmod(md5_draw(*parts, seed=seed), F.lit(hi - lo))).cast("int")
