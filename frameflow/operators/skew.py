"""A join on keys of which a few may hold a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.session import materialize

#: A key is hot if it holds more than one in SHARE of the rows, so there are fewer than SHARE hot keys.
SHARE = 10_000
#: Keys with fewer rows than this are never hot.
LEAST = 100_000


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], rows: int, how: str = "inner", share: int = SHARE, least: int = LEAST) -> DataFrame:
    """``left`` with the columns of ``right``, which has at most one row per key; ``how`` is inner or left.

    Rows of hot keys meet their rows of ``right`` where they lie (fewer than ``share`` of them are broadcast, whatever
    the size of the tables), all others by an exchange in which no key holds more than max(least, rows / share) rows.
    left is read twice and should be a written table; rows is its size. Null keys match nothing.
    """
    on = list(on)
    if rows <= least:
        return left.join(right, on, how)
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max(least, rows // share))
    hot = materialize(counts.select(*on), "hot")
    if hot.isEmpty():
        return left.join(right, on, how)
    small = F.broadcast(right.join(F.broadcast(hot), on, "left_semi"))
    cold = left.join(F.broadcast(hot), on, "left_anti").join(right, on, how)
    return cold.unionByName(left.join(F.broadcast(hot), on, "left_semi").join(small, on, how))


__all__ = ["lookup"]
