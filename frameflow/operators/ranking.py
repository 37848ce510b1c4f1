"""Row numbers and runs within streams of any size.

A window over a whole stream sorts it in one task. Here a stream is cut into buckets of its sequence numbers; rows are
numbered within their bucket, and a second, small step over one row per bucket adds what lies before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameflow.session import materialize

BUCKET = 4096


def ranked(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = (), name: str = "rn", bucket: int = BUCKET) -> DataFrame:
    """Adds the row's number from 0 in its group, by the 64-bit column ``order`` and then ``ties``.

    Null keys form a group; rows with a null order come last. bucket is the width of a bucket in units of order.
    """
    b, n, before = "_bucket", "_n", "_before"
    rows = df.withColumn(b, F.coalesce(F.floor(F.col(order) / bucket), F.lit(2**62)))
    inner = Window.partitionBy(*keys, b)
    rows = rows.withColumn(name, F.row_number().over(inner.orderBy(F.col(order).asc_nulls_last(), *ties)) - 1)
    sizes = df.groupBy(*keys, F.coalesce(F.floor(F.col(order) / bucket), F.lit(2**62)).alias(b)).agg(F.count(F.lit(1)).alias(n))
    outer = Window.partitionBy(*keys).orderBy(b) if keys else Window.partitionBy(F.lit(0)).orderBy(b)
    sizes = sizes.withColumn(before, F.sum(n).over(outer) - F.col(n)).drop(n)
    right = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(b).alias("_b2"), before)
    on = rows[b] == right["_b2"]
    for i, k in enumerate(keys):
        on = on & rows[k].eqNullSafe(right[f"_k{i}"])
    return rows.join(right, on).select(*df.columns, (F.col(name) + F.col(before)).cast("long").alias(name))


def numbered(df: DataFrame, order: Sequence[str], partitions: int = 16, name: str = "rn") -> DataFrame:
    """Adds the row's number from 0 in the whole table, by any columns: a range sort and one count per partition."""
    sorted_ = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    sorted_ = materialize(sorted_, "numbered")
    part = F.shiftrightunsigned("_id", 33)
    sizes = sorted_.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    sizes = sizes.select("_p", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("_n")).alias("_before"))
    joined = sorted_.withColumn("_q", part).join(F.broadcast(sizes), F.col("_q") == F.col("_p"))
    return joined.select(*df.columns, (F.col("_id").bitwiseAND(F.lit(2**33 - 1)) + F.col("_before")).alias(name))


def positions(df: DataFrame, keys: Sequence[str], seq: str, step: int, bucket: int = BUCKET) -> DataFrame:
    """(keys, seq, pos): the place from 0 of each number in its run; a run goes on while the next number is exactly
    ``step`` more than the one before. Numbers that are null are left out, repeated ones count once."""
    rows = df.select(*keys, F.col(seq).cast("long").alias("seq")).filter("seq is not null").distinct()
    rows = rows.withColumn("_b", F.floor(F.col("seq") / bucket))
    w = Window.partitionBy(*keys, "_b").orderBy("seq")
    breaks = F.coalesce(F.col("seq") - F.lag("seq").over(w) != step, F.lit(False))
    rows = rows.withColumns({"_break": breaks, "_rn": F.row_number().over(w) - 1})
    start = F.coalesce(F.max(F.when(F.col("_break"), F.col("_rn"))).over(w), F.lit(0))  # one sort serves all
    rows = rows.withColumns({"_run": start, "_at": F.col("_rn") - start}).drop("_break", "_rn")
    tail = rows.groupBy(*keys, "_b").agg(F.min("seq").alias("_first"), F.max(F.struct("seq", "_run", "_at")).alias("_last"))
    outer = Window.partitionBy(*keys).orderBy("_b") if keys else Window.partitionBy(F.lit(0)).orderBy("_b")
    before = F.lag("_last").over(outer)
    tail = tail.withColumn("_joined", F.coalesce(F.col("_first") - before["seq"] == step, F.lit(False)))
    tail = tail.withColumn("_base", F.when(F.col("_joined"), before["_at"] + 1).otherwise(0))
    tail = tail.withColumn("_reset", F.when(~F.col("_joined") | (before["_run"] > 0), 1).otherwise(0))
    tail = tail.withColumn("_segment", F.sum("_reset").over(outer))
    carry = F.sum("_base").over(Window.partitionBy(*keys, "_segment").orderBy("_b"))
    right = tail.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_b2"), carry.alias("_carry"))
    on = rows["_b"] == right["_b2"]
    for i, k in enumerate(keys):
        on = on & rows[k].eqNullSafe(right[f"_k{i}"])
    pos = F.col("_at") + F.when(F.col("_run") == 0, F.col("_carry")).otherwise(0)
    return rows.join(right, on).select(*keys, "seq", pos.cast("long").alias("pos"))
