"""Neighbours in a globally sorted table, without a window that gathers a whole group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameflow.session import materialize


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pid, last, seen = TaskContext.get().partitionId(), None, False
    names = ["g", "a", "b", "edge", "pid"]

    def row(edge: str, g, v) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([g], pa.string()), pa.array([v], pa.int64()), pa.array([None], pa.int64()), pa.array([edge], pa.string()), pa.array([pid], pa.int32())], names=names
        )

    for b in batches:
        if not b.num_rows:
            continue
        g, v = b.column("g"), b.column("v").to_numpy(zero_copy_only=False)
        code = g.dictionary_encode()
        which = code.indices.to_numpy(zero_copy_only=False)
        if not seen:
            yield row("first", g[0].as_py(), int(v[0]))
            seen = True
        elif last is not None and last[0] == g[0].as_py():
            yield pa.RecordBatch.from_arrays(
                [pa.array([last[0]], pa.string()), pa.array([last[1]]), pa.array([int(v[0])]), pa.array([None], pa.string()), pa.array([pid], pa.int32())], names=names
            )
        i = np.flatnonzero(which[1:] == which[:-1])
        if len(i):
            yield pa.RecordBatch.from_arrays(
                [g.take(pa.array(i)).cast(pa.string()), pa.array(v[i]), pa.array(v[i + 1]), pa.nulls(len(i), pa.string()), pa.array(np.full(len(i), pid, np.int32))], names=names
            )
        last = (g[len(g) - 1].as_py(), int(v[-1]))
    if last is not None:
        yield row("last", *last)


def neighbour_pairs(df: DataFrame, group: str, value: str, partitions: int) -> DataFrame:
    """(g, a, b): the values of each group that are next to each other, a < b; values are distinct within a group.

    The table is range-partitioned by (group, value), so a group of any size is spread; only the first and last row of
    each partition meet again, two per partition.
    """
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(value).cast("long").alias("v")).filter("g is not null and v is not null")
    ranged = rows.repartitionByRange(partitions, "g", "v").sortWithinPartitions("g", "v")
    out = materialize(ranged.mapInArrow(_pairs, "g string, a long, b long, edge string, pid int"), "pairs")
    w = Window.partitionBy(F.lit(0)).orderBy("pid", F.when(F.col("edge") == "first", 0).otherwise(1))
    edges = out.filter("edge is not null").withColumn("before", F.lag(F.struct("g", "a", "edge")).over(w))
    joins = edges.filter((F.col("edge") == "first") & (F.col("before.edge") == "last") & (F.col("before.g") == F.col("g")))
    return out.filter("edge is null").select("g", "a", "b").unionByName(joins.select("g", F.col("before.a").alias("a"), F.col("a").alias("b")))
