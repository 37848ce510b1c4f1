"""Most similar vectors for every vector, by a hash-prefix forest.

Each tree is one sorted array of long hash strings, range-partitioned over the tasks, so that neither a dense region
nor many equal vectors end in one task. A vector descends to its own place in every array. Around it lie the rows that
share the longest prefixes of its hash string, and the number of rows that share a prefix of each length is its profile
in that tree. All trees ascend together, from the longest prefix to shorter ones, until the rows that share the
prefixes of one length number ``candidates`` over all trees. These rows are the vector's candidates: in each array one
range of variable length, of which the nearest ``reach`` on either side count, on both sides of partition edges.
Vectors that lie side by side are compared with the ranges of all of them by one matrix product, and the best ``k`` of
all trees are kept.

Equal vectors are one entry of the arrays: their group comes in through its smallest ids, so that a group of any size
costs as much as one vector.

Accuracy. Only rows that no tree places near each other are missed; README.md gives the recall measured against brute
force. Defined results: rows that are not comparable (null, NaN, infinite, all zeros, other length, null id) have no
neighbours and are nobody's; ties in the cosine go to the smaller id; equal vectors are neighbours with cosine 1; an
empty table gives no rows; other columns of the tables are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameflow.llm.vectors import BITS, Rows, fit_forest, packed, scans, sorted_parts
from frameflow.operators.skew import lookup
from frameflow.session import discard, materialize, release

NEAR = "kind string, id long, other long, cosine double"
STEPS = "kind string, id long, steps array<int>"
#: Rows that share one product.
PIECE = 512


def best_of_rows(s: np.ndarray, row: np.ndarray, col: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the listed cells, the k largest of each row (ties: the smaller id)."""
    v = s[row, col]
    o = np.lexsort((ids[col], -v, row))
    row, col, v = row[o], col[o], v[o]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, int)
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
    keep = rank < k
    return row[keep], col[keep], v[keep]


def profile(code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """How many other rows share a prefix with each row, as the lengths at which their number grows, the longest first.

    Gives offsets and steps; a step is length << 24 | growth. Numbers above ``most`` count as ``most``.
    """
    n = len(code)
    x = (code[1:] ^ code[:-1]).astype(np.uint64)
    same = np.full(max(n - 1, 0), BITS)  # length of the prefix that a row shares with the next one
    some = x > 0
    high = np.zeros(len(x), np.int64)
    for shift in (32, 16, 8, 4, 2, 1):
        big = x >> np.uint64(shift) > 0
        high += big * shift
        x = np.where(big, x >> np.uint64(shift), x)
    same[some] = BITS - 1 - high[some]
    before = np.zeros(n, np.int64)
    at, steps = [], []
    for length in range(BITS, -1, -1):
        start = np.flatnonzero(np.r_[True, same < length])
        size = np.diff(np.r_[start, n])
        now = np.repeat(np.minimum(size - 1, most), size)
        grown = np.flatnonzero(now > before)
        at.append(grown)
        steps.append((length << 24) | (now - before)[grown])
        before = now
        if before.min(initial=most) >= most:
            break
    at, steps = np.concatenate(at), np.concatenate(steps)
    o = np.argsort(at, kind="stable")
    return np.r_[0, np.cumsum(np.bincount(at, minlength=n))], steps[o]


def ascend(offsets: np.ndarray, steps: np.ndarray, candidates: int) -> np.ndarray:
    """The longest prefix length at which all trees together have ``candidates`` rows, or 0; steps of one row in any order."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    length, grown = steps >> 24, steps & 0xFFFFFF
    o = np.lexsort((-length, row))
    row, length = row[o], length[o]
    total = np.cumsum(grown[o])
    base = np.r_[0, total][offsets[:-1]]
    enough = np.flatnonzero(total - base[row] >= candidates)
    out = np.zeros(n, np.int32)
    first = np.unique(row[enough], return_index=True)
    out[first[0]] = length[enough[first[1]]]
    return out


def _profiles(most: int):
    def visit(rows: Rows) -> Iterator[pa.RecordBatch]:
        if rows.cut is not None:
            return
        offsets, steps = profile(rows.code, most)
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(steps.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array([rows.kind] * len(rows)), pa.array(rows.ids), lists], names=["kind", "id", "steps"])

    return visit


def _lengths(candidates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps = b.column("steps")
            first = steps.offsets.to_numpy()
            length = ascend(first - first[0], steps.flatten().to_numpy(zero_copy_only=False).astype(np.int64), candidates)
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("id"), pa.array(length)], names=["kind", "id", "length"])

    return run


def ranges(code: np.ndarray, length: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """[lo, hi) of the rows that share each row's prefix of the given length, at most ``reach`` on either side."""
    shift = BITS - length.astype(np.int64)
    low = (code >> shift) << shift
    i = np.arange(len(code))
    lo = np.maximum(np.searchsorted(code, low, "left"), i - reach)
    hi = np.minimum(np.searchsorted(code, low + (np.int64(1) << shift), "left"), i + reach + 1)
    return lo, hi


def _search(k: int, floor: float, reach: int, step: int):
    def cells(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the products that may count: all from the floor on, or each row's k largest."""
        if floor > -1:
            return np.divmod(np.flatnonzero(s.ravel() >= floor - 1e-5), s.shape[1])
        m = min(k, s.shape[1])
        col = np.argpartition(s, s.shape[1] - m, axis=1)[:, -m:] if m < s.shape[1] else np.tile(np.arange(m), (len(s), 1))
        row = np.repeat(np.arange(len(s)), col.shape[1])
        col = col.ravel()
        real = s[row, col] > -2
        return row[real], col[real]

    def visit(rows: Rows) -> Iterator[pa.RecordBatch]:
        u, ids = rows.units(), rows.ids
        lo, hi = ranges(rows.code, rows.more["length"], reach)
        asks = (ids % step == 0) | (rows.more["many"] > 0) if step > 1 else np.ones(len(ids), bool)
        for a, z, first, end in rows.pieces(PIECE):
            q = a + np.flatnonzero(asks[a:z] & (hi[a:z] > first) & (lo[a:z] < end))
            if not len(q):
                continue
            left, right = max(first, int(lo[q].min())), min(end, int(hi[q].max()))
            s = u[q] @ u[left:right].T
            own = (q >= left) & (q < right)
            s[np.flatnonzero(own), q[own] - left] = -2
            row, col, _ = best_of_rows(s, *cells(s), ids[left:right], k)
            if len(row):
                exact = np.einsum("ij,ij->i", u[q[row]].astype(np.float64), u[left + col].astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array([rows.kind] * len(row)), pa.array(ids[q[row]]), pa.array(ids[left + col]), pa.array(exact)], names=["kind", "id", "other", "cosine"])

    return visit


def similar(
    vectors: DataFrame, k: int = 5, trees: int = 8, candidates: int = 800, min_cosine: float = -1.0, query_step: int = 1, rows: int | None = None
) -> DataFrame:
    """(kind, id, other, cosine, rank): the k most similar others of each vector, of those with at least min_cosine.

    vectors: (kind, id, vec), ids unique in a kind. candidates: rows with which a vector is compared at least, over all
    trees. query_step n takes as queries the rows whose id is divisible by n; the index always holds all rows. rows:
    the table's size, if known, for the sample's fraction.
    """
    spark = vectors.sparkSession
    n = rows if rows is not None else vectors.count()
    reach = max(32, 2 * candidates // trees)
    table = materialize(packed(vectors, fit_forest(vectors, n, trees)), "vectors")
    codes = [f"c{t}" for t in range(trees)]
    # Of equal vectors the k + 1 smallest ids; the smallest stands in the arrays for all.
    order = Window.partitionBy("kind", "vec").orderBy("id")
    firsts = materialize(table.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1), "firsts")
    groups = materialize(firsts.groupBy("kind", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter("size(ids) > 1"), "groups")
    heads = groups.select("kind", F.get("ids", F.lit(0)).alias("id"), F.lit(1).alias("many"))
    entries = firsts.filter("r = 1").select("kind", "id", *codes, "vec").join(heads, ["kind", "id"], "left").withColumn("many", F.coalesce("many", F.lit(0)))
    parts = sorted_parts(spark, n, reach)
    release(spark)

    steps = scans(firsts.filter("r = 1").withColumn("vec", F.lit(b"")), trees, _profiles(candidates), STEPS, 0, parts, together=trees)
    per = steps.groupBy("kind", "id").agg(F.flatten(F.collect_list("steps")).alias("steps"))  # one list per tree
    length = per.mapInArrow(_lengths(candidates), "kind string, id long, length int")
    arrays = materialize(entries.join(length, ["kind", "id"]), "entries")
    discard(steps, firsts)
    release(spark)

    found = scans(arrays, trees, _search(k, min_cosine, reach, query_step), NEAR, reach, parts, ("length", "many"), together=2)
    top = Window.partitionBy("kind", "id").orderBy(F.desc("cosine"), "other")  # at most trees x 3k rows each
    best = found.groupBy("kind", "id", "other").agg(F.max("cosine").alias("cosine")).filter(F.col("cosine") >= min_cosine)
    best = best.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
    best = materialize(best, "neighbours")
    if not groups.isEmpty():
        best = _of_groups(table, groups, best, k, n, min_cosine)
    if query_step > 1:
        best = best.filter(F.col("id") % query_step == 0)
    discard(found, arrays)
    return best


def _of_groups(table: DataFrame, groups: DataFrame, best: DataFrame, k: int, rows: int, min_cosine: float) -> DataFrame:
    """Neighbours of all vectors from those of the entries: every entry stands for its group of equal vectors."""
    one = groups.select("kind", F.get("ids", F.lit(0)).alias("head"), "ids")
    spread = lookup(best, one.select("kind", F.col("head").alias("other"), F.col("ids").alias("others")), ["kind", "other"], rows, "left")
    spread = spread.select("kind", "id", F.explode(F.coalesce("others", F.array("other"))).alias("other"), "cosine")
    own = one.select("kind", F.col("head").alias("id"), F.explode("ids").alias("other"), F.lit(1.0).alias("cosine")).filter(F.lit(min_cosine <= 1))
    top = Window.partitionBy("kind", "id").orderBy(F.desc("cosine"), "other")  # at most k groups of k + 1 ids
    listed = spread.unionByName(own).withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k + 1).drop("rank")
    listed = materialize(listed, "listed")
    alone = listed.join(one.select("kind", F.col("head").alias("id")), ["kind", "id"], "left_anti")
    lists = listed.groupBy("kind", "id").agg(F.collect_list(F.struct("cosine", "other")).alias("near"))
    lists = groups.select("kind", "vec", F.get("ids", F.lit(0)).alias("id")).join(lists, ["kind", "id"]).drop("id")
    members = lookup(table.select("kind", "vec", "id"), lists, ["kind", "vec"], rows).select("kind", "id", F.inline("near")).filter("id <> other")
    out = alone.unionByName(members.select("kind", "id", "other", "cosine"))
    return materialize(out.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k), "expanded")


def close_pairs(neighbours: DataFrame) -> DataFrame:
    """(kind, id_a, id_b, cosine) of neighbours in either direction, the smaller id first, no pair twice."""
    return neighbours.groupBy("kind", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).agg(F.max("cosine").alias("cosine"))
