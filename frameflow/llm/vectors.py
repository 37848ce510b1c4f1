"""Comparable vectors, their lossless packing, and a hash-prefix forest over them.

A row of the packed table is (kind, id, c0 .. c{T-1}, vec): ``kind`` groups vectors that may be compared, ``c_t`` is the
hash string of tree t, BITS long, and ``vec`` the packed values. The hash string starts with the path through
hyperplanes fitted on a bounded sample (they adapt to where the vectors lie) and goes on with signs of random
projections of the vector's offset from its cell's centre; sorting by it makes the sorted array of a tree, in which a
longer common prefix means a closer place.

A sorted array lies in range partitions; ``scan`` visits each partition, and then the rows on either side of every
edge between two partitions, so that an edge separates nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameflow.session import materialize, partitions_for, release

#: Vectors of all kinds on which the top hyperplanes are fitted, at most about this many; every row is indexed.
FIT_ROWS = 16_384
#: Sample vectors that a fitted cell keeps at least.
FIT_LEAF = 48
#: Length of a hash string.
BITS = 62


def descriptor_vectors(descriptors: DataFrame, kinds: DataFrame) -> DataFrame:
    """(field, kind, id, vec) of descriptors.values whose length is that of their feature name."""
    k = kinds.filter(F.col("field") == "values").select(F.col("name").alias("_name"), F.col("vec_len").alias("_len"))
    d = descriptors.select(F.col("feature_name").alias("_n"), F.col("descriptor_id").cast("long").alias("id"), F.col("values").alias("vec"))
    return d.join(k, F.col("_n") == F.col("_name")).filter((F.size("vec") == F.col("_len")) & F.col("id").isNotNull()).select(
        F.lit("values").alias("field"), F.concat(F.lit("values|"), "_n").alias("kind"), "id", "vec"
    )


def dense_vectors(features: DataFrame, kinds: DataFrame) -> DataFrame:
    """(field, kind, id, vec) of features.dense; the dims are part of the kind, and null dims compare with nothing."""
    k = kinds.filter(F.col("field") == "dense").select(F.col("name").alias("_name"), F.col("vec_len").alias("_len"))
    d = features.select(F.col("name").alias("_n"), F.col("feature_id").cast("long").alias("id"), F.col("dense.dims").alias("_dims"), F.col("dense.data").alias("vec"))
    kind = F.concat(F.lit("dense|"), "_n", F.lit("|"), F.array_join(F.col("_dims").cast("array<string>"), "x", "?"))
    return d.join(k, F.col("_n") == F.col("_name")).filter((F.size("vec") == F.col("_len")) & F.col("id").isNotNull() & F.col("_dims").isNotNull()).select(
        F.lit("dense").alias("field"), kind.alias("kind"), "id", "vec"
    )


# ---- values of an Arrow column -----------------------------------------------------------------------------------


def matrix(column: pa.Array, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The listed rows, all of one length, as float32; and which of them are comparable: no null, NaN or infinite
    element and not all zeros."""
    taken = column.take(pa.array(rows))
    flat = taken.flatten()
    m = flat.cast(pa.float32()).to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(rows), length)
    return m, np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one (scaled first, so that tiny or huge values don't vanish)."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return (m / np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64))[:, None]).astype(np.float32)


def pack(m: np.ndarray) -> list[bytes]:
    """Lossless bytes per row: whole multiples of a power of two as int8 or int16, else float32."""
    top = np.abs(m).max(axis=1).astype(np.float64)
    out: list[bytes | None] = [None] * len(m)
    left = np.arange(len(m))
    for tag, kind, limit in ((1, np.int8, 127.0), (2, np.int16, 32767.0)):
        if not len(left):
            break
        e = np.clip(np.floor(np.log2(limit / top[left])), -100, 100)
        q = m[left].astype(np.float64) * np.exp2(e)[:, None]
        whole = (q == np.rint(q)).all(axis=1)
        for i, head, body in zip(left[whole], e[whole].astype(np.int8), q[whole].astype(kind), strict=True):
            out[i] = bytes((tag, int(head) & 255)) + body.tobytes()
        left = left[~whole]
    for i in left:
        out[i] = b"\x00\x00" + m[i].tobytes()
    return out


def unpack(column: pa.Array) -> np.ndarray:
    """The values of packed rows of one length, as float32."""
    n = len(column)
    if not n:
        return np.empty((0, 0), np.float32)
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    tags, size = data[offsets[:-1]], offsets[1:] - offsets[:-1] - 2
    width = np.array([4, 1, 2])[tags]
    d = int((size // width).max())
    out = np.empty((n, d), np.float32)
    for tag, kind in ((0, np.float32), (1, np.int8), (2, np.int16)):
        i = np.flatnonzero(tags == tag)
        if len(i):
            k = d * np.dtype(kind).itemsize
            at = offsets[i][:, None] + 2 + np.arange(k)
            body = np.ascontiguousarray(data[at]).view(kind).astype(np.float32)
            e = data[offsets[i] + 1].view(np.int8).astype(np.float64)
            out[i] = body if tag == 0 else body * np.exp2(-e)[:, None].astype(np.float32)
    return out


# ---- the forest ---------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Hyperplanes of one tree of one kind: node i has the children 2i+1 and 2i+2."""

    depth: int
    normals: np.ndarray
    offsets: np.ndarray
    centres: np.ndarray
    random: np.ndarray

    def codes(self, u: np.ndarray) -> np.ndarray:
        node = np.zeros(len(u), np.int64)
        if self.depth:
            side = u @ self.normals.T > self.offsets
            for _ in range(self.depth):
                node = 2 * node + 1 + side[np.arange(len(u)), node]
        leaf = node - (2**self.depth - 1)
        sign = u @ self.random.T > (self.centres @ self.random.T)[leaf]
        code = leaf
        for b in range(sign.shape[1]):
            code = (code << 1) | sign[:, b]
        return code


@dataclass
class Forest:
    """The trees of each kind. Size: kinds x trees x 2**depth x length floats, with 2**depth <= FIT_ROWS / FIT_LEAF."""

    n_trees: int
    trees: dict[str, list[Tree]] = field(default_factory=dict)

    def codes(self, kind: str, u: np.ndarray) -> list[np.ndarray]:
        if kind not in self.trees:  # a kind without a vector in the sample: its rows lie in the order of random signs
            self.trees[kind] = [grow(np.zeros((1, u.shape[1]), np.float32), np.random.default_rng([t, u.shape[1]])) for t in range(self.n_trees)]
        return [t.codes(u) for t in self.trees[kind]]


def grow(sample: np.ndarray, rng: np.random.Generator) -> Tree:
    """A tree fitted on sample vectors of length one. Each node separates two centres found by a few two-means steps;
    a split that leaves under a sixth on one side is moved to the median."""
    d = sample.shape[1]
    depth = max(0, int(np.log2(max(1, len(sample) / FIT_LEAF))))
    normals, offsets = np.zeros((2**depth - 1, d), np.float32), np.zeros(2**depth - 1, np.float32)
    members = {0: np.arange(len(sample))}
    for node in range(2**depth - 1):
        i = members.pop(node)
        x = sample[i]
        if len(i) < 2:
            normal, cut = rng.standard_normal(d).astype(np.float32), np.float32(0)
            s = x @ normal
        else:
            a, b = x[rng.choice(len(x), 2, replace=False)]
            for _ in range(3):
                near = x @ (a - b) > (a @ a - b @ b) / 2
                if near.all() or not near.any():
                    break
                a, b = x[near].mean(axis=0), x[~near].mean(axis=0)
            normal, cut = a - b, (a @ a - b @ b) / 2
            if not normal.any():
                normal = rng.standard_normal(d).astype(np.float32)
            s = x @ normal
            if not 1 / 6 <= (s > cut).mean() <= 5 / 6:
                cut = np.median(s)
        normals[node], offsets[node] = normal, cut
        right = s > cut
        members[2 * node + 1], members[2 * node + 2] = i[~right], i[right]
    first = 2**depth - 1
    centres = np.array([sample[members[first + k]].mean(axis=0) if len(members.get(first + k, ())) else np.zeros(d) for k in range(2**depth)], np.float32)
    return Tree(depth, normals, offsets, centres, rng.standard_normal((BITS - depth, d)).astype(np.float32))


def fit_forest(vectors: DataFrame, rows: int, trees: int, seed: int = 7) -> Forest:
    """Fit on every row whose hashed id falls into a fraction of about FIT_ROWS of ``rows``; only the fit is sampled."""
    step = max(1, rows // FIT_ROWS)
    sample = vectors.filter(F.pmod(F.xxhash64("kind", "id"), F.lit(step)) == 0).select("kind", "vec")
    table = sample.toArrow()
    kinds = table.column("kind").combine_chunks()
    vec = table.column("vec").combine_chunks()
    forest = Forest(trees)
    of = np.array(kinds.to_pylist(), dtype=object)
    for kind in sorted(set(of)):
        i = np.flatnonzero(of == kind)
        m, ok = matrix(vec, i, len(vec[int(i[0])]))
        if ok.any():
            u = unit(m[ok])
            forest.trees[kind] = [grow(u, np.random.default_rng([seed, t, len(kind)])) for t in range(trees)]
    return forest


def packed(vectors: DataFrame, forest: Forest) -> DataFrame:
    """The packed table of all comparable vectors; vectors of one kind have one length. Extra columns are not kept."""
    names = [f"c{t}" for t in range(forest.n_trees)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.column("kind").dictionary_encode() if not pa.types.is_dictionary(b.column("kind").type) else b.column("kind")
            which = kind.indices.to_numpy(zero_copy_only=False)
            ids = b.column("id").to_numpy(zero_copy_only=False)
            for k, name in enumerate(kind.dictionary.to_pylist()):
                rows = np.flatnonzero(which == k)
                vec = b.column("vec")
                m, ok = matrix(vec, rows, len(vec[int(rows[0])]))
                m, rows = m[ok], rows[ok]
                if len(rows):
                    codes = forest.codes(name, unit(m))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(rows)), pa.array(ids[rows]), *map(pa.array, codes), pa.array(pack(m), pa.binary())], names=["kind", "id", *names, "vec"]
                    )

    return vectors.select("kind", "id", "vec").mapInArrow(run, f"kind string, id long, {', '.join(n + ' long' for n in names)}, vec binary")


# ---- sorted arrays ------------------------------------------------------------------------------------------------


@dataclass
class Rows:
    """Rows of one kind in the order of a sorted array."""

    kind: str
    ids: np.ndarray
    code: np.ndarray
    vec: pa.Array
    more: dict[str, np.ndarray]
    #: None: all rows may meet; else only those before this place with those from it on.
    cut: int | None = None

    def __len__(self) -> int:
        return len(self.ids)

    def units(self) -> np.ndarray:
        return unit(unpack(self.vec))

    def pieces(self, size: int) -> Iterator[tuple[int, int, int, int]]:
        """Rows [a, z) of bounded number, and the rows [lo, hi) that they may meet."""
        n = len(self)
        for a in range(0, n, size):
            z = min(a + size, n)
            if self.cut is None:
                yield a, z, 0, n
            else:
                if a < self.cut:
                    yield a, min(z, self.cut), self.cut, n
                if z > self.cut:
                    yield max(a, self.cut), z, 0, self.cut

    def meets(self, size: int, reach: int) -> Iterator[tuple[int, int, int, int]]:
        """Pairs of pieces, rows [a, z) and later rows [lo, hi) or the same ones, in which any two rows that may meet and
        lie at most ``reach`` apart come together once."""
        n = len(self)
        for a in range(0, n if self.cut is None else self.cut, size):
            z = min(a + size, n if self.cut is None else self.cut)
            if self.cut is None:
                yield a, z, a, z
            for lo in range(z if self.cut is None else self.cut, min(z + reach, n), size):
                yield a, z, lo, min(lo + size, z + reach, n)


Visit = Callable[[Rows], Iterator[pa.RecordBatch]]


def sorted_parts(spark: SparkSession, rows: int, reach: int) -> int:
    """Partitions of a sorted array: enough that one holds a bounded number of rows, but each of several times
    ``reach`` rows, since only that many rows beside an edge see the other side."""
    return max(1, min(partitions_for(spark, rows, 64 * 1024), rows // (4 * reach)))


def _runs_of_kinds(t: pa.Table, more: Sequence[str]) -> list[Rows]:
    if not t.num_rows:
        return []
    t = t.combine_chunks()
    which = t.column("kind").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(which)]
    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        part = t.slice(lo, hi - lo).combine_chunks()
        column = lambda c, part=part: part.column(c).combine_chunks()
        out.append(Rows(column("kind")[0].as_py(), column("id").to_numpy(), column("code").to_numpy(), column("vec"), {c: column(c).to_numpy() for c in more}))
    return out


def scan(table: DataFrame, trees: Sequence[int], visit: Visit, schema: str, reach: int, parts: int, more: Sequence[str] = ()) -> DataFrame:
    """What ``visit`` gives for the sorted arrays of the trees, as a table of ``schema``, written unless reach is 0.

    visit gets the rows of one kind in one partition, and then, with ``cut``, the ``reach`` rows (none if 0) on either
    side of each edge. ``more``: further numeric columns of the table that the rows carry.
    """
    keys = ["kind", "code", "id"]
    columns = [*keys, "vec", *more]
    names = [x.strip().split()[0] for x in schema.split(",")]
    types = [ARROW[x.strip().split()[1]] for x in schema.split(",")]
    edge_names = ["tree", "pid", "side", *[f"e_{c}" for c in columns]]

    def runner(tree: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            t = pa.Table.from_batches(held)
            runs = _runs_of_kinds(t, more)
            for rows in runs:
                for b in visit(rows):
                    none = [pa.nulls(b.num_rows, pa.int32())] * 3 + [pa.nulls(b.num_rows, t.schema.field(c).type) for c in columns]
                    yield pa.RecordBatch.from_arrays([*b.columns, *none], names=[*names, *edge_names])
            if not reach:
                return
            pid = TaskContext.get().partitionId()
            last = min(reach, len(runs[-1]))
            for side, e in ((0, t.slice(0, min(reach, len(runs[0])))), (1, t.slice(t.num_rows - last, last))):
                for b in e.combine_chunks().to_batches():
                    marks = [pa.array(np.full(b.num_rows, x, np.int32)) for x in (tree, pid, side)]
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(b.num_rows, x) for x in types], *marks, *b.columns], names=[*names, *edge_names])

        return run

    found = None
    for tree in trees:
        sorted_ = table.select("kind", F.col(f"c{tree}").alias("code"), "id", "vec", *more).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        fields = sorted_.schema.fields
        edge_schema = ", ".join([schema, "tree int, pid int, side int", *[f"e_{f.name} {f.dataType.simpleString()}" for f in fields]])
        one = sorted_.mapInArrow(runner(tree), edge_schema)
        found = one if found is None else found.unionByName(one)
    if not reach:
        return found.select(*names)
    found = materialize(found, "arrays")
    inner = found.filter("side is null").select(*names)
    inner._frameflow_steps = [found]
    if parts == 1:
        return inner
    edges = found.filter("side is not null").select("tree", "pid", "side", *[F.col(f"e_{c}").alias(c) for c in columns])
    pids = edges.select("tree", "pid").distinct()  # one row per partition that isn't empty
    before = pids.select("tree", "pid", F.lag("pid").over(Window.partitionBy("tree").orderBy("pid")).alias("before"))
    first = edges.filter("side = 0").join(F.broadcast(before), ["tree", "pid"]).filter("before is not null").withColumn("edge", F.col("before")).drop("before")
    edges = first.unionByName(edges.filter("side = 1").withColumn("edge", F.col("pid")))

    def beside(group: pa.Table) -> pa.Table:
        order = [("side", "descending"), ("code", "ascending"), ("id", "ascending")]  # the last rows of one partition, then the first of the next
        runs = _runs_of_kinds(group.sort_by(order), (*more, "side"))
        out = []
        if len(runs) == 1:
            rows = runs[0]
            rows.cut = int((rows.more["side"] == 1).sum())
            if 0 < rows.cut < len(rows):
                out = list(visit(rows))
        kinds = pa.schema(list(zip(names, types, strict=True)))
        return pa.Table.from_batches(out).cast(kinds) if out else kinds.empty_table()

    crossed = materialize(edges.select("tree", "edge", "side", *columns).groupBy("tree", "edge").applyInArrow(beside, schema), "edges")
    out = inner.unionByName(crossed)
    out._frameflow_steps = [found, crossed]
    return out


def scans(table: DataFrame, trees: int, visit: Visit, schema: str, reach: int, parts: int, more: Sequence[str] = (), together: int = 4) -> DataFrame:
    """``scan`` of all trees, ``together`` at a time, between which their shuffle files are dropped."""
    out, steps = None, []
    for t in range(0, trees, together):
        one = scan(table, range(t, min(trees, t + together)), visit, schema, reach, parts, more)
        steps.append(one)
        out = one if out is None else out.unionByName(one)
        if reach:
            release(table.sparkSession)
    out._frameflow_steps = steps if len(steps) > 1 else getattr(out, "_frameflow_steps", [])
    return out


ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
