"""Clusters of mutually similar vectors by density peaks, each with its size and most typical members.

A cluster holds the vectors of one kind whose cosine to the mean of the cluster's unit vectors is at least
``min_cosine``; clusters do not overlap, and those below ``min_size`` are none: their vectors stand apart.

Method. The vectors lie in the sorted arrays of a hash-prefix forest. In blocked neighbour joins over all arrays each
vector gets its density, the summed cosine of the neighbours from ``link`` on, and then, with the densities of all
arrays summed, its nearest denser neighbour and the cosine to it. A vector whose nearest denser neighbour is farther
than ``follow`` is a peak; all others are labelled by following the pointers to their peak, in joins that double the
pointers. The sets of the peaks, as weighted records at their means, pass through the same step again, level by level,
until no pointer is left: a set split over several peaks comes together. At last the sets are fitted to their means:
members that lie too far from the mean leave, and vectors outside join the nearest mean that takes them, pass by pass,
until no set changes (or the sets come back to those of an earlier pass). From the second pass on only what changed is
compared: members with the mean of a set that got or lost vectors, vectors outside with such means, and vectors that left
their set with all means; sums of sets get what joined and lose what left.

A vector outside is compared with the means that lie next to it in the arrays of all means, at least ``means`` on either
side in every tree (with fewer means: with all), in groups of bounded size, so that the work grows with the number of
vectors alone. Large sets and small ones have arrays of their own. Which vectors meet in an array is a matter of the
trees, so the result is not exact; README.md compares it with brute force.

Defined results: vectors that are not comparable belong to no cluster and don't stand apart either (they are left
out); equal vectors share a cluster; ties in density go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameflow.llm.vectors import Forest, Rows, fit_forest, pack, packed, scans, sorted_parts, unit, unpack
from frameflow.operators.skew import lookup
from frameflow.session import discard, materialize, release

DENSE = "kind string, id long, density double"
POINTER = "kind string, id long, parent long, cosine double"
SUMS = "kind string, label long, n double, total binary, mark long"
HIT = "kind string, id long, label long, cosine double, vec binary"
#: Rows that share one product, and vectors outside that meet a block of means in one task.
PIECE, OUTSIDE = 512, 32_768


# ---- density and pointers ------------------------------------------------------------------------------------------


def density(u: np.ndarray, v: np.ndarray, weight: np.ndarray, link: float) -> np.ndarray:
    """Of each row of u the summed cosine, times weight, of the rows of v from ``link`` on."""
    return (_linked(u @ v.T, link) @ weight.astype(np.float32)).astype(np.float64)


def _linked(s: np.ndarray, link: float) -> np.ndarray:
    return np.multiply(s, s >= np.float32(link), out=s)


def nearest_denser(u: np.ndarray, v: np.ndarray, rank_u: np.ndarray, rank_v: np.ndarray, follow: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of u the nearest row of v with a smaller rank (the denser come first) and the cosine to it, or -1."""
    near, cosine = _largest(u @ v.T, rank_v[None, :] < rank_u[:, None])
    return np.where((cosine >= follow) & (cosine > 0), near, -1), cosine.astype(np.float64)


def _largest(s: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and value of the largest positive allowed entry of each row; a row without one has a value of 0."""
    s = np.multiply(s, allowed)
    near = s.argmax(axis=1)
    return near, s[np.arange(len(s)), near]


def _densities(link: float, reach: int):
    def visit(rows: Rows) -> Iterator[pa.RecordBatch]:
        u, w = rows.units(), rows.more["weight"]
        w32 = w.astype(np.float32)
        out = np.zeros(len(rows))
        for a, z, lo, hi in rows.meets(PIECE, reach):  # each product serves both sides
            s = u[a:z] @ u[lo:hi].T
            if s.max() < link:
                continue
            s = _linked(s, link)
            out[a:z] += s @ w32[lo:hi]
            if lo != a:
                out[lo:hi] += w32[a:z] @ s
        if rows.cut is None:
            out -= w  # a row is no neighbour of its own
        some = np.flatnonzero(out > 1e-3)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array([rows.kind] * len(some)), pa.array(rows.ids[some]), pa.array(out[some])], names=["kind", "id", "density"])

    return visit


def _pointers(follow: float, reach: int):
    def visit(rows: Rows) -> Iterator[pa.RecordBatch]:
        u, ids = rows.units(), rows.ids
        rank = np.empty(len(rows), np.int32)
        rank[np.lexsort((ids, -rows.more["density"]))] = np.arange(len(rows), dtype=np.int32)
        cosine, parent = np.zeros(len(rows), np.float32), np.full(len(rows), -1)

        def better(a: int, z: int, lo: int, hi: int, s: np.ndarray) -> None:
            near, value = _largest(s, rank[None, lo:hi] < rank[a:z, None])
            new = a + np.flatnonzero(value > cosine[a:z])
            cosine[new], parent[new] = value[new - a], lo + near[new - a]

        for a, z, lo, hi in rows.meets(PIECE, reach):
            s = u[a:z] @ u[lo:hi].T
            if s.max() < follow:
                continue
            better(a, z, lo, hi, s)
            if lo != a:
                better(lo, hi, a, z, np.ascontiguousarray(s.T))
        some = np.flatnonzero((cosine >= follow) & (parent >= 0))
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows.kind] * len(some)), pa.array(ids[some]), pa.array(ids[parent[some]]), pa.array(cosine[some].astype(np.float64))], names=["kind", "id", "parent", "cosine"]
            )

    return visit


def peaks(records: DataFrame, trees: int, n: int, link: float, follow: float, reach: int) -> DataFrame:
    """(kind, id, root): each record with the peak that its pointers lead to. records: kind, id, c0 .., vec, weight."""
    led = led_to_peaks(records, trees, n, link, follow, reach)
    alone = records.select("kind", "id").join(led.select("kind", "id"), ["kind", "id"], "left_anti")
    return led.unionByName(alone.withColumn("root", F.col("id")))


def led_to_peaks(records: DataFrame, trees: int, n: int, link: float, follow: float, reach: int) -> DataFrame:
    """The rows of ``peaks`` that are no peaks themselves."""
    spark = records.sparkSession
    parts = sorted_parts(spark, n, reach)
    dense = scans(records, trees, _densities(link, reach), DENSE, reach, parts, ("weight",))
    per = dense.groupBy("kind", "id").agg(F.round(F.sum("density"), 3).alias("density")).filter("density > 0")
    # A record without neighbours from ``link`` on has none from ``follow`` on either: it points nowhere.
    ranked = materialize(records.join(per, ["kind", "id"]).withColumn("density", F.col("density") + F.col("weight")), "dense")
    discard(dense)
    pointer = scans(ranked, trees, _pointers(follow, reach), POINTER, reach, parts, ("density",))
    nearest = pointer.groupBy("kind", "id").agg(F.max(F.struct("cosine", (-F.col("parent")).alias("parent"))).alias("p"))
    roots = materialize(nearest.select("kind", "id", (-F.col("p.parent")).alias("root")), "pointers")
    discard(pointer, ranked)
    # Follow the pointers: those of a round lead twice as far as those of the round before.
    while True:
        above = roots.select("kind", F.col("id").alias("root"), F.col("root").alias("up"))
        step = lookup(roots, above, ["kind", "root"], n, "left")
        old, roots = roots, materialize(step.select("kind", "id", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        done = roots.filter("moved").isEmpty()
        roots = _plain(roots, ["kind", "id", "root"])
        discard(old)
        if done:
            return roots


def _plain(df: DataFrame, columns: list[str]) -> DataFrame:
    out = df.select(*columns)
    out._frameflow_steps = [df]
    return out


# ---- sets and their means ------------------------------------------------------------------------------------------


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Scattered ids; their sum, which wraps around, tells sets apart and doesn't depend on the order."""
    x = ids.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _summed(kind: str, labels: np.ndarray, n: np.ndarray, total: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
    """One row per label."""
    o = np.argsort(labels, kind="stable")
    of, start = np.unique(labels[o], return_index=True)
    sums = np.add.reduceat(total[o], start, axis=0)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind] * len(of)),
            pa.array(of),
            pa.array(np.add.reduceat(n[o], start)),
            pa.array([s.tobytes() for s in sums], pa.binary()),
            pa.array(np.add.reduceat(mark[o], start).view(np.int64)),
        ],
        names=["kind", "label", "n", "total", "mark"],
    )


def _of_kinds(b: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    kinds = b.column("kind").dictionary_encode()
    which = kinds.indices.to_numpy(zero_copy_only=False)
    for k, kind in enumerate(kinds.dictionary.to_pylist()):
        rows = np.flatnonzero(which == k)
        yield kind, b if len(rows) == b.num_rows else b.take(pa.array(rows))


def _member_sums(sign: int):
    """Of each label the sums of its rows, or with sign -1 what they take away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, part in _of_kinds(b):
                mark = _mixed(part.column("id").to_numpy(zero_copy_only=False))
                total = sign * unit(unpack(part.column("vec"))).astype(np.float64)
                yield _summed(kind, part.column("label").to_numpy(zero_copy_only=False), np.full(len(mark), float(sign)), total, mark if sign > 0 else np.uint64(0) - mark)

    return run


def _sum_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one label come next to each other; the last label of a batch may go on in the next one."""
    held: pa.RecordBatch | None = None

    def add(kind: str, part: pa.RecordBatch) -> pa.RecordBatch:
        total = np.frombuffer(b"".join(part.column("total").to_pylist()), np.float64).reshape(part.num_rows, -1)
        return _summed(kind, part.column("label").to_numpy(), part.column("n").to_numpy(), total, part.column("mark").to_numpy().view(np.uint64))

    for b in batches:
        for kind, part in _of_kinds(b):
            if held is not None and held.column("kind")[0].as_py() == kind:
                part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            elif held is not None:
                yield held
            out = add(kind, part)  # in the order of labels, as the rows are
            held = out.slice(out.num_rows - 1, 1)
            if out.num_rows > 1:
                yield out.slice(0, out.num_rows - 1)
    if held is not None:
        yield held


def sets_of(members: DataFrame) -> DataFrame:
    """(kind, label, n, total, mark): size, sum of unit vectors and mark of each set; members: kind, id, label, vec.

    Sums are added where the rows lie before they are exchanged, so that the largest set costs no task more than others.
    """
    return _added(members.filter("label is not null").select("kind", "id", "label", "vec").mapInArrow(_member_sums(1), SUMS))


def _added(sums: DataFrame) -> DataFrame:
    local = sums.repartition("kind", "label").sortWithinPartitions("kind", "label")
    return materialize(local.mapInArrow(_sum_sums, SUMS).filter("n > 0"), "sets")


def _records(sets: DataFrame, forest: Forest) -> DataFrame:
    """Sets as records at their means: kind, id (the label), c0 .., vec, weight."""
    names = [f"c{t}" for t in range(forest.n_trees)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, part in _of_kinds(b):
                total = np.frombuffer(b"".join(part.column("total").to_pylist()), np.float64).reshape(part.num_rows, -1)
                ok = np.flatnonzero(np.abs(total).max(axis=1) > 1e-9)
                if not len(ok):
                    continue
                mean = unit(total[ok].astype(np.float32))
                codes = [pa.array(c) for c in forest.codes(kind, mean)]
                part = part.take(pa.array(ok))
                yield pa.RecordBatch.from_arrays([part.column("kind"), part.column("label"), *codes, pa.array(pack(mean), pa.binary()), part.column("n")], names=["kind", "id", *names, "vec", "weight"])

    return materialize(sets.mapInArrow(run, f"kind string, id long, {', '.join(n + ' long' for n in names)}, vec binary, weight double"), "means")


def _merged(sets: DataFrame, forest: Forest, follow: float, reach: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The sets and their records (see _records) after the sets' own peaks, from ``follow`` on, have drawn the other sets
    in, level by level, until none draws another; and (kind, label, to) of those drawn, None if there are none."""
    into = None
    while True:
        records = _records(sets, forest)
        count = records.count()
        led = led_to_peaks(records, forest.n_trees, count, follow, follow, reach) if count else None
        if led is None or led.isEmpty():
            return sets, records, into
        drawn = led.withColumnRenamed("id", "label")
        joined = lookup(sets, drawn, ["kind", "label"], count, "left").select("kind", F.coalesce("root", "label").alias("label"), "n", "total", "mark")
        sets = _added(joined)
        new = drawn.withColumnRenamed("root", "to")
        if into is not None:  # what a set drawn now had drawn before goes along
            on = drawn.select("kind", F.col("label").alias("to"), "root")
            new = new.unionByName(into.join(on, ["kind", "to"], "left").select("kind", "label", F.coalesce("root", "to").alias("to")))
        into = materialize(new, "into")
        discard(led, records)
        release(sets.sparkSession)


def _fits(floor: float, names: list[str]):
    """Members too far from their mean lose their label; ``was`` is the one they had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in _of_kinds(b):
                cosine = np.full(part.num_rows, -2.0)
                own = np.flatnonzero(part.column("mean").is_valid().to_numpy(zero_copy_only=False))
                if len(own):
                    near = part.select(["vec", "mean"]).take(pa.array(own))
                    cosine[own] = np.einsum("ij,ij->i", *(unit(unpack(near.column(c))).astype(np.float64) for c in ("vec", "mean")))
                label = pc.if_else(pa.array(cosine >= floor), part.column("was"), pa.scalar(None, pa.int64()))
                out = {c: part.column(c) for c in ("kind", "id", "was")} | {"label": label, "cosine": pa.array(cosine)} | {c: part.column(c) for c in names}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def _blocks_of(edges: list[dict[str, tuple[int, np.ndarray]]], code: str):
    """The block in each array of means in which each vector lies: edges has, of each kind, its first block and the
    first codes of the later ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, part in _of_kinds(b):
                for array, of in enumerate(edges):
                    if kind in of:
                        first, codes = of[kind]
                        block = first + np.searchsorted(codes, part.column(code).to_numpy(zero_copy_only=False), "right")
                        marks = [pa.array(x.astype(np.int32)) for x in (np.full(len(block), array), block)]
                        yield pa.RecordBatch.from_arrays([*marks, *(part.column(c) for c in ("kind", "id", "vec"))], names=["array", "block", "kind", "id", "vec"])

    return run


def _nearest_mean(floor: float):
    def run(group: pa.Table) -> pa.Table:
        out = []
        group = group.sort_by([("kind", "ascending"), ("label", "ascending")]).combine_chunks()
        for b in group.to_batches():
            for kind, part in _of_kinds(b):
                label = part.column("label")
                here = np.flatnonzero(label.is_valid().to_numpy(zero_copy_only=False))
                rest = np.flatnonzero(label.is_null().to_numpy(zero_copy_only=False))
                if not len(here) or not len(rest):
                    continue
                m = unit(unpack(part.column("vec").take(pa.array(here))))
                labels = label.take(pa.array(here)).to_numpy()
                for a in range(0, len(rest), 2048):
                    rows = pa.array(rest[a : a + 2048])
                    s = unit(unpack(part.column("vec").take(rows))) @ m.T
                    best = s.argmax(axis=1)
                    v = s[np.arange(len(s)), best].astype(np.float64)
                    hit = np.flatnonzero(v >= floor)
                    at = rows.take(pa.array(hit))
                    out.append(pa.table({"kind": [kind] * len(hit), "id": part.column("id").take(at), "label": labels[best[hit]], "cosine": v[hit], "vec": part.column("vec").take(at)}))
        empty = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("label", pa.int64()), ("cosine", pa.float64()), ("vec", pa.binary())])
        return pa.concat_tables([t.cast(empty) for t in out]) if out else empty.empty_table()

    return run


def taken(outside: DataFrame, records: DataFrame, trees: int, floor: float, min_size: int, means: int) -> DataFrame:
    """(kind, id, label, cosine, vec): the nearest mean, from floor on, of vectors outside, among those next to them in
    each array of means. outside: kind, id, c0 .., vec; records as of _records."""
    large = F.col("weight") >= min_size
    counts = records.agg(F.count_if(large), F.count_if(~large)).first()
    n_blocks = [max(1, k // means) for k in counts]
    found = None
    for t in range(trees if max(n_blocks) > 1 else 1):  # one block holds all means: other trees would give the same
        arrays = []
        for array, (n, part) in enumerate(zip(n_blocks, (records.filter(large), records.filter(~large)), strict=True)):
            ranged = part.select("kind", F.col(f"c{t}").alias("code"), F.col("id").alias("label"), "vec").repartitionByRange(n, "kind", "code", "label")
            arrays.append(ranged.withColumns({"array": F.lit(array), "block": F.spark_partition_id()}))
        placed = materialize(arrays[0].unionByName(arrays[1]), "blocks")
        edges: list[dict[str, tuple[int, np.ndarray]]] = [{}, {}]
        firsts = placed.groupBy("array", "kind", "block").agg(F.min("code").alias("code")).orderBy("array", "kind", "block").collect()  # one row per block and kind
        for array, kind in {(r["array"], r["kind"]) for r in firsts}:
            own = [(r["block"], r["code"]) for r in firsts if (r["array"], r["kind"]) == (array, kind)]
            edges[array][kind] = (own[0][0], np.array([c for _, c in own[1:]], np.int64))
        where = materialize(outside.select("kind", "id", f"c{t}", "vec").mapInArrow(_blocks_of(edges, f"c{t}"), "array int, block int, kind string, id long, vec binary"), "outside")
        at = ["array", "block"]
        shares = F.broadcast(where.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / OUTSIDE).cast("int").alias("shares")))  # one row per block
        vectors = where.join(shares, at).select(*at, F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"), "kind", "id", F.lit(None).cast("long").alias("label"), "vec")
        spread = placed.select("array", F.explode(F.array(*[F.col("block") + i for i in (-1, 0, 1)])).alias("block"), "kind", "label", "vec").join(shares, at)
        spread = spread.select(*at, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "kind", F.lit(None).cast("long").alias("id"), "label", "vec")
        hits = materialize(vectors.unionByName(spread).groupBy(*at, "share").applyInArrow(_nearest_mean(floor), HIT), "hits")
        discard(placed, where)
        found = hits if found is None else found.unionByName(hits)
    return found


def _fitted(
    touched: DataFrame, targets: DataFrame, outside: DataFrame, records: DataFrame, fresh: DataFrame | None, labels: DataFrame, sets: DataFrame, n: int, trees: int, floor: float, min_size: int, means: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels and sets after one pass, and the vectors that left their set in it: members near enough to their mean stay,
    vectors outside join the nearest mean that takes them.

    touched: kind, id, label, c0 .., vec of the members to compare with their mean, the others stay; targets: kind, label,
    to, mean. Vectors that left just now meet all records, those of ``outside`` only the fresh ones (None: all).
    """
    names = [*[f"c{t}" for t in range(trees)], "vec"]
    with_mean = lookup(touched, targets, ["kind", "label"], n, "left").select("kind", "id", F.coalesce("to", "label").alias("was"), "mean", *names)
    codes = ", ".join(f"{c} long" for c in names[:-1])
    known = materialize(with_mean.mapInArrow(_fits(floor, names), f"kind string, id long, was long, label long, cosine double, {codes}, vec binary"), "known")
    gone = known.filter("label is null")
    left = gone.select("kind", "id", *names)
    if fresh is None:
        hits = taken(outside.select("kind", "id", *names).unionByName(left), records, trees, floor, min_size, means)
    else:
        hits = taken(left, records, trees, floor, min_size, means)
        if not fresh.isEmpty():
            hits = hits.unionByName(taken(outside.select("kind", "id", *names), fresh, trees, floor, min_size, means))
    seen = known.select("kind", "id", F.struct("label", "cosine").alias("_now"))
    now = [F.when(F.col("_now").isNotNull(), F.col(f"_now.{c}")).otherwise(F.col(c)).alias(c) for c in ("label", "cosine")]
    after = materialize(labels.join(seen, ["kind", "id"], "left").select("kind", "id", *now), "after")
    best = hits.groupBy("kind", "id").agg(F.max(F.struct("cosine", (-F.col("label")).alias("label"), "vec")).alias("b"))
    best = best.select("kind", "id", (-F.col("b.label")).alias("_label"), F.col("b.cosine").alias("_cosine"), F.col("b.vec").alias("vec"))
    joined = materialize(best.join(after.filter("label is null").select("kind", "id"), ["kind", "id"]), "joined")
    new = after.join(joined.drop("vec"), ["kind", "id"], "left")
    new = materialize(new.select("kind", "id", F.coalesce("label", "_label").alias("label"), F.when(F.col("label").isNull(), F.col("_cosine")).otherwise(F.col("cosine")).alias("cosine")), "labels")
    lost = gone.select("kind", "id", F.col("was").alias("label"), "vec").mapInArrow(_member_sums(-1), SUMS)
    won = joined.select("kind", "id", F.col("_label").alias("label"), "vec").mapInArrow(_member_sums(1), SUMS)
    sets = _added(sets.unionByName(lost).unionByName(won))
    discard(after, joined)
    release(labels.sparkSession)
    return new, sets, left


def _moved(labels: DataFrame, into: DataFrame | None, n: int) -> DataFrame:
    """Labels after sets were drawn into others."""
    if into is None:
        return labels
    moved = lookup(labels, into, ["kind", "label"], n, "left")
    return materialize(moved.select("kind", "id", F.coalesce("to", "label").alias("label"), "cosine"), "labels")


def _mark(sets: DataFrame) -> tuple:
    """Equal for equal sets."""
    return tuple(sets.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("kind", "label", "n", "mark"))).first())


def clusters(
    vectors: DataFrame, min_cosine: float = 0.8, min_size: int = 12, reach: int = 1024, trees: int = 4, means: int = 1024, rows: int | None = None
) -> DataFrame:
    """(kind, id, cluster, size, cosine) of every comparable vector; cluster, the smallest id of its members, is null
    for a vector that stands apart. vectors: (kind, id, vec), ids unique in a kind. reach: rows on either side in each
    array among which a vector looks for neighbours; means: those among which it looks for a set."""
    n = rows if rows is not None else vectors.count()
    forest = fit_forest(vectors, n, trees)
    table = materialize(packed(vectors, forest), "vectors")
    if table.isEmpty():
        return table.select("kind", "id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "long"), ("size", "long"), ("cosine", "double"))])
    link = 0.95 * min_cosine**2  # two vectors at min_cosine from one mean have about the square of it between them
    follow = 0.85 * min_cosine  # the nearest of many is nearer; a lower bound would lead pointers into other clusters
    led = led_to_peaks(table.withColumn("weight", F.lit(1.0)), trees, n, link, follow, reach)
    sets_of_peaks = led.unionByName(led.select("kind", F.col("root").alias("id"), "root").distinct()).withColumnRenamed("root", "label")
    state = materialize(table.join(sets_of_peaks, ["kind", "id"], "left"), "state")
    discard(led)
    touched, outside = state.filter("label is not null"), state.filter("label is null")
    sets, records, into = _merged(sets_of(touched), forest, min_cosine, reach)
    labels = _moved(materialize(state.select("kind", "id", "label", F.lit(None).cast("double").alias("cosine")), "labels"), into, n)
    own = touched.select("kind", "label").distinct().withColumn("to", F.col("label"))
    if into is not None:
        own = own.drop("to").join(into, ["kind", "label"], "left").withColumn("to", F.coalesce("to", "label"))
    targets = own.join(records.select("kind", F.col("id").alias("to"), F.col("vec").alias("mean")), ["kind", "to"], "left")
    # The first pass takes vectors from farther away, since the mean of few vectors lies off that of their cluster.
    floor, merging, seen, fresh = 0.9 * min_cosine, True, set(), None
    compared = sets
    while True:
        labels, sets, left = _fitted(touched, targets, outside, records, fresh, labels, sets, n, trees, floor, min_size, means)
        outside = outside.select(left.columns).unionByName(left)
        floor = min_cosine
        mark = _mark(sets)
        if merging:
            drawing, records, into = _merged(sets.filter("n > 1"), forest, (1 + min_cosine) / 2, reach)
            seen.add(mark)
            merging = into is not None
            labels, sets, kept = _moved(labels, into, n), drawing.unionByName(sets.filter("n <= 1")), drawing
        else:
            kept = sets
            if mark in seen:  # no set changes any more, or a few vectors go round in a cycle
                kept = sets.filter(F.col("n") >= min_size)
                if sets.filter(F.col("n") < min_size).isEmpty():
                    break
                mark = _mark(kept)
            seen.add(mark)
            records = _records(kept, forest)
        # A set that no vector left or joined has the mean it had: its members' cosines hold, and so does what vectors
        # outside that met it, at this floor or a lower one, were told.
        same = kept.join(compared.select("kind", "label", "n", "mark"), ["kind", "label", "n", "mark"], "left_semi").select("kind", "label", F.lit(True).alias("same"))
        marks = materialize(records.select("kind", F.col("id").alias("label"), F.col("vec").alias("mean")).join(same, ["kind", "label"], "left").withColumn("same", F.coalesce("same", F.lit(False))), "marks")
        fresh = records.join(marks.filter("not same").select("kind", F.col("label").alias("id")), ["kind", "id"], "left_semi")
        members = lookup(_plain(labels.filter("label is not null"), ["kind", "id", "label", "cosine"]), marks.select("kind", "label", "same"), ["kind", "label"], n, "left")
        moving = members.filter(~F.coalesce("same", F.lit(False)) | F.col("cosine").isNull() | (F.col("cosine") < floor)).select("kind", "id", "label")
        touched = materialize(table.join(moving, ["kind", "id"]), "touched")
        targets = marks.select("kind", "label", F.col("label").alias("to"), "mean")
        compared = kept
    sizes = labels.filter("label is not null").groupBy("kind", "label").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("cluster")).filter(F.col("size") >= min_size)
    out = lookup(labels, sizes, ["kind", "label"], n, "left")
    out = out.select("kind", "id", "cluster", "size", F.when(F.col("cluster").isNotNull(), F.col("cosine")).alias("cosine"))
    discard(table, state)
    return out


def described(members: DataFrame, typical: int = 5) -> DataFrame:
    """(kind, cluster, size, typical_ids): each cluster with the ids nearest to its mean (ties: the smaller id)."""
    inside = members.filter("cluster is not null")
    salted = inside.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    order = [F.desc("cosine"), F.asc("id")]
    near = salted.withColumn("r", F.row_number().over(Window.partitionBy("kind", "cluster", "salt").orderBy(*order))).filter(F.col("r") <= typical)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "cluster").orderBy(*order))).filter(F.col("rank") <= typical)
    return near.groupBy("kind", "cluster").agg(
        F.max("size").alias("size"), F.expr("transform(array_sort(collect_list(struct(rank, id))), x -> x.id)").alias("typical_ids")
    )
