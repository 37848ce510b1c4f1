"""Nearest prototypes with a ratio test, as a request over a table of prototypes.

Distances are computed in Arrow batches: the prototypes (a library of bounded, checked size) are sent to the workers,
and each batch of queries meets them in one product. A library above the bound goes through in several pieces, whose
best two are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Floats of prototypes that a worker holds at a time.
PROTOTYPE_FLOATS = 8_000_000


def _vectors(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the given length without null or NaN, as doubles, and their places."""
    rows = column.to_pylist() if column.null_count or len(column) == 0 else None
    if rows is None:
        size = np.diff(column.offsets.to_numpy())
        if (size == length).all():
            flat = column.flatten()
            m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
            ok = np.flatnonzero(~np.isnan(m).any(axis=1))
            return m[ok], ok
        rows = column.to_pylist()
    ok = [i for i, r in enumerate(rows) if r is not None and len(r) == length and all(x is not None and x == x for x in r)]
    return np.array([rows[i] for i in ok], np.float64).reshape(len(ok), length), np.array(ok, np.int64)


def nearest_two(queries: DataFrame, prototypes: DataFrame, within: str | None = None) -> DataFrame:
    """(query_id, part, best_id, d0, d1): per query, and per value of the prototypes' column ``within`` if given, the
    nearest prototype and the two smallest distances. d1 is null with a single prototype. Ties: the smaller id.

    queries: (query_id LONG, vec), prototypes: (proto_id LONG, vec, ...). Vectors of another length than the first
    prototype's, or with null or NaN, match nothing.
    """
    proto = prototypes.select(F.col("proto_id").cast("long"), F.col("vec").cast("array<double>").alias("vec"), (F.col(within).cast("string") if within else F.lit("")).alias("part"))
    proto = proto.filter("proto_id is not null and vec is not null and size(vec) > 0")
    n, length = proto.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    pieces = max(1, -(-n * (length or 1) // PROTOTYPE_FLOATS))
    q = queries.select(F.col("query_id").cast("long"), F.col("vec").cast("array<double>").alias("vec"))
    out = None
    for p in range(pieces):
        part = proto.filter(F.pmod(F.xxhash64("proto_id"), F.lit(pieces)) == p) if pieces > 1 else proto
        t = part.toArrow().combine_chunks()
        m, ok = _vectors(t.column("vec").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.float64())), length or 1)
        ids = t.column("proto_id").to_numpy()[ok]
        parts = np.array(t.column("part").to_pylist(), dtype=object)[ok]
        o = np.argsort(ids, kind="stable")
        found = q.mapInArrow(_search(m[o], ids[o], parts[o], length or 1), "query_id long, part string, proto_id long, d double")
        out = found if out is None else out.unionByName(found)
    if pieces > 1:
        w = Window.partitionBy("query_id", "part").orderBy("d", "proto_id")  # two rows per piece
        out = out.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    g = out.groupBy("query_id", "part").agg(F.sort_array(F.collect_list(F.struct("d", "proto_id"))).alias("_b"))
    return g.select("query_id", "part", F.get("_b", F.lit(0))["proto_id"].alias("best_id"), F.get("_b", F.lit(0))["d"].alias("d0"), F.get("_b", F.lit(1))["d"].alias("d1"))


def _search(m: np.ndarray, ids: np.ndarray, parts: np.ndarray, length: int):
    groups = [(name, np.flatnonzero(parts == name)) for name in sorted(set(parts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, ok = _vectors(b.column("vec"), length)
            if not len(ok):
                continue
            qid = b.column("query_id").to_numpy(zero_copy_only=False)[ok]
            for name, rows in groups:
                step = max(1, 4_000_000 // (len(rows) * length))
                for k in range(0, len(v), step):
                    x = v[k : k + step]
                    d = np.sqrt(((x[:, None, :] - m[rows][None, :, :]) ** 2).sum(axis=2))
                    best = np.argsort(d, axis=1, kind="stable")[:, :2]
                    n = best.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(qid[k : k + step], n)),
                            pa.array([name] * (len(x) * n)),
                            pa.array(ids[rows][best].ravel()),
                            pa.array(np.take_along_axis(d, best, axis=1).ravel()),
                        ],
                        names=["query_id", "part", "proto_id", "d"],
                    )

    return run


def strong_matches(nearest: DataFrame, ratio: float) -> DataFrame:
    """Matches whose nearest is clearly nearer than the second: d0 < ratio x d1; one without a second has no match."""
    return nearest.filter(F.col("d1").isNotNull() & (F.col("d0") < F.lit(ratio) * F.col("d1")))


def ratio_match(queries: DataFrame, prototypes: DataFrame, ratio: float, per: str | None = None, shards: int | None = None) -> DataFrame:
    """Strong matches of queries: against all prototypes, per group ``per`` of them, or per shard (proto_id mod shards).

    Sharding changes the answer, since the second neighbour is then the shard's own.
    """
    if shards:
        prototypes = prototypes.withColumn("_shard", F.pmod(F.col("proto_id"), F.lit(shards)))
        per = "_shard"
    return strong_matches(nearest_two(queries, prototypes, per), ratio)


def match_counts(matches: DataFrame, owner: DataFrame, request: DataFrame, least: int = 1) -> DataFrame:
    """(request_id, prototype, n): strong matches per request and owner of the prototype, of at least ``least``.

    owner: (proto_id, prototype); request: (query_id, request_id).
    """
    m = matches.join(request, "query_id").join(owner, matches["best_id"] == owner["proto_id"])
    return m.groupBy("request_id", "prototype").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def request_results(counts: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, result): one JSON object of prototype: count per request, in order of the prototypes; {} if none."""
    per = counts.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct(F.col("prototype").cast("string").alias("prototype"), "n"))).alias("_e"))
    out = requests.select("request_id").distinct().join(per, "request_id", "left")
    body = F.to_json(F.map_from_entries(F.col("_e")))
    return out.select("request_id", F.coalesce(body, F.lit("{}")).alias("result"))


def match(requests: DataFrame, descriptors: DataFrame, prototypes: DataFrame, ratio: float, least: int = 1, shards: int | None = None) -> DataFrame:
    """The request call: requests (request_id), their descriptors (request_id, query_id, vec), prototypes (proto_id,
    prototype, vec) to (request_id, result)."""
    found = ratio_match(descriptors, prototypes, ratio, shards=shards)
    counts = match_counts(found, prototypes.select("proto_id", "prototype"), descriptors.select("query_id", "request_id"), least)
    return request_results(counts, requests)


