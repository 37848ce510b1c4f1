"""Messages delivered more than once: exactly one kept copy of each, by a persisted index of sorted identifier arrays.

Identity is (stream_id without blanks and case, sequence_nr, request_id with null as -1). The kept copy has the
earliest arrived_at (nulls last), then the smallest delivery_id. Identifiers are 128-bit hashes (two independent
64-bit hashes; at 10**12 messages a collision has a probability below 10**-14).

Method. Every input partition is first deduplicated where it lies, so that a message holding a third of all rows
leaves a row per partition; its losers are decided there and are never shuffled. The winners of a batch then meet
the index by hash prefix: the index is a list of immutable runs, each holding per prefix one sorted identifier array
(with the kept copy's order key beside it), which the batch searches by bisection. Novel identifiers, and copies that
beat the indexed one, form the batch's own run; as soon as there are ``merge_every`` runs of one level, they are merged
into one of the next level, so that an identifier is written once per level.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.schema import normal_stream
from frameflow.session import delete, materialize, names_in, partitions_for, read_text, release, shared_dir, write_text

LAST = 2**63 - 1
RUN_SCHEMA = "delivery_id long, prefix int, n long, h1 binary, h2 binary, at binary, did binary"
#: Tasks over which the prefixes are spread at most.
BUCKETS = 4096
#: Duplicates up to this many (8 bytes each) are broadcast to the rows that they drop out of.
BROADCAST_IDS = 500_000


def message_key(stream: str = "stream_id", seq: str = "sequence_nr", request: str = "request_id") -> list[Column]:
    """The three columns that identify a message."""
    return [
        normal_stream(stream).alias("stream_id"),
        F.col(seq).cast("long").alias("sequence_nr"),
        F.coalesce(F.col(request).cast("long"), F.lit(-1)).alias("request_id"),
    ]


def arrival_key(at: str = "arrived_at") -> Column:
    """Microseconds of arrival; a null arrival comes after all others."""
    return F.coalesce(F.unix_micros(F.col(at)), F.lit(LAST))


def identified(frames: DataFrame, batch: str | None = "batch_nr") -> DataFrame:
    """(h1, h2, at, did, batch) of each delivery of a message; rows without a stream or number are no message."""
    key = frames.filter(F.col("stream_id").isNotNull() & F.col("sequence_nr").isNotNull()).select(
        *message_key(),
        arrival_key().alias("at"),
        F.coalesce(F.col("delivery_id").cast("long"), F.lit(LAST)).alias("did"),
        (F.col(batch).cast("long") if batch else F.lit(0).cast("long")).alias("batch"),
    )
    return key.select(
        F.xxhash64("stream_id", "sequence_nr", "request_id").alias("h1"),
        F.xxhash64(F.lit("m"), "request_id", "sequence_nr", "stream_id").alias("h2"),
        "at",
        "did",
        "batch",
    )


def first_of_each(*order: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort by all columns; gives the order and, along it, whether a row is the first of its ``keys`` leading columns."""
    o = np.lexsort(order[::-1])
    first = np.ones(len(o), bool)
    if len(o):
        same = np.ones(len(o) - 1, bool)
        for c in order[:keys]:
            s = c[o]
            same &= s[1:] == s[:-1]
        first[1:] = ~same
    return o, first


def local_winners(batches: Iterator[pa.RecordBatch], held_rows: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The best copy of each (round, message) of an input partition, and its losers marked ``dup``; at most
    ``held_rows`` winners are held at a time."""
    names = ("round", "h1", "h2", "at", "did")
    held: list[list[np.ndarray]] = []
    n = 0

    def out(dup: bool, cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), dup)), *map(pa.array, cols)], names=["dup", *names])

    for b in batches:
        held.append([b.column(c).to_numpy(zero_copy_only=False) for c in names])
        n += b.num_rows
        if n < held_rows // 8:
            continue
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        o, first = first_of_each(*cols, keys=3)
        if (~first).any():
            yield out(True, [c[o[~first]] for c in cols])
        keep = [c[o[first]] for c in cols]
        if len(keep[0]) >= held_rows:
            yield out(False, keep)
            held, n = [], 0
        else:
            held, n = [keep], 0
    if held:
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        o, first = first_of_each(*cols, keys=3)
        for dup, take in ((True, o[~first]), (False, o[first])):
            if len(take):
                yield out(dup, [c[take] for c in cols])


def bisect(h1: np.ndarray, h2: np.ndarray, q1: np.ndarray, q2: np.ndarray) -> np.ndarray:
    """Place of each (q1, q2) in the arrays sorted by (h1, h2), or -1."""
    if not len(h1):
        return np.full(len(q1), -1)
    at, end = np.searchsorted(h1, q1, "left"), np.searchsorted(h1, q1, "right")
    found = np.full(len(q1), -1)
    open_ = at < end
    while open_.any():  # more than one step only where 64-bit halves collide
        i = np.flatnonzero(open_)
        hit = h2[at[i]] == q2[i]
        found[i[hit]] = at[i[hit]]
        at[i] += 1
        open_[i] = ~hit & (at[i] < end[i])
    return found


def _unpack(row: dict) -> list[np.ndarray]:
    return [np.frombuffer(row[c], np.int64) for c in ("h1", "h2", "at", "did")]


def _run_rows(prefix: int, run: list[np.ndarray], dup: np.ndarray) -> pa.Table:
    k, n = (1 if len(run[0]) else 0), len(dup)
    return pa.table(
        {
            "delivery_id": pa.array([*dup.tolist(), *[None] * k], pa.int64()),
            "prefix": pa.array([prefix] * (n + k), pa.int32()),
            "n": pa.array([None] * n + [len(run[0])] * k, pa.int64()),
            **{c: pa.array([None] * n + [x.astype(np.int64).tobytes()] * k, pa.binary()) for c, x in zip(("h1", "h2", "at", "did"), run, strict=True)},
        }
    )


def _ingest(batch: pa.Table, runs: pa.Table) -> pa.Table:
    """The duplicates that a batch shows in one prefix, and its own run."""
    prefix = (batch if batch.num_rows else runs).column("prefix")[0].as_py()
    cols = [batch.column(c).to_numpy() for c in ("h1", "h2", "at", "did")]
    o, first = first_of_each(*cols, keys=2)  # the batch's own copies, over all its partitions
    dups = [cols[3][o[~first]]]
    h1, h2, at, did = (c[o[first]] for c in cols)
    best_at, best_did, seen = np.full(len(h1), LAST), np.full(len(h1), LAST), np.zeros(len(h1), bool)
    for r1, r2, rat, rdid in (_unpack(r) for r in runs.to_pylist()):
        p = bisect(r1, r2, h1, h2)
        i = np.flatnonzero(p >= 0)
        a, d = rat[p[i]], rdid[p[i]]
        better = ~seen[i] | (a < best_at[i]) | ((a == best_at[i]) & (d < best_did[i]))
        best_at[i[better]], best_did[i[better]] = a[better], d[better]
        seen[i] = True
    same = seen & (at == best_at) & (did == best_did) & (did != LAST)  # the indexed delivery itself comes again
    wins = ~seen | (at < best_at) | ((at == best_at) & (did < best_did))
    dups += [did[~wins & ~same], best_did[wins & seen]]  # a better late copy makes the indexed one a duplicate
    return _run_rows(prefix, [h1[wins], h2[wins], at[wins], did[wins]], np.concatenate(dups))


def _merge(runs: pa.Table) -> pa.Table:
    return _run_rows(runs.column("prefix")[0].as_py(), merge_runs([_unpack(r) for r in runs.to_pylist()]), np.empty(0, np.int64))


def merge_runs(runs: list[list[np.ndarray]]) -> list[np.ndarray]:
    """One sorted run with the best copy of each identifier."""
    cols = [np.concatenate(x) for x in zip(*runs, strict=True)]
    o, first = first_of_each(*cols, keys=2)
    return [c[o[first]] for c in cols]


class MessageIndex:
    """The persisted index; ``ingest`` takes one batch after another, in any order of arrival.

    A run is a table below ``path``, bucketed by prefix, so that a batch is exchanged once and the index not at all:
    the task of a bucket reads its part of every run where it lies, and buckets whose prefixes the batch doesn't hold
    aren't read. A prefix groups a bounded number of identifiers (the caller chooses ``prefixes`` by the size expected).

    A manifest names the runs and the batches that are in them; it is replaced as a whole after each batch. A batch
    that comes again under its number (after a failure, also in another session) gives the duplicates that it gave the
    first time and changes nothing; one that failed before the manifest was replaced is ingested anew.
    """

    def __init__(self, spark: SparkSession, prefixes: int, merge_every: int = 2, path: str | None = None):
        self.spark, self.prefixes, self.merge_every = spark, prefixes, merge_every
        self.buckets = min(prefixes, BUCKETS)
        self.path = path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex[:8]}"
        #: Of each run its folder and level; of each batch its folder.
        self.runs: list[tuple[str, int]] = []
        self.batches: dict[int, str] = {}
        self.version = 0
        self.tables: dict[str, str] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str, prefixes: int, merge_every: int = 2) -> MessageIndex:
        """The index at ``path`` as its last batch left it; a new one, of ``prefixes``, where there is none."""
        versions = [n for n in names_in(spark, path) if n.startswith("manifest-") and n.endswith(".json")]
        if not versions:
            return cls(spark, prefixes, merge_every, path)
        m = json.loads(read_text(spark, f"{path}/{max(versions)}"))
        index = cls(spark, m["prefixes"], merge_every, path)
        index.runs = [(r, level) for r, level in m["runs"]]
        index.batches = {int(k): v for k, v in m["batches"].items()}
        index.version = m["version"]
        return index

    def _commit(self) -> None:
        self.version += 1
        text = json.dumps({"prefixes": self.prefixes, "runs": self.runs, "batches": self.batches, "version": self.version})
        write_text(self.spark, f"{self.path}/manifest-{self.version:012d}.json", text)
        if self.version > 2:
            delete(self.spark, f"{self.path}/manifest-{self.version - 2:012d}.json")

    def prefix(self) -> Column:
        """The leading bits of the identifier, as one of ``prefixes`` equal ranges."""
        return F.floor(F.shiftrightunsigned(F.col("h1"), 33) * F.lit(self.prefixes) / F.lit(float(2**31))).cast("int")

    def _table(self, folder: str) -> DataFrame:
        """A run, as a bucketed table of this session's catalog."""
        if folder not in self.tables:
            name = f"frameflow_run_{uuid.uuid4().hex}"
            columns = ", ".join(c.strip() for c in RUN_SCHEMA.split(","))
            self.spark.sql(f"create table {name} ({columns}) using parquet options (path '{self.path}/{folder}') clustered by (prefix) into {self.buckets} buckets")
            self.tables[folder] = name
        return self.spark.table(self.tables[folder]).filter("n is not null").select("prefix", "h1", "h2", "at", "did")

    def _write(self, rows: DataFrame, name: str) -> str:
        folder, table = f"{name}-{uuid.uuid4().hex[:8]}", f"frameflow_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "prefix").option("path", f"{self.path}/{folder}").saveAsTable(table)
        self.tables[folder] = table
        return folder

    def _duplicates(self, folder: str) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(f"{self.path}/{folder}").filter("n is null").select("delivery_id")

    def ingest(self, winners: DataFrame, batch_id: int | None = None) -> DataFrame:
        """delivery_id of every delivery that this batch shows not to be the kept copy; the batch enters the index.

        winners: (h1, h2, at, did), a written table, since it is read twice. batch_id: the batch's number, by default
        the next one. A delivery that is the indexed copy itself (same arrival and delivery_id) is no duplicate.
        """
        if batch_id is None:
            batch_id = max(self.batches, default=-1) + 1
        if batch_id in self.batches:
            return self._duplicates(self.batches[batch_id])
        batch = winners.select(self.prefix().alias("prefix"), "h1", "h2", "at", "did")
        known = self.spark.createDataFrame([], "prefix int, h1 binary, h2 binary, at binary, did binary")
        if self.runs:
            held = [r[0] for r in batch.select("prefix").distinct().limit(1001).collect()] if self.prefixes > 1000 else []
            for i, (folder, _) in enumerate(self.runs):
                run = self._table(folder)
                run = run.filter(F.col("prefix").isin(held)) if 0 < len(held) <= 1000 else run
                known = run if i == 0 else known.unionByName(run)
        out = batch.repartition(self.buckets, "prefix").groupBy("prefix").cogroup(known.groupBy("prefix")).applyInArrow(_ingest, RUN_SCHEMA)
        folder = self._write(out, f"batch-{batch_id}")
        self.runs.append((folder, 0))
        self.batches[batch_id] = folder
        self._commit()
        self._merge_levels()
        release(self.spark)
        return self._duplicates(folder)

    def _merge_levels(self) -> None:
        """Merge the runs of a level once there are ``merge_every``."""
        level = 0
        while (same := [r for r in self.runs if r[1] == level]) or any(r[1] > level for r in self.runs):
            if len(same) >= max(2, self.merge_every):
                known = self._table(same[0][0])
                for folder, _ in same[1:]:
                    known = known.unionByName(self._table(folder))
                merged = self._write(known.groupBy("prefix").applyInArrow(_merge, RUN_SCHEMA), f"level-{level + 1}")
                self.runs = [*[r for r in self.runs if r[1] != level], (merged, level + 1)]
                self._commit()
                for folder, _ in same:  # a batch's folder also holds its duplicates, which may be asked for again
                    if folder not in self.batches.values():
                        delete(self.spark, f"{self.path}/{folder}")
            level += 1

    def forget_batches(self, before: int) -> None:
        """Let go of the duplicates of batches below a number, which won't come again."""
        live = {r[0] for r in self.runs}
        gone = {b: f for b, f in self.batches.items() if b < before}
        self.batches = {b: f for b, f in self.batches.items() if b >= before}
        self._commit()
        for folder in gone.values():
            if folder not in live:
                delete(self.spark, f"{self.path}/{folder}")

    def close(self) -> None:
        """Forget this session's names of the runs; the index itself stays."""
        for name in self.tables.values():
            self.spark.sql(f"drop table if exists {name}")
        self.tables = {}


def duplicate_deliveries(frames: DataFrame, rounds: int = 3, ids_per_prefix: int = 250_000) -> DataFrame:
    """delivery_id of every delivery of a message that is not its kept copy.

    ``rounds`` consecutive ranges of batch_nr are ingested one after another, as they would arrive (null batch_nr
    last). Rows with a null stream_id or sequence_nr are no message and no duplicate; an empty table gives no rows;
    repeated rows with one delivery_id count as copies within a range, and as the same delivery if their arrival is
    equal too and they lie in different ranges; null delivery_ids come after all others and are given as null. Other
    columns of the input are not read.
    """
    spark = frames.sparkSession
    ids = identified(frames)
    span = frames.agg(F.min("batch_nr").cast("long"), F.max("batch_nr").cast("long"), F.count(F.lit(1))).first()
    lo, hi, rows = span[0] or 0, span[1] or 0, span[2]
    width = max(1, -(-(hi - lo + 1) // rounds))
    ids = ids.withColumn("round", F.coalesce(F.floor((F.col("batch") - lo) / width), F.lit(rounds - 1)).cast("int")).drop("batch")
    local = materialize(ids.mapInArrow(local_winners, "dup boolean, round int, h1 long, h2 long, at long, did long"), "deliveries")
    index = MessageIndex(spark, partitions_for(spark, rows, ids_per_prefix))
    found = local.filter("dup").select(F.col("did").alias("delivery_id"))
    for r in range(rounds):
        found = found.unionByName(index.ingest(local.filter(~F.col("dup") & (F.col("round") == r))))
    index.close()
    return found.select(F.when(F.col("delivery_id") != LAST, F.col("delivery_id")).alias("delivery_id"))


def kept_messages(frames: DataFrame, rounds: int = 3) -> DataFrame:
    """One row per message, its kept copy, with all columns of the input and the key in normal form.

    A delivery is named by its delivery_id: rows that repeat one count once, rows without one are left out.
    """
    key = {c: k for c, k in zip(("stream_id", "sequence_nr", "request_id"), message_key(), strict=True)}
    rows = frames.filter(F.col("stream_id").isNotNull() & F.col("sequence_nr").isNotNull() & F.col("delivery_id").isNotNull())
    lost = duplicate_deliveries(rows, rounds).groupBy("delivery_id").agg(F.count(F.lit(1)).alias("lost"))
    lost = materialize(lost, "lost")
    few = lost.count() <= BROADCAST_IDS
    hint = F.broadcast if few else (lambda x: x)
    # Only ids among the duplicates can stand on several rows; one that was lost less often than it stands is kept.
    stands = rows.select("delivery_id").join(hint(lost), "delivery_id").groupBy("delivery_id").agg(F.count(F.lit(1)).alias("n"), F.max("lost").alias("lost"))
    stands = materialize(stands, "stands")
    kept = rows.join(hint(stands.select("delivery_id")), "delivery_id", "left_anti")
    again = stands.filter("n > lost").select("delivery_id")
    if not again.isEmpty():
        kept = kept.unionByName(rows.join(hint(again), "delivery_id", "left_semi").dropDuplicates(["delivery_id"]))
    return kept.select(*frames.columns).withColumns(key)


__all__ = ["MessageIndex", "arrival_key", "duplicate_deliveries", "kept_messages", "message_key"]
