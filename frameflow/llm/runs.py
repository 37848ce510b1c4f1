"""Runs of equal or nearly equal consecutive events, each collapsed into one record with its count and duration.

Events are the kept copies of frames, by (stream_id, request_id) in order of sequence_nr; gaps don't matter.
Neighbours belong together if both images are non-empty and equally long and the sum of absolute differences of their
bytes is at most ``tolerance`` x length.

Method. The events are range-partitioned by (stream_id, request_id, sequence_nr), so that a stream of any size is cut
into chunks of bounded size. In every chunk the run starts are gathered into a sorted array, events are assigned to
them by binary search, and counts and times are aggregated per run. Runs that touch an end of their partition carry
their outer image. A join of each partition's last run with the next partition's first compares those images, and the
runs that go on, also over many partitions, are added up by the numbers of their partitions, without images.

Defined results: rows with a null stream_id or sequence_nr are no event; a null request_id is -1; a null or empty
image belongs to nothing, so its event is a run of one; the duration is the span of the non-null ts_ms, null if there
is none; equal arrival times are decided by delivery_id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameflow.operators.messages import LAST, arrival_key, first_of_each, message_key
from frameflow.session import materialize, partitions_for

RUN = "stream_id string, request_id long, first_seq long, last_seq long, n_frames long, ts_first long, ts_last long, edge int, pid int, head binary, tail binary"
NAMES = [x.split()[0] for x in RUN.split(", ")]
NO_TS = (2**62, -(2**62))
#: Bytes of a table's files per partition.
PARTITION_BYTES = 256 << 20


def _best_copies(held_rows: int, held_bytes: int = 64 << 20):
    """The best copy of each message among so many rows or bytes, so that no message floods a later task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = size = 0

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            o, first = first_of_each(*[t.column(c).to_numpy() for c in ("h1", "h2", "at", "did")], keys=2)
            if not first.all():
                t = t.take(pa.array(np.sort(o[first])))
            yield from t.drop_columns(["h1", "h2"]).to_batches(max_chunksize=20_000)

        for b in batches:
            held.append(b)
            n, size = n + b.num_rows, size + b.nbytes
            if n >= held_rows or size >= held_bytes:
                yield from out()
                held, n, size = [], 0, 0
        if held:
            yield from out()

    return run


def alike(images: pa.Array, tolerance: int) -> np.ndarray:
    """Whether each image belongs together with the one before it; the first never does."""
    n = len(images)
    images = images.cast(pa.large_binary())
    off = np.frombuffer(images.buffers()[1], np.int64)[images.offset : images.offset + n + 1]
    data = np.frombuffer(images.buffers()[2], np.uint8) if images.buffers()[2] is not None else np.empty(0, np.uint8)
    size = np.diff(off)
    out = np.zeros(n, bool)
    same = np.flatnonzero((size[1:] == size[:-1]) & (size[1:] > 0)) + 1
    order = same[np.argsort(size[same], kind="stable")]
    for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        if not len(part):
            continue
        length = int(size[part[0]])
        step = max(1, 8_000_000 // length)
        for k in range(0, len(part), step):
            i = part[k : k + step]
            total = np.zeros(len(i), np.int64)
            for lo in range(0, length, 1 << 20):
                col = np.arange(lo, min(length, lo + (1 << 20)))
                a, b = data[off[i][:, None] + col].astype(np.int16), data[off[i - 1][:, None] + col]
                total += np.abs(a - b).sum(axis=1, dtype=np.int64)
            out[i] = total <= tolerance * length
    return out


def _runs(tolerance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        last: pa.Table | None = None  # the last event so far
        open_: list | None = None  # its run: first_seq, count, first ts, last ts, whether it began the partition
        head = None

        def rows(stream, request, first, stop, n, lo, hi, edge, heads, tails) -> pa.RecordBatch:
            k = len(first)
            ts = [pa.array(np.where(lo == NO_TS[0], 0, x), mask=lo == NO_TS[0]) for x in (lo, hi)]
            return pa.RecordBatch.from_arrays(
                [stream.cast(pa.string()), *map(pa.array, (request, first, stop, n)), *ts, pa.array(edge.astype(np.int32)), pa.array(np.full(k, pid, np.int32)), pa.array(heads, pa.binary()), pa.array(tails, pa.binary())],
                names=NAMES,
            )

        for b in batches:
            t = pa.Table.from_batches([b])
            if last is not None:
                t = pa.concat_tables([last, t])
            t = t.combine_chunks()
            stream = t.column("stream_id").combine_chunks()
            code = stream.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            request, seq = t.column("request_id").to_numpy(), t.column("sequence_nr").to_numpy()
            first_copy = np.r_[True, (code[1:] != code[:-1]) | (request[1:] != request[:-1]) | (seq[1:] != seq[:-1])]
            if not first_copy.all():
                keep = np.flatnonzero(first_copy)
                t = t.take(pa.array(keep)).combine_chunks()
                stream, code, request, seq = stream.take(pa.array(keep)), code[keep], request[keep], seq[keep]
            n = len(seq)
            images = t.column("image").combine_chunks()
            if head is None:
                head = images[0].as_py()
            together = alike(images, tolerance)
            together[1:] &= (code[1:] == code[:-1]) & (request[1:] == request[:-1])
            starts = np.flatnonzero(~together)
            of = np.searchsorted(starts, np.arange(n), "right") - 1  # the run of each event
            count = np.bincount(of, minlength=len(starts))
            ts = t.column("ts_ms")
            none = pc.is_null(ts).combine_chunks().to_numpy(zero_copy_only=False)
            value = pc.fill_null(ts, 0).to_numpy()
            lo = np.minimum.reduceat(np.where(none, NO_TS[0], value), starts)
            hi = np.maximum.reduceat(np.where(none, NO_TS[1], value), starts)
            first, stop = seq[starts], seq[np.r_[starts[1:] - 1, n - 1]]
            began = np.zeros(len(starts), bool)
            if open_ is None:
                began[0] = True
            else:
                first[0], began[0] = open_[0], open_[4]
                count[0] += open_[1] - 1  # the carried event is in both
                lo[0], hi[0] = min(lo[0], open_[2]), max(hi[0], open_[3])
            if len(starts) > 1:
                s = slice(0, len(starts) - 1)
                heads = [head if x else None for x in began[s]]
                yield rows(stream.take(pa.array(starts[s])), request[starts[s]], first[s], stop[s], count[s], lo[s], hi[s], began[s], heads, [None] * len(heads))
            open_ = [first[-1], count[-1], lo[-1], hi[-1], began[-1]]
            last = t.slice(n - 1, 1)
        if last is not None:
            one = lambda x: np.array([x])
            edge = one(int(open_[4]) + 2)
            yield rows(
                last.column("stream_id").combine_chunks(), last.column("request_id").to_numpy(), one(open_[0]), last.column("sequence_nr").to_numpy(), one(open_[1]), one(open_[2]), one(open_[3]), edge,
                [head if open_[4] else None], [last.column("image")[0].as_py()],
            )

    return run


def _go_on(tolerance: int):
    """Whether the last image of a partition and the first of the next belong together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair = pa.concat_arrays([b.column("tail"), b.column("head")]).take(pa.array(np.arange(2 * b.num_rows).reshape(2, -1).T.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("pid"), pa.array(alike(pair, tolerance)[1::2])], names=["pid", "together"])

    return run


def _stitched(runs: DataFrame, tolerance: int) -> DataFrame:
    """The runs at the ends of partitions, put together where they go on. runs: as of _runs, written."""
    edges = runs.filter("edge > 0")
    order = Window.partitionBy(F.lit(0)).orderBy("pid")
    pids = edges.select("pid").distinct().withColumn("next", F.lead("pid").over(order)).filter("next is not null")  # numbers, one per partition
    tails = edges.filter(F.col("edge").bitwiseAND(2) > 0).select("pid", "stream_id", "request_id", "tail")
    heads = edges.filter(F.col("edge").bitwiseAND(1) > 0).select(F.col("pid").alias("next"), "stream_id", "request_id", "head")
    pairs = tails.join(pids, "pid").join(heads, ["next", "stream_id", "request_id"]).filter("tail is not null and head is not null").select("next", "tail", "head")
    links = pairs.select(F.col("next").alias("pid"), "tail", "head").mapInArrow(_go_on(tolerance), "pid int, together boolean").filter("together")
    plain = edges.drop("head", "tail").join(links, "pid", "left")
    # Two rows per partition at most, without images, in order; a row that doesn't go on begins a new run.
    along = Window.partitionBy(F.lit(0)).orderBy("pid", "edge")
    begins = F.when((F.col("edge").bitwiseAND(1) > 0) & F.coalesce("together", F.lit(False)), 0).otherwise(1)
    g = plain.withColumn("run", F.sum(begins).over(along)).groupBy("run", "stream_id", "request_id")
    return g.agg(F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.sum("n_frames").alias("n_frames"), F.min("ts_first").alias("ts_first"), F.max("ts_last").alias("ts_last"))


def collapsed_runs(frames: DataFrame, tolerance: int = 2, rows: int | None = None, partitions: int | None = None) -> DataFrame:
    """(stream_id, request_id, first_seq, last_seq, n_frames, duration_ms), one row per run; every kept event is in one.

    partitions: by default so many that one holds a bounded number of rows and, as far as the size of the table's
    files tells, of bytes."""
    spark = frames.sparkSession
    n = rows if rows is not None else frames.count()
    events = frames.filter(F.col("stream_id").isNotNull() & F.col("sequence_nr").isNotNull()).select(
        *message_key(), arrival_key().alias("at"), F.coalesce(F.col("delivery_id").cast("long"), F.lit(LAST)).alias("did"), F.col("ts_ms").cast("long").alias("ts_ms"), F.col("image").alias("image")
    )
    hashed = events.withColumns({"h1": F.xxhash64("stream_id", "sequence_nr", "request_id"), "h2": F.xxhash64(F.lit("m"), "request_id", "sequence_nr", "stream_id")})
    local = hashed.mapInArrow(_best_copies(60_000), events.schema)
    key = ["stream_id", "request_id", "sequence_nr"]
    if partitions is None:
        size = int(str(frames._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        partitions = max(partitions_for(spark, n, 500_000), min(n // 1000, size // PARTITION_BYTES))
    ranged = local.repartitionByRange(partitions, *key).sortWithinPartitions(*key, "at", "did")
    runs = materialize(ranged.select(*key, "ts_ms", "image").mapInArrow(_runs(tolerance), RUN), "runs")
    columns = ["stream_id", "request_id", "first_seq", "last_seq", "n_frames", "ts_first", "ts_last"]
    whole = runs.filter("edge = 0").select(*columns).unionByName(_stitched(runs, tolerance).select(*columns))
    return whole.select("stream_id", "request_id", "first_seq", "last_seq", "n_frames", (F.col("ts_last") - F.col("ts_first")).alias("duration_ms"))
