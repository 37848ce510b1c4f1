"""Keyed history in a stream: count windows with expiry, the latest row per stream, and exactly-once ingestion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from frameflow.operators.media import latest
from frameflow.operators.windows import Batcher
from frameflow.session import delete, names_in

# Defaults of the history, in milliseconds and items.
TTL_MS, MAX_ITEMS = 30_000, 500


def refreshed(held: dict[int, int], numbers: np.ndarray, times: np.ndarray, ttl_ms: int) -> dict[int, int]:
    """The history, sorted, after the arrival of numbers with times: each number with the time it is held until.

    A number that is late gives the numbers behind it new time; a number that is held already counts once.
    """
    old = np.array(list(held), np.int64)
    at = np.r_[old, numbers]
    until = np.r_[np.array(list(held.values()), np.int64), times + ttl_ms]
    fresh = np.r_[np.full(len(old), -(2**62)), times + ttl_ms]
    o = np.lexsort((np.arange(len(at)), at))
    at, until, fresh = at[o], until[o], fresh[o]
    first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.empty(0, bool)
    start = np.flatnonzero(first)
    before = np.r_[-(2**62), np.maximum.accumulate(fresh)][start]  # the latest of the arrivals below the number
    return dict(zip(at[start].tolist(), np.maximum(until[start], before).tolist(), strict=True))


def stream_windows(
    df: DataFrame, keys: Sequence[str], window: Batcher, seq: str = "sequence_nr", ts: str = "ts", ttl_ms: int = TTL_MS, max_items: int = MAX_ITEMS, emit_expired: bool = False
) -> DataFrame:
    """(keys, first_seq, last_seq, expired) of a streaming table with a watermark on ``ts``.

    window: Discrete, Sliding or any other Batcher. Each key keeps a sorted history. A number that completes a window
    takes it out (a sliding window only its head); a late number is put in order and gives the numbers behind it new
    time. Numbers older than ttl_ms against the watermark, and the oldest beyond max_items, leave unmatched: as rows of
    one number with expired true, if emit_expired. Without late rows and expiry the windows are those of the batch
    operator. Null keys, numbers and times are left out, a number that is in the history already counts once.
    """
    out = T.StructType([*[df.schema[k] for k in keys], T.StructField("first_seq", T.LongType()), T.StructField("last_seq", T.LongType()), T.StructField("expired", T.BooleanType())])
    names = out.fieldNames()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers, until = (list(x) for x in state.get) if state.exists else ([], [])
        held = dict(zip(numbers, until, strict=True))
        for b in batches:
            held = refreshed(held, b["_n"].to_numpy(np.int64), b["_t"].to_numpy(np.int64), ttl_ms)
        found, left = window.take(list(held))
        rows = [(*key, a, z, False) for a, z in found]
        mark = state.getCurrentWatermarkMs()
        gone = [n for n in left if held[n] <= mark]
        left = [n for n in left if held[n] > mark]
        gone += left[: max(0, len(left) - max_items)]
        left = left[max(0, len(left) - max_items) :]
        if emit_expired:
            rows += [(*key, n, n, True) for n in gone]
        if left:
            state.update((left, [held[n] for n in left]))
            state.setTimeoutTimestamp(max(mark + 1, min(held[n] for n in left)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=names)

    rows = _complete(df, keys, seq, ts).select(*keys, F.col(ts), F.col(seq).cast("long").alias("_n"), F.unix_millis(ts).alias("_t"))
    return rows.groupBy(*keys).applyInPandasWithState(run, out, "numbers array<long>, until array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def _complete(df: DataFrame, keys: Sequence[str], *others: str) -> DataFrame:
    """Rows without a null in these columns."""
    good = F.lit(True)
    for c in (*keys, *others):
        good = good & F.col(c).isNotNull()
    return df.filter(good)


def stream_same_sequence(df: DataFrame, keys: Sequence[str], count: int, ts: str = "ts", ttl_ms: int = TTL_MS) -> DataFrame:
    """(keys, n, overflow) of groups of one key with at least ``count`` items, as the batch operator gives them.

    keys hold the stream and the number. A group closes when the watermark is ttl_ms past its last item, whenever its
    items come; smaller groups are let go then. An item that is later than that begins a new group.
    """
    out = T.StructType([*[df.schema[k] for k in keys], T.StructField("n", T.LongType()), T.StructField("overflow", T.BooleanType())])
    names = out.fieldNames()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, until = state.get if state.exists else (0, 0)
        for b in batches:
            if len(b):
                n, until = n + len(b), max(until, int(b["_t"].max()) + ttl_ms)
        rows = []
        if state.hasTimedOut:
            rows = [(*key, n, n > count)] if n >= count else []
            state.remove()
        else:
            state.update((n, until))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, until))
        yield pd.DataFrame(rows, columns=names)

    rows = _complete(df, keys, ts).select(*keys, F.col(ts), F.unix_millis(ts).alias("_t"))
    return rows.groupBy(*keys).applyInPandasWithState(run, out, "n long, until long", "append", GroupStateTimeout.EventTimeTimeout)


def once(df: DataFrame, key: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Each key once in a stream, for copies that arrive within ``delay``."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions below path that were written whole."""
    return sorted(int(n[1:]) for n in names_in(spark, path) if n.startswith("v") and n[1:].isdigit() and "_SUCCESS" in names_in(spark, f"{path}/{n}"))


def upsert_latest(path: str, keys: Sequence[str], order: Sequence[str], keep: int = 2):
    """A foreachBatch function that keeps, below ``path``, the latest row per key, whatever columns the rows have.

    Every batch writes a new version beside the newest earlier one, so that a batch that runs again starts from what it
    started from the first time; the last ``keep`` versions stay. Of rows that are equal in keys and order any one stays.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, path) if v < batch_id]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/v{before[-1]}")) if before else batch
        latest(rows, keys, order, batch.columns).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        for v in before[: max(0, len(before) + 1 - max(2, keep))]:
            delete(spark, f"{path}/v{v}")

    return apply


def read_latest(spark, path: str, batch_id: int | None = None, ts: str | None = None, expire_ms: int | None = None, now_ms: int | None = None) -> DataFrame:
    """A version of the latest rows, by default the newest, without those that have expired."""
    df = spark.read.parquet(f"{path}/v{_versions(spark, path)[-1] if batch_id is None else batch_id}")
    return df if ts is None else df.filter(F.col(ts) >= F.lit(now_ms - expire_ms))


def ingest_batches(index, sink):
    """A foreachBatch function that puts every micro-batch through a message index and hands the duplicates to
    ``sink(duplicates, batch_id)``.

    A micro-batch that runs again gives what it gave the first time and enters the index once; with an index opened by
    ``MessageIndex.open`` that holds over restarts. The sink may see a batch_id twice and should replace what it has.
    """
    from frameflow.operators.messages import identified, local_winners
    from frameflow.session import materialize

    def apply(batch: DataFrame, batch_id: int) -> None:
        ids = identified(batch, None).withColumn("round", F.lit(0)).drop("batch")
        local = materialize(ids.mapInArrow(local_winners, "dup boolean, round int, h1 long, h2 long, at long, did long"), "deliveries")
        dups = local.filter("dup").select(F.col("did").alias("delivery_id")).unionByName(index.ingest(local.filter("not dup"), batch_id))
        sink(dups, batch_id)

    return apply
