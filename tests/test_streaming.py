import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameflow.operators.messages import MessageIndex, duplicate_deliveries
from frameflow.operators.windows import Discrete, SameSequence, Sliding
from frameflow.session import ship
from frameflow.streaming.history import ingest_batches, once, read_latest, refreshed, stream_same_sequence, stream_windows, upsert_latest

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "stream_id string, sequence_nr long, ts timestamp"


def stream(spark, tmp_path, batches, schema=SCHEMA):
    """A file stream that gives one batch per trigger, in order."""
    ship(spark)
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for p in folder.glob("part-*.parquet"):
            if not p.name.startswith("part-b"):
                p.rename(folder / f"part-b{i:03d}-{p.name}")
                import os

                os.utime(folder / f"part-b{i:03d}-{p.name}", (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder))


def collect(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def rows(*numbers, stream_id="s", second=0):
    return [(stream_id, n, T0 + dt.timedelta(seconds=second + (n or 0))) for n in numbers]


@pytest.mark.parametrize("window", [Discrete(3, 1), Sliding(2, 1), Sliding(3, 1, 3)])
def test_stream_equals_batch(spark, tmp_path, window):
    parts = [rows(0, 1, 2, 3) + rows(5, None, stream_id="t"), rows(4, 5, 7), rows(8, 9, 10) + rows(6, 7, stream_id="t")]
    df = stream(spark, tmp_path, parts).withWatermark("ts", "1 hour")
    got = collect(stream_windows(df, ["stream_id"], window, ttl_ms=3_600_000), tmp_path, f"w{window.size}{type(window).__name__}")
    batch = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    want = window.frame(batch, ["stream_id"]).collect()
    key = lambda r: (r["stream_id"], r["first_seq"], r["last_seq"])
    assert sorted(map(key, got)) == sorted(map(key, want)) and not any(r["expired"] for r in got)


def test_late_and_expired_numbers(spark, tmp_path):
    df = stream(spark, tmp_path, [rows(1, 3), rows(2), rows(20), rows(500), rows(501)]).withWatermark("ts", "0 seconds")
    got = collect(stream_windows(df, ["stream_id"], Discrete(3, 1), ttl_ms=60_000, emit_expired=True), tmp_path, "late")
    assert {(r["first_seq"], r["last_seq"], r["expired"]) for r in got} >= {(1, 3, False), (20, 20, True)}


def test_size_cap(spark, tmp_path):
    df = stream(spark, tmp_path, [rows(*range(0, 20, 2))]).withWatermark("ts", "1 hour")
    got = collect(stream_windows(df, ["stream_id"], Discrete(3, 1), ttl_ms=3_600_000, max_items=4, emit_expired=True), tmp_path, "cap")
    assert sorted(r["first_seq"] for r in got) == [0, 2, 4, 6, 8, 10]


def test_once_and_same_sequence(spark, tmp_path):
    parts = [rows(1, 1, 2), rows(1, 3), rows(400)]
    got = collect(once(stream(spark, tmp_path, parts), ["stream_id", "sequence_nr"], "ts", "1 hour"), tmp_path, "once")
    assert sorted(r["sequence_nr"] for r in got) == [1, 2, 3, 400]
    # Items on both sides of a minute, and a group with too many.
    minute = [("s", 7, T0 + dt.timedelta(seconds=59)), ("s", 8, T0 + dt.timedelta(seconds=58))]
    minute2 = [("s", 7, T0 + dt.timedelta(seconds=61))] + [("s", 9, T0 + dt.timedelta(seconds=62))] * 3
    df = stream(spark, tmp_path / "b", [minute, minute2, rows(400)]).withWatermark("ts", "10 seconds")
    same = collect(stream_same_sequence(df, ["stream_id", "sequence_nr"], 2), tmp_path, "same")
    batch = SameSequence(2).frame(spark.createDataFrame(minute + minute2, SCHEMA), ["stream_id"]).collect()
    assert sorted((r["sequence_nr"], r["n"], r["overflow"]) for r in same) == sorted((r["seq"], r["n"], r["overflow"]) for r in batch) == [(7, 2, False), (9, 3, True)]


def test_takes_equal_folds():
    r = random.Random(3)
    for _ in range(300):
        numbers = sorted(r.sample(range(24), r.randrange(1, 20)))
        for window in (Discrete(3, 1), Discrete(2, 2), Sliding(3, 1), Sliding(2, 1, 4), Sliding(3, 1, 3), Sliding(3, 2, 5)):
            found, left, held = [], [], []
            for k in range(0, len(numbers), 4):  # arrivals in batches; what isn't needed any more is gone
                out, held = window.take(sorted({*held, *numbers[k : k + 4]}))
                found += out
            want = [(w[0], w[-1]) for w in window.fold(numbers)]
            if isinstance(window, Discrete):
                assert len(found) == len(set(found)) and set(want) <= {(a, z) for a, z in found} | set(want)
            else:
                assert sorted(found) == want


def test_late_numbers_give_new_time():
    held = refreshed({}, np.array([5, 3]), np.array([100, 200]), 10)
    assert held == {3: 210, 5: 210}
    held = refreshed(held, np.array([4, 5]), np.array([400, 1]), 10)
    assert held == {3: 210, 4: 410, 5: 410} and list(held) == [3, 4, 5]
    assert refreshed({}, np.array([], np.int64), np.array([], np.int64), 10) == {}


def test_own_batcher(spark, tmp_path):
    class EveryOther:
        """Each number with the one after the next."""

        def take(self, history):
            return [(a, b) for a, b in zip(history[:-2], history[2:], strict=True)], history[-2:]

    df = stream(spark, tmp_path, [rows(0, 1, 2), rows(3, 4)]).withWatermark("ts", "1 hour")
    got = collect(stream_windows(df, ["stream_id"], EveryOther(), ttl_ms=3_600_000), tmp_path, "own")
    assert sorted((r["first_seq"], r["last_seq"]) for r in got) == [(0, 2), (1, 3), (2, 4)]


def test_latest(spark, tmp_path):
    df = stream(spark, tmp_path, [rows(1, 5), rows(3) + rows(2, stream_id="t"), rows(6)])
    path = str(tmp_path / "latest")
    q = df.writeStream.foreachBatch(upsert_latest(path, ["stream_id"], ["sequence_nr"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["stream_id"], r["sequence_nr"]) for r in read_latest(spark, path, 2).collect()) == [("s", 6), ("t", 2)]
    upsert_latest(path, ["stream_id"], ["sequence_nr"])(spark.createDataFrame(rows(6), SCHEMA), 2)  # runs again
    fresh = read_latest(spark, path).withColumn("ms", F.unix_millis("ts"))
    assert fresh.count() == 2 and read_latest(spark, path, ts="sequence_nr", expire_ms=3, now_ms=8).count() == 1


def test_latest_carries_maps(spark, tmp_path):
    schema = "stream_id string, sequence_nr long, metadata map<string,string>, features array<struct<m:map<string,string>>>"
    apply = upsert_latest(str(tmp_path / "l"), ["stream_id"], ["sequence_nr"])
    for b in range(4):
        apply(spark.createDataFrame([("s", b, {"k": str(b)}, [({"a": "b"},)]), ("t", -b, None, None)], schema), b)
    got = {r["stream_id"]: (r["sequence_nr"], r["metadata"]) for r in read_latest(spark, str(tmp_path / "l")).collect()}
    assert got == {"s": (3, {"k": "3"}), "t": (0, None)}
    assert sorted(p.name for p in (tmp_path / "l").iterdir()) == ["v2", "v3"]


def test_index_in_a_stream(spark, tmp_path):
    schema = "delivery_id long, arrived_at timestamp, request_id long, stream_id string, sequence_nr long, batch_nr long"
    data = [[(i * 10 + k, T0 + dt.timedelta(seconds=k), -1, "s", (i + k) % 5, i) for k in range(6)] for i in range(3)]
    found = []
    sink = lambda d, _: found.extend(r[0] for r in d.collect())
    q = stream(spark, tmp_path, data, schema).writeStream.foreachBatch(ingest_batches(MessageIndex(spark, 4, 2), sink)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    want = duplicate_deliveries(spark.createDataFrame([r for b in data for r in b], schema)).collect()
    assert sorted(found) == sorted(r[0] for r in want)
