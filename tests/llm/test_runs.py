import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest

from frameflow.llm.runs import alike, collapsed_runs
from frameflow.llm import runs as R

SCHEMA = "delivery_id long, arrived_at timestamp, request_id long, stream_id string, sequence_nr long, ts_ms long, image binary, edge string, h1 string"
T0 = dt.datetime(2024, 1, 1)


def brute(rows):
    best = {}
    for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or T0, r[0])):
        if r[3] is not None and r[4] is not None:
            best.setdefault((r[3].strip(" ").lower(), -1 if r[2] is None else r[2], r[4]), r)
    out, prev = [], None
    for key in sorted(best):
        r = best[key]
        a = r[6]
        same = prev is not None and prev[0][:2] == key[:2] and a and prev[1] and len(a) == len(prev[1])
        same = same and sum(abs(x - y) for x, y in zip(a, prev[1], strict=True)) <= 2 * len(a)
        if same:
            out[-1][3:] = [key[2], out[-1][4] + 1, out[-1][5] + [r[5]]]
        else:
            out.append([key[0], key[1], key[2], key[2], 1, [r[5]]])
        prev = (key, a)
    ts = lambda v: max(v) - min(v) if (v := [x for x in v if x is not None]) else None
    return sorted((s, q, a, b, n, -1 if ts(t) is None else ts(t)) for s, q, a, b, n, t in out)


def rows_for(seed, n=500, streams=("cam", " CAM", "b_1", None)):
    r = random.Random(seed)
    scene = {}
    rows = []
    for i in range(n):
        s = r.choice(streams)
        image = scene.get(s)
        if image is None or r.random() < 0.2:
            image = bytes(r.randrange(256) for _ in range(r.choice([4, 4, 9, 0, 200])))
        elif image and r.random() < 0.5:
            image = bytes(min(255, x + r.randrange(4)) for x in image)
        scene[s] = image
        at = None if r.random() < 0.1 else T0 + dt.timedelta(seconds=r.randrange(50))
        rows.append((i, at, r.choice([None, -1, -1, 3]), s, None if r.random() < 0.03 else r.randrange(120), None if r.random() < 0.3 else i * 40, None if r.random() < 0.05 else image, "e", "h"))
    return rows


def result(df):
    return sorted((r["stream_id"], r["request_id"], r["first_seq"], r["last_seq"], r["n_frames"], -1 if r["duration_ms"] is None else r["duration_ms"]) for r in df.collect())


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 8), (3, 40)])
def test_runs_match_brute_force(spark, seed, parts):
    rows = rows_for(seed)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert result(collapsed_runs(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_long_run_over_all_partitions(spark):
    image = bytes(range(64))
    rows = [(i, T0, -1, "hot", i * 3, i * 40, image, "", "") for i in range(3000)] + [(9000 + i, None, None, "HOT", 0, 1, b"", "", "") for i in range(2000)]
    frames = spark.createDataFrame(rows, SCHEMA)
    for partitions in (16, 200):
        assert result(collapsed_runs(frames, partitions=partitions)) == [("hot", -1, 0, 8997, 3000, 2999 * 40)]


def test_local_copies_are_dropped_before_the_exchange(spark):
    t = pa.table({"stream_id": ["a"] * 4, "request_id": [-1] * 4, "sequence_nr": [1, 1, 2, 1], "at": [3, 1, 1, 1], "did": [1, 2, 3, 4], "h1": [5, 5, 6, 5], "h2": [5, 5, 6, 5]})
    out = pa.Table.from_batches(list(R._best_copies(10)(iter(t.to_batches()))))
    assert out.column("did").to_pylist() == [2, 3] and "h1" not in out.column_names


def test_empty(spark):
    assert collapsed_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collapsed_runs(spark.createDataFrame([(None,) * 9] * 2, SCHEMA)).count() == 0


def test_alike_bounds():
    a = bytes([10] * 10)
    images = pa.array([a, bytes([12] * 10), bytes([15] * 10), None, b"", b"", bytes([15] * 9)], pa.binary())
    assert alike(images, 2).tolist() == [False, True, False, False, False, False, False]
    long_ = np.zeros(3_000_000, np.uint8)
    assert alike(pa.array([long_.tobytes(), (long_ + 2).tobytes(), (long_ + 5).tobytes()], pa.binary()), 2).tolist() == [False, True, False]
