import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from frameflow.operators import keyed
from frameflow.operators.keyed import heavy_keys, key_profile, selected_heavy_keys
from frameflow.operators.messages import MessageIndex, duplicate_deliveries, kept_messages
from frameflow.operators.ordered import neighbour_pairs
from frameflow.operators.skew import lookup
from frameflow.plans.messages import p5_found
from frameflow.streaming.history import ingest_batches

SCHEMA = "delivery_id long, batch_nr long, arrived_at timestamp, request_id long, stream_id string, sequence_nr long, h1 string, prefix string"
T0 = dt.datetime(2024, 1, 1)


def expected(rows):
    """delivery_ids that are not the kept copy, by a plain dictionary."""
    best, dups = {}, []
    for r in sorted(rows, key=lambda r: (r[2] is None, r[2] or T0, r[0] is None, r[0] or 0)):
        if r[4] is None or r[5] is None:
            continue
        key = (r[4].strip(" ").lower(), r[5], -1 if r[3] is None else r[3])
        if key in best:
            dups.append(r[0])
        best.setdefault(key, r[0])
    return sorted(dups)


def random_rows(seed, n, hot=False):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        stream = None if r.random() < 0.03 else "cam_1" if hot and r.random() < 0.5 else r.choice(["cam_1", " Cam_1", "CAM_2 ", "cam_3"])
        seq = None if r.random() < 0.03 else 1 if hot and r.random() < 0.7 else r.randrange(40)
        at = None if r.random() < 0.1 else T0 + dt.timedelta(seconds=r.randrange(30))
        rows.append((i, None if r.random() < 0.05 else i // 20, at, r.choice([None, -1, 5]), stream, seq, "x", "y"))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, hot", [(1, False), (2, False), (3, True)])
def test_duplicates_match_brute_force(spark, seed, hot):
    rows = random_rows(seed, 400, hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(x[0] for x in duplicate_deliveries(df, rounds=5).collect())
    assert got == expected(rows)
    kept = kept_messages(df, rounds=2)
    assert kept.columns == df.columns  # clashing names of the index don't matter
    assert kept.count() + len(got) == sum(x[4] is not None and x[5] is not None for x in rows)


def test_late_better_copy_replaces_the_indexed_one(spark):
    rows = [(1, 1, None, None, "a", 1, "", ""), (2, 2, T0, -1, "A ", 1, "", ""), (3, 3, T0, -1, "a", 1, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(x[0] for x in duplicate_deliveries(df, rounds=3).collect()) == [1, 3]


def test_empty_and_null_tables(spark):
    assert duplicate_deliveries(spark.createDataFrame([], SCHEMA)).count() == 0
    nulls = spark.createDataFrame([(None,) * 8] * 3, SCHEMA)
    assert duplicate_deliveries(nulls).count() == 0
    same = spark.createDataFrame([(None, None, None, None, "a", 1, None, None)] * 3, SCHEMA)
    assert [x[0] for x in duplicate_deliveries(same).collect()] == [None, None]
    assert kept_messages(same).count() == 0
    twice = spark.createDataFrame([(1, 1, T0, -1, "a", 1, "", ""), (1, 1, T0, -1, "a", 1, "", ""), (2, 1, T0, -1, "a", 2, "", "")], SCHEMA)
    assert [x[0] for x in duplicate_deliveries(twice).collect()] == [1]
    assert sorted(x["delivery_id"] for x in kept_messages(twice).collect()) == [1, 2]


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_quantiles_are_exact(spark, broadcast_rows):
    r = random.Random(4)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), r.choice([None, r.randrange(-(2**62), 2**62), r.randrange(5)]), 1) for _ in range(3000)]
    rows += [("one", 7, 1), ("none", None, 1), ("wide", -(2**63), 1), ("wide", 2**63 - 1, 1)]
    df = spark.createDataFrame(rows, "k string, v long, q long").repartition(7)
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    out = {x["key"]: x for x in key_profile(df, F.col("k"), F.col("v"), probs, {"s": F.col("q")}, bits=4, broadcast_rows=broadcast_rows).collect()}
    for k in {x[0] for x in rows}:
        all_ = [x[1] for x in rows if x[0] == k]
        v = sorted(x for x in all_ if x is not None)
        got = out[k]
        assert (got["n_rows"], got["n_values"], got["s"]) == (len(all_), len(v), len(all_))
        want = [v[max(1, -int(-p * len(v) // 1)) - 1] for p in probs] if v else [None] * 5
        assert [got[f"q{i}"] for i in range(5)] == want
        assert (got["first"], got["last"]) == ((v[0], v[-1]) if v else (None, None))
    assert {x["key"] for x in heavy_keys(spark.createDataFrame(list(out.values())), 30).collect()} == {"hot"}


@pytest.mark.parametrize("seed, n, places", [(1, 3000, 2**31 - 1), (2, 3000, 7), (3, 33, 2**31 - 1), (4, 1, 2**31 - 1)])
def test_heavy_keys_by_selection(spark, seed, n, places):
    r = random.Random(seed)
    keys = [r.choice(["hot", "hot", None, f"k{int(r.paretovariate(0.5)) % 300}"]) for _ in range(n - 1)] + ["one"]
    exact = ["edge"] * 3 + [f"single{i}" for i in range(97)]  # exactly 3 %
    for rows in (keys, exact):
        got = {x["key"]: x["n_rows"] for x in selected_heavy_keys(spark.createDataFrame([(k,) for k in rows], "key string").repartition(3), F.col("key"), 3, places=places).collect()}
        assert got == {k: rows.count(k) for k in set(rows) - {None} if rows.count(k) * 100 >= 3 * len(rows)}


def test_heavy_keys_of_empty_and_null_tables(spark):
    for rows in ([], [(None,)] * 3):
        assert selected_heavy_keys(spark.createDataFrame(rows, "k string"), F.col("k"), 3).count() == 0


def test_p5_found_selects(spark, monkeypatch):
    rounds, refine = [], keyed._refine
    monkeypatch.setattr(keyed, "_refine", lambda *a: rounds.append(1) or refine(*a))
    frames = spark.read.parquet("/root/testdata/sf0.001/frames.parquet")
    counts = {x[0]: x[1] for x in frames.groupBy(F.lower(F.trim("stream_id"))).count().collect()}
    total = sum(counts.values())
    got = sorted(x["stream_id"] for x in p5_found(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(k for k, n in counts.items() if k is not None and n * 100 >= 3 * total)
    assert rounds


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, v long")
    p = key_profile(df, F.col("k"), F.col("v"))
    assert p.count() == 0 and heavy_keys(p, 3).count() == 0


def test_neighbour_pairs(spark):
    r = random.Random(5)
    rows = [(g, v) for g in ("a", "b", "hot") for v in r.sample(range(10_000), 300 if g == "hot" else 9)] + [(None, 1), ("a", None), ("single", 4)]
    got = sorted(tuple(x) for x in neighbour_pairs(spark.createDataFrame(rows, "g string, v long"), "g", "v", 7).collect())
    want = []
    for g in ("a", "b", "hot"):
        v = sorted(x[1] for x in rows if x[0] == g and x[1] is not None)
        want += [(g, a, b) for a, b in zip(v, v[1:], strict=False)]
    assert got == sorted(want)
    assert neighbour_pairs(spark.createDataFrame([], "g string, v long"), "g", "v", 3).count() == 0


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    rows = random_rows(7, 200, True)
    seen = {}
    sink = lambda d, b: seen.setdefault(b, []).append(sorted(x[0] for x in d.collect()))
    parts = [rows[k::4] for k in range(4)]
    for b, part in enumerate(parts):
        index = MessageIndex.open(spark, f"file://{tmp_path}/index", prefixes=5)  # a restart before every batch
        df = spark.createDataFrame(part, SCHEMA)
        ingest_batches(index, sink)(df, b)
        ingest_batches(MessageIndex.open(spark, f"file://{tmp_path}/index", prefixes=9), sink)(df, b)
        index.close()
    assert all(len(x) == 2 and x[0] == x[1] for x in seen.values()) and len(seen) == 4
    assert sorted(i for x in seen.values() for i in x[0]) == expected(rows)
    index = MessageIndex.open(spark, f"file://{tmp_path}/index", prefixes=5)
    assert [level for _, level in index.runs] == [2]  # four runs, merged twice
    # The indexed deliveries themselves under a new number are no duplicates of themselves.
    ingest_batches(index, sink)(spark.createDataFrame([r for r in rows if r[0] not in expected(rows)], SCHEMA), 9)
    assert seen[9] == [[]]
    index.forget_batches(9)
    assert set(MessageIndex.open(spark, f"file://{tmp_path}/index", prefixes=5).batches) == {9}


def test_a_kept_id_on_several_rows(spark):
    rows = [(1, 1, T0, -1, "a", 1, "", ""), (1, 1, T0, -1, "a", 1, "", ""), (2, 9, T0, -1, "A", 1, "", ""), (3, 9, T0, -1, "b", 1, "", "")]
    kept = kept_messages(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r["delivery_id"], r["stream_id"]) for r in kept.collect()) == [(1, "a"), (3, "b")]


def test_lookup_spreads_hot_keys(spark):
    rows = [("h", i) for i in range(500)] + [(f"k{i % 50}", i) for i in range(200)] + [(None, 1)]
    left = spark.createDataFrame(rows, "k string, v long")
    right = spark.createDataFrame([("h", 1.0), ("k3", 2.0), ("none", 3.0)], "k string, w double")
    for how in ("inner", "left"):
        got = sorted(map(tuple, lookup(left, right, ["k"], 701, how, share=10, least=100).collect()), key=str)
        assert got == sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)
