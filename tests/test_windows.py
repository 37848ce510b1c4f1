import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameflow.operators.media import chunk_frames, frame_pairs, frames_to_chunks, group_frames, latest, number_frames, stream_rates, within_ttl
from frameflow.operators.ranking import numbered, positions, ranked
from frameflow.operators.windows import Discrete, SameSequence, Sliding
from frameflow.streaming.history import take_windows


def frame(spark, numbers, stream="s"):
    return spark.createDataFrame([(stream, n) for n in numbers], "stream string, n long")


def out(df):
    return sorted((r["first_seq"], r["last_seq"]) for r in df.collect())


GOLDEN = [
    (Discrete(3, 10), [20, 30, 40, 50, 60, 70, 90, 100, 110], [(20, 40), (50, 70), (90, 110)]),
    (Discrete(2, 10), [0, 20, 30, 40, 50, 60, 70, 80, 90, 100, 110], [(20, 30), (40, 50), (60, 70), (80, 90), (100, 110)]),
    (Sliding(3, 10), [20, 30, 40, 50, 70, 80, 90], [(20, 40), (30, 50), (70, 90)]),
    (Sliding(2, 10), [20, 40, 50, 60, 30], [(20, 30), (30, 40), (40, 50), (50, 60)]),
    (Discrete(3, 1), [], []),
    (Discrete(1, 1), [5, 5, 9], [(5, 5), (9, 9)]),
]


@pytest.mark.parametrize("window, numbers, want", GOLDEN)
def test_golden_windows(spark, window, numbers, want):
    assert out(window.frame(frame(spark, numbers), ["stream"], "n")) == want
    assert [(w[0], w[-1]) for w in window.fold(numbers)] == want


numbers = st.lists(st.integers(0, 60), max_size=40)


@settings(max_examples=60, deadline=None)
@given(numbers, st.integers(1, 4), st.integers(1, 3))
def test_stream_step_equals_fold(ns, size, step):
    """In one go, the stream's step finds the windows of the fold."""
    for window in (Discrete(size, step), Sliding(size, step)):
        assert take_windows(sorted(set(ns)), window)[0] == [(w[0], w[-1]) for w in window.fold(ns)]


@settings(max_examples=100, deadline=None)
@given(numbers, st.integers(1, 4), st.integers(1, 3))
def test_sliding_count_follows_runs(ns, size, step):
    runs, last = [], None
    for n in sorted(set(ns)):
        if last is not None and n - last == step:
            runs[-1] += 1
        else:
            runs.append(1)
        last = n
    assert len(Sliding(size, step).fold(ns)) == sum(max(0, r - size + 1) for r in runs)
    assert len(Discrete(size, step).fold(ns)) == sum(r // size for r in runs)


def test_frames_equal_folds_on_many_streams(spark):
    import random

    r = random.Random(6)
    rows = [(s, r.randrange(-50, 150)) for s in range(12) for _ in range(r.randrange(1, 120))] + [(None, 3), (None, 4), (1, None)]
    df = spark.createDataFrame(rows, "stream long, n long").repartition(6)
    streams = {s: [n for t, n in rows if t == s and n is not None] for s in {x[0] for x in rows}}
    for window in (Discrete(3, 1), Discrete(2, 2), Sliding(3, 1), Sliding(2, 3), Sliding(3, 1, 4), Sliding(2, 1, 2)):
        got = sorted((str(x["stream"]), x["first_seq"], x["last_seq"]) for x in window.frame(df, ["stream"], "n").collect())
        want = sorted((str(s), w[0], w[-1]) for s, ns in streams.items() for w in window.fold(ns))
        assert got == want, window


def test_buckets_do_not_matter(spark):
    ns = [n for n in range(-100, 300) if n % 17]
    df = frame(spark, ns)
    want = sorted((r["seq"], r["pos"]) for r in positions(df, ["stream"], "n", 1).collect())
    for bucket in (1, 7, 64):
        assert sorted((r["seq"], r["pos"]) for r in positions(df, ["stream"], "n", 1, bucket).collect()) == want
        assert [r["rn"] for r in ranked(df, ["stream"], "n", bucket=bucket).orderBy("n").collect()] == list(range(len(ns)))
    assert [r["rn"] for r in numbered(df, ["n"], 5).orderBy("n").collect()] == list(range(len(ns)))


def test_same_sequence(spark):
    df = spark.createDataFrame([("s", 1), ("s", 2), ("s", 1), ("s", 3), ("t", 3), ("t", 3), ("t", 3), ("t", None)], "stream string, n long")
    got = sorted(map(tuple, SameSequence(2).frame(df, ["stream"], "n").collect()))
    assert got == [("s", 1, 2, False), ("t", 3, 3, True)]


def test_media(spark):
    df = frame(spark, [3, 1, 8]).withColumn("image", F.lit(b"x")).withColumn("ts", F.col("n") * 40)
    assert [tuple(r) for r in number_frames(df.select("stream", "n"), ["stream"], "n", 30).orderBy("n").collect()][-1] == ("s", 8, 2, 66)
    p = frame_pairs(df, ["stream"], "n", ["image"]).orderBy("first_seq").collect()
    assert [(r["first_seq"], r["second_seq"], r["duration"]) for r in p] == [(1, 3, 2), (3, 8, 5)]
    assert frame_pairs(df, ["stream"], "n", ["image"], step=2).count() == 1
    assert group_frames(df, ["stream"], "n", 2, ["image"]).select("first_seq", "n_frames").collect() == [(1, 2)]
    c = frames_to_chunks(df, ["stream"], "n", 2).orderBy("chunk_nr")
    assert [(r["sequence_nr"], r["n_frames"], len(r["video"])) for r in c.collect()] == [(1, 2, 2), (8, 1, 1)]
    back = chunk_frames(c, 13, video="video").orderBy("sequence_nr").collect()
    assert [r["sequence_nr"] for r in back] == [1, 8, 14]
    one = spark.createDataFrame([("c", 100, 3), ("d", 5, 0), ("e", 5, None)], "id string, sequence_nr long, n_frames long")
    assert [r["sequence_nr"] for r in chunk_frames(one, 13).orderBy("nth").collect()] == [100, 113, 126]
    assert stream_rates(df, ["stream"], "n", "ts").collect() == [("s", 12.0)]
    assert latest(df, ["stream"], ["n"], ["ts"]).collect() == [("s", 8, 320)]
    assert within_ttl(df, ["stream"], "ts", F.lit(200)).count() == 2
