import random

import numpy as np
import pytest

from frameflow.llm.spans import share_of_records, shared_spans
from frameflow.sources.tables import table

SCHEMA = "doc_id long, text string, h string, lo string, anchor string"


def brute(texts, m):
    seen = {}
    for i, t in texts.items():
        for p in range(len(t) - m + 1):
            g = t[p : p + m]
            seen[g] = i if seen.get(g, i) == i else -1
    out = []
    for i, t in texts.items():
        hit = np.zeros(len(t) + 2, int)
        for p in range(len(t) - m + 1):
            if seen[t[p : p + m]] == -1:
                hit[p + 1] += 1
                hit[p + m + 1] -= 1
        c = np.diff((np.cumsum(hit) > 0).astype(int))
        out += [(i, int(a), int(b)) for a, b in zip(np.flatnonzero(c == 1), np.flatnonzero(c == -1), strict=True)]
    return sorted(out)


def found(spark, texts, m, **options):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts.items()], SCHEMA).repartition(4)
    return sorted(map(tuple, shared_spans(df, m, **options).collect()))


def corpus(seed, n=60, alphabet="ab ", length=200):
    r = random.Random(seed)
    pool = ["".join(r.choice(alphabet) for _ in range(r.randrange(10, 120))) for _ in range(12)]
    texts = {}
    for i in range(n):
        parts = [r.choice(pool) if r.random() < 0.5 else "".join(r.choice(alphabet) for _ in range(r.randrange(length // 4))) for _ in range(r.randrange(1, 6))]
        texts[i] = "".join(parts)
    return texts


@pytest.mark.parametrize("seed, alphabet", [(1, "ab "), (2, "abcdefghijklmnop é暗🙂"), (3, "aaab")])
def test_spans_match_brute_force(spark, seed, alphabet):
    texts = corpus(seed, alphabet=alphabet)
    want = brute(texts, 40)
    assert want
    assert found(spark, texts, 40, gram=12) == want
    assert found(spark, texts, 40, gram=12, hot=2) == want  # the way for busy anchors


def test_tables(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect() if r["text"]}
    assert sorted(map(tuple, shared_spans(docs).collect())) == brute(texts, 100)


def test_edges(spark):
    base = "".join(random.Random(9).choice("abcdefgh ") for _ in range(400))
    texts = {
        1: base[:100], 2: base[:100],  # exactly long enough, whole records
        3: base[150:249], 4: base[150:249],  # one too short
        5: "x" * 500,  # repeats only itself
        6: base[200:330] + "#" + base[200:330], 7: "%" + base[200:330],  # twice in one record
        8: "", 9: None, 10: base[:100] + "tail",
    }
    known = {i: t for i, t in texts.items() if t}
    assert found(spark, texts, 100) == brute(known, 100)
    same = {i: "y" * 300 for i in range(30)}
    assert found(spark, same, 100) == [(i, 0, 300) for i in range(30)]
    assert found(spark, {i: base for i in range(50)} | {99: base + base}, 100, hot=5) == [(i, 0, 400) for i in range(50)] + [(99, 0, 800)]


def test_very_long_and_empty(spark):
    r = random.Random(4)
    long_ = "".join(r.choice("abcdefghijklmnopqrst ") for _ in range(3_000_000))
    texts = {1: long_, 2: "prefix " + long_[1_000_000:1_000_500] + " suffix"}
    got = found(spark, texts, 100)
    assert [g[0] for g in got] == [1, 2] and all(500 <= g[2] - g[1] <= 502 for g in got)
    none = spark.createDataFrame([], SCHEMA)
    assert shared_spans(none).count() == 0
    nulls = spark.createDataFrame([(None, "a" * 300, *"xyz"), (None, "a" * 300, *"xyz"), (1, None, *"xyz")], SCHEMA)
    assert shared_spans(nulls).count() == 0


def test_shares(spark):
    docs = spark.createDataFrame([(1, "a" * 150, *"xyz"), (2, "a" * 120, *"xyz"), (3, None, *"xyz")], SCHEMA)
    assert sorted(map(tuple, share_of_records(docs, shared_spans(docs)).collect())) == [(1, 150, 1, 150), (2, 120, 1, 120), (3, 0, 0, 0)]


def test_repeated_rows_count_once(spark):
    r = random.Random(5)
    text = "".join(r.choice("abcdefgh ") for _ in range(900))
    rows = [(1, text), (1, text), (2, "x" + text[100:800]), (3, text[:50])]
    got = sorted(tuple(x) for x in shared_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 100, 800), (2, 1, 701)]
    alone = spark.createDataFrame(rows[:2], "doc_id long, text string")
    assert shared_spans(alone).count() == 0
