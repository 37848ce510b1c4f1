import base64
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameflow.llm import tokens as T
from frameflow.llm.packing import best_fit, described_containers, packed_containers
from frameflow.sources.tables import table

public = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


VOCABULARY = T.Vocabulary(open(T.VOCABULARY, "rb").read())


def ids(texts, vocabulary=VOCABULARY):
    off, flat = T.Encoder(vocabulary)(pa.array(texts, pa.string()))
    return [flat[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]


ODD = ["a", " ", "  ", "\n", "\t", "'s", "'ll", "'", "don't", "''s", " 's", "é", "な", "暗", "1", "²", "\xa0", "　", "\x1c", "\x85", "-", "!!!", "<|endoftext|>", "The", "🙂", "​", "́", "aaaa", "\r\n", "٣", "'llama", "﻿", "hello", "'"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=25).map("".join))
def test_odd_texts(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))} if not hasattr(test_odd_texts, "e") else None
    if ranks is not None:
        test_odd_texts.e = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert ids([text]) == [test_odd_texts.e.encode_ordinary(text)]


def test_other_vocabulary():
    data = open(public.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    e = tiktoken.Encoding("multi", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Straße über größere Flüsse", "なん暗た換接確", "don't stop 12345", "naïve café\n\n  x"]
    assert ids(texts, T.Vocabulary(data)) == [e.encode_ordinary(t) for t in texts]


def test_pairs_agree_with_exact_merging():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 50256, 3000), r.integers(0, 50256, 3000)
    seen = [VOCABULARY.merge(VOCABULARY.bytes_[x] + VOCABULARY.bytes_[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert VOCABULARY.compatible(a, b).tolist() == seen


def test_long_texts_and_forgetting(exact, monkeypatch):
    r = random.Random(3)
    long_ = ["a" * 50_000, "-=" * 20_000, "暗" * 5_000, "".join(r.choice("abcdefg ") for _ in range(200_000))]
    assert ids(long_) == [exact.encode_ordinary(t) for t in long_]
    monkeypatch.setattr(T, "REMEMBERED", 50)
    e = T.Encoder(VOCABULARY)
    for k in range(5):
        text = " ".join(f"w{k}{i}" for i in range(40))
        off, flat = e(pa.array([text]))
        assert flat.tolist() == exact.encode_ordinary(text) and len(e.size) <= 90


def test_every_row_of_the_table(spark, exact):
    docs = table(spark, DATA, "documents")
    got = {r["doc_id"]: r["ids"] for r in T.encode_column(docs, F.col("doc_id"), F.col("text")).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["doc_id"]] == (exact.encode_ordinary(r["text"]) if r["text"] else [])
        assert exact.decode(got[r["doc_id"]]) == (r["text"] or "")


def test_null_and_empty_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a", None), (4, "<|endoftext|>", "x")], "doc_id long, text string, ids string")
    got = [(r["doc_id"], len(r["ids"])) for r in T.encode_column(df, F.col("doc_id"), F.col("text")).collect()]
    assert got == [(1, 0), (2, 0), (None, 1), (4, 7)]
    assert T.encode_column(df.filter("doc_id < 0"), F.col("doc_id"), F.col("text")).count() == 0


# ---- packing -------------------------------------------------------------------------------------------------------


def check_ranges(parts, sizes, capacity):
    by, fill = {}, {}
    for c, doc, a, b in parts:
        by.setdefault(doc, []).append((a, b))
        fill[c] = fill.get(c, 0) + b - a
    assert max(fill.values(), default=0) <= capacity
    assert set(by) == {d for d, n in sizes.items() if n}
    for doc, ranges in by.items():
        ranges.sort()
        assert ranges[0][0] == 0 and ranges[-1][1] == sizes[doc]
        assert all(x[1] == y[0] for x, y in zip(ranges, ranges[1:], strict=False))
        assert len(ranges) == 1 or sizes[doc] > capacity
    return fill


def test_containers_of_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    sizes = {r["doc_id"]: len(r["ids"]) for r in T.encode_column(docs, F.col("doc_id"), F.col("text")).collect()}
    parts = [tuple(r)[:4] for r in packed_containers(docs, 2048).collect()]
    fill = check_ranges(parts, sizes, 2048)
    assert len(fill) <= 1.01 * -(-sum(sizes.values()) // 2048) + 1
    several = [tuple(r)[:4] for r in packed_containers(docs, 512, bins=50).collect()]
    fill = check_ranges(several, sizes, 512)
    assert len({c >> 32 for c in fill}) > 3 and len(fill) <= 1.08 * -(-sum(sizes.values()) // 512)


def test_dirty_documents_are_packed(spark):
    rows = [(1, "a b c", None), (2, "a b c", "s"), (3, None, "s"), (4, "", "s"), (None, "x", "s"), (5, "word " * 100, "s")] + [(10 + i, "same text here", "hot") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {r["doc_id"]: len(r["ids"]) for r in T.encode_column(df, F.col("doc_id"), F.col("text")).collect() if r["doc_id"]}
    fill = check_ranges([tuple(r)[:4] for r in packed_containers(df, 16).collect()], sizes, 16)
    assert sum(fill.values()) == sum(sizes.values())
    assert packed_containers(df.filter("doc_id < 0"), 16).count() == 0


def test_best_fit_avoids_conflicts_and_wastes_nothing():
    size = np.array([6, 6, 4, 4])
    bins = best_fit(size, np.array([1, 2, 3, 4]), np.array([7, 8, 7, 9]), 10)
    assert bins[2] == bins[1] and bins[3] == bins[0]  # the copy goes beside the other text
    alone = best_fit(np.full(8, 5), np.full(8, 1), np.full(8, 1), 10)
    assert len(set(alone.tolist())) == 4  # conflicts never cost a container
    r = np.random.default_rng(0)
    size = np.sort(r.integers(1, 100, 600))[::-1]
    bins = best_fit(size, r.integers(0, 5, 600), r.integers(0, 80, 600), 100)
    fill = np.bincount(bins, size)
    free = np.arange(600)  # without conflicts it is plain best fit
    plain = len(set(best_fit(size, free, free, 100).tolist()))
    assert fill.max() <= 100 and len(fill) <= 1.02 * plain + 1


def test_strict_packing_never_repeats():
    r = np.random.default_rng(2)
    size, source, copy = np.sort(r.integers(1, 60, 400))[::-1], r.integers(0, 9, 400), r.integers(0, 50, 400)
    bins = best_fit(size, source, copy, 100, strict=True)
    for b in set(bins.tolist()):
        i = np.flatnonzero(bins == b)
        assert size[i].sum() <= 100 and len(set(source[i].tolist())) == len(i) == len(set(copy[i].tolist()))


def test_containers_are_described(spark):
    df = spark.createDataFrame([(1, 0, 10, 5, 1), (1, 1, 0, 3, 1), (2, 0, 0, 16, 2)], "container long, doc_id long, token_start long, token_end long, source long")
    df = df.withColumns({"token_start": F.lit(0), "copy": F.col("doc_id")})
    got = sorted(tuple(x) for x in described_containers(df, 20).collect())
    assert got == [(1, 2, 8, 12, 1, 0), (2, 1, 16, 4, 0, 0)]
