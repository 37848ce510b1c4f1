"""Items of varying length combined into containers of fixed capacity with little unused space.

Items are posts measured in tokens. Only a post longer than the capacity is split, into full containers and a rest.

Method. Items are dealt by a hash of their id to shards of about ``bins`` containers, so that no source and no cluster
of copies gathers in one of them. In a shard, items go from the longest to the shortest into bins kept in order of
their residual space; each bin carries a bitmap of its sources and one of its clusters of equal texts. The search
starts at the tightest bin that fits and goes on to its successors until it meets one without a conflict. As long as
the shard has fewer bins than its tokens need at least, an item without such a bin opens one; after that the source,
and last the cluster, may repeat, so that conflicts never cost a container. With ``strict`` they never repeat, and an
item without such a bin opens one, whatever the space that costs.

Defined results: null and empty texts have no tokens and are left out; a null source is a source; rows that share a
doc_id are packed each on its own; equal lengths go in order of doc_id; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.llm.tokens import VOCABULARY, encoder, text_slices
from frameflow.session import materialize

PART = "container long, doc_id long, token_start long, token_end long, source long, copy long"


def measured(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, copy, tokens) of each post with tokens; copy is the same for equal texts."""
    data = documents.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(data.value)
        for b in batches:
            for s in text_slices(b, "text"):
                off, _ = encode(s.column("text"))
                size = np.diff(off)
                some = pa.array(np.flatnonzero(size))
                yield pa.RecordBatch.from_arrays([*[s.column(c).take(some) for c in ("doc_id", "source", "copy")], pa.array(size).take(some)], names=["doc_id", "source", "copy", "tokens"])

    rows = documents.filter("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("source").alias("source"), F.xxhash64(F.trim("text")).alias("copy"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, source long, copy long, tokens long")


def best_fit(size: np.ndarray, source: np.ndarray, copy: np.ndarray, capacity: int, strict: bool = False) -> np.ndarray:
    """The bin of each item; items come longest first and none exceeds the capacity."""
    least = -(-int(size.sum()) // capacity)
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(source.tolist()))}
    values, count = np.unique(copy, return_counts=True)
    copy_bit = {c: 1 << i for i, c in enumerate(values[count > 1].tolist())}  # a text without copies conflicts with nothing
    order: list[tuple[int, int]] = []  # (residual, bin) of the bins that have space
    sources: list[int] = []
    copies: list[int] = []
    out = np.empty(len(size), np.int64)
    for i, (n, s, c) in enumerate(zip(size.tolist(), source.tolist(), copy.tolist(), strict=True)):
        sb, cb = source_bit[s], copy_bit.get(c, 0)
        first = bisect_left(order, (n, -1))
        hit = -1
        lenient = first if first < len(order) else -1
        relaxed = -1
        for at in range(first, len(order)):
            b = order[at][1]
            if copies[b] & cb:
                continue
            if relaxed < 0:
                relaxed = at
            if not sources[b] & sb:
                hit = at
                break
        if hit < 0 and len(sources) >= least and not strict:
            hit = relaxed if relaxed >= 0 else lenient
        if hit < 0:
            b, left = len(sources), capacity - n
            sources.append(0)
            copies.append(0)
        else:
            left, b = order.pop(hit)
            left -= n
        sources[b] |= sb
        copies[b] |= cb
        if left:
            insort(order, (left, b))
        out[i] = b
    return out


def _pack(capacity: int, strict: bool):
    def run(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        doc, tokens, source, copy = (group.column(c).to_numpy() for c in ("doc_id", "tokens", "source", "copy"))
        o = np.lexsort((copy, doc))
        doc, tokens, source, copy = doc[o], tokens[o], source[o], copy[o]
        full, rest = np.divmod(tokens, capacity)
        over = np.repeat(np.arange(len(doc)), full)  # the full containers of posts that exceed the capacity
        nth = np.arange(len(over)) - np.repeat(np.cumsum(full) - full, full)
        item = np.flatnonzero(rest)
        item = item[np.lexsort((doc[item], -rest[item]))]
        bins = best_fit(rest[item], source[item], copy[item], capacity, strict) + len(over)
        start = full[item] * capacity
        of = np.r_[np.arange(len(over)), bins]
        lo = np.r_[nth * capacity, start]
        hi = np.r_[(nth + 1) * capacity, start + rest[item]]
        return pa.table({"container": pa.array(of + (int(shard) << 32)), "doc_id": np.r_[doc[over], doc[item]], "token_start": lo, "token_end": hi, "source": np.r_[source[over], source[item]], "copy": np.r_[copy[over], copy[item]]})

    return run


def packed_containers(documents: DataFrame, capacity: int = 2048, bins: int = 1024, vocabulary: str = VOCABULARY, strict: bool = False) -> DataFrame:
    """(container, doc_id, token_start, token_end, source, copy): the token ranges of each container, token_end being
    exclusive, with hashes of the item's source and text."""
    items = materialize(measured(documents, vocabulary), "sizes")
    total = items.agg(F.sum("tokens")).first()[0] or 0  # one number
    shards = max(1, -(-total // (capacity * bins)))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(_pack(capacity, strict), PART)


def described_containers(parts: DataFrame, capacity: int) -> DataFrame:
    """(container, n_parts, tokens, unused, same_source, same_text): of each container its parts, their tokens and the
    unused space, and how many parts share their source or their text with an earlier one in it."""
    tokens = F.sum(F.col("token_end") - F.col("token_start"))
    n = F.count(F.lit(1))
    return parts.groupBy("container").agg(
        n.alias("n_parts"), tokens.alias("tokens"), (F.lit(capacity) - tokens).alias("unused"), (n - F.count_distinct("source")).alias("same_source"), (n - F.count_distinct("copy")).alias("same_text")
    )
