"""Long spans of text that occur verbatim in other records, and how much of each record they cover.

A character is shared if it lies in a substring of at least ``min_chars`` characters that also occurs in the text of
another record.

Method. Of every window of ``min_chars`` characters the k-gram with the smallest hash is chosen; these anchors, chosen
by content alone, are the tokens of a sparse de Bruijn graph: a node is an anchor with its gram, an edge joins an
anchor to the next one of its text and carries the text between them. Nodes that occur in two records or more are
repeated. A repeated node is plain if all its occurrences have the same text from the anchor before to the anchor
after (or to the end of the record), and chains of plain nodes compact to one path: a Spark join gives the records
their repeated nodes, and each chain's source coordinates are a shared span as a whole. Around the other repeated
nodes, where paths branch, the text itself decides: the occurrences of one anchor meet with the characters around them
and every window of ``min_chars`` is compared. Every window contains an anchor, so the result is exact. (Texts are
compared by 64-bit hashes of the same anchor's windows.)

An anchor with more than ``hot`` branching occurrences is decided by a count of its windows with partial aggregation
instead, so that no task gathers it.

Defined results: a null text and a null doc_id have no spans; copies within one record are not shared, nor are rows that
repeat a record with its doc_id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameflow.llm.tokens import SEPARATOR, code_points, mixed, text_slices
from frameflow.operators.skew import lookup
from frameflow.session import discard, materialize, release

GRAM = 24
INDEX_BITS = 34
ONE = np.uint64(1)


class Text:
    """Code points of some texts with the hashes of all their ranges."""

    def __init__(self, texts: pa.Array):
        self.cps, self.start, _ = code_points(texts)
        n = len(self.cps)
        base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
        self.back = np.multiply.accumulate(np.full(n + 1, inverse, np.uint64))
        power = np.multiply.accumulate(np.full(n, base, np.uint64))
        power *= mixed()[self.cps]
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(power, out=self.total[1:])

    def hash(self, lo: np.ndarray | slice, hi: np.ndarray | slice) -> np.ndarray:
        """Equal for equal ranges, wherever they are."""
        x = (self.total[hi] - self.total[lo]) * self.back[lo]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x7FB5D329728EA185)
        x ^= x >> np.uint64(29)
        return x

    def anchors(self, min_chars: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors of all texts and the hashes of their grams."""
        n = len(self.cps)
        windows = n - min_chars + 1
        if windows <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        grams = n - gram + 1
        h = self.hash(slice(0, grams), slice(gram, n + 1))
        key = ((h >> np.uint64(INDEX_BITS)) << np.uint64(INDEX_BITS)) | np.arange(grams, dtype=np.uint64)
        width, have = min_chars - gram + 1, 1
        while 2 * have <= width:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if have < width:
            key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
        breaks = np.r_[0, np.cumsum(self.cps == SEPARATOR)]
        inside = breaks[min_chars:] == breaks[: n - min_chars + 1]
        chosen = np.zeros(grams, bool)
        chosen[(key[:windows][inside] & np.uint64(2**INDEX_BITS - 1)).astype(np.int64)] = True
        at = np.flatnonzero(chosen)
        return at, h[at]


def _anchor_rows(s: pa.RecordBatch, min_chars: int, gram: int) -> tuple[Text, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: its place, gram hash, text number, and the start and end of its neighbourhood with its hash."""
    text = Text(s.column("text"))
    at, h = text.anchors(min_chars, gram)
    doc = np.searchsorted(text.start, at, "right") - 1
    first = np.r_[True, doc[1:] != doc[:-1]] if len(at) else np.empty(0, bool)
    last = np.r_[first[1:], True] if len(at) else first
    lo = np.where(first, text.start[doc], np.r_[0, at[:-1]]) if len(at) else at
    hi = np.where(last, text.start[doc + 1] - 1, np.r_[at[1:], 0] + gram) if len(at) else at
    near = text.hash(lo, hi) * np.uint64(0x9FB21C651E98DF25) + ((at - lo) * 4 + first * 2 + last).astype(np.uint64)
    return text, at, h, doc, lo, hi, near


ANCHOR = "h long, doc_id long, near long, place long"


def _anchors(min_chars: int, gram: int):
    """Every anchor with its neighbourhood's hash and its place (position, and how far the neighbourhood reaches)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in text_slices(b, "text"):
                text, at, h, doc, lo, hi, near = _anchor_rows(s, min_chars, gram)
                ids = s.column("doc_id").to_numpy(zero_copy_only=False)
                place = ((at - text.start[doc]) << 32) | ((at - lo) << 16) | (hi - at)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[doc]), pa.array(near.view(np.int64)), pa.array(place)], names=["h", "doc_id", "near", "place"])

    return run


PIECE = "doc_id long, h long, lo long, hi long, anchor long, context string"


def _pieces(min_chars: int, gram: int):
    """Of each record: the spans of its plain chains (h null), and the text around its branching anchors."""
    side = min_chars - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in text_slices(b, "text"):
                ids = s.column("doc_id").to_numpy(zero_copy_only=False)
                marks = s.column("marks")
                n = np.diff(marks.offsets.to_numpy())
                flat = marks.flatten()
                place, h, branch = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("place", "h", "branch"))
                row = np.repeat(np.arange(len(n)), n)
                o = np.lexsort((place, row))
                place, h, branch, row = place[o], h[o], branch[o], row[o]
                at = place >> 32
                lo, hi = at - ((place >> 16) & 0xFFFF), at + (place & 0xFFFF)
                p = np.flatnonzero(~branch)
                if len(p):
                    # consecutive plain anchors: the one after begins its neighbourhood at this one
                    new = np.r_[True, (row[p[1:]] != row[p[:-1]]) | (lo[p[1:]] != at[p[:-1]])]
                    begin = np.flatnonzero(new)
                    end = np.r_[begin[1:] - 1, len(p) - 1]
                    a, z, r = lo[p[begin]], hi[p[end]], row[p[begin]]
                    k = np.flatnonzero(z - a >= min_chars)
                    none = pa.nulls(len(k), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r[k]]), none, pa.array(a[k]), pa.array(z[k]), none, pa.nulls(len(k), pa.string())], names=[x.split()[0] for x in PIECE.split(", ")])
                p = np.flatnonzero(branch)
                if len(p):
                    cps, start, _ = code_points(s.column("text"))
                    size = np.diff(start) - 1
                    a, z = np.maximum(at[p] - side, 0), np.minimum(at[p] + min_chars, size[row[p]])
                    begin = start[row[p]] + a
                    length = z - a
                    upto = np.r_[0, np.cumsum(length)]
                    own = cps[np.arange(upto[-1]) - np.repeat(upto[:-1] - begin, length)]
                    body = own.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
                    width = 1 + (own > 0x7F).astype(np.int64) + (own > 0x7FF) + (own > 0xFFFF)
                    off = np.r_[0, np.cumsum(width)][upto].astype(np.int32)
                    context = pa.StringArray.from_buffers(len(p), pa.py_buffer(off), pa.py_buffer(body))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row[p]]), pa.array(h[p]), pa.array(a), pa.array(z), pa.array(at[p]), context], names=[x.split()[0] for x in PIECE.split(", ")]
                    )

    return run


def _windows(t: pa.Table, min_chars: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window around the anchor of a context: the context's number, its start there, and its hash."""
    text = Text(t.column("context").combine_chunks())
    lo, anchor = t.column("lo").to_numpy(), t.column("anchor").to_numpy()
    size = np.diff(text.start) - 1
    first = np.maximum(anchor - lo + gram - min_chars, 0)
    last = np.minimum(anchor - lo, size - min_chars)
    n = np.maximum(last - first + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
    place = text.start[row] + at
    return row, at, text.hash(place, place + min_chars)


def _shared(min_chars: int, gram: int, held_rows: int = 4096):
    """Spans of the windows that occur around the same anchor in another record; contexts come sorted by anchor."""

    def spans(t: pa.Table) -> pa.RecordBatch:
        doc, lo, h = (t.column(c).to_numpy() for c in ("doc_id", "lo", "h"))
        row, at, window = _windows(t, min_chars, gram)
        key = window ^ (h[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        o = np.lexsort((doc[row], key))
        k, d = key[o], doc[row][o]
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
        n = np.diff(np.r_[start, len(k)])
        many = np.repeat(d[start] != d[start + n - 1], n) if len(k) else np.empty(0, bool)
        hit = np.zeros(len(k), bool)
        hit[o] = many
        row, at = row[hit], at[hit]
        new = np.r_[True, (row[1:] != row[:-1]) | (at[1:] > at[:-1] + min_chars)] if len(row) else np.empty(0, bool)
        begin = np.flatnonzero(new)
        end = np.r_[begin[1:] - 1, len(row) - 1] if len(row) else begin
        r = row[begin]
        return pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(lo[r] + at[begin]), pa.array(lo[r] + at[end] + min_chars)], names=["doc_id", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
            if held.num_rows < held_rows:
                continue
            h = held.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))  # the last anchor may go on
            if cut:
                yield spans(held.slice(0, cut).combine_chunks())
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield spans(held)

    return run


def _window_rows(min_chars: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            row, at, window = _windows(t, min_chars, gram)
            doc, lo = t.column("doc_id").to_numpy(), t.column("lo").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(lo[row] + at), pa.array(window.view(np.int64))], names=["doc_id", "at", "window"])

    return run


def shared_spans(documents: DataFrame, min_chars: int = 100, gram: int = GRAM, hot: int = 20_000) -> DataFrame:
    """(doc_id, span_start, span_end): the maximal runs of shared characters of each record; span_end is exclusive."""
    if not gram <= min_chars < 2**15:
        raise ValueError("min_chars must be at least gram and below 32768")
    spark = documents.sparkSession
    docs = documents.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") >= min_chars)
    anchors = materialize(docs.mapInArrow(_anchors(min_chars, gram), ANCHOR), "anchors")
    counted = anchors.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.min("near").alias("n1"), F.max("near").alias("n2"), F.count(F.lit(1)).alias("n"))
    nodes = materialize(counted.filter("a < z").select("h", (F.col("n1") != F.col("n2")).alias("branch"), (F.col("n") > hot).alias("hot")), "nodes")
    release(spark)
    places = lookup(anchors.select("h", "doc_id", "place"), nodes.select("h", "branch"), ["h"], anchors.count())
    marked = places.groupBy("doc_id").agg(F.array_distinct(F.collect_list(F.struct("place", "h", "branch"))).alias("marks"))  # the anchors of one record
    marked = materialize(marked, "marks")
    discard(anchors)
    release(spark)
    pieces = materialize(docs.join(marked, "doc_id").select("doc_id", "text", "marks").mapInArrow(_pieces(min_chars, gram), PIECE), "pieces")
    release(spark)
    plain = pieces.filter("h is null").select("doc_id", "lo", "hi")
    context = pieces.filter("h is not null").select("doc_id", "h", "lo", "anchor", "context")
    busy = nodes.filter("branch and hot").select("h")
    cool = context.join(busy, "h", "left_anti").select("doc_id", "h", "lo", "anchor", "context")
    spans = cool.repartition("h").sortWithinPartitions("h").mapInArrow(_shared(min_chars, gram), "doc_id long, lo long, hi long")
    found = plain.unionByName(spans)
    if not busy.isEmpty():
        rows = context.join(busy, "h", "left_semi").select("doc_id", "lo", "anchor", "context").mapInArrow(_window_rows(min_chars, gram), "doc_id long, at long, window long")
        rows = materialize(rows, "windows")
        many = rows.groupBy("window").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z").select("window")
        hits = rows.join(many, "window", "left_semi").select("doc_id", F.col("at").alias("lo"), (F.col("at") + min_chars).alias("hi"))
        found = found.unionByName(hits)
    w = Window.partitionBy("doc_id").orderBy("lo", "hi")
    island = found.distinct().withColumn("reach", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    island = island.withColumn("n", F.sum(F.when(F.col("lo") <= F.col("reach"), 0).otherwise(1)).over(w))
    return island.groupBy("doc_id", "n").agg(F.min("lo").alias("span_start"), F.max("hi").alias("span_end")).drop("n")


def share_of_records(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_chars, n_spans, shared_chars) of every record."""
    sums = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    docs = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    return docs.join(sums, "doc_id", "left").select("doc_id", "n_chars", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_spans", "shared_chars")])

