"""Encoding of a corpus by a public byte-level BPE vocabulary, by speculation and verification.

Method. Texts are cut into pieces (words, numbers, marks, blanks) by array operations over code points. Every distinct
piece that is new to a worker gets tokens proposed by greedy longest match. A sequence of tokens is the BPE encoding
exactly if every adjacent pair is (no merge crosses the seam before both sides are complete), and that is tested for
all new pairs at once by walking the merge trees along their seams. Only pieces with a failing pair are merged exactly.

Defined results: a null or empty text has an empty list; strings that look like special tokens are ordinary text; every
row has a row; the path of the vocabulary is a parameter.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct pieces that a worker remembers; when there are more it starts anew.
REMEMBERED = 400_000
LETTER, NUMBER, OTHER, BLANK, END = range(5)
# The endings that split off after an apostrophe, and the code points of White_Space.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SEPARATOR = 0x110000
NEVER = 2**30


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.array([kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)] + [END], np.uint8)
    table[WHITE] = BLANK
    return table


@lru_cache(1)
def mixed() -> np.ndarray:
    """A random 64-bit value for each code point."""
    return np.random.default_rng(20240101).integers(1, 2**63, 0x110001, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code points of all texts with SEPARATOR after each, the place where each text starts, and the UTF-8 bytes
    (without separators). A null text is empty."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    raw = body[int(off[0]) : int(off[-1])].to_pybytes() if body is not None and n else b""
    off = off - off[0]
    cps = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.frombuffer(raw, np.uint8)
    before = np.r_[0, np.cumsum((lead & 0xC0) != 0x80)] if len(lead) else np.zeros(1, np.int64)
    starts = before[off]  # in code points
    size = np.diff(starts)
    out = np.full(len(cps) + n, SEPARATOR, np.uint32)
    out[np.arange(len(cps)) + np.repeat(np.arange(n), size)] = cps
    return out, starts + np.arange(n + 1), raw


def piece_starts(cps: np.ndarray) -> np.ndarray:
    """Where the pieces of the public pattern start; a separator is a piece of its own."""
    cls = classes()[cps]
    n = len(cps)
    if not n:
        return np.empty(0, np.int64)
    edge = np.r_[True, (cls[1:] != cls[:-1]) | (cls[1:] == END)]
    blank_before = np.r_[False, cls[:-1] == BLANK]
    space_before = np.r_[False, cps[:-1] == 0x20]
    start = edge & ~(space_before & (cls != END) & (cls != BLANK))
    word = edge & (cls != BLANK) & (cls != END) & blank_before
    start[np.flatnonzero(word) - 1] = True  # the last blank before a word stands alone or leads the word
    quote = np.flatnonzero((cps == 0x27) & edge & ~space_before)
    quote = quote[quote + 1 < n]
    quote = quote[cls[quote + 1] == LETTER]
    for e in ENDINGS:
        q = quote[quote + len(e) < n]
        hit = np.ones(len(q), bool)
        for k, ch in enumerate(e):
            hit &= cps[q + 1 + k] == ord(ch)
        q = q[hit]
        start[q + 1] = False
        start[q + 1 + len(e)] = True  # there is always a separator behind
    return np.flatnonzero(start)


class Vocabulary:
    """Tokens by id, the pair that each is merged from, and the seams of the merge trees."""

    def __init__(self, data: bytes):
        pairs = [line.split() for line in data.splitlines() if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.rank.values()) + 1
        self.parts = np.full((size, 2), -1, np.int64)
        self.bytes_ = [b""] * size
        for token, i in self.rank.items():
            self.bytes_[i] = token
        self.longest = max(map(len, self.rank))
        for token, i in self.rank.items():
            if len(token) > 1:
                two = self.merge(token, i)
                if len(two) == 2:
                    self.parts[i] = two
        whole = self.parts[:, 0] >= 0
        ids = np.arange(size)
        #: Pair tests hold where parts come before their wholes; any other vocabulary is merged exactly.
        self.ordered = bool((self.parts[whole] < ids[whole, None]).all() and whole.sum() + 256 >= len(self.rank))
        key = (self.parts[whole, 0] << 32) | self.parts[whole, 1]
        o = np.argsort(key)
        self.keys, self.merged = key[o], ids[whole][o]
        self.right, self.left = self._seam(1), self._seam(0)
        self.prefixes = {token[:k]: -1 for token in self.rank for k in range(1, len(token))} | self.rank

    def _seam(self, side: int) -> np.ndarray:
        """For each token the chain from itself to the outermost byte on one side; -1 behind the end."""
        now, chain = np.arange(len(self.parts)), []
        while (now >= 0).any():
            chain.append(now)
            now = np.where(now >= 0, self.parts[np.maximum(now, 0), side], -1)
        return np.array(chain).T.copy()

    def merge(self, piece: bytes, below: int = NEVER) -> list[int]:
        """Exact merging by rank, of ranks under ``below``; equal ranks from the left."""
        ids = [self.rank[piece[i : i + 1]] for i in range(len(piece))]
        n = len(ids)
        end = list(range(1, n + 1))  # where part i ends; parts are named by where they start
        prev = list(range(-1, n - 1))
        alive = [True] * n
        get = self.rank.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2], below)) < below]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i], ids[i] = stop, r
            if stop < n:
                prev[stop] = i
                if stop < n and (q := get(piece[i : end[stop]], below)) < below:
                    heapq.heappush(heap, (q, i, end[stop]))
            if prev[i] >= 0 and (q := get(piece[prev[i] : stop], below)) < below:
                heapq.heappush(heap, (q, prev[i], stop))
        return [ids[i] for i in range(n) if alive[i]]

    def greedy(self, piece: bytes) -> list[int]:
        """The longest token at each place; -1 counts as a failed proposal."""
        out, i, n, known = [], 0, len(piece), self.prefixes
        while i < n:
            best, stop, j = -1, i + 1, i + 1
            while j <= n:
                t = known.get(piece[i:j])
                if t is None:
                    break
                if t >= 0:
                    best, stop = t, j
                j += 1
            out.append(best)
            i = stop
        return out

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or NEVER."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a, b side by side stay as they are.

        Along the seam lie the right chain of a and the left chain of b. A part of a chain exists until the merge that
        takes it up. Walking both chains from the bytes upwards, in the order of those merges, meets all pairs that
        exist together; the seam breaks where such a pair merges earlier (for a tie: further left) than either is
        taken up.
        """
        ok = np.ones(len(a), bool)
        i = (self.right[a] >= 0).sum(axis=1) - 1
        j = (self.left[b] >= 0).sum(axis=1) - 1
        open_ = np.arange(len(a))
        while len(open_):
            ia, jb, ta, tb = i[open_], j[open_], a[open_], b[open_]
            ends_a = np.where(ia > 0, self.right[ta, np.maximum(ia - 1, 0)], NEVER)
            ends_b = np.where(jb > 0, self.left[tb, np.maximum(jb - 1, 0)], NEVER)
            m = self.lookup(self.right[ta, ia], self.left[tb, jb])
            broken = (m < ends_a) & (m <= ends_b) & (m < NEVER)
            ok[open_[broken]] = False
            up_a = (ends_a <= ends_b) & (ia > 0)
            up_b = ~up_a & (jb > 0)
            i[open_] = ia - up_a
            j[open_] = jb - up_b
            open_ = open_[~broken & (up_a | up_b)]
        return ok

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Tokens of each piece: proposed, verified together, and merged exactly where the proposal fails."""
        if not self.ordered:
            return [self.merge(p) for p in pieces]
        out = [self.greedy(p) for p in pieces]
        size = np.array([len(t) for t in out])
        flat = np.array([x for t in out for x in t], np.int64)
        of = np.repeat(np.arange(len(out)), size)
        bad = set(of[flat < 0].tolist())
        inner = np.flatnonzero((of[1:] == of[:-1]) & (flat[1:] >= 0) & (flat[:-1] >= 0)) if len(flat) > 1 else np.empty(0, np.int64)
        if len(inner):
            key, back = np.unique((flat[inner] << 32) | flat[inner + 1], return_inverse=True)
            bad |= set(of[inner[~self.compatible(key >> 32, key & 0xFFFFFFFF)[back]]].tolist())
        for k in bad:
            out[k] = self.merge(pieces[k])
        return out


class Encoder:
    """A vocabulary with the pieces that this worker has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.hashes, self.where = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        if len(self.size) + len(pieces) > REMEMBERED and len(self.size):
            raise _Full
        tokens = self.vocabulary.encode(pieces)
        size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.r_[self.start, len(self.ids) + np.cumsum(size) - size]
        self.ids = np.r_[self.ids, np.array([x for t in tokens for x in t], np.int32)]
        self.where = np.r_[self.where, len(self.size) + np.arange(len(pieces))]
        self.size = np.r_[self.size, size]
        self.hashes = np.r_[self.hashes, hashes]
        o = np.argsort(self.hashes)
        self.hashes, self.where = self.hashes[o], self.where[o]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets per text, and the ids of all texts."""
        try:
            return self._encode(texts)
        except _Full:
            self.clear()
            return self._encode(texts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cps, text_start, raw = code_points(texts)
        start = piece_starts(cps)
        stop = np.r_[start[1:], len(cps)]
        real = cps[start] != SEPARATOR
        start, stop = start[real], stop[real]
        h = piece_hashes(cps, start, stop)
        unique, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, unique), max(0, len(self.hashes) - 1))
        new = np.flatnonzero(self.hashes[at] != unique) if len(self.hashes) else np.arange(len(unique))
        if len(new):
            width = 1 + (cps > 0x7F).astype(np.int8) + (cps > 0x7FF) + (cps > 0xFFFF)
            width[cps == SEPARATOR] = 0
            byte = np.r_[0, np.cumsum(width, dtype=np.int64)]
            lo, hi = byte[start[first[new]]].tolist(), byte[stop[first[new]]].tolist()
            self._learn(unique[new], [raw[a:b] for a, b in zip(lo, hi, strict=True)])
        which = self.where[np.searchsorted(self.hashes, unique)][back]
        size = self.size[which]
        upto = np.r_[0, np.cumsum(size)]
        flat = np.arange(upto[-1]) + np.repeat(self.start[which] - upto[:-1], size)
        return upto[np.searchsorted(start, text_start)], self.ids[flat]


class _Full(Exception):
    pass


def piece_hashes(cps: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of code points."""
    base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
    power = np.multiply.accumulate(np.full(len(cps), base, np.uint64))
    back = np.multiply.accumulate(np.full(len(cps), inverse, np.uint64))
    total = np.r_[np.uint64(0), np.cumsum(mixed()[cps] * power)]
    return (total[stop] - total[start]) * back[start] * np.uint64(0xD6E8FEB86659FD93) + (stop - start).astype(np.uint64)


_ENCODERS: dict[int, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """The encoder of a vocabulary file in this process."""
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(data))
    return _ENCODERS[key]


def text_slices(batch: pa.RecordBatch, column: str, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``chars`` bytes of text, at least one row each."""
    texts = batch.column(column).cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(off, off[at] + chars, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def encode_column(df: DataFrame, id_: Column, text: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row. The vocabulary (about 1 MB, fixed) is read by the driver and sent to the workers."""
    data = df.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(data.value)
        for b in batches:
            for s in text_slices(b, "text"):
                off, ids = encode(s.column("text"))
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return df.select(id_.cast("long").alias("doc_id"), text.cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
