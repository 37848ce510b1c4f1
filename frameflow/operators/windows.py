"""Count windows over sequence numbers: discrete, sliding and same-sequence.

All hold for streams of any size: runs and row numbers come from bucketed prefix sums (see ranking), and the windows
themselves are groups on (stream, first number).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.operators.ranking import positions, ranked


class Batcher(Protocol):
    """What a window must offer to a stream: own windows need no more than this."""

    def take(self, history: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
        """The windows (first and last number) that a sorted history holds, and the numbers that are still needed."""


@dataclass(frozen=True)
class Discrete:
    """Windows of ``size`` numbers, each exactly ``step`` after the one before, that don't overlap.

    Each run of numbers is cut from its start; what is left at its end, shorter than ``size``, is no window. A gap
    starts a new run, so windows behind a gap come out too. Repeated numbers count once, null numbers not at all.
    """

    size: int
    step: int = 1

    def frame(self, df: DataFrame, keys: Sequence[str], seq: str = "sequence_nr") -> DataFrame:
        """(keys, first_seq, last_seq)."""
        p = positions(df, keys, seq, self.step)
        first = F.col("seq") - self.step * (F.col("pos") % self.size)
        whole = p.groupBy(*keys, first.alias("first_seq")).agg(F.count(F.lit(1)).alias("_n"), F.max("seq").alias("last_seq"))
        return whole.filter(F.col("_n") == self.size).drop("_n")

    def fold(self, numbers: Sequence[int]) -> list[list[int]]:
        """The same for one sorted list, as the streaming operator applies it."""
        out, run = [], []
        for n in sorted(set(numbers)):
            if run and n - run[-1] != self.step:
                run = []
            run.append(n)
            if len(run) == self.size:
                out.append(run)
                run = []
        # a full window is followed by a new one only where the run goes on; a new run starts anew anyway
        return out

    def take(self, history: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
        out, left, i = [], [], 0
        while i < len(history):
            w = history[i : i + self.size]
            if len(w) == self.size and w[-1] - w[0] == self.step * (self.size - 1) and all(b - a == self.step for a, b in zip(w, w[1:], strict=False)):
                out.append((w[0], w[-1]))
                i += self.size
            else:
                left.append(history[i])
                i += 1
        return out, left


@dataclass(frozen=True)
class Sliding:
    """Every ``size`` neighbouring numbers, each exactly ``step`` after the one before.

    With ``max_size`` m, the head of a history longer than m is let go with its next ``size`` numbers even if they are
    not in step; a head that is blocked when the stream ends, with m or fewer numbers left, holds back all behind it.
    """

    size: int
    step: int = 1
    max_size: int | None = None

    def frame(self, df: DataFrame, keys: Sequence[str], seq: str = "sequence_nr") -> DataFrame:
        """(keys, first_seq, last_seq), and with max_size whether the window is in step."""
        if self.max_size is None:
            # A window's numbers lie in one run; the one at place p of its run ends a window if p >= size - 1.
            p = positions(df, keys, seq, self.step).filter(F.col("pos") >= self.size - 1)
            return p.select(*keys, (F.col("seq") - self.step * (self.size - 1)).alias("first_seq"), F.col("seq").alias("last_seq"))
        rows = df.select(*keys, F.col(seq).cast("long").alias("seq")).filter("seq is not null").distinct()
        rows = ranked(rows, keys, "seq", name="_i")
        spread = rows.select(*keys, "seq", F.explode(F.array(*[F.col("_i") - j for j in range(self.size)])).alias("_i")).filter("_i >= 0")
        windows = spread.groupBy(*keys, "_i").agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list("seq")).alias("_w")).filter(F.col("_n") == self.size)
        inside = F.forall(F.sequence(F.lit(1), F.lit(self.size - 1)), lambda j: F.get("_w", j) - F.get("_w", j - 1) == self.step) if self.size > 1 else F.lit(True)
        windows = windows.select(*keys, "_i", F.get("_w", F.lit(0)).alias("first_seq"), F.get("_w", F.lit(self.size - 1)).alias("last_seq"), inside.alias("in_step"))
        last = rows.groupBy(*keys).agg(F.max("_i").alias("_last"))
        joined = _null_safe(windows, last, keys)
        # Heads with more than max_size numbers from them on always go; of the others, those before the first blocked.
        tail = joined.filter(F.col("_last") - F.col("_i") < self.max_size)
        blocked = tail.filter("not in_step").groupBy(*keys).agg(F.min("_i").alias("_stop"))
        out = _null_safe(joined, blocked, keys, "left").filter((F.col("_last") - F.col("_i") >= self.max_size) | F.col("_stop").isNull() | (F.col("_i") < F.col("_stop")))
        return out.select(*keys, "first_seq", "last_seq", "in_step")

    def fold(self, numbers: Sequence[int]) -> list[list[int]]:
        """The same for one stream in order of arrival of its sorted numbers."""
        history, out = [], []
        for n in sorted(set(numbers)):
            history.append(n)
            while len(history) >= self.size:
                w = history[: self.size]
                if all(b - a == self.step for a, b in zip(w, w[1:], strict=False)) or (self.max_size is not None and len(history) > self.max_size):
                    out.append(w)
                elif self.max_size is not None:
                    break
                history.pop(0)
        return out

    def take(self, history: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
        """Without max_size a head out of step waits, for a late number, behind the heads that go; with it, it holds back
        all behind it until the history is longer than max_size."""
        out, left, n = [], [], len(history)
        for i, head in enumerate(history):
            w = history[i : i + self.size]
            in_step = len(w) == self.size and all(b - a == self.step for a, b in zip(w, w[1:], strict=False))
            if in_step or (len(w) == self.size and self.max_size is not None and n - i > self.max_size):
                out.append((head, w[-1]))
            elif self.max_size is not None:
                return out, history[i:]
            else:
                left.append(head)
        return out, left


@dataclass(frozen=True)
class SameSequence:
    """Groups of exactly ``count`` items of one stream and number, whatever their kind; larger groups are overflow."""

    count: int

    def frame(self, df: DataFrame, keys: Sequence[str], seq: str = "sequence_nr") -> DataFrame:
        """(keys, seq, n, overflow); smaller groups wait and don't come out."""
        g = df.filter(F.col(seq).isNotNull()).groupBy(*keys, F.col(seq).alias("seq")).agg(F.count(F.lit(1)).alias("n"))
        return g.filter(F.col("n") >= self.count).withColumn("overflow", F.col("n") > self.count)


def with_trigger(windows: DataFrame, items: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("request_id",), seq: str = "sequence_nr", last: str = "last_seq") -> DataFrame:
    """Windows with header columns of the item that completed them, the one with their last number.

    Of several items with that number the one with the smallest columns counts. Columns that the windows have under
    the same name are replaced.
    """
    rest = [c for c in windows.columns if c not in columns]
    ends = items.filter(F.col(seq).isNotNull()).groupBy(*keys, F.col(seq).cast("long").alias(last)).agg(F.min(F.struct(*columns)).alias("_trigger"))
    return _null_safe(windows.select(*rest), ends, [*keys, last]).select(*rest, *[F.col("_trigger")[c].alias(c) for c in columns])


def _null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    b = b.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[x for x in b.columns if x not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & a[k].eqNullSafe(b[f"_k{i}"])
    return a.join(b, on, how).drop(*[f"_k{i}" for i in range(len(keys))])
