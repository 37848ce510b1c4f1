"""Numbering, times and chunks of frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameflow.functions.columns import frame_interval
from frameflow.operators.ranking import ranked


def number_frames(df: DataFrame, keys: Sequence[str], order: str, fps: float, ties: Sequence[str] = ()) -> DataFrame:
    """Adds sequence_nr from 0 in each source, and ts_ms = sequence_nr x whole milliseconds between frames."""
    out = ranked(df, keys, order, ties, "sequence_nr")
    return out.withColumn("ts_ms", F.col("sequence_nr") * F.lit(frame_interval(fps)))


def group_frames(
    df: DataFrame, keys: Sequence[str], order: str, size: int, payload: Sequence[str], keep_rest: bool = False, ties: Sequence[str] = ()
) -> DataFrame:
    """(keys, group_nr, first_seq, n_frames, frames): every ``size`` frames of a source in one row, in order.

    An incomplete last group waits for more frames and comes out only with keep_rest.
    """
    r = ranked(df, keys, order, ties)
    g = r.groupBy(*keys, F.floor(F.col("rn") / size).alias("group_nr")).agg(
        F.min(order).alias("first_seq"), F.count(F.lit(1)).alias("n_frames"), F.array_sort(F.collect_list(F.struct("rn", *payload))).alias("frames")
    )
    return g if keep_rest else g.filter(F.col("n_frames") == size)


def on_groups(groups: DataFrame, operation: Callable[[Column], Column], name: str = "result", frames: str = "frames") -> DataFrame:
    """An operation on the frames inside each group, as a function of their array: no state and no exchange."""
    return groups.withColumn(name, operation(F.col(frames)))


def frame_pairs(df: DataFrame, keys: Sequence[str], seq: str, payload: Sequence[str], step: int | None = None) -> DataFrame:
    """(keys, first_seq, second_seq, duration, first, second): each frame with the next one of its stream.

    step: only pairs that are exactly so far apart. Payload columns come as structs. One exchange on (keys, place): a
    frame joins the pair that it begins and the pair that it ends.
    """
    rows = ranked(df, keys, seq, payload)
    spread = rows.select(*keys, seq, *payload, "rn", F.explode(F.array(F.lit(0), F.lit(1))).alias("_side"))
    pair = spread.groupBy(*keys, (F.col("rn") - F.col("_side")).alias("_pair")).agg(
        F.max(F.when(F.col("_side") == 0, F.struct(F.col(seq).alias("seq"), *payload))).alias("first"),
        F.max(F.when(F.col("_side") == 1, F.struct(F.col(seq).alias("seq"), *payload))).alias("second"),
    )
    pair = pair.filter("first is not null and second is not null")
    out = pair.select(*keys, F.col("first.seq").alias("first_seq"), F.col("second.seq").alias("second_seq"), (F.col("second.seq") - F.col("first.seq")).alias("duration"), "first", "second")
    return out if step is None else out.filter(F.col("duration") == step)


def frames_to_chunks(
    df: DataFrame, keys: Sequence[str], order: str, least: int, image: str = "image", container: str = "frames", keep_rest: bool = True, ties: Sequence[str] = ()
) -> DataFrame:
    """Video chunks of ``least`` frames: (keys, sequence_nr, n_frames, video ARRAY<BINARY>, container).

    sequence_nr is the first frame's and n_frames the true count; the last chunk of a stream may be shorter and comes
    out only with keep_rest. A chunk is an ordered array of encoded images.
    """
    g = group_frames(df.filter(F.col(image).isNotNull()), keys, order, least, [image], keep_rest, ties)
    return g.select(
        *keys,
        F.col("group_nr").alias("chunk_nr"),
        F.col("first_seq").alias("sequence_nr"),
        "n_frames",
        F.transform("frames", lambda f: f[image]).alias("video"),
        F.lit(container).alias("container"),
    )


def chunk_frames(chunks: DataFrame, skip: int, n_frames: str = "n_frames", seq: str = "sequence_nr", video: str | None = None) -> DataFrame:
    """One row per frame of a chunk: ``nth`` and sequence_nr = the chunk's + nth x skip (and the image, for a video
    that is an array). Chunks with no, a null or a negative count have no frames."""
    rest = [c for c in chunks.columns if c not in (seq, video)]
    if video:
        out = chunks.select(*rest, F.col(seq).alias("_s"), F.posexplode(video).alias("nth", "image"))
    else:
        whole = chunks.filter(F.col(n_frames) > 0)
        out = whole.select(*rest, F.col(seq).alias("_s"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_frames) - 1)).alias("nth"))
    return out.withColumn(seq, F.col("_s") + F.col("nth") * max(1, skip)).drop("_s")


def frame_rate(first_ts: Column, second_ts: Column, speed: float = 1.0) -> Column:
    """Frames per second from the first two times (whole division), times the speed; null if they are equal."""
    gap = second_ts - first_ts
    return F.when(gap > 0, F.floor(F.lit(1000) / gap) * F.lit(float(speed)))


def stream_rates(df: DataFrame, keys: Sequence[str], seq: str = "sequence_nr", ts: str = "ts_ms", speed: float = 1.0) -> DataFrame:
    """(keys, fps) from the two frames with the lowest numbers of each stream, by partial aggregation."""
    first = df.filter(f"{seq} is not null and {ts} is not null").groupBy(*keys, seq).agg(F.min(ts).alias("_t"))
    low = first.groupBy(*keys).agg(F.min(F.struct(seq, "_t")).alias("_a"))
    joined = first.join(low, [*keys]).filter(F.col(seq) > F.col("_a")[seq])
    both = joined.groupBy(*keys, "_a").agg(F.min(F.struct(seq, "_t")).alias("_b"))
    return both.select(*keys, frame_rate(F.col("_a._t"), F.col("_b._t"), speed).alias("fps"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str], expire_before: Column | None = None) -> DataFrame:
    """The latest row of each stream; with expire_before, only streams whose latest row is not older.

    ``order`` should tell the rows of a stream apart; of rows that are equal in it any one comes out. The payload may
    have columns of any type.
    """
    rest = [p for p in payload if p not in (*keys, *order)]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_m"))
    out = g.select(*keys, *[F.col(f"_m.{x}").alias(x) for x in (*order, *rest)])
    return out.filter(expire_before) if expire_before is not None else out


def within_ttl(df: DataFrame, keys: Sequence[str], ts: str, ttl: Column) -> DataFrame:
    """Rows no older than ``ttl`` against the newest of their stream: what a history with expiry still holds at the
    end of the input. The newest time per stream is a partial aggregate."""
    newest = df.groupBy(*keys).agg(F.max(ts).alias("_newest"))
    return df.join(newest, list(keys)).filter(F.col(ts) >= F.col("_newest") - ttl).drop("_newest")
