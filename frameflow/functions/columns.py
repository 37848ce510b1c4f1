"""Column functions for stream ids, boxes and numbers; all stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameflow.schema import bbox


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5), which differs from SQL's round for negative halves."""
    return F.floor(x + F.lit(0.5))


def base_stream(stream="stream_id") -> Column:
    """The stream a tile or region came from: what stands before the last '_'."""
    return F.regexp_replace(c(stream), "_[^_]*$", "")


def tile_suffix(stream="stream_id") -> Column:
    """What stands behind the last '_'."""
    return F.substring_index(c(stream), "_", -1)


def is_tile(stream="stream_id") -> Column:
    """Whether a stream id ends in a tile number behind the source's own number."""
    return c(stream).rlike("_[0-9]+_[0-9]+$")


def basename(path="path") -> Column:
    return F.substring_index(c(path), "/", -1)


def source_stream(path="path") -> Column:
    """Stream id of a file: its base name and a hash of the whole path, never negative."""
    return F.concat_ws("_", basename(path), F.pmod(F.xxhash64(c(path)), F.lit(2**31 - 1)).cast("string"))


def right(b) -> Column:
    return c(b)["x"] + c(b)["width"]


def bottom(b) -> Column:
    return c(b)["y"] + c(b)["height"]


def intersect(a, b) -> Column:
    """The common part of two boxes; its width or height is not above zero if there is none."""
    a, b = c(a), c(b)
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    return bbox(x, y, F.least(right(a), right(b)) - x, F.least(bottom(a), bottom(b)) - y)


def is_empty(b) -> Column:
    return (c(b)["width"] <= 0) | (c(b)["height"] <= 0)


def contains_point(b, x, y) -> Column:
    """Left and top edges belong to a box, right and bottom edges don't."""
    return (c(x) >= c(b)["x"]) & (c(y) >= c(b)["y"]) & (c(x) < right(b)) & (c(y) < bottom(b))


def translate(b, dx, dy) -> Column:
    return bbox(c(b)["x"] + c(dx), c(b)["y"] + c(dy), c(b)["width"], c(b)["height"])


def pad(b, by) -> Column:
    return bbox(c(b)["x"] - c(by), c(b)["y"] - c(by), c(b)["width"] + 2 * c(by), c(b)["height"] + 2 * c(by))


def scaled(size, factor: float) -> Column:
    """Pixels of a side after scaling: halved (rounding up) while the factor is at most a half, then multiplied."""
    out, f = c(size), factor
    while f <= 0.5:
        out = F.greatest(round_half_up(out * F.lit(0.5)), F.lit(1))
        f *= 2
    return round_half_up(out * F.lit(f)).cast("int")


def frame_interval(fps: float) -> int:
    """Whole milliseconds between two frames."""
    return int(1000 // fps)


def l2(a, b) -> Column:
    """Euclidean distance of two arrays, summed in double."""
    d = F.zip_with(c(a).cast("array<double>"), c(b).cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def magnitude(dx, dy) -> Column:
    """Length of a flow vector, at most 1."""
    return F.least(F.sqrt(c(dx) * c(dx) + c(dy) * c(dy)), F.lit(1.0))


def entries_text(m) -> Column:
    """A map as 'k=v' joined by ';' in order of the keys; empty for null."""
    e = F.transform(F.array_sort(F.map_entries(c(m))), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit(""))))
    return F.coalesce(F.array_join(e, ";"), F.lit(""))
