"""Kernels on images, as Arrow-batched pandas UDFs over NumPy.

An image is a BINARY column with one byte per gray sample, row by row, and a width column; rows that a cut-short image
lacks are missing, and samples beyond the last whole row are ignored. A null or empty image, or a width below 1, gives
null.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZED = "struct<image binary, width int, height int>"


def to_array(image: bytes | None, width: int | None, channels: int = 1) -> np.ndarray | None:
    """Height x width (x channels) samples, or None."""
    if image is None or width is None or width != width or width < 1:
        return None
    width = int(width)
    height = len(image) // (width * channels)
    if not height:
        return None
    a = np.frombuffer(bytes(image), np.uint8)[: height * width * channels]
    return a.reshape((height, width) if channels == 1 else (height, width, channels))


def luma(bgr: np.ndarray) -> np.ndarray:
    """BT.601 luma of BGR samples."""
    return np.rint(bgr[..., 0] * 0.114 + bgr[..., 1] * 0.587 + bgr[..., 2] * 0.299).astype(np.uint8)


def grayscale(image: Column, width: Column, channels: int = 3) -> Column:
    """Gray bytes of interleaved BGR bytes; with one channel the image itself, cut to whole rows."""

    if channels == 1:
        return F.when((width >= 1) & (F.octet_length(image) >= width), F.substring(image, F.lit(1), (F.floor(F.octet_length(image) / width) * width).cast("int")))

    @F.pandas_udf("binary")
    def run(im: pd.Series, w: pd.Series) -> pd.Series:
        arrays = [to_array(i, x, channels) for i, x in zip(im, w, strict=True)]
        return pd.Series([None if a is None else luma(a).tobytes() for a in arrays], dtype=object)

    return run(image, width)


#: Bytes of images that one step of a batch-wise kernel holds.
STEP = 4 << 20


def steps(im: pd.Series, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Images in steps of bounded size: (places in the series, first sample of each, row of each sample, samples).

    size: how many bytes of each image count; images of size 0 are left out.
    """
    some = np.flatnonzero(size > 0)
    group = np.cumsum(size[some]) // STEP
    for part in np.split(some, np.flatnonzero(np.diff(group)) + 1):
        if len(part):
            n = size[part]
            data = np.frombuffer(b"".join(im.iloc[i][: size[i]] for i in part.tolist()), np.uint8)
            yield part, np.cumsum(n) - n, np.repeat(np.arange(len(part)), n), data


def levels(df: DataFrame, image: str, table: Sequence[int]) -> DataFrame:
    """Every sample of an image replaced by its level's entry in a table of 256."""
    entries = bytes(table)

    @F.pandas_udf("binary")
    def run(im: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else bytes(i).translate(entries) for i in im], dtype=object)

    return df.withColumn(image, run(image))


def half(a: np.ndarray) -> np.ndarray:
    """Each sample the mean of up to four; odd sides are rounded up."""
    a = np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2)), mode="edge").astype(np.float64)
    return (a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2]) / 4


def _cubic(t: np.ndarray) -> np.ndarray:
    """Weights of the four neighbours at distances 1 + t, t, 1 - t, 2 - t (a = -0.5)."""
    d = np.stack([1 + t, t, 1 - t, 2 - t])
    near = 1.5 * d**3 - 2.5 * d**2 + 1
    far = -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2
    return np.where(d <= 1, near, far)


def _axis(a: np.ndarray, size: int, cubic: bool) -> np.ndarray:
    """Interpolate along the first axis to ``size`` samples, centres on centres."""
    at = (np.arange(size) + 0.5) * a.shape[0] / size - 0.5
    i = np.floor(at).astype(int)
    t = at - i
    offsets, weights = ((-1, 0, 1, 2), _cubic(t)) if cubic else ((0, 1), np.stack([1 - t, t]))
    return sum(a[np.clip(i + o, 0, a.shape[0] - 1)] * w[:, None] for o, w in zip(offsets, weights, strict=True))


def scale_array(a: np.ndarray, factor: float) -> np.ndarray:
    """Halved while the factor is at most a half, then bilinear below 1 and bicubic above."""
    a = a.astype(np.float64)
    while factor <= 0.5:
        a, factor = half(a), factor * 2
    if factor != 1:
        h, w = (max(1, int(np.floor(s * factor + 0.5))) for s in a.shape)
        a = _axis(_axis(a, h, factor > 1).T, w, factor > 1).T
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def _sized(arrays: list[np.ndarray | None]) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "image": pd.Series([None if a is None else a.tobytes() for a in arrays], dtype=object),
            "width": pd.Series([None if a is None else a.shape[1] for a in arrays], dtype="Int32"),
            "height": pd.Series([None if a is None else a.shape[0] for a in arrays], dtype="Int32"),
        }
    )


def scale(image: Column, width: Column, factor: float) -> Column:
    """(image, width, height) scaled by a factor above 0; fields are null without an image."""

    @F.pandas_udf(SIZED)
    def run(im: pd.Series, w: pd.Series) -> pd.DataFrame:
        return _sized([None if (a := to_array(i, x)) is None else scale_array(a, factor) for i, x in zip(im, w, strict=True)])

    return run(image, width)


def crop(image: Column, width: Column, box: Column) -> Column:
    """(image, width, height) of the part of the image that the box covers; null where it covers none."""

    @F.pandas_udf(SIZED)
    def run(im: pd.Series, w: pd.Series, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, x, bx, by, bw, bh in zip(im, w, b["x"], b["y"], b["width"], b["height"], strict=True):
            a = to_array(i, x)
            if a is not None and not pd.isna([bx, by, bw, bh]).any():
                a = a[max(0, int(by)) : max(0, int(by + bh)), max(0, int(bx)) : max(0, int(bx + bw))]
            out.append(a if a is not None and a.size else None)
        return _sized(out)

    return run(image, width, box)


def histogram(image: Column, bins: int = 255, low: float = 0, high: float = 256, channel: int = 0, channels: int = 1) -> Column:
    """Counts of one channel's samples per equal bin of [low, high); null without an image."""

    @F.pandas_udf("array<int>")
    def run(im: pd.Series) -> pd.Series:
        which = np.floor((np.arange(256) - low) * bins / (high - low)).astype(int)
        inside = np.flatnonzero((np.arange(256) >= low) & (np.arange(256) < high))
        inside = inside[(which[inside] >= 0) & (which[inside] < bins)]
        out: list = [None] * len(im)
        for part, start, row, data in steps(im, np.array([0 if i is None else len(i) for i in im], np.int64)):
            if channels > 1:
                own = np.flatnonzero((np.arange(len(data)) - start[row]) % channels == channel)
                row, data = row[own], data[own]
            level = np.bincount(row * 256 + data, minlength=256 * len(part)).reshape(len(part), 256)
            counts = np.zeros((len(part), bins), np.int32)
            np.add.at(counts.T, which[inside], level[:, inside].T.astype(np.int32))
            for i, c in zip(part.tolist(), counts, strict=True):
                out[i] = c
        return pd.Series(out, dtype=object)

    return run(image)


def equalize_array(a: np.ndarray) -> np.ndarray:
    """Levels spread by their cumulative share; an image of one level stays as it is."""
    n = np.bincount(a.ravel(), minlength=256)
    first = n[np.flatnonzero(n)[0]]
    if first == a.size:
        return a
    level = np.rint((np.cumsum(n) - first) * 255.0 / (a.size - first))
    return np.clip(level, 0, 255).astype(np.uint8)[a]


def equalize_value(bgr: np.ndarray) -> np.ndarray:
    """A color image with its largest channel (the value of HSV) equalized; hue and saturation stay."""
    value = bgr.max(axis=2)
    gain = np.where(value > 0, equalize_array(value) / np.maximum(value, 1), 0.0)
    return np.clip(np.rint(bgr * gain[..., None]), 0, 255).astype(np.uint8)


def equalize_color(image: Column, width: Column) -> Column:
    """Equalization of interleaved BGR bytes by their value."""

    @F.pandas_udf("binary")
    def run(im: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([None if (a := to_array(i, x, 3)) is None else equalize_value(a).tobytes() for i, x in zip(im, w, strict=True)], dtype=object)

    return run(image, width)


def equalize(image: Column, width: Column) -> Column:
    """Histogram equalization, as equalize_array, of all images of a batch at once."""

    @F.pandas_udf("binary")
    def run(im: pd.Series, w: pd.Series) -> pd.Series:
        size = np.array([0 if i is None or x is None or not x >= 1 else len(i) // int(x) * int(x) for i, x in zip(im, w, strict=True)], np.int64)
        out: list = [None] * len(im)
        for part, start, row, data in steps(im, size):
            n = np.bincount(row * 256 + data, minlength=256 * len(part)).reshape(len(part), 256)
            total = n.sum(axis=1, keepdims=True)
            first = n[np.arange(len(part)), (n > 0).argmax(axis=1)][:, None]
            flat = first == total
            level = np.rint((np.cumsum(n, axis=1) - first) * 255.0 / np.where(flat, 1, total - first))
            table = np.where(flat, np.arange(256), np.clip(level, 0, 255)).astype(np.uint8)
            body = table[row, data].tobytes()
            for i, a, z in zip(part.tolist(), start.tolist(), (start + size[part]).tolist(), strict=True):
                out[i] = body[a:z]
        return pd.Series(out, dtype=object)

    return run(image, width)


def draw_array(a: np.ndarray, boxes: list, level: int = 255) -> np.ndarray:
    """One-pixel frames of (x, y, width, height) boxes; a box without size is a point, parts outside are cut."""
    a = a.copy()
    h, w = a.shape
    for x, y, bw, bh in boxes:
        x2, y2 = x + max(1, bw) - 1, y + max(1, bh) - 1
        cols, rows = slice(max(0, x), max(0, min(w, x2 + 1))), slice(max(0, y), max(0, min(h, y2 + 1)))
        for r in (y, y2):
            if 0 <= r < h:
                a[r, cols] = level
        for col in (x, x2):
            if 0 <= col < w:
                a[rows, col] = level
    return a


def draw(image: Column, width: Column, boxes: Column, level: int = 255) -> Column:
    """The image with boxes drawn; null boxes and null elements are none."""

    @F.pandas_udf("binary")
    def run(im: pd.Series, w: pd.Series, bs: pd.Series) -> pd.Series:
        out = []
        for i, x, b in zip(im, w, bs, strict=True):
            a = to_array(i, x)
            listed = [] if b is None else [(r["x"], r["y"], r["width"], r["height"]) for r in b if r is not None]
            out.append(None if a is None else draw_array(a, [r for r in listed if None not in r], level).tobytes())
        return pd.Series(out, dtype=object)

    return run(image, width, boxes)


def flow_image(dims: Column, data: Column) -> Column:
    """Gray bytes of a flow tensor [rows][columns][2]: 255 x min(length, 1) of each vector; other tensors give null."""

    @F.pandas_udf("binary")
    def run(ds: pd.Series, vs: pd.Series) -> pd.Series:
        out = []
        for d, v in zip(ds, vs, strict=True):
            if d is None or v is None or len(d) != 3 or d[2] != 2 or len(v) != d[0] * d[1] * 2 or not len(v):
                out.append(None)
                continue
            m = np.nan_to_num(np.hypot(*np.asarray(v, np.float64).reshape(-1, 2).T), nan=0.0)
            out.append(np.rint(np.minimum(m, 1) * 255).astype(np.uint8).tobytes())
        return pd.Series(out, dtype=object)

    return run(dims, data)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(a: np.ndarray) -> bytes:
    """A gray (two axes) or RGB (three axes) PNG file."""
    h, w = a.shape[:2]
    rows = np.hstack([np.zeros((h, 1), np.uint8), np.ascontiguousarray(a).reshape(h, -1)])
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if a.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def encode_png(image: Column, width: Column) -> Column:
    """The image as a PNG file."""

    @F.pandas_udf("binary")
    def run(im: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([None if (a := to_array(i, x)) is None else png(a) for i, x in zip(im, w, strict=True)], dtype=object)

    return run(image, width)
