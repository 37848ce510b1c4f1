"""Vision kernels after published methods: difference-of-Gaussian keypoints, Haar cascades, a per-pixel background
mixture and least-squares optical flow. All work on gray arrays; see pixels for the form of an image."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameflow.operators.pixels import half, to_array
from frameflow.operators.ranking import ranked

KEYPOINTS = "array<struct<x:int,y:int,scale:float,response:float,values:array<float>>>"
BOXES = "array<struct<x:int,y:int,width:int,height:int>>"


@lru_cache(64)
def _blur_matrix(n: int, sigma: float) -> np.ndarray:
    """Weights of n samples in each blurred one; samples beyond an edge are the edge's."""
    r = max(1, int(3 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    out = np.zeros((n, n))
    np.add.at(out, (np.repeat(np.arange(n), 2 * r + 1), np.clip(np.arange(n)[:, None] + np.arange(-r, r + 1), 0, n - 1).ravel()), np.tile(k / k.sum(), n))
    return out


def blur(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur with edges repeated."""
    return _blur_matrix(a.shape[0], sigma) @ a @ _blur_matrix(a.shape[1], sigma).T


def find_keypoints(a: np.ndarray, threshold: float = 2.0, octaves: int = 2, cells: int = 4, bins: int = 4) -> list[tuple]:
    """(x, y, scale, response, values) of extrema in space and scale; values is a unit histogram of gradients over
    cells x cells cells with ``bins`` directions (64 numbers by default)."""
    out = []
    base = a.astype(np.float64)
    for octave in range(octaves):
        if min(base.shape) < 5:
            break
        levels = [blur(base, s) for s in (0.8, 1.13, 1.6, 2.26)]
        dog = np.stack([b - c for b, c in zip(levels[1:], levels[:-1], strict=True)])
        mid = dog[1, 1:-1, 1:-1]
        around = np.stack([dog[z, 1 + dy : dog.shape[1] - 1 + dy, 1 + dx : dog.shape[2] - 1 + dx] for z in (0, 1, 2) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (z, dy, dx) != (1, 0, 0)])
        peak = (np.abs(mid) >= threshold) & ((mid > around.max(axis=0)) | (mid < around.min(axis=0)))
        gy, gx = np.gradient(levels[1])
        size, angle = np.hypot(gx, gy), np.arctan2(gy, gx)
        for y, x in zip(*np.nonzero(peak), strict=True):
            out.append(((x + 1) << octave, (y + 1) << octave, 1.13 * 2**octave, float(mid[y, x]), _describe(size, angle, y + 1, x + 1, cells, bins)))
        base = half(levels[2])
    return out


def _describe(size: np.ndarray, angle: np.ndarray, y: int, x: int, cells: int, bins: int) -> list[float]:
    r = 2 * cells
    dy, dx = np.mgrid[-r:r, -r:r]
    yy, xx = y + dy, x + dx
    inside = (yy >= 0) & (yy < size.shape[0]) & (xx >= 0) & (xx < size.shape[1])
    yy, xx, dy, dx = yy[inside], xx[inside], dy[inside], dx[inside]
    weight = size[yy, xx] * np.exp(-(dy**2 + dx**2) / (2.0 * r**2))
    turn = np.floor((angle[yy, xx] + np.pi) / (2 * np.pi) * bins).astype(int) % bins
    cell = ((dy + r) * cells // (2 * r)) * cells + (dx + r) * cells // (2 * r)
    v = np.bincount(cell * bins + turn, weight, minlength=cells * cells * bins)
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32).tolist()


def keypoints(image: Column, width: Column, threshold: float = 2.0) -> Column:
    """Keypoints of each image as an array; empty if none, null without an image."""

    @F.pandas_udf(KEYPOINTS)
    def run(im: pd.Series, w: pd.Series) -> pd.Series:
        names = ("x", "y", "scale", "response", "values")
        out = []
        for i, x in zip(im, w, strict=True):
            a = to_array(i, x)
            out.append(None if a is None else [dict(zip(names, (int(k[0]), int(k[1]), *k[2:]), strict=True)) for k in find_keypoints(a, threshold)])
        return pd.Series(out, dtype=object)

    return run(image, width)


# ---- cascades ------------------------------------------------------------------------------------------------------


@dataclass
class Weak:
    """A stump: rectangles (x, y, width, height, weight) and the values on either side of the threshold."""

    rects: list[tuple[int, int, int, int, float]]
    threshold: float
    below: float
    above: float


@dataclass
class Cascade:
    width: int
    height: int
    stages: list[tuple[float, list[Weak]]] = field(default_factory=list)


def parse_cascade(xml: str) -> Cascade:
    """A cascade of stumps in the common XML form (stages, weakClassifiers, internalNodes, leafValues, features)."""
    root = ElementTree.fromstring(xml)
    c = next(e for e in root.iter() if e.find("stages") is not None and e.find("features") is not None)
    rects = []
    for f in c.find("features"):
        rects.append([(int(v[0]), int(v[1]), int(v[2]), int(v[3]), float(v[4])) for r in f.find("rects") if (v := r.text.split())])
    out = Cascade(int(c.findtext("width")), int(c.findtext("height")))
    for s in c.find("stages"):
        weak = []
        for k in s.find("weakClassifiers"):
            node, leaf = k.findtext("internalNodes").split(), k.findtext("leafValues").split()
            weak.append(Weak(rects[int(node[2])], float(node[3]), float(leaf[0]), float(leaf[1])))
        out.stages.append((float(s.findtext("stageThreshold")), weak))
    return out


@lru_cache(256)
def _places(height: int, width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of all window corners."""
    ys, xs = (g.ravel() for g in np.mgrid[0:height:step, 0:width:step])
    return ys, xs


def detect(a: np.ndarray, cascade: Cascade, scale: float = 1.1, neighbours: int = 3, min_size: tuple[int, int] = (0, 0), max_size: tuple[int, int] = (1000, 1000)) -> list[tuple[int, int, int, int]]:
    """Boxes that pass every stage at some size, grouped; groups of fewer than ``neighbours`` hits are dropped."""
    h, w = a.shape
    x = a.astype(np.float64)
    sums = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    squares = np.pad((x * x).cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def area(s: np.ndarray, ys: np.ndarray, xs: np.ndarray, bw: int, bh: int) -> np.ndarray:
        return s[ys + bh, xs + bw] - s[ys, xs + bw] - s[ys + bh, xs] + s[ys, xs]

    hits, f = [], 1.0
    while True:
        ww, wh = int(round(cascade.width * f)), int(round(cascade.height * f))
        if ww > min(w, max_size[0]) or wh > min(h, max_size[1]):
            break
        if ww >= min_size[0] and wh >= min_size[1]:
            ys, xs = _places(h - wh + 1, w - ww + 1, max(1, int(f)))
            n = ww * wh
            mean = area(sums, ys, xs, ww, wh) / n
            dev = np.sqrt(np.maximum(area(squares, ys, xs, ww, wh) / n - mean**2, 1.0))
            for limit, weak in cascade.stages:
                score = np.zeros(len(ys))
                for k in weak:
                    v = np.zeros(len(ys))
                    for rx, ry, rw, rh, weight in k.rects:
                        v += weight * area(sums, ys + int(ry * f), xs + int(rx * f), max(1, int(rw * f)), max(1, int(rh * f)))
                    score += np.where(v / n < k.threshold * dev, k.below, k.above)
                ys, xs, dev = (z[score >= limit] for z in (ys, xs, dev))
                if not len(ys):
                    break
            hits += [(int(px), int(py), ww, wh) for py, px in zip(ys, xs, strict=True)]
        f *= scale
    return group_boxes(hits, neighbours)


def group_boxes(boxes: Sequence[tuple[int, int, int, int]], neighbours: int) -> list[tuple[int, int, int, int]]:
    """Means of boxes that lie within a fifth of their size of each other, of groups with enough members."""
    groups: list[list[tuple[int, int, int, int]]] = []
    for b in sorted(boxes):
        for g in groups:
            m = np.mean(g, axis=0)
            if np.abs(m[:2] - b[:2]).max() <= 0.2 * min(m[2], b[2]) and abs(m[2] - b[2]) <= 0.2 * max(m[2], b[2]):
                g.append(b)
                break
        else:
            groups.append([b])
    return [tuple(int(v) for v in np.rint(np.mean(g, axis=0))) for g in groups if len(g) >= max(1, neighbours)]


def cascade_boxes(image: Column, width: Column, cascade: Cascade, **options) -> Column:
    """Detections of each image; the model, a few hundred kB, travels with the function."""

    @F.pandas_udf(BOXES)
    def run(im: pd.Series, w: pd.Series) -> pd.Series:
        names = ("x", "y", "width", "height")
        arrays = [to_array(i, x) for i, x in zip(im, w, strict=True)]
        return pd.Series([None if a is None else [dict(zip(names, b, strict=True)) for b in detect(a, cascade, **options)] for a in arrays], dtype=object)

    return run(image, width)


# ---- background ----------------------------------------------------------------------------------------------------


class Background:
    """A mixture of a few Gaussians per pixel; a pixel far from all likely ones is foreground."""

    def __init__(self, shape: tuple[int, int], history: int = 50, modes: int = 3, spread: float = 2.5, first_deviation: float = 15.0, share: float = 0.7):
        self.rate, self.spread, self.share, self.first = 1.0 / history, spread, share, first_deviation**2
        self.mean = np.zeros((modes, *shape))
        self.var = np.full((modes, *shape), self.first)
        self.weight = np.zeros((modes, *shape))

    def apply(self, a: np.ndarray) -> np.ndarray:
        """The mask of foreground pixels, after which the frame becomes part of the history."""
        x = a.astype(np.float64)
        d2 = (x - self.mean) ** 2
        fits = (d2 <= self.spread**2 * self.var) & (self.weight > 0)
        rank = np.where(fits, self.weight / np.sqrt(self.var), -1)
        best = rank.argmax(axis=0)
        any_ = fits.any(axis=0)
        order = np.argsort(-(self.weight / np.sqrt(self.var)), axis=0, kind="stable")
        before = np.cumsum(np.take_along_axis(self.weight, order, 0), axis=0) - np.take_along_axis(self.weight, order, 0)
        likely = np.zeros_like(fits)
        np.put_along_axis(likely, order, before < self.share, 0)
        mask = ~(any_ & np.take_along_axis(likely, best[None], 0)[0])
        hit = (np.arange(len(self.mean))[:, None, None] == best) & any_
        self.weight += self.rate * (hit - self.weight)
        self.mean = np.where(hit, self.mean + self.rate * 4 * (x - self.mean), self.mean)
        self.var = np.where(hit, np.maximum(self.var + self.rate * 4 * (d2 - self.var), 4.0), self.var)
        worst = (self.weight.argmin(axis=0)[None] == np.arange(len(self.mean))[:, None, None]) & ~any_
        self.mean, self.var = np.where(worst, x, self.mean), np.where(worst, self.first, self.var)
        self.weight = np.where(worst, np.maximum(self.rate, 1e-3), self.weight)
        self.weight /= self.weight.sum(axis=0)
        return mask


def blobs(mask: np.ndarray, least: int = 5) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, width, height) of the mask's connected parts (8 neighbours) that are at least so wide and high."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        p = np.pad(label, 1)
        around = np.max([p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        new = np.where(mask, around, 0)
        if (new == label).all():
            break
        label = new
    out = []
    for k in np.unique(label[label > 0]):
        ys, xs = np.nonzero(label == k)
        box = (int(xs.min()), int(ys.min()), int(xs.max() - xs.min() + 1), int(ys.max() - ys.min() + 1))
        if min(box[2:]) >= least:
            out.append(box)
    return sorted(out)


def foreground(
    df: DataFrame, width: int, history: int = 50, chunk: int = 1024, warm_up: int = 150, least: int = 5, stream: str = "stream_id", seq: str = "sequence_nr", image: str = "image"
) -> DataFrame:
    """(stream_id, sequence_nr, foreground, pixels, boxes): changed pixels of each frame against its stream's
    background, and the boxes of connected ones at least ``least`` wide and high.

    A model lives in one stream. A long stream is cut into chunks of ``chunk`` frames in order of their numbers, gaps or
    not, each of which first learns from the ``warm_up`` frames before it, three times the history, after which a frame
    weighs under a twentieth; so no task holds a whole stream, and results don't depend on the cluster. Frames without a
    whole row of pixels are left out; a frame of another size than the one before begins a new model; frames of one
    number are learnt in the order of their images.
    """
    rows = df.filter(F.col(stream).isNotNull() & F.col(seq).isNotNull() & (F.length(image) >= width)).select(F.col(stream).alias("s"), F.col(seq).cast("long").alias("n"), F.col(image).alias("image"))
    rows = ranked(rows, ["s"], "n", ["image"], "r")
    spread = rows.withColumn("c", F.explode(F.sequence(F.floor(F.col("r") / chunk), F.floor((F.col("r") + warm_up) / chunk))))
    spread = spread.repartition("s", "c").sortWithinPartitions("s", "c", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, model, shape = None, None, None
        for b in batches:
            out = []
            for s, n, r, c, image_ in zip(*(b.column(x).to_pylist() for x in ("s", "n", "r", "c", "image")), strict=True):
                a = to_array(image_, width)
                if (s, c) != key or a.shape != shape:
                    key, shape, model = (s, c), a.shape, Background(a.shape, history)
                mask = model.apply(a)
                if r // chunk == c:
                    boxes = [dict(zip(("x", "y", "width", "height"), b, strict=True)) for b in (blobs(mask, least) if mask.any() else [])]
                    out.append((s, n, int(mask.sum()), mask.size, boxes))
            if out:
                *plain, boxes = zip(*out, strict=True)
                kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("x", "y", "width", "height")]))
                yield pa.RecordBatch.from_arrays([*map(pa.array, plain), pa.array(boxes, kind)], names=["stream_id", "sequence_nr", "foreground", "pixels", "boxes"])

    return spread.mapInArrow(run, f"stream_id string, sequence_nr long, foreground long, pixels long, boxes {BOXES}")


# ---- flow ----------------------------------------------------------------------------------------------------------


def flow_array(a: np.ndarray, b: np.ndarray, window: int = 2) -> np.ndarray:
    """Per pixel (dx, dy) from a to b by least squares over a square window; 0 where the window has no structure."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    gy, gx = np.gradient((a + b) / 2) if min(a.shape) > 1 else (np.zeros_like(a), np.zeros_like(a))
    gt = b - a

    def box(x: np.ndarray) -> np.ndarray:
        p = np.pad(x, window, mode="edge")
        s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        k = 2 * window + 1
        return s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]

    xx, yy, xy, xt, yt = box(gx * gx), box(gy * gy), box(gx * gy), box(gx * gt), box(gy * gt)
    det = xx * yy - xy * xy
    good = det > 1e-6 * np.maximum((xx + yy) ** 2, 1)
    det = np.where(good, det, 1)
    return np.stack([np.where(good, (xy * yt - yy * xt) / det, 0), np.where(good, (xy * xt - xx * yt) / det, 0)], axis=-1)


def optical_flow(first: Column, second: Column, width: Column) -> Column:
    """dense (dims [rows, columns, 2], data) of two images of one size; null for other pairs."""

    @F.pandas_udf("struct<dims array<int>, data array<float>>")
    def run(i1: pd.Series, i2: pd.Series, w: pd.Series) -> pd.DataFrame:
        dims, data = [], []
        for x, y, k in zip(i1, i2, w, strict=True):
            a, b = to_array(x, k), to_array(y, k)
            ok = a is not None and b is not None and a.shape == b.shape
            f = flow_array(a, b) if ok else None
            dims.append(None if f is None else np.array(f.shape, np.int32))
            data.append(None if f is None else f.astype(np.float32).ravel())
        return pd.DataFrame({"dims": pd.Series(dims, dtype=object), "data": pd.Series(data, dtype=object)})

    return run(first, second, width)
