"""Tiles, regions of interest and merging of features, on boxes and structs inside Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameflow.functions.columns import base_stream, contains_point, intersect, is_empty, pad, tile_suffix
from frameflow.operators.pixels import crop
from frameflow.schema import BBOX, DENSE, bbox, inherit_metadata


def tile_boxes(box: Column, rows: int, cols: int, overlap: int = 0) -> Column:
    """The tiles of a box, row by row: whole-number sizes, grown to the right and below by overlap, cut at the box.

    Pixels that rows x cols whole tiles don't reach stay uncovered, unless the overlap does.
    """
    w, h = F.floor(box["width"] / cols), F.floor(box["height"] / rows)

    def tile(i: Column) -> Column:
        x, y = box["x"] + (i % cols) * w, box["y"] + F.floor(i / cols) * h
        return intersect(bbox(x, y, w + overlap, h + overlap), box)

    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), tile)


def tiling(df: DataFrame, rows: int, cols: int, overlap: int = 0, box: str = "bbox", stream: str = "stream_id") -> DataFrame:
    """One row per tile, with ``tile``, the tile's box and the stream id with ``_<tile>`` behind it.

    Frames narrower than 2 x cols or lower than 2 x rows, and frames without a box, are dropped.
    """
    b = F.col(box)
    rest = [c for c in df.columns if c not in (box, stream)]
    whole = df.filter((b["width"] >= 2 * cols) & (b["height"] >= 2 * rows))
    out = whole.select(F.col(stream).alias("_stream"), *rest, F.posexplode(tile_boxes(b, rows, cols, overlap)).alias("tile", box))
    return out.withColumn(stream, F.concat_ws("_", "_stream", F.col("tile").cast("string"))).select(stream, *rest, "tile", box)


def tile_pixels(df: DataFrame, rows: int, cols: int, overlap: int = 0, image: str = "image", width: str = "width", stream: str = "stream_id") -> DataFrame:
    """Tiles with their pixels: ``tiling`` of the image itself, one byte a sample; image and width are those of the tile,
    and ``bbox`` is the tile's place in the image. Images without a whole row are dropped."""
    box = bbox(0, 0, F.col(width), F.floor(F.octet_length(image) / F.col(width)))
    tiles = tiling(df.filter((F.col(width) >= 1) & (F.octet_length(image) >= F.col(width))).withColumn("bbox", box), rows, cols, overlap, stream=stream)
    cut = tiles.withColumn("_c", crop(F.col(image), F.col(width), F.col("bbox")))
    return cut.withColumns({image: F.col("_c.image"), width: F.col("_c.width")}).drop("_c")


def paste_pixels(tiles: DataFrame, keys: Sequence[str] = ("stream_id", "sequence_nr"), image: str = "image", box: str = "bbox") -> DataFrame:
    """(base stream, sequence, width, height, image): the image that tiles came from, each at its corner; where tiles
    overlap the later one holds, and what none covers is 0."""
    stream, seq = keys
    one = F.struct(tile_suffix(stream).cast("int").alias("nr"), F.col(box)["x"].alias("x"), F.col(box)["y"].alias("y"), F.array(F.col(box)["height"], F.col(box)["width"], F.lit(1)).alias("dims"), F.col(image).alias("data"))
    g = tiles.filter(F.octet_length(image) > 0).withColumn("_base", base_stream(stream)).groupBy(F.col("_base").alias(stream), seq).agg(
        F.max(F.col(box)["x"] + F.col(box)["width"]).alias("width"), F.max(F.col(box)["y"] + F.col(box)["height"]).alias("height"), F.array_sort(F.collect_list(one)).alias("_tiles")
    )

    @F.pandas_udf("binary")
    def run(ts: pd.Series, ws: pd.Series, hs: pd.Series) -> pd.Series:
        out = []
        for listed, w, h in zip(ts, ws, hs, strict=True):
            a = np.zeros((int(h), int(w)), np.uint8)
            for t in listed:
                rows, cols, _ = t["dims"]
                part = np.frombuffer(bytes(t["data"]), np.uint8).reshape(rows, cols)
                a[max(0, t["y"]) : t["y"] + rows, max(0, t["x"]) : t["x"] + cols] = part[max(0, -t["y"]) :, max(0, -t["x"]) :]
            out.append(a.tobytes())
        return pd.Series(out, dtype=object)

    return g.select(stream, seq, "width", "height", run("_tiles", "width", "height").alias(image))


def recombine(tiles: DataFrame, keys: Sequence[str] = ("stream_id", "sequence_nr"), box: str = "bbox", features: str | None = None, count: int | None = None) -> DataFrame:
    """The frame that tiles came from: (base stream, sequence, width, height, n_tiles), and its merged features.

    width and height are the largest right and bottom edge of the tiles. With ``features``, an array of (name, sparse,
    and dense and metadata if they have them), descriptors are moved by the tile's origin and merged by name with all
    their fields; dense tensors are pasted at the tiles' corners, and metadata of a later tile adds the keys that the
    earlier ones lack. ``boxes`` are the moved boxes alone. With ``count``, only frames with that many tiles.
    """
    stream, seq = keys
    base = tiles.withColumn("_base", base_stream(stream))
    g = base.groupBy(F.col("_base").alias(stream), seq).agg(
        F.max(F.col(box)["x"] + F.col(box)["width"]).alias("width"),
        F.max(F.col(box)["y"] + F.col(box)["height"]).alias("height"),
        F.count_distinct(tile_suffix(stream)).alias("n_tiles"),
    )
    if count is not None:
        g = g.filter(F.col("n_tiles") == count)
    if features is None:
        return g
    element = _element(base, features)
    f = base.select(F.col("_base").alias(stream), seq, F.col(box).alias("_tile"), tile_suffix(stream).cast("int").alias("_nr"), F.explode(features).alias("_f"))
    f = f.select("*", F.transform(F.coalesce(F.col("_f.sparse"), F.array()), lambda d: moved(d, F.col("_tile.x"), F.col("_tile.y"))).alias("_sparse"))
    parts = {"boxes": F.sort_array(F.flatten(F.collect_list(F.transform("_sparse", lambda d: d["bbox"])))), "sparse": in_order(F.flatten(F.collect_list("_sparse")), _element(f, "_sparse"))}
    if "metadata" in element.fieldNames():
        # Of the tiles in order, each adds the keys that those before it lack.
        maps = F.array_sort(F.collect_list(F.struct(F.col("_nr").alias("nr"), F.map_entries(F.coalesce(F.col("_f.metadata"), empty_map())).alias("m"))))
        parts["metadata"] = F.aggregate(maps, empty_map(), lambda a, m: inherit_metadata(a, F.map_from_entries(m["m"])))
    if "dense" in element.fieldNames():
        tensor = F.struct(F.col("_nr").alias("nr"), F.col("_tile.x").alias("x"), F.col("_tile.y").alias("y"), F.col("_f.dense.dims").alias("dims"), F.col("_f.dense.data").alias("data"))
        parts["dense"] = F.array_sort(F.collect_list(F.when(F.size("_f.dense.data") > 0, tensor)))
    by_name = f.groupBy(stream, seq, F.col("_f.name").alias("name")).agg(*[c.alias(n) for n, c in parts.items()])
    by_name = by_name.join(g.select(stream, seq, "width", "height"), [stream, seq])
    if "dense" in parts:
        by_name = by_name.withColumn("dense", pasted(F.col("dense"), F.col("width"), F.col("height")))
    fields = F.struct(F.col("name"), *parts)
    named = by_name.groupBy(stream, seq).agg(in_order(F.collect_list(fields), T.StructType([T.StructField("name", T.StringType())])).alias("features"))
    return g.join(named, [stream, seq], "left")


def _element(df: DataFrame, column: str) -> T.StructType:
    """The type of an array column's elements."""
    return df.schema[column].dataType.elementType


def empty_map() -> Column:
    return F.from_json(F.lit("{}"), "map<string,string>")


def moved(descriptor: Column, dx: Column, dy: Column) -> Column:
    """A descriptor with its box moved, and all else as it is."""
    b = descriptor["bbox"]
    return descriptor.withField("bbox", F.when(b.isNotNull(), bbox(b["x"] + dx, b["y"] + dy, b["width"], b["height"])))


def in_order(array: Column, element: T.StructType) -> Column:
    """An array of structs in the order of their fields, the box first; maps don't count."""
    names = sorted((f.name for f in element.fields if not isinstance(f.dataType, T.MapType)), key=lambda n: n != "bbox")
    key = lambda d: F.struct(*[d[n] for n in names])
    return F.array_sort(array, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))


def pasted(tensors: Column, width: Column, height: Column) -> Column:
    """dense (dims [height, width, depth], data) of a frame from those of its tiles, each at its tile's corner.

    tensors: array of (nr, x, y, dims, data) with dims [rows, columns, depth]; where tiles overlap, the later one holds;
    what no tile covers is 0, what lies outside is cut. Tensors of another rank or depth than the first, or with data
    shorter than their dims say, are left out; null without any.
    """

    @F.pandas_udf("struct<dims array<int>, data array<float>>")
    def run(ts: pd.Series, ws: pd.Series, hs: pd.Series) -> pd.DataFrame:
        dims, data = [], []
        for listed, w, h in zip(ts, ws, hs, strict=True):
            out = None
            for t in listed if listed is not None and w == w and h == h else ():
                d = list(t["dims"]) if t["dims"] is not None else []
                if len(d) != 3 or min(d) < 1 or len(t["data"]) < d[0] * d[1] * d[2] or (out is not None and d[2] != out.shape[2]):
                    continue
                if out is None:
                    out = np.zeros((int(h), int(w), d[2]), np.float32)
                part = np.asarray(t["data"], np.float32)[: d[0] * d[1] * d[2]].reshape(d)
                y, x = max(0, t["y"]), max(0, t["x"])
                y2, x2 = min(out.shape[0], t["y"] + d[0]), min(out.shape[1], t["x"] + d[1])
                if y < y2 and x < x2:
                    out[y:y2, x:x2] = part[y - t["y"] : y2 - t["y"], x - t["x"] : x2 - t["x"]]
            dims.append(None if out is None else np.array(out.shape, np.int32))
            data.append(None if out is None else out.ravel())
        return pd.DataFrame({"dims": pd.Series(dims, dtype=object), "data": pd.Series(data, dtype=object)})

    out = run(tensors, width, height)
    return F.when(out["dims"].isNotNull(), out)


def regions(
    df: DataFrame,
    names: Sequence[str],
    spacing: int = 0,
    min_size: tuple[int, int] = (0, 0),
    max_size: tuple[int, int] = (2**31 - 1, 2**31 - 1),
    stream: str = "stream_id",
    box: str = "bbox",
    features: str = "features",
) -> DataFrame:
    """One row per descriptor box of the named features: the region ``roi``, its number, and the points inside it.

    The size test is on the box itself; then spacing is added on every side and the region is cut at the frame. Boxes
    of all features that begin inside the region come along as ``inside`` (name, bbox counted from the region's corner,
    and the descriptor as it was, with its values, duration and header). Regions outside the frame, and frames without a box, are dropped; image bytes are no concern here, so a frame without an
    image has regions too.
    """
    whole = df.filter(F.col(box).isNotNull())
    all_boxes = F.flatten(F.transform(F.coalesce(F.col(features), F.array()), lambda f: F.transform(F.coalesce(f["sparse"], F.array()), lambda d: F.struct(f["name"].alias("name"), d["bbox"].alias("bbox"), d.alias("descriptor")))))
    wanted = F.filter(all_boxes, lambda d: d["name"].isin(list(names)) & d["bbox"].isNotNull())
    sized = F.filter(
        wanted,
        lambda d: (d["bbox"]["width"] >= min_size[0]) & (d["bbox"]["height"] >= min_size[1]) & (d["bbox"]["width"] <= max_size[0]) & (d["bbox"]["height"] <= max_size[1]),
    )
    rest = [c for c in df.columns if c not in (stream, box, features)]
    rows = whole.select(F.col(stream).alias("_s"), *rest, F.col(box).alias("_frame"), all_boxes.alias("_all"), F.posexplode(sized).alias("roi_nr", "_d"))
    rows = rows.withColumn("roi", intersect(pad(F.col("_d.bbox"), F.lit(spacing)), F.col("_frame"))).filter(~is_empty("roi"))
    inside = F.transform(
        F.filter(F.col("_all"), lambda d: contains_point(F.col("roi"), d["bbox"]["x"], d["bbox"]["y"])),
        lambda d: d.withField("bbox", bbox(d["bbox"]["x"] - F.col("roi.x"), d["bbox"]["y"] - F.col("roi.y"), d["bbox"]["width"], d["bbox"]["height"])),
    )
    return rows.select(F.concat_ws("_", "_s", F.col("roi_nr").cast("string")).alias(stream), *rest, "roi_nr", F.col("_d.name").alias("name"), "roi", inside.alias("inside"))


def combine_features(particles: DataFrame, expected: int | None = None) -> DataFrame:
    """Frames and Features of one (stream_id, sequence_nr) into one Frame: features merged by name, sparse lists joined.

    particles: (stream_id, sequence_nr, type, ts_ms, bbox, features, name, sparse, dense); a frame row has ``features``,
    a feature row ``name``, ``sparse`` and ``dense``; columns that are missing are null. Descriptors keep all their
    fields (``boxes`` are their boxes alone); of the dense tensors of one name the frame's own comes out, else the
    longest. The first frame gives ts_ms and bbox; without one the frame is empty: type
    none, ts 0, an empty box. With ``expected``, only groups of exactly that many particles (others still wait).
    """
    keys = ["stream_id", "sequence_nr"]
    types = {f.name: f.dataType.simpleString() for f in particles.schema.fields}
    sparse = types.get("sparse", f"array<struct<bbox:{BBOX.simpleString()}>>")
    kinds = {"ts_ms": "long", "bbox": BBOX.simpleString(), "features": f"array<struct<name:string,sparse:{sparse}>>", "name": "string", "sparse": sparse, "dense": DENSE.simpleString()}
    particles = particles.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in types})
    has_dense = "dense" in _element(particles, "features").fieldNames()
    part = lambda name, sparse, dense: F.struct(name.alias("name"), sparse.alias("sparse"), dense.alias("dense"))
    own = F.transform(F.coalesce(F.col("features"), F.array()), lambda f: part(f["name"], f["sparse"], f["dense"] if has_dense else F.lit(None).cast(DENSE.simpleString())))
    listed = F.when(F.col("type") == "frame", own).otherwise(F.array(part(F.col("name"), F.col("sparse"), F.col("dense"))))
    head = particles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_particles"),
        F.min(F.when(F.col("type") == "frame", F.struct(F.col("ts_ms"), F.col("bbox")))).alias("_frame"),
    )
    if expected is not None:
        head = head.filter(F.col("n_particles") == expected)
    each = particles.select(*keys, (F.col("type") == "frame").alias("_own"), F.explode(listed).alias("_f")).filter("_f.name is not null")
    each = each.select(*keys, "_own", "_f.name", F.coalesce(F.col("_f.sparse"), F.array()).alias("_sparse"), "_f.dense")
    whole = F.flatten(F.collect_list("_sparse"))
    tensor = F.when(F.size("dense.data") > 0, F.struct(F.coalesce("_own", F.lit(False)).alias("own"), F.size("dense.data").alias("n"), F.col("dense")))
    merged = each.groupBy(*keys, "name").agg(whole.alias("_all"), F.max(tensor)["dense"].alias("dense"))
    boxes = F.sort_array(F.transform("_all", lambda d: d["bbox"]))
    merged = merged.select(*keys, F.struct("name", boxes.alias("boxes"), in_order(F.col("_all"), _element(each, "_sparse")).alias("sparse"), "dense").alias("_m"))
    named = merged.groupBy(*keys).agg(in_order(F.collect_list("_m"), T.StructType([T.StructField("name", T.StringType())])).alias("features"))
    out = head.join(named, keys, "left")
    return out.select(
        *keys,
        "n_particles",
        F.when(F.col("_frame").isNull(), F.lit("none")).otherwise(F.lit("frame")).alias("image_type"),
        F.coalesce(F.col("_frame.ts_ms"), F.lit(0)).alias("ts_ms"),
        F.coalesce(F.col("_frame.bbox"), bbox(0, 0, 0, 0)).alias("bbox"),
        "features",
    )


def with_parent_metadata(child: DataFrame, parent: DataFrame, on: Sequence[str]) -> DataFrame:
    """child with its parent's metadata keys that it lacks; a child without a parent keeps its own."""
    p = parent.select(*on, F.col("metadata").alias("_parent"))
    return child.join(p, list(on), "left").withColumn("metadata", inherit_metadata(F.col("metadata"), F.col("_parent"))).drop("_parent")


def features_of(df: DataFrame, features: str = "features") -> DataFrame:
    """The features of frames as rows; frames without features have none."""
    rest = [c for c in df.columns if c not in (features, "name", "sparse", "dense", "duration")]
    return df.select(*rest, F.explode(features).alias("_f")).select(*rest, "_f.name", "_f.duration", "_f.sparse", "_f.dense")


def sequential(df: DataFrame, steps: Sequence, output_frame: bool = True, retain_image: bool = True) -> DataFrame:
    """Apply operators one after the other; give the frame or its features, with or without the image."""
    for step in steps:
        df = df.transform(step)
    if not retain_image and "image" in df.columns:
        df = df.drop("image")
    return df if output_frame else features_of(df)
