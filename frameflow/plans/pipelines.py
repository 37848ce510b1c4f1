"""Whole pipelines from source to sink, each composed of the library's operators over all frames.

Thumbnails are 8 samples wide; boxes are those of the full pictures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.functions.columns import scaled
from frameflow.operators import geometry, media, pixels, routing, vision
from frameflow.operators.matching import match
from frameflow.operators.messages import kept_messages
from frameflow.operators.windows import Discrete, Sliding
from frameflow.plans.matching import RATIO, _requests, _tables
from frameflow.plans.particles import frames
from frameflow.plans.pixels import EDGE, W
from frameflow.sources.tables import table


def _kept(spark, d, *columns) -> DataFrame:
    """One copy per (stream, number) with an image; which one doesn't depend on the order of rows."""
    f = frames(spark, d).filter("stream_id is not null and sequence_nr is not null and length(image) >= 8")
    copy = F.struct("delivery_id", *columns)
    return f.groupBy("stream_id", "sequence_nr").agg(F.min(copy).alias("_c")).select("stream_id", "sequence_nr", "_c.*")


def pipeline_gray(spark, d):
    """Every 13th frame, scaled, gray, ordered in pairs, the latest pair per stream."""
    f = routing.sample(_kept(spark, d, "image"), 13)
    small = f.withColumn("s", pixels.scale(F.col("image"), F.lit(W), 0.66)).select("stream_id", "sequence_nr", pixels.grayscale(F.col("s.image"), F.col("s.width"), 1).alias("gray"))
    pairs = Sliding(2, 13, 6).frame(small, ["stream_id"])
    last = media.latest(pairs.select("stream_id", F.col("last_seq").alias("sequence_nr")), ["stream_id"], ["sequence_nr"], [])
    return last.join(small, ["stream_id", "sequence_nr"]).select("stream_id", "sequence_nr", F.hex("gray").alias("gray"))


def pipeline_faces(spark, d):
    """Detections, padded regions around them, their crops as PNG."""
    f = _kept(spark, d, "image").withColumn("boxes", vision.cascade_boxes(F.col("image"), F.lit(W), EDGE, neighbours=1))
    one = F.array(F.struct(F.lit("face").alias("name"), F.transform("boxes", lambda b: F.struct(b.alias("bbox"))).alias("sparse")))
    box = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(W).alias("width"), F.floor(F.length("image") / W).cast("int").alias("height"))
    r = geometry.regions(f.select("stream_id", "sequence_nr", "image", box.alias("bbox"), one.alias("features")), ["face"], 1)
    crop = r.withColumn("c", pixels.crop(F.col("image"), F.lit(W), F.col("roi"))).filter("c.image is not null")
    return crop.select("stream_id", "sequence_nr", "roi_nr", F.length(pixels.encode_png(F.col("c.image"), F.col("c.width"))).alias("png_bytes"))


def _features(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detections and keypoints of frames, as two edges of features."""
    base = f.select("stream_id", "sequence_nr", "image")
    as_box = lambda k: F.struct(k["x"].alias("x"), k["y"].alias("y"), F.lit(0).alias("width"), F.lit(0).alias("height"))
    face = base.withColumn("b", vision.cascade_boxes(F.col("image"), F.lit(W), EDGE, neighbours=1))
    face = face.select(F.lit("feature").alias("type"), "stream_id", "sequence_nr", F.lit("face").alias("name"), F.transform("b", lambda b: F.struct(b.alias("bbox"))).alias("sparse"))
    keys = base.withColumn("k", vision.keypoints(F.col("image"), F.lit(W)))
    keys = keys.select(F.lit("feature").alias("type"), "stream_id", "sequence_nr", F.lit("keypoint").alias("name"), F.transform("k", lambda k: F.struct(as_box(k).alias("bbox"))).alias("sparse"))
    return face, keys


def _combined(df: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("features", lambda q: F.concat_ws(":", q["name"], F.size(q["boxes"]).cast("string"))), ",")
    return df.select("stream_id", "sequence_nr", "n_particles", text.alias("features"))


def pipeline_features(spark, d):
    """Two feature operators side by side, combined by stream and number."""
    f = routing.sample(_kept(spark, d, "image"), 13)
    return _combined(geometry.combine_features(routing.fan_in(*_features(f)), 2))


def pipeline_sequential(spark, d):
    """The same two operators fused on the frame, without an exchange between them."""
    f = routing.sample(_kept(spark, d, "image"), 13)
    steps = [lambda x: x.withColumn("face", vision.cascade_boxes(F.col("image"), F.lit(W), EDGE, neighbours=1)), lambda x: x.withColumn("keypoint", vision.keypoints(F.col("image"), F.lit(W)))]
    return geometry.sequential(f, steps, retain_image=False).select("stream_id", "sequence_nr", F.size("face").alias("n_face"), F.size("keypoint").alias("n_keypoint"))


def pipeline_tiles(spark, d):
    """Frames cut in tiles; tiles 1 and 2 inverted on an edge of their own, all united and put together again."""
    f = _kept(spark, d, "image").withColumn("width", F.lit(W))
    tiles = geometry.tile_pixels(f, 2, 2)
    dark = pixels.levels(routing.tiles_only(tiles, [1, 2]), "image", [255 - i for i in range(256)])
    rest = tiles.filter(~F.col("tile").isin(1, 2))
    back = geometry.paste_pixels(routing.fan_in(dark, rest))
    return back.select("stream_id", "sequence_nr", "width", "height", F.hex("image").alias("image"))


def pipeline_flow(spark, d):
    """Two of every 13 frames, in windows of two neighbours, their flow as an image."""
    f = routing.sample(_kept(spark, d, "image"), 13, 2)
    w = Discrete(2, 1).frame(f, ["stream_id"])
    pairs = w.join(f.select("stream_id", F.col("sequence_nr").alias("first_seq"), F.col("image").alias("a")), ["stream_id", "first_seq"])
    pairs = pairs.join(f.select("stream_id", F.col("sequence_nr").alias("last_seq"), F.col("image").alias("b")), ["stream_id", "last_seq"])
    flow = pairs.withColumn("f", vision.optical_flow(F.col("a"), F.col("b"), F.lit(W)))
    return flow.filter("f.data is not null").select("stream_id", "first_seq", "last_seq", F.hex(pixels.flow_image(F.col("f.dims"), F.col("f.data"))).alias("image"))


def pipeline_fused_draw(spark, d):
    """Keypoints found and drawn in the source's own stage."""
    f = _kept(spark, d, "image").withColumn("k", vision.keypoints(F.col("image"), F.lit(W)))
    boxes = F.transform("k", lambda k: F.struct(k["x"].alias("x"), k["y"].alias("y"), F.lit(0).alias("width"), F.lit(0).alias("height")))
    return f.select("stream_id", "sequence_nr", F.size("k").alias("n"), F.hex(pixels.draw(F.col("image"), F.lit(W), boxes)).alias("image"))


def pipeline_background(spark, d):
    """Streams by the share of their pixels that moved."""
    fg = vision.foreground(kept_messages(table(spark, d, "frames")), W)
    g = fg.groupBy("stream_id").agg(F.sum("foreground").alias("moved"), F.sum("pixels").alias("pixels"))
    return g.select("stream_id", "moved", "pixels")


def pipeline_match(spark, d):
    """The request call over two shards of the prototypes."""
    q, p = _tables(spark, d)
    return match(q.select("request_id").distinct(), q, p, RATIO, shards=2)


def pipeline_contrast(spark, d):
    """Equalized frames, the latest per stream."""
    last = media.latest(_kept(spark, d, "image"), ["stream_id"], ["sequence_nr"], ["image"])
    return last.select("stream_id", "sequence_nr", F.hex(pixels.equalize(F.col("image"), F.lit(W))).alias("image"))


def pipeline_deploy(spark, d):
    """Sampled, halved, described and drawn in one stage, the latest per stream."""
    f = routing.sample(_kept(spark, d, "image", "bbox"), 13)
    s = f.withColumn("s", pixels.scale(F.col("image"), F.lit(W), 0.5)).select("stream_id", "sequence_nr", "s.image", "s.width", scaled(F.col("bbox.width"), 0.5).alias("full_width"))
    k = s.withColumn("k", vision.keypoints(F.col("image"), F.col("width")))
    return media.latest(k.select("stream_id", "sequence_nr", "width", "full_width", F.size("k").alias("n_keypoints")), ["stream_id"], ["sequence_nr"], ["width", "full_width", "n_keypoints"])


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("pipeline_")}
ORACLES = {
    "pipeline_match": _requests("(p.proto_id % 2)::varchar"),
    "pipeline_tiles": """with k as (select lower(trim(stream_id)) as stream_id, sequence_nr, min({'d': delivery_id, 'i': image}).i as image
    from frames where stream_id is not null and sequence_nr is not null and octet_length(image) >= 8 group by 1, 2),
  s as (select stream_id, sequence_nr, hex(image) as x, octet_length(image) // 8 // 2 as h from k),
  p as (select stream_id, sequence_nr, h, i, ('0x' || substr(x, 2 * i + 1, 2))::int as v, (i % 8 >= 4)::int + 2 * (i // 8 >= h)::int as tile
    from s, range(0, 4096) r(i) where h >= 2 and i < 16 * h)
select stream_id, sequence_nr, 8 as width, (2 * h)::int as height, string_agg(printf('%02X', case when tile in (1, 2) then 255 - v else v end), '' order by i) as image
from p group by stream_id, sequence_nr, h""",
}
