"""Queries of the image and vision kernels over all frames; thumbnails are 8 samples wide."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameflow.operators import pixels, vision
from frameflow.operators.media import frame_pairs
from frameflow.operators.messages import kept_messages
from frameflow.plans.particles import frames
from frameflow.sources.tables import table

W = 8
_BYTES = "(select delivery_id, hex(image) as x, octet_length(image) as n from frames where octet_length(image) > 0)"


def _image(spark, d):
    return table(spark, d, "frames").select("delivery_id", "image", F.lit(W).alias("w"))


def histogram(spark, d):
    """Counts of each image's samples in 16 bins, non-empty bins only."""
    h = _image(spark, d).select("delivery_id", F.posexplode(pixels.histogram(F.col("image"), 16)).alias("bin", "n"))
    return h.filter("n > 0")


def grayscale(spark, d):
    """Gray of whole rows: here the images themselves, cut to whole rows."""
    g = _image(spark, d).select("delivery_id", pixels.grayscale(F.col("image"), F.col("w"), 1).alias("image"))
    return g.filter("image is not null").select("delivery_id", F.hex("image").alias("gray"))


def scale_pixels(spark, d):
    s = _image(spark, d).select("delivery_id", pixels.scale(F.col("image"), F.col("w"), 0.5).alias("s"))
    return s.filter("s.image is not null").select("delivery_id", "s.width", "s.height", F.hex("s.image").alias("image"))


def equalize(spark, d):
    e = _image(spark, d).select("delivery_id", pixels.equalize(F.col("image"), F.col("w")).alias("e"))
    return e.filter("e is not null").select("delivery_id", F.hex("e").alias("image"))


def draw(spark, d):
    """Boxes of the frame's features, scaled to the thumbnail, drawn into it."""
    f = table(spark, d, "frames").select("delivery_id", "image", "bbox", "features")
    boxes = F.flatten(F.transform(F.coalesce("features", F.array()), lambda x: F.transform(F.coalesce(x["sparse"], F.array()), lambda p: p["bbox"])))
    by = F.greatest(F.lit(1), F.floor(F.coalesce(F.col("bbox.width"), F.lit(320)) / W).cast("int"))
    small = F.transform(boxes, lambda b: F.struct(*[F.floor(b[c] / by).cast("int").alias(c) for c in ("x", "y", "width", "height")]))
    g = f.select("delivery_id", pixels.draw(F.col("image"), F.lit(W), small).alias("i"))
    return g.filter("i is not null").select("delivery_id", F.hex("i").alias("image"))


def keypoints(spark, d):
    k = _image(spark, d).select("delivery_id", vision.keypoints(F.col("image"), F.col("w")).alias("k"))
    return k.filter("k is not null").select("delivery_id", F.size("k").alias("n_keypoints"))


#: A stump that answers to a dark left half beside a bright right one, as a small stand-in for a trained model.
EDGE = vision.Cascade(4, 4, [(0.5, [vision.Weak([(0, 0, 4, 4, -1.0), (2, 0, 2, 4, 2.0)], 0.5, 0.0, 1.0)])])


def cascade(spark, d):
    c = _image(spark, d).select("delivery_id", vision.cascade_boxes(F.col("image"), F.col("w"), EDGE, neighbours=1).alias("b"))
    return c.filter("b is not null").select("delivery_id", F.explode("b").alias("box")).select("delivery_id", "box.*")


def background(spark, d):
    f = vision.foreground(kept_messages(table(spark, d, "frames")), W)
    return f.select("stream_id", "sequence_nr", "foreground", "pixels", F.size("boxes").alias("n_blobs"))


def optical_flow(spark, d):
    """Flow of neighbouring frames one number apart: its mean length."""
    f = frames(spark, d).filter("stream_id is not null and sequence_nr is not null and length(image) > 0")
    f = f.groupBy("stream_id", "sequence_nr").agg(F.min("image").alias("image"))
    p = frame_pairs(f, ["stream_id"], "sequence_nr", ["image"], 1)
    flow = p.select("stream_id", "first_seq", "duration", vision.optical_flow(F.col("first.image"), F.col("second.image"), F.lit(W)).alias("dense")).filter("dense.data is not null")
    total = F.aggregate(F.sequence(F.lit(0), F.size("dense.data") - 1, F.lit(2)), F.lit(0.0), lambda s, i: s + F.hypot(F.get("dense.data", i), F.get("dense.data", i + 1)))
    return flow.select("stream_id", "first_seq", "duration", F.array_join(F.col("dense.dims").cast("array<string>"), "x").alias("dims"), F.round(total / (F.size("dense.data") / 2), 3).alias("mean_length"))


def flow_image(spark, d):
    f = table(spark, d, "features").filter("name = 'flow'").select("feature_id", pixels.flow_image(F.col("dense.dims"), F.col("dense.data")).alias("i"))
    return f.filter("i is not null").select("feature_id", F.hex("i").alias("image"))


def png_files(spark, d):
    p = _image(spark, d).select("delivery_id", pixels.encode_png(F.col("image"), F.col("w")).alias("png")).filter("png is not null")
    return p.select("delivery_id", F.length("png").alias("n_bytes"), F.crc32("png").alias("crc"))


QUERIES = {f.__name__: f for f in (histogram, grayscale, scale_pixels, equalize, draw, keypoints, cascade, background, optical_flow, flow_image, png_files)}
_SAMPLE = "('0x' || substr(x, 2 * i + 1, 2))::int"
ORACLES = {
    "histogram": f"""select delivery_id, ({_SAMPLE} // 16)::int as bin, count(*)::int as n from {_BYTES}, range(0, 4096) r(i) where i < n group by 1, 2""",
    "grayscale": f"select delivery_id, substr(x, 1, 2 * {W} * (n // {W})) as gray from {_BYTES} where n >= {W}",
    "equalize": f"""with p as (select delivery_id, i, {_SAMPLE} as v, n // {W} * {W} as m from {_BYTES}, range(0, 4096) r(i) where i < n // {W} * {W}),
  h as (select delivery_id, m, v, count(*) as c from p group by 1, 2, 3),
  k as (select *, sum(c) over (partition by delivery_id order by v) as cum, first_value(c) over (partition by delivery_id order by v) as c0 from h),
  l as (select delivery_id, v, case when c0 = m then v else round_even((cum - c0) * 255.0 / (m - c0), 0)::int end as e from k)
select p.delivery_id, string_agg(printf('%02X', l.e), '' order by p.i) as image from p join l on p.delivery_id = l.delivery_id and p.v = l.v group by 1""",
}
