"""Particle schemas as Spark types, and small helpers on the common header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BBOX = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x", "y", "width", "height")])
HEADER = [
    T.StructField("request_id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("stream_id", T.StringType()),
    T.StructField("sequence_nr", T.LongType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
]
DESCRIPTOR = T.StructType(
    HEADER + [T.StructField("bbox", BBOX), T.StructField("duration", T.LongType()), T.StructField("values", T.ArrayType(T.FloatType()))]
)
DENSE = T.StructType([T.StructField("dims", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(T.FloatType()))])
FEATURE = T.StructType(
    HEADER
    + [
        T.StructField("name", T.StringType()),
        T.StructField("duration", T.LongType()),
        T.StructField("sparse", T.ArrayType(DESCRIPTOR)),
        T.StructField("dense", DENSE),
    ]
)
FRAME = T.StructType(
    HEADER
    + [
        T.StructField("image_type", T.StringType()),
        T.StructField("image", T.BinaryType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("bbox", BBOX),
        T.StructField("features", T.ArrayType(FEATURE)),
    ]
)
GROUP = T.StructType(HEADER + [T.StructField("frames", T.ArrayType(FRAME))])
CHUNK = T.StructType(
    HEADER + [T.StructField("n_frames", T.LongType()), T.StructField("video", T.BinaryType()), T.StructField("container", T.StringType())]
)
PARTICLES = {"descriptor": DESCRIPTOR, "feature": FEATURE, "frame": FRAME, "group": GROUP, "chunk": CHUNK}


def bbox(x, y, width, height) -> Column:
    """A bbox struct of INT fields from columns or numbers."""
    as_int = lambda v, n: (v if isinstance(v, Column) else F.lit(v)).cast("int").alias(n)
    return F.struct(as_int(x, "x"), as_int(y, "y"), as_int(width, "width"), as_int(height, "height"))


def normal_stream(c: Column | str = "stream_id") -> Column:
    """Stream ids compare without surrounding blanks and without case."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def normal_type(c: Column | str = "type") -> Column:
    """The type tag in one spelling; null stays null."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def inherit_metadata(child: Column, parent: Column) -> Column:
    """Metadata of the output, plus the input's keys that it lacks (the child's value wins); null counts as empty."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    own, base = F.coalesce(child, empty), F.coalesce(parent, empty)
    return F.map_concat(own, F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)))


def as_particle(df: DataFrame, kind: str, stream: Column, seq: Column, request_id: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """Put the five header columns first; the other columns stay behind them."""
    head = [
        (request_id if request_id is not None else F.lit(-1)).cast("long").alias("request_id"),
        F.lit(kind).alias("type"),
        stream.cast("string").alias("stream_id"),
        seq.cast("long").alias("sequence_nr"),
        (metadata if metadata is not None else F.lit(None).cast("map<string,string>")).alias("metadata"),
    ]
    names = {"request_id", "type", "stream_id", "sequence_nr", "metadata"}
    return df.select(*head, *[c for c in df.columns if c not in names])
