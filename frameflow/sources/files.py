"""Files as particles: images and chunks through Spark's own readers, any scheme that Hadoop's file systems know."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.functions.columns import basename, source_stream
from frameflow.schema import as_particle
from frameflow.session import ship

# The file extensions of images and videos.
IMAGES = ("jpg", "jpeg", "png", "gif", "bmp")
VIDEOS = ("m2v", "mp4", "mkv", "ts", "flv", "avi", "mov", "wmv", "mpg", "mpeg")


def extension_glob(extensions: Sequence[str]) -> str:
    """A glob that takes the extensions in either case."""
    return "*.{" + ",".join(x for e in extensions for x in dict.fromkeys((e.lower(), e.upper()))) + "}"


def _files(spark: SparkSession, locations: str | Sequence[str], extensions: Sequence[str], recursive: bool) -> DataFrame:
    ship(spark)
    paths = [locations] if isinstance(locations, str) else list(locations)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", extension_glob(extensions)).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(paths)


def read_images(spark: SparkSession, locations: str | Sequence[str], extensions: Sequence[str] = IMAGES, recursive: bool = False) -> DataFrame:
    """One frame per image file: sequence_nr 0, image_type by the extension, the file's path as metadata uri.

    The bytes stay encoded. The scheme picks the file system: file, s3a, ftp, hdfs and any that is registered.
    """
    f = _files(spark, locations, extensions, recursive)
    kind = F.lower(F.substring_index(basename("path"), ".", -1))
    rows = f.select("path", F.when(kind == "jpeg", "jpg").otherwise(kind).alias("image_type"), F.col("content").alias("image"), F.lit(0).cast("long").alias("ts_ms"))
    return as_particle(rows, "frame", source_stream("path"), F.lit(0), metadata=F.create_map(F.lit("uri"), F.col("path"))).drop("path")


def decode_images(spark: SparkSession, locations: str | Sequence[str]) -> DataFrame:
    """Decoded images by Spark's image source: (path, width, height, n_channels, image) with BGR bytes; files that are
    no image are left out."""
    paths = [locations] if isinstance(locations, str) else list(locations)
    f = spark.read.format("image").option("dropInvalid", "true").load(paths)
    return f.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("image"))


def read_videos(spark: SparkSession, locations: str | Sequence[str], extensions: Sequence[str] = VIDEOS, recursive: bool = False) -> DataFrame:
    """One video chunk per file, its bytes not decoded: container by the extension, n_frames unknown (null)."""
    f = _files(spark, locations, extensions, recursive)
    rows = f.select("path", F.lit(None).cast("long").alias("n_frames"), F.col("content").alias("video"), F.lower(F.substring_index(basename("path"), ".", -1)).alias("container"))
    return as_particle(rows, "chunk", source_stream("path"), F.lit(0), metadata=F.create_map(F.lit("uri"), F.col("path"))).drop("path")


def register_file_system(spark: SparkSession, scheme: str, implementation: str, **settings: str) -> None:
    """Let paths of a scheme go through a Hadoop FileSystem class, with its settings (keys, users, passwords)."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set(f"fs.{scheme}.impl", implementation)
    for k, v in settings.items():
        conf.set(k.replace("__", "."), v)
