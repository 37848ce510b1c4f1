"""Filters and routes of particles. A filter is a predicate, a route an exchange; both are lazy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameflow.functions.columns import base_stream, is_tile, tile_suffix
from frameflow.schema import normal_type


def sample(df: DataFrame, skip: int, group: int = 1, seq: str = "sequence_nr") -> DataFrame:
    """Of every ``skip`` frames the first ``group``; both are at least 1. Null numbers are dropped."""
    return df.filter(F.col(seq) % max(1, skip) < max(1, group))


def mod_filter(df: DataFrame, mod: int, seq: str = "sequence_nr") -> DataFrame:
    """Rows whose number is a multiple of ``mod``."""
    return df.filter(F.col(seq) % mod == 0)


def feature_filter(df: DataFrame, name: str, column: str = "name") -> DataFrame:
    """Features of one name."""
    return df.filter(F.col(column) == name)


def has_any_key(keys: Sequence[str], metadata: str = "metadata") -> Column:
    """Whether the metadata has one of the keys; null metadata has none."""
    return F.coalesce(F.arrays_overlap(F.map_keys(metadata), F.array(*map(F.lit, keys))), F.lit(False))


def accepts(accept: Mapping[str, Sequence[str]], metadata: str = "metadata") -> Column:
    """Whether any key has any of its accepted values."""
    tests = [F.coalesce(F.col(metadata)[k].isin(list(v)), F.lit(False)) for k, v in accept.items()]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def route(df: DataFrame, partitions: int, *keys: str | Column) -> DataFrame:
    """Rows of equal keys together; without keys spread evenly."""
    return df.repartition(partitions, *keys) if keys else df.repartition(partitions)


def route_by_metadata(df: DataFrame, partitions: int, keys: Sequence[str], metadata: str = "metadata") -> DataFrame:
    """Rows with one of the keys, together by the values of the keys."""
    return df.filter(has_any_key(keys, metadata)).repartition(partitions, *[F.col(metadata)[k] for k in keys])


def target_of(keys: Sequence[Column], targets: int) -> Column:
    """The number of the consumer that a hash route picks, never negative."""
    return F.pmod(F.hash(*keys), F.lit(targets))


def supervised_target(producer: Column, targets: int) -> Column:
    """The fixed consumer of the producer with this number from 0; an unknown producer (null) has none."""
    return F.pmod(producer, F.lit(targets))


def to_base_stream(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Tiles under the stream they came from, together with the tiles of the same frame."""
    out = df.withColumn("stream_id", F.when(is_tile("stream_id"), base_stream("stream_id")).otherwise(F.col("stream_id")))
    return out.repartition(partitions, "stream_id", "sequence_nr") if partitions else out


def tiles_only(df: DataFrame, accepted: Sequence[int]) -> DataFrame:
    """Rows of tile streams with one of the tile numbers."""
    return df.filter(is_tile("stream_id") & tile_suffix("stream_id").isin([str(i) for i in accepted]))


def of_type(df: DataFrame, kind: str) -> DataFrame:
    """Particles of one type, in whatever spelling."""
    return df.filter(normal_type("type") == kind)


def fan_in(*frames: DataFrame) -> DataFrame:
    """Several edges into one: columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def split_owner(index: Column, tasks: int) -> Column:
    """Round-robin owner of the location with this number from 0."""
    return F.pmod(index, F.lit(tasks))


def block_owner(index: Column, total: Column, tasks: int) -> Column:
    """Owner by contiguous blocks that differ by at most one location, and leave none out."""
    return F.floor(index * F.lit(tasks) / total).cast("int")
