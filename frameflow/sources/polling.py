"""A source that polls images again and again, and a sink that writes image files, by Spark's Python data sources."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceWriter, SimpleDataSourceStreamReader, WriterCommitMessage
from pyspark.sql.types import StructType

POLLED = "stream_id string, sequence_nr long, polled_ms long, image binary, uri string"


class PolledImages(DataSource):
    """``spark.readStream.format("polled_images").option("paths", "a,b").option("polls", n).load()``

    Every trigger reads each path anew: one row per path with a number that rises by one per poll of the path. Paths
    are files that all executors see. A path that can't be read at a poll gives no row at that poll. ``polls`` ends
    the source after so many polls (default: never).
    """

    @classmethod
    def name(cls) -> str:
        return "polled_images"

    def schema(self) -> str:
        return POLLED

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Poller(self.options)


class _Poller(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.paths = [p for p in options["paths"].split(",") if p]
        self.polls = int(options.get("polls", 2**62))

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def _rows(self, poll: int) -> list[tuple]:
        out = []
        for p in self.paths:
            try:
                with open(p.removeprefix("file://"), "rb") as f:
                    out.append((os.path.basename(p), poll, int(time.time() * 1000), f.read(), p))
            except OSError:
                continue
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        poll = start["poll"]
        if poll >= self.polls:
            return iter(()), start
        return iter(self._rows(poll)), {"poll": poll + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for poll in range(start["poll"], end["poll"]):
            yield from self._rows(poll)


class ImageFiles(DataSource):
    """``df.write.format("image_files").option("path", folder).mode("append").save()``

    Writes (stream_id, sequence_nr, image) rows as ``<stream_id>_<sequence_nr>.<extension>`` files of their bytes. The
    name depends on the row alone, so that a task that runs twice writes the same file; rows with a null column are
    skipped. The folder must be one that all executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _ImageWriter(self.options["path"].removeprefix("file://"), self.options.get("extension", "png"))


class _Written(WriterCommitMessage):
    def __init__(self, n: int):
        self.n = n


class _ImageWriter(DataSourceWriter):
    def __init__(self, folder: str, extension: str):
        self.folder, self.extension = folder, extension

    def write(self, rows) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        n = 0
        for r in rows:
            if r["stream_id"] is None or r["sequence_nr"] is None or r["image"] is None:
                continue
            name = f"{r['stream_id']}_{r['sequence_nr']}.{self.extension}".replace("/", "_")
            part = os.path.join(self.folder, f".{name}.{os.getpid()}")
            with open(part, "wb") as f:
                f.write(bytes(r["image"]))
            os.replace(part, os.path.join(self.folder, name))
            n += 1
        return _Written(n)


def register(spark) -> None:
    """Make both formats known to the session."""
    spark.dataSource.register(PolledImages)
    spark.dataSource.register(ImageFiles)


__all__ = ["ImageFiles", "PolledImages", "register"]
