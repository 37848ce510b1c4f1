import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from frameflow.operators.pixels import png
from frameflow.sources import files, polling


def test_images_and_videos(spark, tmp_path):
    a = np.arange(48, dtype=np.uint8).reshape(6, 8)
    (tmp_path / "one.png").write_bytes(png(a))
    (tmp_path / "two.PNG").write_bytes(png(np.stack([a, a, a], axis=-1)))
    (tmp_path / "clip.mp4").write_bytes(b"abc")
    (tmp_path / "note.txt").write_bytes(b"no")
    sub = tmp_path / "sub"
    sub.mkdir()
    (sub / "three.png").write_bytes(png(a))
    f = files.read_images(spark, str(tmp_path))
    rows = f.collect()
    assert len(rows) == 2 and {r["image_type"] for r in rows} == {"png"} and {r["sequence_nr"] for r in rows} == {0}
    assert all(r["metadata"]["uri"].lower().endswith(".png") for r in rows)
    assert files.read_images(spark, str(tmp_path), recursive=True).count() == 3
    v = files.read_videos(spark, str(tmp_path)).collect()
    assert [(r["container"], bytes(r["video"]), r["n_frames"]) for r in v] == [("mp4", b"abc", None)]
    d = files.decode_images(spark, [str(tmp_path / "one.png"), str(tmp_path / "two.PNG")]).collect()
    assert sorted((r["width"], r["height"], r["n_channels"]) for r in d) == [(8, 6, 1), (8, 6, 3)]
    gray = next(r for r in d if r["n_channels"] == 1)
    assert bytes(gray["image"]) == a.tobytes()  # what was written comes back


def test_png_is_well_formed():
    body = png(np.zeros((2, 3), np.uint8))
    at = 8
    while at < len(body):
        n, kind = struct.unpack(">I4s", body[at : at + 8])
        assert struct.unpack(">I", body[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body[at + 8 : at + 8 + n])
        at += 12 + n


def test_polled_images(spark, tmp_path):
    polling.register(spark)
    files.ship(spark)
    a = tmp_path / "a.jpg"
    a.write_bytes(b"1")
    q = spark.readStream.format("polled_images").option("paths", f"{a},{tmp_path / 'missing.jpg'}").option("polls", "3").load()
    s = q.writeStream.format("memory").queryName("polled").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        s.processAllAvailable()
    finally:
        s.stop()
    got = spark.table("polled").orderBy("sequence_nr").collect()
    assert [(r["stream_id"], r["sequence_nr"], bytes(r["image"])) for r in got] == [("a.jpg", i, b"1") for i in range(3)]


def test_image_files_sink(spark, tmp_path):
    polling.register(spark)
    df = spark.createDataFrame([("s", 1, b"x"), ("s", 2, None), (None, 3, b"y")], "stream_id string, sequence_nr long, image binary")
    for _ in range(2):  # a second run writes the same files
        df.write.format("image_files").option("path", str(tmp_path / "out")).mode("append").save()
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["s_1.png"]


def test_file_system_settings(spark):
    files.register_file_system(spark, "demo", "org.apache.hadoop.fs.LocalFileSystem", fs__demo__key="k")
    conf = spark._jsc.hadoopConfiguration()
    assert conf.get("fs.demo.impl").endswith("LocalFileSystem") and conf.get("fs.demo.key") == "k"
    assert "*.{jpg,JPG" in files.extension_glob(["jpg"]) and F is not None
