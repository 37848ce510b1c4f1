import numpy as np
from pyspark.sql import functions as F

from frameflow.operators import pixels, vision

RNG = np.random.default_rng(0)


def run(spark, image, width, f):
    df = spark.createDataFrame([(image, width)], "i binary, w int")
    return df.select(f(F.col("i"), F.col("w")).alias("o")).first()["o"]


def test_gray_and_scale(spark):
    bgr = bytes([10, 20, 30, 255, 255, 255])
    assert bytes(run(spark, bgr, 2, pixels.grayscale)) == bytes([round(1.14 + 11.74 + 8.97), 255])
    a = RNG.integers(0, 256, (6, 8), dtype=np.uint8)
    s = run(spark, a.tobytes(), 8, lambda i, w: pixels.scale(i, w, 0.5))
    assert (s["width"], s["height"]) == (4, 3)
    assert abs(int(bytes(s["image"])[0]) - a[:2, :2].mean()) <= 0.5
    up = pixels.scale_array(np.full((4, 4), 9, np.uint8), 2.0)
    assert up.shape == (8, 8) and (up == 9).all()
    assert pixels.scale_array(a, 1.0).tolist() == a.tolist()
    assert pixels.scale_array(np.zeros((480, 640), np.uint8), 0.66).shape == (317, 422)


def test_missing_images(spark):
    for image, width in ((None, 8), (b"", 8), (b"abc", 8), (b"abc", 0), (b"abc", None)):
        assert run(spark, image, width, lambda i, w: pixels.grayscale(i, w, 1)) is None
        assert run(spark, image, width, pixels.equalize) is None
        assert run(spark, image, width, vision.keypoints) is None
        assert run(spark, image, width, lambda i, w: pixels.scale(i, w, 0.3))["image"] is None


def test_crop_draw_histogram(spark):
    a = np.arange(64, dtype=np.uint8).reshape(8, 8)
    box = lambda x, y, w, h: F.struct(*[F.lit(v).alias(n) for v, n in zip((x, y, w, h), ("x", "y", "width", "height"), strict=True)])
    c = run(spark, a.tobytes(), 8, lambda i, w: pixels.crop(i, w, box(6, 1, 5, 2)))
    assert (c["width"], c["height"], list(bytes(c["image"]))) == (2, 2, [14, 15, 22, 23])
    assert run(spark, a.tobytes(), 8, lambda i, w: pixels.crop(i, w, box(9, 9, 2, 2)))["image"] is None
    d = np.frombuffer(bytes(run(spark, a.tobytes(), 8, lambda i, w: pixels.draw(i, w, F.array(box(2, 2, 3, 3), box(7, 7, 0, 0))))), np.uint8).reshape(8, 8)
    assert (d == 255).sum() == 9 and d[7, 7] == 255 and d[3, 3] == a[3, 3]
    h = run(spark, a.tobytes(), 8, lambda i, w: pixels.histogram(i, 4, 0, 32))
    assert h == [8, 8, 8, 8]


def test_equalize():
    a = np.repeat(np.array([10, 20, 30, 40], np.uint8), 4).reshape(4, 4)
    assert pixels.equalize_array(a)[:, 0].tolist() == [0, 85, 170, 255]
    flat = np.full((3, 3), 7, np.uint8)
    assert pixels.equalize_array(flat).tolist() == flat.tolist()


def test_color():
    a = np.zeros((4, 4, 3), np.uint8)
    a[..., 2] = np.repeat([10, 20, 30, 40], 4).reshape(4, 4)
    a[..., 0] = a[..., 2] // 2
    e = pixels.equalize_value(a)
    assert e[:, 0, 2].tolist() == [0, 85, 170, 255] and abs(int(e[3, 0, 0]) - 128) <= 1
    assert (pixels.equalize_value(np.zeros((2, 2, 3), np.uint8)) == 0).all()


def test_channels(spark):
    bgr = bytes([0, 100, 200] * 4)
    h = [run(spark, bgr, 2, lambda i, w, c=c: pixels.histogram(i, 2, channel=c, channels=3)) for c in range(3)]
    assert h == [[4, 0], [4, 0], [0, 4]]


def test_blobs():
    m = np.zeros((12, 14), bool)
    m[1:7, 2:8] = True
    m[7:12, 8:13] = True  # touches by a corner
    m[0, 13] = True
    assert vision.blobs(m) == [(2, 1, 11, 11)]
    assert vision.blobs(m, 1) == [(2, 1, 11, 11), (13, 0, 1, 1)]
    assert vision.blobs(np.zeros((3, 3), bool)) == []


def test_flow_finds_a_shift():
    y, x = np.mgrid[0:24, 0:24]
    scene = lambda dx: 100 + 60 * np.sin((x - dx) / 3) + 40 * np.cos(y / 4)
    f = vision.flow_array(scene(0), scene(0.5), 3)
    inner = f[6:-6, 6:-6]
    assert abs(np.median(inner[..., 0]) - 0.5) < 0.15 and abs(np.median(inner[..., 1])) < 0.1
    assert (vision.flow_array(np.zeros((4, 4)), np.ones((4, 4))) == 0).all()


def test_keypoint_at_a_blob():
    y, x = np.mgrid[0:32, 0:32]
    blob = (200 * np.exp(-((x - 16) ** 2 + (y - 12) ** 2) / 5)).astype(np.uint8)
    k = vision.find_keypoints(blob, 2.0)
    assert k and min(abs(p[0] - 16) + abs(p[1] - 12) for p in k) <= 2
    assert all(len(p[4]) == 64 and abs(np.linalg.norm(p[4]) - 1) < 1e-5 for p in k)
    assert vision.find_keypoints(np.full((16, 16), 9, np.uint8)) == []


CASCADE = """<opencv_storage><cascade><height>4</height><width>4</width><stages><_><stageThreshold>0.5</stageThreshold><weakClassifiers>
<_><internalNodes>0 -1 0 0.5</internalNodes><leafValues>0. 1.</leafValues></_></weakClassifiers></_></stages>
<features><_><rects><_>0 0 4 4 -1.</_><_>2 0 2 4 2.</_></rects></_></features></cascade></opencv_storage>"""


def test_cascade(spark):
    c = vision.parse_cascade(CASCADE)
    assert (c.width, c.height, len(c.stages)) == (4, 4, 1)
    a = np.zeros((8, 12), np.uint8)
    a[:, 6:] = 200
    found = vision.detect(a, c, neighbours=1, max_size=(4, 4))
    assert found and all(x <= 6 <= x + w for x, _, w, _ in found)
    assert vision.detect(np.zeros((8, 12), np.uint8), c) == []
    got = run(spark, a.tobytes(), 12, lambda i, w: vision.cascade_boxes(i, w, c, neighbours=1, max_size=(4, 4)))
    assert [tuple(b) for b in got] == found


def test_background(spark):
    b = vision.Background((4, 4), 20)
    still = np.full((4, 4), 50, np.uint8)
    masks = [b.apply(still) for _ in range(40)]
    assert masks[0].all() and not masks[-1].any()
    moved = still.copy()
    moved[1, 2] = 200
    assert b.apply(moved).sum() == 1
    rows = [("s", n, bytes(moved.ravel() if n == 90 else still.ravel())) for n in range(100)] + [(None, 1, b"1234"), ("s", None, b"1234"), ("t", 1, None)]
    df = spark.createDataFrame(rows, "stream_id string, sequence_nr long, image binary")
    got = {r["sequence_nr"]: r["foreground"] for r in vision.foreground(df, 4, 20, chunk=32, warm_up=20).collect()}
    assert set(got) == set(range(100)) and got[90] == 1 and got[70] == 0


def test_background_learns_from_frames_not_numbers(spark):
    rng = np.random.default_rng(4)
    images = [rng.choice([40, 120, 200], (4, 4), p=[0.6, 0.3, 0.1]).astype(np.uint8) for _ in range(300)]
    df = spark.createDataFrame([("s", 13 * n, a.tobytes()) for n, a in enumerate(images)], "stream_id string, sequence_nr long, image binary")
    want = []
    for start in range(0, 300, 64):  # each chunk of 64 frames after the 60 before it
        b = vision.Background((4, 4), 20)
        for a in images[max(0, start - 60) : start]:
            b.apply(a)
        want += [int(b.apply(a).sum()) for a in images[start : start + 64]]
    got = {r["sequence_nr"] // 13: r["foreground"] for r in vision.foreground(df, 4, 20, chunk=64, warm_up=60).collect()}
    assert [got[n] for n in range(300)] == want
    whole = {r["sequence_nr"] // 13: r["foreground"] for r in vision.foreground(df, 4, 20, chunk=10**6, warm_up=60).collect()}
    assert sum(got[n] != whole[n] for n in range(64, 300)) < 30
