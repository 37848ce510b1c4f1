from pyspark.sql import functions as F

from frameflow.functions.columns import base_stream, frame_interval, is_tile, l2, magnitude, scaled
from frameflow.operators import geometry, routing
from frameflow.schema import FRAME, PARTICLES, as_particle, bbox, inherit_metadata


def boxes(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def frame(spark, w, h, x=0, y=0):
    return spark.range(1).select(F.lit("cam").alias("stream_id"), F.lit(1).alias("sequence_nr"), bbox(x, y, w, h).alias("bbox"))


def test_tiling(spark):
    t = lambda w, h, o=0: boxes(geometry.tiling(frame(spark, w, h), 2, 2, o).orderBy("tile"), "bbox.*")
    assert t(100, 80) == [(0, 0, 50, 40), (50, 0, 50, 40), (0, 40, 50, 40), (50, 40, 50, 40)]
    assert t(100, 80, 10) == [(0, 0, 60, 50), (50, 0, 50, 50), (0, 40, 60, 40), (50, 40, 50, 40)]
    assert t(101, 81)[3] == (50, 40, 50, 40)
    assert t(3, 80) == []
    assert boxes(geometry.tiling(frame(spark, 100, 80), 2, 2), "stream_id")[3] == ("cam_3",)


def test_tile_and_recombine_round_trip(spark):
    f = frame(spark, 100, 80)
    tiles = geometry.tiling(f, 2, 2)
    point = F.array(F.struct(F.lit("face").alias("name"), F.array(F.struct(bbox(3, 4, 0, 0).alias("bbox"))).alias("sparse")))
    r = geometry.recombine(tiles.withColumn("features", F.when(F.col("tile") == 3, point)), features="features", count=4)
    row = r.collect()[0]
    assert (row["stream_id"], row["width"], row["height"], row["n_tiles"]) == ("cam", 100, 80, 4)
    assert [(x["name"], [tuple(b) for b in x["boxes"]]) for x in row["features"]] == [("face", [(53, 44, 0, 0)])]
    assert geometry.recombine(tiles.filter("tile < 3"), count=4).count() == 0


def test_regions(spark):
    d = lambda x, y, w, h: F.struct(bbox(x, y, w, h).alias("bbox"))
    feature = lambda n, *p: F.struct(F.lit(n).alias("name"), F.array(*p).alias("sparse"))
    f = frame(spark, 100, 100).withColumn("features", F.array(feature("face", d(10, 20, 30, 40)), feature("sift", d(10, 20, 0, 0), d(70, 10, 0, 0))))
    r = geometry.regions(f, ["face"], 25).collect()
    assert [tuple(r[0]["roi"]), r[0]["stream_id"]] == [(0, 0, 65, 85), "cam_0"]
    assert [(i["name"], tuple(i["bbox"])[:2]) for i in r[0]["inside"]] == [("face", (10, 20)), ("sift", (10, 20))]
    assert geometry.regions(f, ["face"], 25, min_size=(31, 0)).count() == 0
    assert geometry.regions(f.withColumn("bbox", F.lit(None).cast(f.schema["bbox"].dataType)), ["face"]).count() == 0


def test_combine(spark):
    sparse = "array<struct<bbox:struct<x:int,y:int,width:int,height:int>>>"
    schema = f"stream_id string, sequence_nr long, type string, ts_ms long, bbox struct<x:int,y:int,width:int,height:int>, features array<struct<name:string,sparse:{sparse}>>, name string, sparse {sparse}"
    p = lambda x: {"bbox": {"x": x, "y": 0, "width": 0, "height": 0}}
    rows = [
        ("s", 1, "frame", 40, {"x": 0, "y": 0, "width": 9, "height": 9}, [{"name": "face", "sparse": [p(1)]}], None, None),
        ("s", 1, "feature", None, None, None, "face", [p(2)]),
        ("s", 1, "feature", None, None, None, "sift", [p(3)]),
        ("s", 2, "feature", None, None, None, "sift", None),
        ("s", 2, "feature", None, None, None, "face", [p(4)]),
    ]
    got = {r["sequence_nr"]: r for r in geometry.combine_features(spark.createDataFrame(rows, schema)).collect()}
    names = lambda r: [(f["name"], [b["x"] for b in f["boxes"]]) for f in r["features"]]
    assert names(got[1]) == [("face", [1, 2]), ("sift", [3])] and got[1]["image_type"] == "frame" and got[1]["ts_ms"] == 40
    assert (got[2]["image_type"], got[2]["ts_ms"], tuple(got[2]["bbox"])) == ("none", 0, (0, 0, 0, 0))
    assert [r["sequence_nr"] for r in geometry.combine_features(spark.createDataFrame(rows, schema), 3).collect()] == [1]


def test_numbers(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    assert [v(scaled(F.lit(x), f)) for x, f in ((640, 0.66), (480, 0.66), (640, 0.25), (101, 0.25), (51, 0.25), (640, 0.5))] == [422, 317, 160, 26, 13, 320]
    assert (v(magnitude(F.lit(0.3), F.lit(0.4))), v(magnitude(F.lit(3.0), F.lit(4.0)))) == (0.5, 1.0)
    assert v(l2(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0)))) == 5.0
    assert (frame_interval(25), frame_interval(30)) == (40, 33)
    assert v(base_stream(F.lit("cam_1_3"))) == "cam_1" and v(is_tile(F.lit("cam_1_3"))) and not v(is_tile(F.lit("cam_1")))


def test_routes(spark):
    n = spark.range(26).withColumnRenamed("id", "sequence_nr")
    assert [r[0] for r in routing.sample(n, 10, 2).orderBy("sequence_nr").collect()] == [0, 1, 10, 11, 20, 21]
    assert routing.sample(n, 0, 0).count() == 26
    assert [r[0] for r in routing.mod_filter(n, 13).orderBy("sequence_nr").collect()] == [0, 13]
    m = spark.createDataFrame([(1, {"label": "a"}), (2, {"label": "c"}), (3, {}), (4, None)], "id long, metadata map<string,string>")
    assert [r[0] for r in m.filter(routing.accepts({"label": ["a", "b"]})).collect()] == [1]
    assert sorted(r[0] for r in routing.route_by_metadata(m, 3, ["label"]).collect()) == [1, 2]
    p = spark.createDataFrame([(i,) for i in range(4)], "i long")
    assert [r[0] for r in p.select(routing.supervised_target(F.col("i"), 2)).collect()] == [0, 1, 0, 1]
    owners = [r[0] for r in spark.range(5).select(routing.split_owner(F.col("id"), 2)).collect()]
    assert owners == [0, 1, 0, 1, 0]
    blocks = [r[0] for r in spark.range(3).select(routing.block_owner(F.col("id"), F.lit(3), 7)).collect()]
    assert len(blocks) == 3 and max(blocks) < 7
    t = spark.createDataFrame([("cam_1_1", 1), ("cam_1_11", 1), ("cam_1", 1)], "stream_id string, sequence_nr long")
    assert [r[0] for r in routing.tiles_only(t, [1]).collect()] == ["cam_1_1"]
    assert {r[0] for r in routing.to_base_stream(t, 2).collect()} == {"cam_1"}
    assert {r[0] for r in n.select(routing.target_of([F.col("sequence_nr")], 3)).distinct().collect()} <= {0, 1, 2}


def test_metadata_and_schema(spark):
    df = spark.createDataFrame([({"b": "9"}, {"a": "1", "b": "2"}), (None, {"a": "1"}), ({"c": "3"}, None)], "c map<string,string>, p map<string,string>")
    assert [r[0] for r in df.select(inherit_metadata(F.col("c"), F.col("p"))).collect()] == [{"a": "1", "b": "9"}, {"a": "1"}, {"c": "3"}]
    assert FRAME.fieldNames()[:5] == ["request_id", "type", "stream_id", "sequence_nr", "metadata"] and set(PARTICLES) == {"descriptor", "feature", "frame", "group", "chunk"}
    p = as_particle(spark.range(1), "frame", F.lit("s"), F.lit(3))
    assert p.columns == ["request_id", "type", "stream_id", "sequence_nr", "metadata", "id"] and p.first()["request_id"] == -1


def test_sequential(spark):
    f = frame(spark, 10, 10).withColumn("image", F.lit(b"1")).withColumn("features", F.expr("array(named_struct('name','a','duration',0L,'sparse',array(1),'dense',null))"))
    assert "image" not in geometry.sequential(f, [], retain_image=False).columns
    assert geometry.sequential(f, [lambda d: d.filter("sequence_nr = 1")], output_frame=False).select("name").collect() == [("a",)]


def test_merging_keeps_whole_descriptors(spark):
    one = "struct<stream_id:string,metadata:map<string,string>,bbox:struct<x:int,y:int,width:int,height:int>,duration:long,values:array<float>>"
    feature = f"struct<name:string,metadata:map<string,string>,sparse:array<{one}>,dense:struct<dims:array<int>,data:array<float>>>"
    schema = f"stream_id string, sequence_nr long, bbox struct<x:int,y:int,width:int,height:int>, features array<{feature}>"
    point = lambda x, v: ("c_0", {"p": "q"}, (x, 1, 0, 0), 7, v)
    dense = lambda v, r=1, c=2: ([r, c, 1], [float(v)] * (r * c))
    rows = [
        ("c_1_0", 5, (0, 0, 2, 2), [("sift", {"a": "0"}, [point(1, [1.0])], dense(1))]),
        ("c_1_1", 5, (2, 0, 2, 2), [("sift", {"a": "1", "b": "1"}, [point(0, [2.0, 3.0])], dense(2)), ("face", None, None, None)]),
        ("c_1_2", 5, (0, 2, 2, 2), [("sift", None, None, dense(3, 2, 3)), ("sift", None, [], ([2, 2], [1.0] * 4))]),
    ]
    row = geometry.recombine(spark.createDataFrame(rows, schema), features="features").first()
    face, sift = row["features"]
    assert (row["width"], row["height"], row["n_tiles"]) == (4, 4, 3) and (face["name"], face["sparse"], face["dense"]) == ("face", [], None)
    assert [(d["bbox"]["x"], d["bbox"]["y"], d["duration"], d["values"], d["metadata"]) for d in sift["sparse"]] == [(1, 1, 7, [1.0], {"p": "q"}), (2, 1, 7, [2.0, 3.0], {"p": "q"})]
    assert sift["metadata"] == {"a": "0", "b": "1"} and sift["dense"]["dims"] == [4, 4, 1]
    assert sift["dense"]["data"] == [1, 1, 2, 2] + [0] * 4 + [3, 3, 3, 0] * 2

    feature_rows = [("s", 1, "feature", "sift", [point(2, [9.0])], dense(5, 2, 2)), ("s", 1, "feature", "sift", [point(1, None)], dense(4)), ("s", 1, "feature", "sift", None, None)]
    got = geometry.combine_features(spark.createDataFrame(feature_rows, f"stream_id string, sequence_nr long, type string, name string, sparse array<{one}>, dense struct<dims:array<int>,data:array<float>>")).first()
    (f,) = got["features"]
    assert [(d["bbox"]["x"], d["values"], d["stream_id"]) for d in f["sparse"]] == [(1, None, "c_0"), (2, [9.0], "c_0")] and f["dense"]["data"] == [5.0] * 4


def test_tiles_with_pixels_round_trip(spark):
    image = bytes(range(24))
    df = spark.createDataFrame([("c", 1, bytearray(image), 4), ("c", 2, bytearray(image[:7]), 4), ("c", 3, None, 4)], "stream_id string, sequence_nr long, image binary, width int")
    tiles = geometry.tile_pixels(df, 2, 2, 1)
    first = tiles.filter("tile = 0").first()
    assert (bytes(first["image"]), first["width"], first["stream_id"]) == (bytes([0, 1, 2, 4, 5, 6, 8, 9, 10, 12, 13, 14]), 3, "c_0")
    back = geometry.paste_pixels(tiles).collect()
    assert [(r["stream_id"], r["sequence_nr"], r["width"], r["height"], bytes(r["image"])) for r in back] == [("c", 1, 4, 6, image)]
