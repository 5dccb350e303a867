"""Point cloud files, cloud messages and streams: round trips and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelyard.sources import pcd, pointcloud2
from voxelyard.streaming import replay


def columns(n=7):
    rng = np.random.default_rng(3)
    return {"x": rng.normal(size=n), "y": rng.normal(size=n).astype(np.float32), "z": np.arange(n, dtype=np.float64), "ring": np.arange(n, dtype=np.uint16)}


@pytest.mark.parametrize("way", ["ascii", "binary", "binary_compressed"])
@pytest.mark.parametrize("n", [0, 1, 400])
def test_files_come_back(way, n):
    given = columns(n)
    got = pcd.parse_pcd(pcd.format_pcd(given, way))
    assert list(got) == list(given)
    for k, v in given.items():
        assert got[k].dtype == v.dtype and (got[k] == v).all()


def test_copies_in_compressed_bodies():
    # "abc", then nine from three back (overlapping), then a long copy
    packed = bytes([2]) + b"abc" + bytes([7 << 5, 0, 2]) + bytes([7 << 5, 20, 0])
    want = b"abc" + b"abcabcabc" + b"c" * 29
    assert pcd.expand_lzf(packed, len(want)) == want
    with pytest.raises(ValueError):
        pcd.expand_lzf(packed, 5)
    with pytest.raises(ValueError):
        pcd.expand_lzf(bytes([1 << 5, 9]), 3)


def test_padding_counts_and_comments():
    body = np.zeros(3, [("x", "<f4"), ("pad", "u1", (4,)), ("y", "<f4"), ("z", "<f4"), ("h", "<f4", (2,))])
    body["x"], body["h"] = [1, 2, 3], [[4, 5]] * 3
    head = b"# made by hand\nVERSION .7\nFIELDS x _ y z h\nSIZE 4 1 4 4 4\nTYPE F U F F F\nCOUNT 1 4 1 1 2\nWIDTH 3\nHEIGHT 1\nDATA binary\n"
    got = pcd.parse_pcd(head + body.tobytes())
    assert list(got) == ["x", "y", "z", "h"] and got["x"].tolist() == [1, 2, 3] and got["h"].tolist() == [4, 4, 4]
    assert pcd.parse_pcd(b"FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nWIDTH 1\nHEIGHT 1\nDATA ascii\n1 nan -2e3\n")["z"].tolist() == [-2000]
    for bad in (b"", b"FIELDS x\nDATA ascii\n", b"FIELDS x\nSIZE 4\nTYPE F\nPOINTS 2\nDATA ascii\n1\n", b"FIELDS x\nSIZE 4\nTYPE F\nPOINTS 1\nDATA zip\n"):
        with pytest.raises(ValueError):
            pcd.parse_pcd(bad)


def frames_of(spark, n=3):
    road = [(10 + i / 4, 2.0, -1.7) for i in range(20)]
    rows = [(f, i, x + f / 8, y, z) for f in range(n) for i, (x, y, z) in enumerate(road + [(10 + i % 4 / 10, i % 3 / 10, i / 15 - 1) for i in range(20)])]
    return spark.createDataFrame(rows, "frame_id long, point_index long, x double, y double, z double").repartition(4)


def test_folder_scan_takes_pcd_files_in_path_order(spark, tmp_path):
    pcd.write_pcd(frames_of(spark), f"file://{tmp_path}", "binary_compressed").collect()
    (tmp_path / "notes.txt").write_text("no cloud")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "000000000.pcd").write_bytes(b"not read")
    got = pcd.read_pcd(spark, f"file://{tmp_path}")
    assert sorted(map(tuple, got.select("frame_id", "point_index", "x", "y", "z").collect())) == sorted(map(tuple, frames_of(spark).collect()))
    assert got.where("intensity is not null or ring is not null").count() == 0


def test_messages_by_name_type_and_padding(spark):
    for order, big in (("<", False), (">", True)):
        row = np.dtype({"names": ["x", "y", "z", "ring"], "formats": [order + "f4", order + "f8", order + "f4", order + "u2"], "offsets": [2, 6, 14, 20], "itemsize": 24})
        cells = np.zeros((2, 3), row)
        cells["x"], cells["ring"] = [[1, 2, 3], [4, 5, 6]], 60000
        data = b"".join(r.tobytes() + b"pad!" for r in cells)
        fields = [("x", 2, 7, 1), ("y", 6, 8, 1), ("z", 14, 7, 1), ("ring", 20, 4, 1)]
        message = spark.createDataFrame([(5, 2, 3, fields, big, 24, 76, bytearray(data), True)], pointcloud2.MESSAGE)
        got = pointcloud2.decode(message).orderBy("point_index").collect()
        assert [r.x for r in got] == [1, 2, 3, 4, 5, 6] and {r.ring for r in got} == {60000} and {r.intensity for r in got} == {None}
        assert pointcloud2.with_layout(pointcloud2.decode(message), ["x", "y", "z", "ring"]).columns[2:] == ["x", "y", "z", "ring"]


def test_messages_of_the_four_layouts_and_no_others(spark):
    base = frames_of(spark).select("frame_id", "point_index", *[F.col(k).cast("float").alias(k) for k in "xyz"]).withColumns({"intensity": F.lit(0.5).cast("float"), "ring": F.lit(7)})
    for layout in pointcloud2.LAYOUTS:
        given = base.select("frame_id", "point_index", *layout)
        message = pointcloud2.encode(given)
        assert message.first().point_step == sum(2 if k == "ring" else 4 for k in layout)
        back = pointcloud2.with_layout(pointcloud2.decode(message), layout)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, given.collect()))
    for names, error in ((["z", "y", "x"], ValueError), (["x", "y"], ValueError), ([f"f{i}" for i in range(21)], OverflowError)):
        with pytest.raises(error):
            pointcloud2.layout_of(names)
    coloured = frames_of(spark, 1).withColumns({"r": F.lit(124), "g": F.lit(252), "b": F.lit(0)})
    message = pointcloud2.encode_coloured(coloured).first()
    rgb = np.frombuffer(message.data, "<u4").reshape(-1, 4)[:, 3]
    assert [f.name for f in message.fields] == ["x", "y", "z", "rgb"] and set(rgb.tolist()) == {124 << 16 | 252 << 8}


def test_stream_takes_each_frame_once(spark, tmp_path):
    folder, sinks, state = f"file://{tmp_path}/in", replay.Sinks(f"file://{tmp_path}/out"), f"file://{tmp_path}/state"
    points = frames_of(spark, 4)

    def run():
        replay.run_stream(replay.file_stream(spark, folder, 1), sinks, state, plane="none", convolution="none").awaitTermination()
        return sinks.read(spark, "clouds").groupBy("frame_id").count().collect()

    pcd.write_pcd(points.where("frame_id < 2"), folder).collect()
    assert sorted(map(tuple, run())) == [(0, 40), (1, 40)]
    pcd.write_pcd(points.where("frame_id >= 2"), folder).collect()
    assert sorted(map(tuple, run())) == [(f, 40) for f in range(4)]
    assert len(list((tmp_path / "out" / "clouds").glob("batch=*"))) == 4
    drawn = sinks.read(spark, "outlines")
    assert drawn.where(F.col("expires_at") != F.col("stamp") + F.expr("interval 150 milliseconds")).count() == 0 and drawn.count() > 0
    assert {r.sensor_frame for r in drawn.collect()} == {"lidar"}
    image = sinks.read(spark, "image")
    assert image.agg(F.min("row"), F.max("row")).first()[0] >= 0


def test_stamps_follow_the_frequency(spark):
    got = replay.stamped(spark.range(25).withColumnRenamed("id", "frame_id"), 100).select("frame_id", F.unix_micros("stamp")).collect()
    assert [r[1] for r in got] == [100_000_000 + 100_000 * r[0] for r in got]


def test_looped_replay_goes_round(spark):
    stream = replay.looped(spark, frames_of(spark, 2).where("point_index < 3"), 2, 50)
    query = stream.writeStream.format("memory").queryName("looped").start()
    try:
        for _ in range(60):
            query.processAllAvailable()
            if spark.table("looped").agg(F.max("tick")).first()[0] is not None and spark.table("looped").agg(F.max("tick")).first()[0] >= 3:
                break
    finally:
        query.stop()
    got = spark.table("looped")
    assert got.where(F.col("frame_id") != F.col("tick") % 2).count() == 0
    assert got.groupBy("tick").count().where("count <> 3").count() == 0 and got.agg(F.max("tick")).first()[0] >= 3
