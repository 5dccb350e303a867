"""Point-cloud operators on hand-made clouds."""

import math

import pytest
from pyspark.sql import functions as F

from voxelyard.config import SegmenterConfig, from_text
from voxelyard.functions import geometry as g
from voxelyard.operators import clustering, ground, polygons, rings, spatial
from voxelyard.operators.components import connected_components
from voxelyard.plans.frames import validate_layout


def cloud(spark, rows):
    return spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(rows)], "frame_id long, point_index long, x double, y double, z double")


def test_rings(spark):
    at = [(math.cos(math.radians(a)), math.sin(math.radians(a)), 0) for a in (10, 100, 200, 350, 5, 300, 2)]
    got = rings.assign_rings(cloud(spark, at)).orderBy("point_index").collect()
    assert [r.ring for r in got] == [63, 63, 63, 63, 62, 62, 61]


def test_atan2_approx(spark):
    pairs = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0.5, 1)]
    df = spark.createDataFrame([(float(y), float(x)) for y, x in pairs], "y double, x double")
    got = [r.a for r in df.select(g.atan2_approx(F.col("y"), F.col("x")).alias("a")).collect()]
    assert got == pytest.approx([0, 0.7854258, 1.5707964, 2.3561668, 3.1415927, -1.5707964, -0.7854258, 0.4636350], abs=1e-6)


def test_robust_minimum(spark):
    cells = [[-5, -1.7, -1.65, -1.6], [-1.7, -1.6, 0.5, 0.6], [-1.7], [-5, -1.7], [-1.7, -1.6, -1.5, 2.0]]
    rows = [(0, i, 1, float(z)) for i, c in enumerate(cells) for z in c]
    df = spark.createDataFrame(rows, "frame_id long, azimuth_index int, radial_index int, z double")
    got = {r.azimuth_index: r.z_min for r in ground.robust_minimum(df).collect()}
    assert got == {0: -1.7, 1: 0.5, 2: -1.7, 3: -1.7, 4: -1.7}


def test_clusters(spark):
    chain = [(10 + 0.4 * i, 0.01, 0) for i in range(4)] + [(20, 0.01, 0)]
    got = clustering.cluster(cloud(spark, chain)).orderBy("point_index").collect()
    assert [r.cluster_label for r in got] == [0, 0, 0, 0, -1]


def test_noise_counts_itself(spark):
    got = spatial.noise_labels(cloud(spark, [(1, 1, 1)] * 3 + [(5, 5, 5)] * 4)).orderBy("point_index").collect()
    assert [r.noise for r in got] == [1, 1, 1, 0, 0, 0, 0]


def test_hull_and_pairs():
    import numpy as np

    x, y = np.array([0, 2, 2, 0, 1, 1.0]), np.array([0, 0, 2, 2, 1, 0.0])
    assert polygons.hull_order(x, y) == [0, 1, 2, 3]
    assert polygons.hull_order(np.array([5.0, 1]), np.array([5.0, 1])) == [0, 1]
    assert len(polygons.hull_order(np.arange(4.0), np.arange(4.0))) == 2
    assert {(0, 2), (1, 3)} <= set(polygons.antipodal_of([0, 2, 2, 0], [0, 0, 2, 2]))


def test_box_and_outline(spark):
    c, s = math.cos(math.radians(30)), math.sin(math.radians(30))
    corners = [(0, 0), (4.5, 0), (4.5, 1.8), (0, 1.8)]
    points = cloud(spark, [(u * c - w * s, u * s + w * c, i % 2) for i, (u, w) in enumerate(corners)]).withColumn("cluster_label", F.lit(0))
    hulls = polygons.convex_hulls(points)
    box = polygons.min_area_boxes(hulls).first().box
    assert (box.area, box.length, box.width) == pytest.approx((8.1, 4.5, 1.8))
    shapes = clustering.cluster_extent(points).join(hulls, ["frame_id", "cluster_label"])
    assert len(polygons.outlines(shapes).first().segments) == 24


def test_ordered_and_simultaneous_votes_agree_on_lone_conflicts(spark):
    rows = [(0, 10, 10, 0, 5.0, 0.0, 0.0, 1, 25.0), (0, 10, 12, 1, 5.0, 0.2, 0.0, 2, 25.1), (0, 30, 30, 2, 9.0, 0.0, 0.0, 1, 81.0)]
    image = spark.createDataFrame(rows, "frame_id long, height_index int, width_index int, point_index long, x double, y double, z double, label int, depth_sq double")
    for f in (ground.convolve_in_order, ground.convolve_simultaneous):
        assert {r.point_index: r.label for r in f(image).collect()} == {0: 2, 1: 2, 2: 1}


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in connected_components(edges).collect()} == {0}
    assert {r.component for r in connected_components(edges, task_edges=0).collect()} == {0}
    assert connected_components(edges.limit(0)).count() == 0


def test_components_of_random_graphs_in_one_task_and_by_rounds(spark):
    import random

    rng = random.Random(4)
    pairs = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(5, 5), (7, None)]
    parent = {x: x for p in pairs for x in p if x is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if b is not None:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    linked = {x for a, b in pairs if b is not None and a != b for x in (a, b)}
    edges = spark.createDataFrame(pairs, "src long, dst long").repartition(5)
    for most in (1 << 20, 0):
        assert {r.node: r.component for r in connected_components(edges, task_edges=most).collect()} == {x: root(x) for x in linked}
    named = edges.where("dst is not null").select(F.concat(F.lit("n"), F.format_string("%04d", F.col("src") + 300)).alias("src"), F.concat(F.lit("n"), F.format_string("%04d", F.col("dst") + 300)).alias("dst"))
    assert {r.node: r.component for r in connected_components(named).collect()} == {f"n{x + 300:04d}": f"n{root(x) + 300:04d}" for x in linked}


def test_settings_and_layouts(spark):
    cfg = from_text(SegmenterConfig, "a:\n  image_width: 1024  # px\n  assume_unorganized_cloud: true\n")
    assert cfg.image_width == 1024 and cfg.assume_unorganized_cloud and cfg.rings == 50 and cfg.slices == 360
    assert validate_layout(cloud(spark, [(1, 2, 3)])) == ["x", "y", "z"]
    with pytest.raises(ValueError):
        from_text(SegmenterConfig, "image_width: 1024", strict=True)
    with pytest.raises(ValueError):
        validate_layout(cloud(spark, [(1, 2, 3)]).select("frame_id", "point_index", "z", "y", "x"))


def test_radius_counts_of_vectors_are_not_capped(spark, tmp_path):
    from voxelyard.plans import queries

    rows = [(i, [0.01 * i if j == 0 else 0.0 for j in range(64)]) for i in range(40)] + [(60, [9.0] * 64), (80, [0.0, *[1.0], *[0.0] * 62])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.q_id: r.n for r in queries.radius_embeddings(spark, str(tmp_path)).collect()}
    assert got == {0: 41, 20: 40, 60: 1, 80: 2}


def random_cloud(spark, seed, n=400):
    import random

    rng = random.Random(seed)
    rows = [(rng.randrange(3), i, *(rng.choice([3, 8, -6]) + rng.gauss(0, 0.8) for _ in "xyz")) for i in range(n)]
    rows += [(0, n, math.nan, 1.0, 1.0), (1, n + 1, math.inf, 1.0, 1.0), (2, n + 2, 1e9, 0.0, 0.0), (2, n + 3, 1e300, 1e300, 0.0), (2, n + 4, 3.0, -0.001, 0.5), (2, n + 5, 3.0, 0.001, 0.5)]
    return spark.createDataFrame(rows, "frame_id long, point_index long, x double, y double, z double").repartition(5)


def test_clusters_by_frame_and_by_edges_agree(spark):
    from voxelyard.config import ClustererConfig

    for seed, full in ((1, False), (2, True)):
        points = random_cloud(spark, seed)
        cfg = ClustererConfig(full_circle=full)
        one, two = (sorted(map(str, clustering.cluster(points.where("abs(x) < 1e200 or isnan(x)"), cfg, by).collect())) for by in ("frame", "edges"))
        assert one == two and len(one) == 404
    got = {r.point_index: r.cluster_label for r in clustering.cluster(points, cfg).collect()}
    assert len(got) == 406 and got[400] == got[401] == got[402] == -1


def test_far_points_cost_no_more_than_near_ones(spark):
    points = random_cloud(spark, 3)
    got = {r.point_index: r.noise for r in spatial.noise_labels(points).collect()}
    assert len(got) == 406 and got[400] == got[401] == got[402] == got[403] == 1
    rows = {(r.frame_id, r.point_index): (r.x, r.y, r.z) for r in points.where("abs(x) < 1e8").collect()}
    for (f, i), p in rows.items():
        reach = max(0.02 * math.hypot(p[0], p[1]), 0.1)
        assert got[i] == int(sum(f == k and math.dist(p, q) <= reach for (k, _), q in rows.items()) < 4)


def test_radius_pairs_of_any_radius(spark):
    points = random_cloud(spark, 4, 150).where("abs(x) < 100")
    rows = [(r.frame_id, r.point_index, (r.x, r.y, r.z)) for r in points.collect()]
    for radius in (0.3, 1.0, 5.0):
        got = {(r.frame_id, r.q_index, r.t_index) for r in spatial.radius_search(points, radius).collect()}
        assert got == {(f, i, j) for f, i, p in rows for k, j, q in rows if f == k and math.dist(p, q) <= radius}
    near = spatial.radius_any(points, 5.0, 3, nearest_first=True).groupBy("frame_id", "q_index").agg(F.min("d2").alias("least"), F.count("*").alias("n"))
    assert near.where("least > 0 or n > 3").count() == 0


def hulls_at_random(seed, many=200):
    import random

    import numpy as np

    rng = random.Random(seed)
    for _ in range(many):
        grid = rng.random() < 0.5
        pts = [(rng.randrange(6), rng.randrange(6)) if grid else (rng.gauss(500, 3), rng.gauss(-900, 1)) for _ in range(rng.randrange(3, 40))]
        x, y = np.array([float(p[0]) for p in pts]), np.array([float(p[1]) for p in pts])
        keep = polygons.hull_order(x, y)
        if len(keep) > 2:
            yield x, y, keep


def test_hulls_hold_their_points_and_turn_left():
    for x, y, keep in hulls_at_random(1):
        for i, j in zip(keep, keep[1:] + keep[:1]):
            side = (x[j] - x[i]) * (y - y[i]) - (y[j] - y[i]) * (x - x[i])
            assert side.min() > -1e-9
        assert polygons.hull_order(x[keep], y[keep]) == list(range(len(keep)))


def test_antipodal_pairs_against_their_definition():
    for x, y, keep in hulls_at_random(2):
        hx, hy = x[keep].tolist(), y[keep].tolist()
        n = len(hx)
        edges = [(hx[(k + 1) % n] - hx[k], hy[(k + 1) % n] - hy[k]) for k in range(n)]
        between = lambda a, b, d: a[0] * d[1] - a[1] * d[0] >= 0 and d[0] * b[1] - d[1] * b[0] >= 0
        cones = [(edges[k - 1], edges[k]) for k in range(n)]
        meets = lambda i, j: any(between(*cones[j], (-dx, -dy)) for dx, dy in cones[i]) or any(between(*cones[i], (-dx, -dy)) for dx, dy in cones[j])  # noqa: B023, E731
        assert polygons.antipodal_of(hx, hy) == [(i, j) for i in range(n) for j in range(i + 1, n) if meets(i, j)]


def test_boxes_are_smallest_and_hold_their_hull(spark):
    rows = [(0, i, [{"x": float(x[k]), "y": float(y[k])} for k in keep]) for i, (x, y, keep) in enumerate(hulls_at_random(3, 60))]
    hulls = spark.createDataFrame(rows, polygons.HULL)
    got = {r.cluster_label: r.box for r in polygons.min_area_boxes(hulls).collect()}
    for _, i, hull in rows:
        areas = []
        for p, q in zip(hull, hull[1:] + hull[:1]):
            a = math.atan2(q["y"] - p["y"], q["x"] - p["x"])
            u = [v["x"] * math.cos(a) + v["y"] * math.sin(a) for v in hull]
            w = [v["y"] * math.cos(a) - v["x"] * math.sin(a) for v in hull]
            areas.append((max(u) - min(u)) * (max(w) - min(w)))
        assert got[i].area == pytest.approx(min(areas), rel=1e-9, abs=1e-9)
        c = got[i].corners
        for v in hull:
            for p, q in zip(c, c[1:] + c[:1]):
                assert (q.x - p.x) * (v["y"] - p.y) - (q.y - p.y) * (v["x"] - p.x) > -1e-6


def test_stale_votes_at_the_border(spark):
    """A conflict pixel on the first row keeps, beyond the image, the votes of the pixel before it."""
    schema = "frame_id long, height_index int, width_index int, point_index long, x double, y double, z double, label int, depth_sq double"
    rows = [
        (0, 0, 10, 0, 5.0, 0.0, 0.0, 1, 25.0), (0, 0, 11, 1, 5.0, 0.3, 0.0, 2, 25.0), (0, 0, 9, 2, 5.0, -0.05, 0.0, 1, 25.0),
        (0, 0, 40, 3, 9.0, 0.0, 0.0, 1, 81.0), (0, 0, 41, 4, 9.0, 0.4, 0.0, 2, 81.0), (0, 0, 38, 5, 9.0, -0.05, 0.0, 1, 81.0),
    ]
    image = spark.createDataFrame(rows, schema)
    plain = {r.point_index: r.label for r in ground.convolve_in_order(image).collect()}
    stale = {r.point_index: r.label for r in ground.convolve_in_order(image, stale_border=True).collect()}
    assert set(plain) == set(stale) == set(range(6)) and plain[1] == stale[1] == 2


def test_draws_come_from_the_twister():
    from voxelyard.plans.oracle import twister

    raw = twister(42, 100)
    assert raw[:2] == [1608637542, 3421126067]
    for n in (2, 3, 17, 4000):
        at, want = 0, []
        while len(want) < 20:
            second, third = raw[at] * n >> 32, raw[at + 1] * n >> 32
            at += 2
            while third == second:
                third = raw[at] * n >> 32
                at += 1
            want.append((second, third))
        assert ground.draw_pairs(n, 20) == want


def test_elevations_in_32_bits_step_by_step(spark):
    import random

    import numpy as np

    rng, cfg = random.Random(7), SegmenterConfig()
    rows = [(0, a, r, rng.uniform(-2, 3)) for a in range(20) for r in range(50) if rng.random() < 0.4]
    cells = spark.createDataFrame(rows, "frame_id long, azimuth_index int, radial_index int, z_min double")
    got = {(r.azimuth_index, r.radial_index): np.float32(r.elevation) for r in ground.elevation_map_32(cells).collect()}
    lowest = {(a, r): np.float32(z) for _, a, r, z in rows}
    for a in range(20):
        e = np.float32(cfg.first_elevation)
        for r in range(50):
            if r:
                e = min(lowest.get((a, r), np.float32(np.inf)), np.float32(e + np.float32(cfg.elevation_step)))
            assert (a, r) not in lowest or got[a, r] == e


def test_tables_of_the_shared_folder_can_be_cleared(spark):
    import pathlib

    from voxelyard.sources import workdir

    held = workdir.write_table(spark.range(5), "short-lived")
    where = pathlib.Path(held.stored_at.removeprefix("file://"))
    assert held.count() == 5 and where.exists()
    workdir.clear_tables(spark)
    assert not where.exists()


def test_nearest_and_radius_counts_against_brute_force(spark):
    """Ties, repeated vectors, groups, far-off coordinates, fewer targets than asked for."""
    import numpy as np

    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(120, 6)), 1) + 1000.0
    v[60:80] = v[0]
    rows = [(i, int(i % 2), x.tolist()) for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "id long, g long, v array<double>").repartition(4)
    d2 = lambda i, j: float(sum((a - b) ** 2 for a, b in zip(v[i], v[j])))
    for k, grouped in ((7, None), (7, "g"), (200, "g")):
        got = {}
        for r in spatial.nearest(frame.where("id % 5 = 0"), frame, k, "id", "v", block=10, group_col=grouped).orderBy("rank").collect():
            got.setdefault(r.q_id, []).append(r.t_id)
        want = {i: sorted((j for j in range(120) if not grouped or i % 2 == j % 2), key=lambda j: (d2(i, j), j))[:k] for i in range(0, 120, 5)}  # noqa: B023
        assert got == want
    counts = {r.q_id: r.n for r in spatial.vector_radius_counts(frame.where("id % 5 = 0"), frame, 2.0, "id", "v").collect()}
    assert counts == {i: sum(d2(i, j) <= 4.0 for j in range(120)) for i in range(0, 120, 5)}


def test_noise_of_dense_cells_is_told_without_pairs(spark, monkeypatch):
    import random

    rng = random.Random(9)
    rows = [(0, i, 3 + rng.random() / 999, -6 + rng.random() / 999, 1.0) for i in range(3000)]
    rows += [(1, i, *(rng.choice([0, 0.5, 5, 40]) + rng.choice([0, 0.03, 0.1, 0.125, 0.8]) * rng.random() for _ in "xyz")) for i in range(900)]
    rows += [(2, 10 * k + i, 1.0, 0.0, z + 0.02 * i) for k, z in enumerate((0.0, 1e9, 3e10, 1e17, 2e17)) for i in range(4)] + [(2, 90 + i, 0.0, 0.0, 1e18 * i) for i in range(1, 6)]
    points = spark.createDataFrame(rows, "frame_id long, point_index long, x double, y double, z double").repartition(5)
    asked, join = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda q, t, r: asked.append(q.groupBy("frame_id").count().collect()) or join(q, t, r))
    got = spatial.noise_labels(points)
    assert got.columns == [*points.columns, "noise"]
    got = {(r.frame_id, r.point_index): r.noise for r in got.collect()}
    counted = {r.frame_id: r["count"] for r in asked[0]}
    assert counted.get(0, 0) <= 64 and 0 < counted[1] < 900
    for f in (1, 2):
        frame = [r for r in rows if r[0] == f]
        for _, i, *p in frame:
            reach = max(0.02 * math.hypot(p[0], p[1]), 0.1)
            assert got[f, i] == int(sum(math.dist(p, q[2:]) ** 2 <= reach * reach for q in frame) < 4)
    assert len(got) == len(rows) and not any(n for (f, _), n in got.items() if f == 0)


def test_cells_are_not_broadcast(spark, tmp_path):
    """A side of the cell join has 27 rows for a point, which the planner does not see: it broadcast 16 million of them."""
    from pyspark.sql import functions as F

    random_cloud(spark, 6, 50).write.parquet(f"{tmp_path}/points")
    points = spark.read.parquet(f"{tmp_path}/points")
    plan = spatial.radius_join(points, points, F.lit(0.5))._jdf.queryExecution().sparkPlan().toString()
    met = [line for line in plan.splitlines() if "Join" in line and "cx" in line]
    assert met and all("SortMergeJoin" in line for line in met)
