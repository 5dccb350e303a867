"""Driver queries of the point-cloud operators over the derived cloud."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelyard.config import SegmenterConfig, VehicleConfig
from voxelyard.functions import geometry as g
from voxelyard.operators import clustering, ground, polygons, rings, spatial
from voxelyard.plans import frames
from voxelyard.sources import pcd, pointcloud2
from voxelyard.sources.fixtures import objects, points
from voxelyard.sources.workdir import new_path, write_table
from voxelyard.streaming import replay

Query = Callable[[SparkSession, str], DataFrame]
CFG = SegmenterConfig()
#: Looser than the default, so that clusters of the small cloud qualify.
VEHICLES = VehicleConfig(min_points=5)
RADIUS, MOST, NEAREST = 0.5, 4, 10
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).drop("is_obj")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = write_table(ground.polar_grid(cloud(spark, sf_dir), CFG), "grid")
    return write_table(ground.elevation_labels(grid, CFG), "labelled")


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_table(clustering.cluster(objects(spark, sf_dir)), "clusters")


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), places) + F.lit(0.0) for n in names})


@query
def derived_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir)


@query
def ring_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings.assign_rings(cloud(spark, sf_dir)).select("frame_id", "point_index", "ring")


@query
def ring_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings.ring_histogram(rings.assign_rings(cloud(spark, sf_dir)))


@query
def ring_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    ringed = rings.assign_rings(cloud(spark, sf_dir))
    return ringed.select("frame_id", "point_index", g.ring_colour(F.col("ring")).alias("c")).select("frame_id", "point_index", "c.r", "c.g", "c.b")


@query
def label_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = labelled(spark, sf_dir).select("frame_id", "point_index", g.label_colour(F.col("label")).alias("c"))
    return told.select("frame_id", "point_index", "c.r", "c.g", "c.b")


@query
def polar_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.polar_grid(cloud(spark, sf_dir), CFG).select("frame_id", "point_index", "azimuth_index", "radial_index", "height_index", "width_index")


@query
def cell_robust_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ground.robust_minimum(ground.polar_grid(cloud(spark, sf_dir), CFG), CFG), "z_min")


@query
def recm_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ground.robust_minimum(ground.polar_grid(cloud(spark, sf_dir), CFG), CFG)
    return rounded(ground.elevation_map(cells, CFG).drop("z_min"), "elevation")


@query
def recm_elevation_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elevation map in 32-bit arithmetic, to the last bit."""
    return ground.elevation_map_32(ground.robust_minimum(ground.polar_grid(cloud(spark, sf_dir), CFG), CFG), CFG)


@query
def recm_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("frame_id", "point_index", "label")


@query
def ransac_plane_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ground.plane_by_ranks(labelled(spark, sf_dir), CFG), "a", "b", "c", "d")


@query
def ransac_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = labelled(spark, sf_dir)
    return ground.correct_by_plane(told, ground.plane_by_ranks(told, CFG), CFG).select("frame_id", "point_index", "label")


@query
def ransac_plane_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ground.plane_by_draws(labelled(spark, sf_dir), CFG), "a", "b", "c", "d")


@query
def range_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.range_image(labelled(spark, sf_dir)).select("frame_id", "height_index", "width_index", "point_index", "label")


@query
def dilate_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.conflict_pixels(write_table(ground.range_image(labelled(spark, sf_dir)), "image")).select("frame_id", "height_index", "width_index")


@query
def jcp_simultaneous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.convolve_simultaneous(ground.range_image(labelled(spark, sf_dir)), CFG).select("frame_id", "height_index", "width_index", "label")


@query
def jcp_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.convolve_in_order(ground.range_image(labelled(spark, sf_dir)), CFG).select("frame_id", "height_index", "width_index", "label")


@query
def point_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.segment(cloud(spark, sf_dir), CFG, "ranks", "simultaneous").select("frame_id", "point_index", "label")


@query
def frame_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.frame_counts(ground.segment(cloud(spark, sf_dir), CFG, "ranks", "simultaneous"))


@query
def label_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = ground.point_labels(cloud(spark, sf_dir), ground.range_image(labelled(spark, sf_dir)))
    return told.groupBy("frame_id", ground.label_name(F.col("label")).alias("label")).agg(F.count("*").alias("n_points"))


@query
def spherical_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustering.spherical(cloud(spark, sf_dir)).select("frame_id", "point_index", F.col("range").alias("range_m"), "azimuth", "elevation")
    return rounded(out, "range_m", "azimuth", "elevation")


@query
def voxel_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.distinct_voxels(clustering.voxelize(objects(spark, sf_dir)))


@query
def voxel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    voxels = clustering.distinct_voxels(clustering.voxelize(objects(spark, sf_dir)))
    return clustering.voxel_edges(voxels).select("frame_id", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))


@query
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(objects(spark, sf_dir)).select("frame_id", "point_index", "cluster_label")


@query
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark, sf_dir).where("cluster_label >= 0").groupBy("frame_id", "cluster_label").agg(F.count("*").alias("n_points"))


@query
def cluster_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clustering.cluster_extent(clustered(spark, sf_dir)), "z_min", "z_max")


@query
def convex_hull_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    hulls = polygons.convex_hulls(clustered(spark, sf_dir)).where(F.size("hull") >= 3)
    return rounded(hulls.select("frame_id", "cluster_label", F.explode("hull").alias("p")).select("frame_id", "cluster_label", "p.x", "p.y"), "x", "y")


@query
def hull_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    hulls = polygons.convex_hulls(clustered(spark, sf_dir)).where(F.size("hull") >= 3)
    return rounded(hulls.select("frame_id", "cluster_label", g.polygon_area(F.col("hull")).alias("area")), "area")


@query
def antipodal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both points of each pair, the lesser first."""
    hulls = polygons.convex_hulls(clustered(spark, sf_dir)).where(F.size("hull") >= 3)
    found = polygons.antipodal_pairs(hulls).select("frame_id", "cluster_label", "hull", F.explode("pairs").alias("p"))
    at = lambda k: F.element_at("hull", F.col(f"p.{k}") + 1)
    ends = found.select("frame_id", "cluster_label", F.array_sort(F.array(at("index_1"), at("index_2"))).alias("e"))
    return rounded(ends.select("frame_id", "cluster_label", *[F.col("e")[i][k].alias(f"{k}{i + 1}") for i in (0, 1) for k in "xy"]), "x1", "y1", "x2", "y2")


@query
def hull_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames.hull_centroids(polygons.convex_hulls(clustered(spark, sf_dir)).where(F.size("hull") >= 3)), "x", "y", places=9)


@query
def min_area_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = polygons.min_area_boxes(polygons.convex_hulls(clustered(spark, sf_dir)))
    ends = boxes.select("frame_id", "cluster_label", F.explode("box.corners").alias("p"), F.col("box.length").alias("length"), F.col("box.width").alias("width"))
    return rounded(ends.select("frame_id", "cluster_label", "p.x", "p.y", "length", "width"), "x", "y", "length", "width")


@query
def pca_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = polygons.pca_boxes(clustered(spark, sf_dir))
    ends = boxes.select("frame_id", "cluster_label", F.explode("box.corners").alias("p"), F.col("box.length").alias("length"), F.col("box.width").alias("width"))
    return rounded(ends.select("frame_id", "cluster_label", "p.x", "p.y", "length", "width"), "x", "y", "length", "width")


@query
def min_area_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = polygons.min_area_boxes(polygons.convex_hulls(clustered(spark, sf_dir)))
    return rounded(boxes.select("frame_id", "cluster_label", F.col("box.area").alias("area")), "area")


@query
def pca_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = polygons.pca_boxes(clustered(spark, sf_dir))
    return rounded(boxes.select("frame_id", "cluster_label", F.col("box.area").alias("area")), "area")


@query
def vehicle_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = frames.describe(clustered(spark, sf_dir))
    told = polygons.classify_vehicles(shapes.join(polygons.min_area_boxes(shapes), ["frame_id", "cluster_label"]), VEHICLES)
    return told.select("frame_id", "cluster_label", "vehicle_class")


@query
def outline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = polygons.outlines(frames.describe(clustered(spark, sf_dir)))
    ends = drawn.select("frame_id", "cluster_label", F.explode("segments").alias("p")).select("frame_id", "cluster_label", "p.x", "p.y", "p.z")
    return rounded(ends, "x", "y", "z")


@query
def noise_dror(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.noise_labels(cloud(spark, sf_dir)).select("frame_id", "point_index", "noise")


@query
def radius_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.radius_search(objects(spark, sf_dir), RADIUS), "d2")


@query
def radius_search_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.radius_counts(objects(spark, sf_dir), RADIUS, MOST)


@query
def knn_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = spatial.nearest(vectors.where("vec_id % 20 = 0"), vectors, NEAREST, "vec_id", "embedding")
    return rounded(found.select("q_id", "t_id", "rank", "d2"), "d2")


@query
def radius_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors lie within a distance of each query (any dimension)."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return spatial.vector_radius_counts(vectors.where("vec_id % 20 = 0"), vectors, 1.0, "vec_id", "embedding")


@query
def knn_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = objects(spark, sf_dir).select("frame_id", "point_index", F.array("x", "y", "z").alias("v"))
    found = spatial.nearest(vectors.where("point_index % 20 = 0"), vectors, 3, "point_index", "v", group_col="frame_id")
    return rounded(found.select(F.col("g").alias("frame_id"), "q_id", "rank", "d2"), "d2")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point with the three after it."""
    w = W.partitionBy("frame_id").orderBy("point_index")
    ahead = {f"{k}{i}": F.lead(k, i).over(w) for i in (1, 2, 3) for k in "xy"}
    return cloud(spark, sf_dir).withColumns(ahead).where("x3 is not null")


def _at(i: int) -> tuple:
    s = str(i) if i else ""
    return F.col(f"x{s}"), F.col(f"y{s}")


@query
def atan2_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(spark, sf_dir).select("frame_id", "point_index", g.atan2_approx(F.col("y"), F.col("x")).alias("angle"))


@query
def orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("frame_id", "point_index", g.orientation(*_at(0), *_at(1), *_at(2)).alias("o"), g.orientation_eps(*_at(0), *_at(1), *_at(2)).alias("o_eps"))


@query
def segments_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = g.segments_intersect(_at(0), _at(1), _at(2), _at(3))
    return _runs(spark, sf_dir).select("frame_id", "point_index", g.on_segment(*_at(0), *_at(1), *_at(2)).alias("on_box"), told.alias("meet"))


@query
def triangle_rectangle_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _runs(spark, sf_dir).select("frame_id", "point_index", g.triangle_area(_at(0), _at(1), _at(2)).alias("triangle"), g.rectangle_area(_at(0), _at(1), _at(2)).alias("rectangle"), F.sqrt(g.dist_sq(list(_at(0)), list(_at(1)))).alias("distance"))
    return rounded(out.withColumn("triangle", F.round("triangle", 9)), "rectangle", "distance")


@query
def map_upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed map after inserts in order: the last value of each key."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.col("user_id").alias("k")).agg(F.max_by("event_id", "event_id").alias("v"))


@query
def set_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of keys in a set: a semi join; missing keys are those of the anti join."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    members = events.where("event_type = 'purchase'").select("user_id")
    every = events.select("user_id").distinct()
    return every.join(members, "user_id", "left_semi").withColumn("contained", F.lit(True)).union(every.join(members, "user_id", "left_anti").withColumn("contained", F.lit(False)))


@query
def radius_search_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of a search that stops at a number: the first by index."""
    return rounded(spatial.radius_any(objects(spark, sf_dir), RADIUS, MOST), "d2")


@query
def radius_search_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in reach, nearest first, up to a number."""
    return rounded(spatial.radius_any(objects(spark, sf_dir), RADIUS, MOST, nearest_first=True), "d2")


@query
def max_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings.assign_rings(cloud(spark, sf_dir)).groupBy("frame_id").agg(F.max("ring").alias("max_ring"))


@query
def ring_major_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.in_order(rings.assign_rings(cloud(spark, sf_dir)), "ring").select("frame_id", "place", "point_index", "ring")


@query
def cluster_major_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clustering.cluster(objects(spark, sf_dir)).where("cluster_label >= 0")
    return frames.in_order(kept, "cluster_label").select("frame_id", "place", "point_index", "cluster_label")


@query
def cluster_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clustering.cluster(objects(spark, sf_dir)).where("cluster_label >= 0")
    return kept.select("frame_id", "point_index", g.cluster_colour(F.col("cluster_label")).alias("c")).select("frame_id", "point_index", "c.r", "c.g", "c.b")


@query
def cluster_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.cluster_counts(clustered(spark, sf_dir))


@query
def frame_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames.frame_extents(cloud(spark, sf_dir)), "max_range", "max_azimuth", "max_elevation")


@query
def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time of seconds and nanoseconds, as microseconds since 1970."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return events.select("event_id", F.unix_micros(g.stamp_micros(F.col("event_id") % 100_000, F.col("event_id") * 7919 % 1_000_000_000)).alias("micros"))


@query
def atan2_approx_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polynomial in 32-bit arithmetic."""
    single = cloud(spark, sf_dir).select("frame_id", "point_index", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"))
    return single.select("frame_id", "point_index", g.atan2_approx(F.col("y"), F.col("x"), "float").alias("angle"))


@query
def pcd_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written as files of all three kinds and read again; every kind gives the points it was given."""
    folder, way = new_path(spark, "pcd"), ["ascii", "binary", "binary_compressed"]
    held = write_table(cloud(spark, sf_dir), "cloud")
    written = [pcd.write_pcd(held.where(F.col("frame_id") % 3 == k), folder, w).count() for k, w in enumerate(way)]
    return pcd.read_pcd(spark, folder).where(F.lit(sum(written) >= 0)).select("frame_id", "point_index", "x", "y", "z")


@query
def pointcloud2_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with rings as messages of bytes and back; coordinates in 64 bits, rings in 16."""
    ringed = rings.assign_rings(cloud(spark, sf_dir))
    messages = pointcloud2.encode(ringed.select("frame_id", "point_index", "x", "y", "z", "ring"), dict.fromkeys("xyz", 8))
    return pointcloud2.decode(messages).select("frame_id", "point_index", "x", "y", "z", "ring")


@query
def coloured_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with the packed colour of their label."""
    told = labelled(spark, sf_dir).select("frame_id", "point_index", g.label_colour(F.col("label")).alias("c"))
    return told.select("frame_id", "point_index", pointcloud2.packed_colour(F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("rgb"))


@query
def stream_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as files, replayed as a stream; the labels that the sinks hold in the end."""
    folder, out = new_path(spark, "replay"), replay.Sinks(new_path(spark, "sinks"))
    pcd.write_pcd(cloud(spark, sf_dir), folder).count()
    replay.run_stream(replay.file_stream(spark, folder, 3), out, new_path(spark, "stream"), plane="none", convolution="none").awaitTermination()
    return out.read(spark, "clouds").select("frame_id", "point_index", "label", "cloud")


@query
def pipeline_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline as it is by default: random draws and votes in scan order."""
    return _shapes(frames.run_frames(cloud(spark, sf_dir), CFG))


@query
def pipeline_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, clusters of obstacles and their extents, hull areas and outline sizes for every frame."""
    return _shapes(frames.run_frames(cloud(spark, sf_dir), CFG, plane="ranks", convolution="simultaneous"))


@query
def pipeline_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline with boxes for what looks like a vehicle: class and outline size of each cluster."""
    done = frames.run_frames(cloud(spark, sf_dir), CFG, plane="ranks", convolution="simultaneous", simplify=True, vehicles=VEHICLES)
    ends = done.outlines.select("frame_id", "cluster_label", F.size("segments").cast("long").alias("n_endpoints"))
    told = done.shapes.select("frame_id", "cluster_label", "vehicle_class").join(ends, ["frame_id", "cluster_label"], "left")
    return told.withColumn("n_endpoints", F.coalesce("n_endpoints", F.lit(0).cast("long")))


def _shapes(done: frames.FrameResult) -> DataFrame:
    ends = done.outlines.select("frame_id", "cluster_label", F.size("segments").cast("long").alias("n_endpoints"))
    shapes = done.shapes.select("frame_id", "cluster_label", "n_points", "z_min", "z_max", "hull_area").join(ends, ["frame_id", "cluster_label"], "left")
    return rounded(shapes.withColumn("n_endpoints", F.coalesce("n_endpoints", F.lit(0).cast("long"))), "z_min", "z_max", "hull_area")
