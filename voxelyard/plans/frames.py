"""The frame pipeline: labels, clusters, hulls, boxes and outlines of every frame of a point table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelyard.config import OBSTACLE, ClustererConfig, SegmenterConfig, VehicleConfig
from voxelyard.functions.geometry import polygon_area
from voxelyard.operators.clustering import cluster, cluster_extent, finite, spherical
from voxelyard.operators.ground import segment
from voxelyard.operators.polygons import GROUP, classify_vehicles, convex_hulls, min_area_boxes, outlines
from voxelyard.sources.workdir import write_table

#: Accepted point layouts, in this order after ``frame_id`` and ``point_index``.
LAYOUTS = [["x", "y", "z"], ["x", "y", "z", "intensity"], ["x", "y", "z", "ring"], ["x", "y", "z", "intensity", "ring"]]


def validate_layout(points: DataFrame) -> list[str]:
    """The fields of a point table; raises for a layout that is not accepted."""
    fields = [c for c in points.columns if c not in ("frame_id", "point_index")]
    if fields not in LAYOUTS or not {"frame_id", "point_index"} <= set(points.columns):
        raise ValueError(f"unsupported point layout: {points.columns}")
    return fields


@dataclass
class FrameResult:
    labels: DataFrame
    clusters: DataFrame
    shapes: DataFrame
    outlines: DataFrame


def run_frames(points: DataFrame, segmenter: SegmenterConfig = SegmenterConfig(), clusterer: ClustererConfig = ClustererConfig(), plane: str = "draws", convolution: str = "ordered", simplify: bool = False, vehicles: VehicleConfig = VehicleConfig()) -> FrameResult:
    """Segment, cluster the obstacles, and describe each cluster; ``simplify`` fits boxes and swaps the hulls of vehicles for them."""
    validate_layout(points)
    labels = write_table(segment(points, segmenter, plane, convolution), "labels")
    clusters = cluster(labels.where(F.col("label") == OBSTACLE).drop("label"), clusterer)
    clusters = write_table(clusters, "clusters")
    shapes = describe(clusters)
    ring = F.col("hull")
    if simplify:
        shapes = classify_vehicles(shapes.join(min_area_boxes(shapes), GROUP, "left"), vehicles)
        ring = F.when(F.col("vehicle_class").isNotNull(), F.col("box.corners")).otherwise(ring)
    return FrameResult(labels, clusters, shapes, outlines(shapes, ring))


def describe(clusters: DataFrame) -> DataFrame:
    """Points, height range, hull and hull area of each cluster."""
    return cluster_extent(clusters).join(convex_hulls(clusters), GROUP).withColumn("hull_area", polygon_area(F.col("hull")))


def cluster_counts(clusters: DataFrame) -> DataFrame:
    """Clusters by frame, those under the least size left out."""
    return clusters.where("cluster_label >= 0").groupBy("frame_id").agg(F.count_distinct("cluster_label").alias("n_clusters"))


def frame_extents(points: DataFrame) -> DataFrame:
    """Largest range, azimuth and elevation of each frame."""
    return spherical(points.where(finite())).groupBy("frame_id").agg(*[F.max(k).alias(f"max_{k}") for k in ("range", "azimuth", "elevation")])


def hull_centroids(shapes: DataFrame) -> DataFrame:
    """Mean of the vertices of each hull."""
    n = F.size("hull")
    mean = lambda k: F.aggregate(F.transform("hull", lambda v: v[k]), F.lit(0.0), lambda s, v: s + v) / n
    return shapes.where(n > 0).select(*GROUP, mean("x").alias("x"), mean("y").alias("y"))


def in_order(points: DataFrame, key: str) -> DataFrame:
    """Points with their ``place`` in their frame when sorted by a key (ring, cluster) and then by index."""
    w = W.partitionBy("frame_id").orderBy(key, "point_index")
    return points.withColumn("place", (F.row_number().over(w) - 1).cast("long"))


def frame_counts(labels: DataFrame) -> DataFrame:
    """Points of each label by frame."""
    sums = [F.sum((F.col("label") == k).cast("long")).alias(n) for k, n in ((1, "n_ground"), (2, "n_obstacle"), (0, "n_unknown"))]
    return labels.groupBy("frame_id").agg(F.count("*").alias("n_points"), *sums)
