"""Curved-voxel clustering: spherical voxels, 26-neighbour edges, components, labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelyard.config import ClustererConfig
from voxelyard.functions.geometry import azimuth_deg, elevation_deg, spatial_range
from voxelyard.operators.components import component_of, connected_components

VOXEL = ["frame_id", "range_index", "azimuth_index", "elevation_index"]
#: One of each pair of opposite steps to the 26 voxels around one.
HALF = [(r, a, e) for r in (-1, 0, 1) for a in (-1, 0, 1) for e in (-1, 0, 1) if (r, a, e) > (0, 0, 0)]


def spherical(points: DataFrame) -> DataFrame:
    """Add range, azimuth [0, 360) and elevation [0, 180] in degrees."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return points.withColumn("range", F.round(spatial_range(x, y, z), 9)).withColumn("azimuth", azimuth_deg(x, y)).withColumn("elevation", elevation_deg(x, y, z) + 90.0)


def finite() -> F.Column:
    """Whether x, y and z are numbers (neither NaN nor infinite nor null) of which the range can be told."""
    return F.coalesce(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z") < float("inf"), F.lit(False))


def voxelize(points: DataFrame, cfg: ClustererConfig = ClustererConfig()) -> DataFrame:
    """Points with finite coordinates and their voxel."""
    return _binned(points.where(finite()), cfg)


def _binned(points: DataFrame, cfg: ClustererConfig) -> DataFrame:
    bins = (("range", cfg.voxel_range_m), ("azimuth", cfg.voxel_azimuth_deg), ("elevation", cfg.voxel_elevation_deg))
    return spherical(points).withColumns({f"{k}_index": F.floor(F.col(k) / size) for k, size in bins})


def distinct_voxels(voxelized: DataFrame) -> DataFrame:
    return voxelized.select(*VOXEL).distinct()


def _node(prefix: str = "") -> F.Column:
    """A voxel as one number that sorts by frame, range, azimuth, elevation."""
    out = F.col(f"{prefix}frame_id").cast("decimal(38,0)")
    for k, size in (("range_index", 1 << 24), ("azimuth_index", 1 << 16), ("elevation_index", 1 << 16)):
        out = (out * size + F.col(prefix + k)).cast("decimal(38,0)")
    return out


def voxel_edges(voxels: DataFrame, cfg: ClustererConfig = ClustererConfig()) -> DataFrame:
    """Undirected edges between occupied voxels whose indices differ by at most one: each voxel asks for half of its surroundings.

    Azimuth does not wrap around unless ``full_circle`` is set.
    """
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dr", "da", "de"), s, strict=True)]) for s in HALF])
    asked = voxels.withColumn("node", _node()).select("*", F.explode(steps).alias("s"))
    azimuth = F.col("azimuth_index") + F.col("s.da")
    if cfg.full_circle:
        azimuth = F.pmod(azimuth, F.lit(round(360.0 / cfg.voxel_azimuth_deg)))
    asked = asked.select("frame_id", F.col("node").alias("src"), (F.col("range_index") + F.col("s.dr")).alias("range_index"), azimuth.alias("azimuth_index"), (F.col("elevation_index") + F.col("s.de")).alias("elevation_index"))
    return asked.join(voxels.select(*VOXEL, _node().alias("dst")), VOXEL).select("frame_id", "src", "dst")


def _frame_labels(cfg: ClustererConfig, names: list[str]):
    """Labels of one frame: distinct voxels, their neighbours by binary search, components, and numbers by lowest point_index."""

    def run(table: pa.Table) -> pa.Table:
        index = table.column("point_index").to_numpy()
        r, a, e = (table.column(k).to_numpy() for k in VOXEL[1:])
        good = table.column("finite").to_numpy()
        label = np.full(len(index), -1, np.int32)
        if good.any():
            r, a, e = (np.asarray(v[good], np.int64) for v in (r, a, e))
            # Gaps of the range index close up to 2, so that a far point doesn't widen the codes.
            levels, place = np.unique(r, return_inverse=True)
            close = np.concatenate([[0], np.cumsum(np.minimum(np.diff(levels), 2))])[place]
            wide, high = int(a.max()) + 3, int(e.max()) + 3
            code = lambda x, y, z: (x * wide + y + 1) * high + z + 1
            voxels, first, own = np.unique(code(close, a, e), return_index=True, return_inverse=True)
            x, y, z = close[first], a[first], e[first]
            turn = round(360.0 / cfg.voxel_azimuth_deg)
            src, dst = [], []
            for dr, da, de in HALF:
                near = (y + da) % turn if cfg.full_circle else y + da
                wanted = np.where((x + dr >= 0) & (near < wide - 1), code(x + dr, near, z + de), -1)
                at = np.minimum(np.searchsorted(voxels, wanted), len(voxels) - 1)
                hit = np.flatnonzero(voxels[at] == wanted)
                src.append(hit), dst.append(at[hit])
            root = component_of(len(voxels), np.concatenate(src), np.concatenate(dst))[own]
            size = np.bincount(root, minlength=len(voxels))
            least = np.full(len(voxels), np.iinfo(np.int64).max)
            np.minimum.at(least, root, index[good])
            large = np.flatnonzero(size >= max(1, cfg.min_cluster_size))
            number = np.full(len(voxels), -1, np.int32)
            number[large[np.argsort(least[large], kind="stable")]] = np.arange(len(large))
            label[good] = number[root]
        return table.select(names).append_column("cluster_label", pa.array(label))

    return run


def cluster(points: DataFrame, cfg: ClustererConfig = ClustererConfig(), by: str = "frame") -> DataFrame:
    """``points`` with ``cluster_label``: from 0 in each frame in the order of the lowest point_index; -1 for clusters under ``min_cluster_size`` points and for coordinates that are not finite.

    by ``frame``: a frame is clustered in one task, in one shuffle (a sensor's turn has some 200,000 points); by ``edges``: voxels and their edges are
    tables and components are found across tasks, for frames of any size.
    """
    if by == "frame":
        binned = _binned(points.withColumn("finite", finite()), cfg).select(*points.columns, *VOXEL[1:], "finite")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
        return binned.groupBy("frame_id").applyInArrow(_frame_labels(cfg, points.columns), f"{fields}, cluster_label int")
    voxelized = voxelize(points, cfg).withColumn("node", _node())
    reached = connected_components(voxel_edges(distinct_voxels(voxelized), cfg))
    rooted = voxelized.join(reached, "node", "left").select(*points.columns, F.coalesce("component", "node").alias("root"))
    sizes = rooted.groupBy("frame_id", "root").agg(F.count("*").alias("n"), F.min("point_index").alias("first")).where(F.col("n") >= cfg.min_cluster_size)
    order = F.dense_rank().over(W.partitionBy("frame_id").orderBy("first")) - 1
    labels = sizes.select("frame_id", "root", order.cast("int").alias("cluster_label"))
    told = rooted.join(labels, ["frame_id", "root"], "left").select(*points.columns, F.coalesce("cluster_label", F.lit(-1)).alias("cluster_label"))
    return told.union(points.where(~finite()).withColumn("cluster_label", F.lit(-1)))


def cluster_extent(clustered: DataFrame) -> DataFrame:
    """Points and height range of each cluster."""
    kept = clustered.where("cluster_label >= 0")
    return kept.groupBy("frame_id", "cluster_label").agg(F.count("*").alias("n_points"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))
