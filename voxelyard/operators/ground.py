"""Ground segmentation: polar grid, elevation map, plane correction, range image, jump convolution, labels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelyard.config import GROUND, OBSTACLE, UNKNOWN, SegmenterConfig
from voxelyard.functions.geometry import TWO_PI, atan2_approx, elevation_deg, planar_range, truncated
from voxelyard.sources.workdir import write_table

CELL = ["frame_id", "azimuth_index", "radial_index"]
PIXEL = ["frame_id", "height_index", "width_index"]
#: Row and column steps to the 24 pixels around one.
AROUND = [(r, c) for r in range(-2, 3) for c in range(-2, 3) if (r, c) != (0, 0)]


def polar_grid(points: DataFrame, cfg: SegmenterConfig = SegmenterConfig()) -> DataFrame:
    """Points within the height, distance and image bands, with polar cell and image pixel. NaN coordinates fall out with the bands."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    low, high = -cfg.sensor_height_m + cfg.z_min_m, -cfg.sensor_height_m + cfg.z_max_m
    known = ~(F.isnan("x") | F.isnan("y") | F.isnan("z"))
    near = points.where(known & z.between(low, high)).withColumn("distance", planar_range(x, y))
    near = near.where(F.col("distance").between(cfg.min_distance_m, cfg.max_distance_m))
    cells = near.withColumn("radial_index", truncated(F.col("distance") / cfg.grid_radial_spacing_m)).where(F.col("radial_index") < cfg.rings)
    cells = cells.withColumn("azimuth", atan2_approx(y, x) + F.when(y < 0, TWO_PI).otherwise(0.0))
    cells = cells.withColumn("azimuth_index", F.least(truncated(F.col("azimuth") / cfg.slice_rad), F.lit(cfg.slices - 1)))
    per_row = (cfg.elevation_up_deg - cfg.elevation_down_deg) / cfg.image_height
    by_ring = "ring" in points.columns and not cfg.assume_unorganized_cloud
    row = F.col("ring") if by_ring else truncated((elevation_deg(x, y, z) - cfg.elevation_down_deg) / per_row)
    cells = cells.withColumn("height_index", row.cast("int")).where(F.col("height_index").between(0, cfg.image_height - 1))
    return cells.withColumn("width_index", truncated((cfg.image_width - 1) * F.col("azimuth") / TWO_PI))


def robust_minimum(grid: DataFrame, cfg: SegmenterConfig = SegmenterConfig()) -> DataFrame:
    """Lowest height per cell, above the highest jump of over ``gap_m`` in the lower half (reflections below the road)."""
    w = W.partitionBy(*CELL).orderBy("z")
    ranked = grid.select(*CELL, "z", F.lag("z").over(w).alias("below"), (F.row_number().over(w) - 1).alias("i"), F.count("*").over(W.partitionBy(*CELL)).alias("n"))
    jump = F.when((F.col("i") <= F.floor(F.col("n") / 2)) & (F.col("z") - F.col("below") > cfg.gap_m), F.col("z"))
    return ranked.groupBy(*CELL).agg(F.coalesce(F.max(jump), F.min("z")).alias("z_min"))


def elevation_map(cells: DataFrame, cfg: SegmenterConfig = SegmenterConfig()) -> DataFrame:
    """Ground elevation of occupied cells: it rises by at most a step per ring and never exceeds a cell's minimum.

    The recursion e(r) = min(z_min(r), e(r-1) + step) is the running minimum of z_min(k) - k * step, plus r * step; ring 0 is fixed.
    """
    step = F.col("radial_index") * F.lit(cfg.elevation_step)
    w = W.partitionBy("frame_id", "azimuth_index").orderBy("radial_index").rowsBetween(W.unboundedPreceding, 0)
    own = F.when(F.col("radial_index") > 0, F.col("z_min") - step)
    lowest = F.least(F.min(own).over(w), F.lit(cfg.first_elevation))
    return cells.withColumn("elevation", F.coalesce(lowest, F.lit(cfg.first_elevation)) + step)


def elevation_map_32(cells: DataFrame, cfg: SegmenterConfig = SegmenterConfig()) -> DataFrame:
    """As ``elevation_map``, step by step in 32-bit arithmetic: rounding then depends on the order of the steps. One array of ``rings`` numbers for each slice."""
    single = lambda v: F.lit(v).cast("float")
    slices = cells.groupBy("frame_id", "azimuth_index").agg(F.map_from_entries(F.collect_list(F.struct("radial_index", F.col("z_min").cast("float")))).alias("lowest"))
    rise = lambda e: (F.element_at(e, -1) + single(cfg.elevation_step)).cast("float")
    known = lambda r: F.coalesce(F.element_at("lowest", r), single(float("inf")))
    run = F.aggregate(F.sequence(F.lit(1), F.lit(cfg.rings - 1)), F.array(single(cfg.first_elevation)), lambda e, r: F.concat(e, F.array(F.least(known(r), rise(e)))))
    every = slices.select("frame_id", "azimuth_index", F.posexplode(run).alias("radial_index", "elevation"))
    return cells.select(*CELL).join(every, CELL)


def elevation_labels(grid: DataFrame, cfg: SegmenterConfig = SegmenterConfig()) -> DataFrame:
    """Gridded points with ``elevation`` and ``label``."""
    elevation = elevation_map(robust_minimum(grid, cfg), cfg).select(*CELL, "elevation")
    told = grid.join(elevation, CELL)
    label = F.when(F.col("z") >= F.col("elevation") + cfg.ground_height_threshold_m, OBSTACLE).otherwise(GROUND)
    return told.withColumn("label", label)


def _candidates(labelled: DataFrame, cfg: SegmenterConfig) -> DataFrame:
    """Points of the inner rings near the ground, ranked in grid order."""
    inner = labelled.where((F.col("radial_index") < min(4, cfg.rings)) & (F.abs(F.col("elevation") - F.col("z")) < 2 * cfg.ground_height_threshold_m))
    w = W.partitionBy("frame_id")
    rank = F.row_number().over(w.orderBy("azimuth_index", "radial_index", "point_index")) - 1
    return inner.select("frame_id", "x", "y", "z", rank.alias("rank"), F.count("*").over(w).alias("n"))


def plane_by_ranks(labelled: DataFrame, cfg: SegmenterConfig = SegmenterConfig()) -> DataFrame:
    """Best plane per frame ``(a, b, c, d, inliers, iteration)`` through the foot of the sensor and two candidates of stated ranks.

    Iteration i takes ranks 7919 i and 104729 i + 1 modulo the number of candidates; the earliest of the best wins. At least two
    candidates are needed. Each candidate meets the iterations of its frame, a fixed number.
    """
    c = write_table(_candidates(labelled, cfg), "candidates")
    sizes = c.groupBy("frame_id").agg(F.max("n").alias("n")).where("n >= 2")
    tries = sizes.select("frame_id", "n", F.explode(F.sequence(F.lit(0), F.lit(cfg.ransac_iterations - 1))).alias("i"))
    second, third = F.pmod(F.col("i") * 7919, F.col("n")), F.pmod(F.col("i") * 104729 + 1, F.col("n"))
    third = F.when(second == third, F.pmod(third + 1, F.col("n"))).otherwise(third)
    drawn = tries.select("frame_id", "i", second.alias("r2"), third.alias("r3"))
    two = c.select("frame_id", F.col("rank").alias("r2"), *[F.col(k).alias(f"{k}2") for k in "xyz"])
    three = c.select("frame_id", F.col("rank").alias("r3"), *[F.col(k).alias(f"{k}3") for k in "xyz"])
    planes = planes_through(drawn.join(two, ["frame_id", "r2"]).join(three, ["frame_id", "r3"]), cfg)
    scored = c.join(planes, "frame_id")
    off = F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") - F.col("d"))
    counted = scored.groupBy("frame_id", "i").agg(
        F.sum((off < cfg.ground_height_threshold_m).cast("long")).alias("inliers"), *[F.first(k).alias(k) for k in "abcd"]
    )
    best = F.max_by(F.struct("a", "b", "c", "d", "inliers", F.col("i").alias("iteration")), F.struct(F.col("inliers"), -F.col("i"))).alias("best_plane")
    return counted.where("inliers > 0").groupBy("frame_id").agg(best).select("frame_id", "best_plane.*")


def planes_through(pairs: DataFrame, cfg: SegmenterConfig) -> DataFrame:
    """Unit normals, pointing up, and offsets of planes through (0, 0, -h) and two points; steep or degenerate ones are left out."""
    h = F.lit(cfg.sensor_height_m)
    u = [F.col("x2"), F.col("y2"), F.col("z2") + h]
    v = [F.col("x3"), F.col("y3"), F.col("z3") + h]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    raw = pairs.select("frame_id", "i", *[e.alias(k) for k, e in zip(("nx", "ny", "nz"), n, strict=True)])
    raw = raw.withColumn("sq", F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")).where("sq >= 1e-5D")
    sign = F.when(F.col("nz") < 0, -F.sqrt("sq")).otherwise(F.sqrt("sq"))
    unit = raw.select("frame_id", "i", (F.col("nx") / sign).alias("a"), (F.col("ny") / sign).alias("b"), (F.col("nz") / sign).alias("c"))
    return unit.where(F.col("c") >= cfg.least_normal_z).withColumn("d", -F.col("c") * h)


def draw_pairs(n: int, iterations: int, seed: int = 42) -> list[tuple[int, int]]:
    """Pairs of different indices below n from a 32-bit Mersenne Twister, mapped by multiply-and-shift with rejection."""
    raw = np.random.RandomState(seed)

    def draw() -> int:
        while True:
            product = int(raw.randint(0, 2**32, dtype=np.uint64)) * n
            if product % 2**32 >= 2**32 % n:
                return product >> 32

    out = []
    for _ in range(iterations):
        second, third = draw(), draw()
        while third == second:
            third = draw()
        out.append((second, third))
    return out


def plane_by_draws(labelled: DataFrame, cfg: SegmenterConfig = SegmenterConfig(), seed: int = 42) -> DataFrame:
    """As ``plane_by_ranks`` with seeded random draws; the candidates of one frame (its four inner rings) meet in one task."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("rank")[["x", "y", "z"]].to_numpy(np.float64)
        best = None
        if len(p) >= 2:
            for i, (second, third) in enumerate(draw_pairs(len(p), cfg.ransac_iterations, seed)):
                foot = np.array([0.0, 0.0, -cfg.sensor_height_m])
                n = np.cross(p[second] - foot, p[third] - foot)
                size = n @ n
                if size < 1e-5:
                    continue
                n = n / (math.sqrt(size) if n[2] >= 0 else -math.sqrt(size))
                if n[2] < cfg.least_normal_z:
                    continue
                d = n @ foot
                count = int((np.abs(p @ n - d) < cfg.ground_height_threshold_m).sum())
                if count and (best is None or count > best[4]):
                    best = (*n, d, count, i)
        rows = [] if best is None else [(pdf["frame_id"].iloc[0], *best)]
        return pd.DataFrame(rows, columns=["frame_id", "a", "b", "c", "d", "inliers", "iteration"])

    return _candidates(labelled, cfg).groupBy("frame_id").applyInPandas(fit, "frame_id long, a double, b double, c double, d double, inliers long, iteration int")


def correct_by_plane(labelled: DataFrame, planes: DataFrame, cfg: SegmenterConfig = SegmenterConfig()) -> DataFrame:
    """Points of the inner rings less than the threshold above the frame's plane become ground."""
    above = F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") - F.col("d")
    inner = F.col("radial_index") < min(4, cfg.rings)
    label = F.when(inner & F.coalesce(above < cfg.ground_height_threshold_m, F.lit(False)), GROUND).otherwise(F.col("label"))
    return labelled.join(planes.select("frame_id", "a", "b", "c", "d"), "frame_id", "left").withColumn("label", label).drop("a", "b", "c", "d")


def range_image(labelled: DataFrame) -> DataFrame:
    """The closest point of each pixel; ties go to the first in grid order."""
    order = F.struct((F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("depth_sq"), "azimuth_index", "radial_index", "point_index")
    best = labelled.groupBy(*PIXEL).agg(F.min_by(F.struct("point_index", "x", "y", "z", "label", (F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("depth_sq")), order).alias("winner"))
    return best.select(*PIXEL, "winner.*")


def _neighbours(core: DataFrame, image: DataFrame, columns: list[str]) -> DataFrame:
    """Core pixels with each occupied pixel of their 5 x 5 surroundings, prefixed ``n_``: an equi-join on the shifted pixel."""
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in AROUND])
    asked = core.select("*", F.explode(steps).alias("s")).withColumn("n_row", F.col("height_index") + F.col("s.dr")).withColumn("n_col", F.col("width_index") + F.col("s.dc")).drop("s")
    told = image.select("frame_id", F.col("height_index").alias("n_row"), F.col("width_index").alias("n_col"), *[F.col(c).alias(f"n_{c}") for c in columns])
    return asked.join(told, ["frame_id", "n_row", "n_col"])


def conflict_pixels(image: DataFrame) -> DataFrame:
    """Ground pixels with an obstacle pixel in their 5 x 5 surroundings (obstacles dilated)."""
    near = _neighbours(image.where(F.col("label") == OBSTACLE).select(*PIXEL), image.where(F.col("label") == GROUND), [])
    hit = near.select("frame_id", F.col("n_row").alias("height_index"), F.col("n_col").alias("width_index")).distinct()
    return image.join(hit, PIXEL, "left_semi")


def convolve_simultaneous(image: DataFrame, cfg: SegmenterConfig = SegmenterConfig()) -> DataFrame:
    """Image with conflict pixels voted anew by their surroundings, all at once: conflict pixels have no vote.

    Weights fall off exponentially with distance; ties go to ground; without any voter in reach the pixel is unknown.
    """
    image = write_table(image, "image")
    conflict = write_table(conflict_pixels(image), "conflict")
    voters = image.join(conflict.select(*PIXEL, F.lit(True).alias("conflict")), PIXEL, "left")
    pairs = _neighbours(conflict.select(*PIXEL, "x", "y", "z"), voters, ["x", "y", "z", "label", "conflict"])
    gap = F.sqrt(sum(((F.col(k) - F.col(f"n_{k}")) * (F.col(k) - F.col(f"n_{k}")) for k in "xyz"), F.lit(0.0)))
    near = pairs.withColumn("gap", gap).where(F.col("gap") <= cfg.kernel_threshold_distance_m)
    weight = F.exp(-cfg.amplification_factor * F.col("gap"))
    free = F.col("n_conflict").isNull()
    votes = near.groupBy(*PIXEL).agg(
        F.round(F.sum(F.when(free & (F.col("n_label") == OBSTACLE), weight).otherwise(0.0)), 12).alias("w_obstacle"),
        F.round(F.sum(F.when(free & (F.col("n_label") == GROUND), weight).otherwise(0.0)), 12).alias("w_ground"),
        F.sum(weight).alias("w_all"),
    )
    voted = conflict.select(*PIXEL).join(votes, PIXEL, "left")
    label = F.when(F.coalesce(F.col("w_all"), F.lit(0.0)) <= 2.0**-23, UNKNOWN).when(F.col("w_obstacle") > F.col("w_ground"), OBSTACLE).otherwise(GROUND)
    voted = voted.select(*PIXEL, label.alias("voted"))
    return image.join(voted, PIXEL, "left").withColumn("label", F.coalesce("voted", "label")).drop("voted")


def convolve_in_order(image: DataFrame, cfg: SegmenterConfig = SegmenterConfig(), stale_border: bool = False) -> DataFrame:
    """As ``convolve_simultaneous``, but in scan order: a conflict pixel that was voted already votes for those after it.

    The order makes a frame one sequential unit; its image has at most height x width pixels. With ``stale_border`` a place beyond the image keeps the vote that it
    had for the conflict pixel before (though not in the sum that a vote needs), as the original does; otherwise it has none.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {(r, c): i for i, (r, c) in enumerate(zip(pdf["height_index"], pdf["width_index"]))}
        xyz, label = pdf[["x", "y", "z"]].to_numpy(), pdf["label"].to_numpy().copy()
        conflict = {p for p, i in at.items() if label[i] == GROUND and any(label[at[q]] == OBSTACLE for d in AROUND if (q := (p[0] + d[0], p[1] + d[1])) in at)}
        now = label.copy()
        for p in conflict:
            now[at[p]] = -1
        votes = dict.fromkeys(AROUND, (0.0, UNKNOWN))
        for p in sorted(conflict):
            i, total = at[p], 0.0
            for d in AROUND:
                q = p[0] + d[0], p[1] + d[1]
                if stale_border and not (0 <= q[0] < cfg.image_height and 0 <= q[1] < cfg.image_width):
                    continue
                j, votes[d] = at.get(q), (0.0, UNKNOWN)
                if j is None or (gap := math.dist(xyz[i], xyz[j])) > cfg.kernel_threshold_distance_m:
                    continue
                w = math.exp(-cfg.amplification_factor * gap)
                total += w
                votes[d] = w, now[j]
            if total > 2.0**-23:
                obstacle, ground = (round(math.fsum(w for w, k in votes.values() if k == own), 12) for own in (OBSTACLE, GROUND))
                now[i] = OBSTACLE if obstacle > ground else GROUND
        return pdf.assign(label=np.where(now < 0, UNKNOWN, now))

    return image.groupBy("frame_id").applyInPandas(run, image.schema)


def point_labels(points: DataFrame, image: DataFrame) -> DataFrame:
    """Every point with its label: pixel winners have their pixel's, all others are unknown."""
    known = image.select("frame_id", "point_index", F.col("label"))
    return points.join(known, ["frame_id", "point_index"], "left").withColumn("label", F.coalesce("label", F.lit(UNKNOWN)))


def segment(points: DataFrame, cfg: SegmenterConfig = SegmenterConfig(), plane: str = "draws", convolution: str = "ordered") -> DataFrame:
    """Label every point. plane: ``draws``, ``ranks`` or ``none``; convolution: ``ordered``, ``simultaneous`` or ``none``."""
    labelled = write_table(elevation_labels(polar_grid(points, cfg), cfg), "labelled")
    if plane != "none":
        labelled = correct_by_plane(labelled, (plane_by_draws if plane == "draws" else plane_by_ranks)(labelled, cfg), cfg)
    image = range_image(labelled)
    if convolution != "none":
        image = (convolve_in_order if convolution == "ordered" else convolve_simultaneous)(image, cfg)
    return point_labels(points, image)


def label_name(label: Column) -> Column:
    return F.when(label == GROUND, "ground").when(label == OBSTACLE, "obstacle").otherwise("unknown")
