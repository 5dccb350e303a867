"""Hulls, boxes, antipodal pairs, vehicle classes and outlines of clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelyard.config import VEHICLES, VehicleConfig
from voxelyard.functions.geometry import polygon_area

GROUP = ["frame_id", "cluster_label"]
#: Sine of the turn below which three points count as collinear: what rounding makes of it.
FLAT = 1e-12
HULL = "frame_id long, cluster_label int, hull array<struct<x:double,y:double>>"


def hull_order(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Indices of the convex hull, counter-clockwise from the lowest (x, y), without collinear vertices; under three points: all of them."""
    if len(x) < 3:
        return list(range(len(x)))
    order = np.lexsort((y, x)).tolist()

    def chain(indices: list[int]) -> list[int]:
        out: list[int] = []
        for i in indices:
            while len(out) > 1:
                ax, ay, bx, by = x[out[-1]] - x[out[-2]], y[out[-1]] - y[out[-2]], x[i] - x[out[-2]], y[i] - y[out[-2]]
                if ax * by - ay * bx > FLAT * (abs(ax) + abs(ay)) * (abs(bx) + abs(by)):
                    break
                out.pop()
            out.append(i)
        return out

    return chain(order)[:-1] + chain(order[::-1])[:-1]


def convex_hulls(clustered: DataFrame) -> DataFrame:
    """``(frame_id, cluster_label, hull)`` of clusters >= 0. Tasks first reduce what they hold to partial hulls, whose hull is the same."""
    points = clustered.where("cluster_label >= 0").select(F.col("frame_id").cast("long").alias("frame_id"), F.col("cluster_label").cast("int").alias("cluster_label"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(GROUP):
                keep = hull_order(part["x"].to_numpy(), part["y"].to_numpy())
                yield part.iloc[sorted(set(keep))]

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        return pd.DataFrame({"frame_id": [pdf["frame_id"].iloc[0]], "cluster_label": [pdf["cluster_label"].iloc[0]], "hull": [[{"x": x[i], "y": y[i]} for i in hull_order(x, y)]]})

    return points.mapInPandas(reduce, points.schema).groupBy(*GROUP).applyInPandas(finish, HULL)


def min_area_boxes(hulls: DataFrame) -> DataFrame:
    """Smallest enclosing rectangle over all hull edges: ``box`` with corners, area and angle; none under three vertices. All within the row: nothing is shuffled.

    Of equal areas (to nine places: all edges of a triangle) the one with the shorter longest side, then the first edge.
    """
    hull = F.col("hull")
    shifted = F.concat(F.slice(hull, 2, F.greatest(F.size(hull) - 1, F.lit(0))), F.slice(hull, 1, 1))
    named = lambda **k: F.struct(*[v.alias(n) for n, v in k.items()])
    sides = F.zip_with(hull, shifted, lambda p, q: named(px=p["x"], py=p["y"], dx=q["x"] - p["x"], dy=q["y"] - p["y"]))
    sized = F.transform(sides, lambda e, i: named(edge=i, px=e["px"], py=e["py"], dx=e["dx"], dy=e["dy"], size=F.sqrt(e["dx"] * e["dx"] + e["dy"] * e["dy"])))
    turned = F.transform(F.filter(sized, lambda e: e["size"] >= 1e-6), lambda e: named(edge=e["edge"], px=e["px"], py=e["py"], ux=e["dx"] / e["size"], uy=e["dy"] / e["size"]))
    along = lambda e: F.transform(hull, lambda v: (v["x"] - e["px"]) * e["ux"] + (v["y"] - e["py"]) * e["uy"])
    across = lambda e: F.transform(hull, lambda v: (v["y"] - e["py"]) * e["ux"] - (v["x"] - e["px"]) * e["uy"])
    spans = F.transform(turned, lambda e: named(e=e, u0=F.array_min(along(e)), u1=F.array_max(along(e)), w0=F.array_min(across(e)), w1=F.array_max(across(e))))
    boxes = F.transform(spans, lambda b: named(k1=F.round((b["u1"] - b["u0"]) * (b["w1"] - b["w0"]), 9), k2=F.round(F.greatest(b["u1"] - b["u0"], b["w1"] - b["w0"]), 9), edge=b["e"]["edge"], area=(b["u1"] - b["u0"]) * (b["w1"] - b["w0"]), px=b["e"]["px"], py=b["e"]["py"], ux=b["e"]["ux"], uy=b["e"]["uy"], u0=b["u0"], u1=b["u1"], w0=b["w0"], w1=b["w1"]))
    best = hulls.where(F.size(hull) >= 3).select(*GROUP, F.array_min(boxes).alias("b")).where("b is not null")
    return best.select(*GROUP, box_struct(F.col("b")).alias("box"))


def box_struct(b: Column) -> Column:
    def corner(u: Column, w: Column) -> Column:
        return F.struct((b["px"] + u * b["ux"] - w * b["uy"]).alias("x"), (b["py"] + u * b["uy"] + w * b["ux"]).alias("y"))

    corners = F.array(corner(b["u0"], b["w0"]), corner(b["u1"], b["w0"]), corner(b["u1"], b["w1"]), corner(b["u0"], b["w1"]))
    sides = (b["u1"] - b["u0"]), (b["w1"] - b["w0"])
    return F.struct(corners.alias("corners"), b["area"].alias("area"), F.atan2(b["uy"], b["ux"]).alias("angle_rad"), F.greatest(*sides).alias("length"), F.least(*sides).alias("width"), F.lit(True).alias("is_valid"))


def pca_boxes(clustered: DataFrame) -> DataFrame:
    """Rectangle along the principal axes of each cluster with two points or more: two aggregations, joined by cluster."""
    kept = clustered.where("cluster_label >= 0").select(*GROUP, "x", "y")
    moments = kept.groupBy(*GROUP).agg(F.avg("x").alias("px"), F.avg("y").alias("py"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("c"), F.count("*").alias("n")).where("n >= 2")
    angle = 0.5 * F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy"))
    axes = moments.select(*GROUP, "px", "py", F.cos(angle).alias("ux"), F.sin(angle).alias("uy"))
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    spans = kept.join(axes, GROUP).select(*GROUP, "px", "py", "ux", "uy", (dx * F.col("ux") + dy * F.col("uy")).alias("u"), (dy * F.col("ux") - dx * F.col("uy")).alias("w"))
    frame = [F.first(k).alias(k) for k in ("px", "py", "ux", "uy")]
    boxes = spans.groupBy(*GROUP).agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("w").alias("w0"), F.max("w").alias("w1"), *frame)
    boxes = boxes.withColumn("area", (F.col("u1") - F.col("u0")) * (F.col("w1") - F.col("w0")))
    return boxes.select(*GROUP, box_struct(F.struct("px", "py", "ux", "uy", "u0", "u1", "w0", "w1", "area")).alias("box"))


def antipodal_of(x: list[float], y: list[float]) -> list[tuple[int, int]]:
    """Antipodal index pairs i < j of a counter-clockwise hull: vertices that parallel support lines can touch at once.

    A line along an edge touches its two vertices; the line opposite touches the vertex at which the edges turn back, or both ends of a parallel edge. Both pointers go round once.
    """
    n = len(x)
    if n < 3:
        return [(0, 1)] if n == 2 else []
    edge = [(x[(k + 1) % n] - x[k], y[(k + 1) % n] - y[k]) for k in range(n)]
    turn = lambda k, j: edge[k][0] * edge[j % n][1] - edge[k][1] * edge[j % n][0]
    found, j = set(), 1
    for k in range(n):
        j = max(j, k + 1)
        while j < k + n and turn(k, j) > 0:
            j += 1
        for opposite in (j, j + 1) if turn(k, j) == 0 else (j,):
            found |= {(min(a % n, opposite % n), max(a % n, opposite % n)) for a in (k, k + 1) if a % n != opposite % n}
    return sorted(found)


def antipodal_pairs(hulls: DataFrame) -> DataFrame:
    """``pairs array<struct<index_1, index_2>>`` for each hull."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hull")
            x, y, ends = lists.flatten().field("x").to_pylist(), lists.flatten().field("y").to_pylist(), np.cumsum([0, *lists.value_lengths().to_pylist()]).tolist()
            found = [[{"index_1": i, "index_2": j} for i, j in antipodal_of(x[a:b], y[a:b])] for a, b in zip(ends, ends[1:], strict=False)]
            pairs = pa.array(found, pa.list_(pa.struct([("index_1", pa.int32()), ("index_2", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in GROUP), lists, pairs], [*GROUP, "hull", "pairs"])

    return hulls.select(*GROUP, "hull").mapInArrow(run, HULL + ", pairs array<struct<index_1:int,index_2:int>>")


def classify_vehicles(shapes: DataFrame, cfg: VehicleConfig = VehicleConfig()) -> DataFrame:
    """Add ``vehicle_class`` to ``(n_points, z_min, z_max, hull, box)``: the first class whose bounds hold strictly, else null."""
    height, area = F.col("z_max") - F.col("z_min"), polygon_area(F.col("hull"))
    length, width, box_area = F.col("box.length"), F.col("box.width"), F.col("box.area")
    inside = lambda e, bounds: (e > bounds[0]) & (e < bounds[1])
    likely = (F.size("hull") >= 3) & (F.col("n_points") > cfg.min_points) & inside(height, cfg.height_m) & inside(area * height, cfg.volume_m3)
    fits = F.lit(None).cast("int")
    for i, v in reversed(list(enumerate(VEHICLES))):
        own = inside(length, v.length) & inside(width, v.width) & inside(height, v.height) & inside(area * height, v.volume) & inside(area, v.area)
        fits = F.when(own, i).otherwise(fits)
    return shapes.withColumn("vehicle_class", F.when(likely & (area > cfg.min_fill * box_area), fits))


def outlines(shapes: DataFrame, polygon: Column | None = None) -> DataFrame:
    """Wire frames of ``(hull, z_min, z_max)``: ``segments`` has 6 n endpoints (bottom, top, uprights); under three vertices no row."""
    ring = F.col("hull") if polygon is None else polygon
    closed = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    at = lambda p, z: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.col(z).alias("z"))
    level = lambda z: F.flatten(F.zip_with(ring, closed, lambda a, b: F.array(at(a, z), at(b, z))))
    uprights = F.flatten(F.transform(ring, lambda p: F.array(at(p, "z_min"), at(p, "z_max"))))
    kept = shapes.where(F.size(ring) >= 3)
    return kept.select(*GROUP, F.col("cluster_label").alias("marker_id"), F.concat(level("z_min"), level("z_max"), uprights).alias("segments"))
