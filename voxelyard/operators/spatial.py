"""Radius and nearest-neighbour search by grid cells and by blocks of queries; dynamic-radius noise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelyard.config import NOISE, VALID, NoiseConfig
from voxelyard.functions.geometry import planar_range
from voxelyard.operators.clustering import finite
from voxelyard.sources.workdir import drop_table, write_table


def _grid(radius: Column) -> Column:
    """Binary logarithm of the cell width for a radius."""
    return F.ceil(F.log2(F.greatest(radius, F.lit(1e-6)))).cast("int")


def radius_join(queries: DataFrame, targets: DataFrame, radius: Column) -> DataFrame:
    """Pairs of a frame within a distance that may differ by query, bounds included: ``q_index, t_index, d2``. Coordinates that are not finite meet nothing.

    Each radius belongs to the grid whose cells are the next power of two wide, so a query asks for 27 cells at most, whatever its radius; targets
    stand in the grids that queries of their frame ask for. Cells meet in an equi-join by sorting: its sides are many times the size that the planner
    expects of them, so a broadcast would not fit the driver.
    """
    ball = radius.cast("double")
    r = queries.where(finite()).withColumn("__r", ball).withColumn("__g", _grid(ball))
    size = F.pow(F.lit(2.0), F.col("__g"))
    span = lambda k: F.sequence(F.floor((F.col(k) - F.col("__r")) / size), F.floor((F.col(k) + F.col("__r")) / size))
    asked = r.select("frame_id", F.col("point_index").alias("q_index"), *[F.col(k).alias(f"q{k}") for k in "xyz"], "__r", "__g", *[span(k).alias(f"s{k}") for k in "xyz"])
    for k in "xyz":
        asked = asked.withColumn(f"c{k}", F.explode(f"s{k}")).drop(f"s{k}")
    grids = r.select("frame_id", "__g").distinct()
    held = targets.where(finite()).select("frame_id", F.col("point_index").alias("t_index"), "x", "y", "z").join(grids, "frame_id")
    held = held.select("*", *[F.floor(F.col(k) / size).alias(f"c{k}") for k in "xyz"])
    met = asked.join(held.hint("merge"), ["frame_id", "__g", "cx", "cy", "cz"])
    d2 = sum(((F.col(k) - F.col(f"q{k}")) * (F.col(k) - F.col(f"q{k}")) for k in "yz"), (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")))
    return met.withColumn("d2", d2).where(F.col("d2") <= F.col("__r") * F.col("__r")).select("frame_id", "q_index", "t_index", "d2")


def radius_search(points: DataFrame, radius: float) -> DataFrame:
    """All pairs of a frame within the radius, each point with itself."""
    return radius_join(points, points, F.lit(float(radius)))


def radius_counts(points: DataFrame, radius: float, most: int | None = None) -> DataFrame:
    """Neighbours of each point, itself included; with ``most`` the count of a search that stops there."""
    counts = radius_search(points, radius).groupBy("frame_id", F.col("q_index").alias("point_index")).agg(F.count("*").alias("n"))
    return counts if most is None else counts.withColumn("n", F.least("n", F.lit(most)))


def radius_any(points: DataFrame, radius: float, most: int, nearest_first: bool = False) -> DataFrame:
    """Up to ``most`` neighbours of each point: the first by index, or the nearest (ties by index); the window keeps so many rows of a point only."""
    w = W.partitionBy("frame_id", "q_index").orderBy(*(["d2"] if nearest_first else []), "t_index")
    return radius_search(points, radius).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def nearest(queries: DataFrame, targets: DataFrame, k: int, id_col: str, vector_col: str, block: int = 1 << 16, group_col: str | None = None) -> DataFrame:
    """Exact k nearest of each query vector: ``q_id, t_id, d2, rank``; ties go to the smaller id; a row finds itself.

    Queries are taken in blocks of bounded size (65,536: some 30 MB at 64 dimensions). A block goes to every partition of the targets, which answer with their own k best, and
    the k best of these are the result: what is shuffled is k rows per query and partition. Distances come from matrix products; those near the
    k-th are measured again exactly. Targets are read once for each block of queries.
    """
    wanted = queries.select(F.col(id_col).alias("q_id"), F.col(vector_col).alias("v"), (F.col(group_col) if group_col else F.lit(0)).cast("long").alias("g"))
    held = targets.select(F.col(id_col).alias("t_id"), F.col(vector_col).alias("v"), (F.col(group_col) if group_col else F.lit(0)).cast("long").alias("g"))
    n = max(1, -(-wanted.count() // block))
    parts = []
    for b in range(n):
        rows = wanted.where(F.pmod(F.xxhash64("q_id", "g"), F.lit(n)) == b).toPandas() if n > 1 else wanted.toPandas()
        if len(rows):
            parts.append(held.mapInPandas(_block_search(rows, k), "g long, q_id long, t_id long, d2 double"))
    if not parts:
        return held.sparkSession.createDataFrame([], "g long, q_id long, t_id long, d2 double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    w = W.partitionBy("g", "q_id").orderBy("d2", "t_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.map(np.asarray)).astype(np.float64)


def _rough(q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and for each query how far they may be off."""
    own, other = (q * q).sum(axis=1), (t * t).sum(axis=1)
    slack = 1e-12 * q.shape[1] * (own + other.max(initial=0.0)) + 1e-300
    return own[:, None] + other[None, :] - 2 * (q @ t.T), slack[:, None]


def _exact(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Squared distances row by row, summed in the order of the dimensions."""
    d2 = np.zeros(len(q))
    for j in range(q.shape[1]):
        d2 += (q[:, j] - t[:, j]) ** 2
    return d2


def _block_search(rows: pd.DataFrame, k: int):
    q, ids, groups = _matrix(rows["v"]), rows["q_id"].to_numpy(), rows["g"].to_numpy()

    def run(batches):
        best = None
        for pdf in batches:
            if not len(pdf):
                continue
            t, t_ids, t_groups = _matrix(pdf["v"]), pdf["t_id"].to_numpy(), pdf["g"].to_numpy()
            for at in range(0, len(q), 256):
                part = slice(at, at + 256)
                rough, slack = _rough(q[part], t)
                rough[groups[part][:, None] != t_groups[None, :]] = np.inf
                # What may be among the k best is measured exactly; the rest is farther by more than any rounding.
                least = np.partition(rough, min(k, len(t)) - 1, axis=1)[:, [min(k, len(t)) - 1]]
                row, column = np.nonzero((rough <= least + 2 * slack) & np.isfinite(rough))
                d2 = _exact(q[part][row], t[column])
                order = np.lexsort((t_ids[column], d2, row))
                row, column, d2 = row[order], column[order], d2[order]
                first = np.searchsorted(row, row)
                kept = np.arange(len(row)) - first < k
                mine = pd.DataFrame({"g": groups[part][row[kept]], "q_id": ids[part][row[kept]], "t_id": t_ids[column[kept]], "d2": d2[kept]})
                best = mine if best is None else pd.concat([best, mine])
            best = best.sort_values(["g", "q_id", "d2", "t_id"]).groupby(["g", "q_id"]).head(k)
        if best is not None:
            yield best

    return run


def vector_radius_counts(queries: DataFrame, targets: DataFrame, radius: float, id_col: str, vector_col: str, block: int = 1 << 16) -> DataFrame:
    """``(q_id, n)``: how many targets lie within the radius of each query vector, bounds included; queries with none are absent.

    Every target is compared, in blocks of queries as in ``nearest``; each partition answers with one count per query.
    """
    wanted = queries.select(F.col(id_col).alias("q_id"), F.col(vector_col).alias("v"))
    held = targets.select(F.col(vector_col).alias("v"))
    n = max(1, -(-wanted.count() // block))
    found = held.sparkSession.createDataFrame([], "q_id long, n long")
    for b in range(n):
        rows = wanted.where(F.pmod(F.xxhash64("q_id"), F.lit(n)) == b).toPandas() if n > 1 else wanted.toPandas()
        if len(rows):
            found = found.union(held.mapInPandas(_block_counts(rows, radius * radius), "q_id long, n long"))
    return found.groupBy("q_id").agg(F.sum("n").alias("n"))


def _block_counts(rows: pd.DataFrame, most: float):
    q, ids = _matrix(rows["v"]), rows["q_id"].to_numpy()

    def run(batches):
        n = np.zeros(len(q), np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            t = _matrix(pdf["v"])
            for at in range(0, len(q), 256):
                part = slice(at, at + 256)
                rough, slack = _rough(q[part], t)
                sure = rough < most - slack
                row, column = np.nonzero(~sure & (rough <= most + slack))
                near = _exact(q[part][row], t[column]) <= most
                n[part] += sure.sum(axis=1) + np.bincount(row[near], minlength=len(sure))
        yield pd.DataFrame({"q_id": ids[n > 0], "n": n[n > 0]})

    return run


def noise_labels(points: DataFrame, cfg: NoiseConfig = NoiseConfig()) -> DataFrame:
    """Add ``noise``: 1 where fewer than ``min_neighbours`` points, itself included, lie within a radius that grows with range.

    Points that share a cell of a quarter of their grid's width are nearer to each other than their radii (the cell's diagonal is 0.433 of that width, a radius over
    0.5 of it), so a cell of enough points decides all of them. Only the others, fewer than ``min_neighbours`` a cell, are counted pair by pair:
    the pairs grow with the points, however dense these are.
    """
    radius = F.greatest(planar_range(F.col("x"), F.col("y")) * cfg.radius_multiplier_m_per_m, F.lit(cfg.min_radius_m)).cast("double")
    side, cell = F.pow(F.lit(2.0), F.col("__g") - 2), ["frame_id", "__g", "__x", "__y", "__z"]
    # Beyond so many cells from the origin (and for radii under the least grid's) rounding might decide; those points are counted.
    surest = finite() & (F.col("__r") >= 2 * side) & (F.greatest(*[F.abs(F.col(k)) for k in "xyz"]) < side * 2.0**40)
    sized = points.withColumn("__r", radius).withColumn("__g", F.when(finite(), _grid(F.col("__r"))))
    sized = write_table(sized, "noise-points")
    placed = sized.withColumns({f"__{k}": F.when(surest, F.floor(F.col(k) / side)) for k in "xyz"})
    full = placed.where("__x is not null").groupBy(*cell).agg(F.count("*").alias("__n")).where(F.col("__n") >= cfg.min_neighbours)
    told = placed.join(full.withColumn("__full", F.lit(True)).drop("__n").hint("merge"), cell, "left").select(*points.columns, "__r", "__full")
    told = write_table(told, "noise-cells")
    drop_table(sized)
    counts = radius_join(told.where("__full is null"), told, F.col("__r")).groupBy("frame_id", F.col("q_index").alias("point_index")).agg(F.count("*").alias("__n"))
    enough = counts.where(F.col("__n") >= cfg.min_neighbours).hint("merge")
    few = F.col("__full").isNull() & F.col("__n").isNull()
    return told.join(enough, ["frame_id", "point_index"], "left").select(*points.columns, F.when(few, NOISE).otherwise(VALID).alias("noise"))
