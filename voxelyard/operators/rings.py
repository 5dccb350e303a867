"""Laser rings from the order of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FIRST_RING = 63


def quadrant(x: Column, y: Column) -> Column:
    """1 to 4 by azimuth in [0, 2 pi), from signs alone."""
    return F.when((x > 0) & (y >= 0), 1).when((x <= 0) & (y > 0), 2).when((x < 0) & (y <= 0), 3).when((x >= 0) & (y < 0), 4).otherwise(1)


def assign_rings(points: DataFrame, first: int = FIRST_RING) -> DataFrame:
    """Add ``ring``: it starts at ``first`` and falls by one, down to 0, whenever the scan passes from quadrant 4 to 1."""
    w = W.partitionBy("frame_id").orderBy("point_index")
    q = points.withColumn("__q", quadrant(F.col("x"), F.col("y")))
    passed = ((F.col("__q") == 1) & (F.lag("__q", 1, 1).over(w) == 4)).cast("int")
    turns = F.sum("__p").over(w.rowsBetween(W.unboundedPreceding, 0))
    return q.withColumn("__p", passed).withColumn("ring", F.greatest(F.lit(first) - turns, F.lit(0)).cast("int")).drop("__q", "__p")


def ring_histogram(points: DataFrame) -> DataFrame:
    return points.groupBy("frame_id", "ring").agg(F.count("*").alias("n_points"))
