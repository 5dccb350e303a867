"""Frames as streams: replay of files and tables, and the frame pipeline over each micro-batch with its sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxelyard.config import GROUND, OBSTACLE, UNKNOWN, ClustererConfig, SegmenterConfig
from voxelyard.functions.geometry import cluster_colour, label_colour, stamp_micros
from voxelyard.operators import ground
from voxelyard.operators.clustering import cluster
from voxelyard.operators.polygons import outlines
from voxelyard.plans.frames import describe
from voxelyard.sources.pcd import FILES, decode_files
from voxelyard.sources.workdir import write_table

FREQUENCY_HZ = 10
#: How long an outline is shown, and how many frames may wait.
OUTLINE_SECONDS, QUEUE = 0.15, 2
SENSOR_FRAME = "lidar"
LABELS = {GROUND: "ground", OBSTACLE: "obstacle", UNKNOWN: "unsegmented"}


def frame_number(path) -> F.Column:
    """The number in a file's name."""
    return F.regexp_extract(path, r"(\d+)\.pcd$", 1).cast("long")


def stamped(frames: DataFrame, start_seconds: int = 0, frequency_hz: int = FREQUENCY_HZ) -> DataFrame:
    """Add ``stamp`` and ``sensor_frame``: frame k comes k periods after the start, whenever it is replayed."""
    nanos = F.col("frame_id") * F.lit(1_000_000_000 // frequency_hz)
    second, rest = F.floor(nanos / 1_000_000_000), F.pmod(nanos, F.lit(1_000_000_000))
    return frames.withColumn("stamp", stamp_micros(second + start_seconds, rest)).withColumn("sensor_frame", F.lit(SENSOR_FRAME))


def file_stream(spark: SparkSession, folder: str, most_files: int = QUEUE, newest_first: bool = False) -> DataFrame:
    """Points of the ``.pcd`` files of a folder as they come, at most so many files in a micro-batch; frame_id is the number in the name.

    A slow reader falls behind rather than loses frames, unless it takes the newest first.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", FILES).option("maxFilesPerTrigger", most_files).option("latestFirst", newest_first).load(folder)
    points = decode_files(files).withColumn("frame_id", frame_number(F.col("path")))
    return points.select("frame_id", "point_index", "x", "y", "z", "intensity", "ring")


def looped(spark: SparkSession, points: DataFrame, n_frames: int, frequency_hz: int = FREQUENCY_HZ) -> DataFrame:
    """An endless replay of a point table: tick t carries frame t modulo ``n_frames``; points join their ticks, so a frame travels only when it is due."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", frequency_hz).load().withColumnRenamed("timestamp", "stamp").withColumnRenamed("value", "tick")
    return ticks.withColumn("frame_id", F.pmod(F.col("tick"), F.lit(n_frames))).join(points, "frame_id")


@dataclass(frozen=True)
class Sinks:
    """Folders of the results, by kind; each micro-batch has its own subfolder, which a repeated batch writes anew: every frame once."""

    folder: str

    def of(self, kind: str) -> str:
        return f"{self.folder}/{kind}"

    def write(self, df: DataFrame, kind: str, batch: int, *by: str) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.of(kind)}/batch={batch}")

    def read(self, spark: SparkSession, kind: str) -> DataFrame:
        return spark.read.option("basePath", self.of(kind)).parquet(self.of(kind)).drop("batch")


def process_frames(points: DataFrame, batch: int, sinks: Sinks, segmenter: SegmenterConfig, clusterer: ClustererConfig, plane: str, convolution: str) -> None:
    """Labels, clusters, the image and the outlines of the frames of a micro-batch; frames have no state in common. Empty results leave no file rows."""
    labelled = write_table(ground.segment(points, segmenter, plane, convolution), "stream-labels")
    name = F.coalesce(*[F.when(F.col("label") == k, v) for k, v in LABELS.items()])
    sinks.write(labelled.withColumn("cloud", name).withColumn("colour", label_colour(F.col("label"))), "clouds", batch, "cloud")
    clusters = write_table(cluster(labelled.where(F.col("label") == OBSTACLE).drop("label"), clusterer), "stream-clusters")
    kept = clusters.where("cluster_label >= 0").withColumn("colour", cluster_colour(F.col("cluster_label")))
    sinks.write(kept.sortWithinPartitions("frame_id", "cluster_label", "point_index"), "clustered", batch)
    grid = ground.polar_grid(points, segmenter)
    image = ground.range_image(ground.elevation_labels(grid, segmenter))
    flipped = image.select("frame_id", (F.lit(segmenter.image_height - 1) - F.col("height_index")).alias("row"), F.col("width_index").alias("column"), label_colour(F.col("label")).alias("colour"))
    sinks.write(flipped, "image", batch)
    drawn = stamped(outlines(describe(clusters)))
    sinks.write(drawn.withColumn("expires_at", F.col("stamp") + F.expr(f"interval {round(OUTLINE_SECONDS * 1000)} milliseconds")), "outlines", batch)


def run_stream(stream: DataFrame, sinks: Sinks, checkpoint: str, segmenter: SegmenterConfig = SegmenterConfig(), clusterer: ClustererConfig = ClustererConfig(), plane: str = "draws", convolution: str = "ordered", frequency_hz: int | None = None) -> StreamingQuery:
    """Start the frame pipeline on a stream of points; with a frequency it looks for frames so often, else it takes what there is and stops.

    A restart from the checkpoint repeats at most the batch that was cut off, into the same folders.
    """

    def batch(points: DataFrame, number: int) -> None:
        held = write_table(points, "stream-batch")
        process_frames(held.select("frame_id", "point_index", "x", "y", "z"), number, sinks, segmenter, clusterer, plane, convolution)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if frequency_hz is None else writer.trigger(processingTime=f"{1000 // frequency_hz} milliseconds")
    return writer.start()
