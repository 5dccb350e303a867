"""Places for intermediate tables that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="voxelyard-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Tables written by this process and not dropped yet.
_WRITTEN: set[str] = set()


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _WRITTEN.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["stored_at"] = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table made by ``write_table`` that nothing reads any more."""
    path = df.__dict__.get("stored_at")
    if path:
        _delete(df.sparkSession, path)


def clear_tables(spark: SparkSession) -> None:
    """Delete all tables of this process that are left in the shared folder: when the results that read them have been written."""
    for path in list(_WRITTEN):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.discard(path)
