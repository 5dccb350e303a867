"""A point cloud derived from the ``events`` table: six frames, ground points and 25 clumps of object points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One text for every engine; literals are cast so that no engine computes in decimals.
POINTS_SQL = """
with e as (
  select event_id, user_id % 25 as k, event_type in ('error','purchase') as is_obj,
         cast(floor((extract(day from ts) - 1) / 5) as bigint) as frame_id
  from {events}),
p as (
  select frame_id, event_id, is_obj,
    case when is_obj then cast((k*37)%61-30 as double) + cast(0.37 as double)
                          + cast((event_id*7919)%1000 as double)/cast(1000 as double)*cast(1.5 as double)
         else cast((event_id*7919)%8000 as double)/cast(100 as double) - cast(39.987 as double) end as x,
    case when is_obj then cast((k*53)%61-30 as double) + cast(0.41 as double)
                          + cast((event_id*104729)%1000 as double)/cast(1000 as double)*cast(0.8 as double)
         else cast((event_id*104729)%8000 as double)/cast(100 as double) - cast(39.983 as double) end as y,
    case when is_obj then cast(-1.73 as double) + cast((event_id*15485863)%1000 as double)/cast(1000 as double)*cast(1.6 as double)
         else cast(-1.73 as double) + cast((event_id*31)%100 as double)/cast(1000 as double) end as z
  from e)
select frame_id, cast(row_number() over (partition by frame_id order by event_id) - 1 as bigint) as point_index, x, y, z, is_obj from p
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    return spark.sql(POINTS_SQL, events=events)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("is_obj").drop("is_obj")
