"""Self-describing cloud messages: fields by name, offset and type, and the points as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelyard.plans.frames import LAYOUTS

#: Numbers of the value kinds in messages.
DATATYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}
#: Fixed layouts of the four kinds of points: 32-bit coordinates and intensity, 16-bit rings.
FIELD_TYPES = {"x": 7, "y": 7, "z": 7, "intensity": 7, "ring": 4, "rgb": 7}
MOST_FIELDS = 20
FIELDS = "array<struct<name:string,offset:int,datatype:int,count:int>>"
MESSAGE = f"frame_id long, height int, width int, fields {FIELDS}, is_bigendian boolean, point_step int, row_step int, data binary, is_dense boolean"


def layout_of(names: list[str]) -> list[str]:
    """The accepted layout with these field names in this order; raises for any other."""
    if len(names) > MOST_FIELDS:
        raise OverflowError(f"over {MOST_FIELDS} fields")
    if names not in LAYOUTS:
        raise ValueError(f"unsupported point layout: {names}")
    return names


def encode(points: DataFrame, types: dict[str, int] | None = None) -> DataFrame:
    """One ``MESSAGE`` row for each frame, points in the order of point_index, fields one after the other; frames without points have none.

    The fields are all columns but frame_id and point_index, 32-bit (rings 16-bit) unless ``types`` says otherwise.
    """
    names = [c for c in points.columns if c not in ("frame_id", "point_index")]
    kinds = {k: (types or {}).get(k, FIELD_TYPES[k]) for k in names}
    row = np.dtype([(k, "<" + DATATYPES[d]) for k, d in kinds.items()])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("point_index")
        out = np.zeros(table.num_rows, row)
        for k in names:
            out[k] = table.column(k).to_numpy()
        fields = [{"name": k, "offset": row.fields[k][1], "datatype": kinds[k], "count": 1} for k in names]
        dense = all(np.isfinite(out[k]).all() for k in names)
        values = table.column("frame_id")[0].as_py(), 1, len(out), fields, False, row.itemsize, row.itemsize * len(out), out.tobytes(), bool(dense)
        return pa.Table.from_pylist([dict(zip(MESSAGE_NAMES, values, strict=True))], schema=MESSAGE_SCHEMA)

    return points.groupBy("frame_id").applyInArrow(run, MESSAGE)


MESSAGE_NAMES = ["frame_id", "height", "width", "fields", "is_bigendian", "point_step", "row_step", "data", "is_dense"]
MESSAGE_SCHEMA = pa.schema(
    [("frame_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("fields", pa.list_(pa.struct([("name", pa.string()), ("offset", pa.int32()), ("datatype", pa.int32()), ("count", pa.int32())]))),
     ("is_bigendian", pa.bool_()), ("point_step", pa.int32()), ("row_step", pa.int32()), ("data", pa.binary()), ("is_dense", pa.bool_())]
)


def decode(messages: DataFrame, check_layout: bool = True) -> DataFrame:
    """``(frame_id, point_index, x, y, z, intensity, ring)`` of messages; a field that the message lacks is null. Rows may be padded beyond their points.

    Field names that are none of the accepted layouts fail the query, unless ``check_layout`` is off and x, y, z are among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                names = [f["name"] for f in m["fields"]]
                if check_layout:
                    layout_of(names)
                order = ">" if m["is_bigendian"] else "<"
                kind = np.dtype({"names": names, "formats": [order + DATATYPES[f["datatype"]] for f in m["fields"]], "offsets": [f["offset"] for f in m["fields"]], "itemsize": m["point_step"]})
                found = np.concatenate([np.empty(0, kind), *(np.frombuffer(m["data"], kind, m["width"], r * m["row_step"]) for r in range(m["height"]))])
                n = len(found)
                columns = [pa.array([m["frame_id"]] * n, pa.int64()), pa.array(np.arange(n))]
                columns += [pa.array(found[k].astype(np.float64)) if k in names else pa.nulls(n, pa.float64()) for k in ("x", "y", "z", "intensity")]
                columns.append(pa.array(found["ring"].astype(np.int32)) if "ring" in names else pa.nulls(n, pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, ["frame_id", "point_index", "x", "y", "z", "intensity", "ring"])

    return messages.select(*MESSAGE_NAMES).mapInArrow(run, "frame_id long, point_index long, x double, y double, z double, intensity double, ring int")


def with_layout(points: DataFrame, layout: list[str]) -> DataFrame:
    """Decoded points with the fields of one of the accepted layouts alone."""
    return points.select("frame_id", "point_index", *layout_of(list(layout)))


def packed_colour(r, g, b):
    """Red, green and blue in the 24 low bits of a number."""
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def encode_coloured(points: DataFrame) -> DataFrame:
    """Messages of points ``(frame_id, point_index, x, y, z, r, g, b)``: the colour's bits stand in a 32-bit field named rgb."""
    named = points.select("frame_id", "point_index", "x", "y", "z", packed_colour(F.col("r"), F.col("g"), F.col("b")).alias("rgb"))
    return encode(named, {"rgb": 6})
