"""Point cloud files (PCD): ascii, binary and compressed bodies, one frame a file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelyard.sources.files import write_bytes

#: Fixed values of the format: value kinds by TYPE and SIZE.
KINDS = {("F", 4): "<f4", ("F", 8): "<f8", ("I", 1): "<i1", ("I", 2): "<i2", ("I", 4): "<i4", ("I", 8): "<i8", ("U", 1): "<u1", ("U", 2): "<u2", ("U", 4): "<u4", ("U", 8): "<u8"}
FILES = "*.pcd"
POINTS = "path string, point_index long, x double, y double, z double, intensity double, ring int"


def expand_lzf(data: bytes, size: int) -> bytes:
    """LZF: runs of literals, and copies of earlier output that may overlap themselves."""
    out, at = bytearray(), 0
    while at < len(data):
        control = data[at]
        at += 1
        if control < 32:
            out += data[at : at + control + 1]
            at += control + 1
            continue
        length = control >> 5
        if length == 7:
            length += data[at]
            at += 1
        back = ((control & 31) << 8 | data[at]) + 1
        at += 1
        if back > len(out):
            raise ValueError("LZF: a copy from before the beginning")
        for _ in range(length + 2):
            out.append(out[-back])
    if len(out) != size:
        raise ValueError(f"LZF: {len(out)} bytes instead of {size}")
    return bytes(out)


def pack_lzf(data: bytes) -> bytes:
    """LZF with literals alone, which every reader takes."""
    return b"".join(bytes([len(data[i : i + 32]) - 1]) + data[i : i + 32] for i in range(0, len(data), 32))


def parse_pcd(data: bytes) -> dict[str, np.ndarray]:
    """Columns of a file by field name; padding fields (``_``) are left out, of fields with several values the first counts."""
    head, at = {}, 0
    while "DATA" not in head:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("PCD: no DATA line")
        line = data[at:end].decode("ascii", "replace").split("#")[0].split()
        at = end + 1
        if line:
            head[line[0].upper()] = line[1:]
    names = head.get("FIELDS") or head.get("COLUMNS") or []
    if not names or not {"SIZE", "TYPE"} <= set(head):
        raise ValueError("PCD: FIELDS, SIZE or TYPE is missing")
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(names))]
    n = int(head["POINTS"][0]) if "POINTS" in head else int(head["WIDTH"][0]) * int(head.get("HEIGHT", ["1"])[0])
    kinds = [np.dtype(KINDS[t.upper(), int(s)]) for t, s in zip(head["TYPE"], head["SIZE"], strict=True)]
    way = head["DATA"][0].lower()
    if way == "ascii":
        words = data[at:].split()
        if len(words) < n * sum(counts):
            raise ValueError("PCD: too few values")
        table = np.array(words[: n * sum(counts)]).reshape(n, sum(counts))
        firsts = np.cumsum([0, *counts[:-1]])
        return {k: table[:, c].astype(np.float64 if t.kind == "f" else np.int64).astype(t) for k, t, c in zip(names, kinds, firsts, strict=True) if k != "_"}
    if way == "binary":
        row = np.dtype({"names": [f"f{i}" for i in range(len(names))], "formats": [(t, (c,)) for t, c in zip(kinds, counts, strict=True)]})
        found = np.frombuffer(data, row, n, at)
        return {k: found[f"f{i}"][:, 0] for i, k in enumerate(names) if k != "_"}
    if way == "binary_compressed":
        packed, size = np.frombuffer(data, "<u4", 2, at).tolist()
        body, out, start = expand_lzf(data[at + 8 : at + 8 + packed], size), {}, 0
        for k, t, c in zip(names, kinds, counts, strict=True):  # field after field
            values = np.frombuffer(body, t, n * c, start).reshape(n, c)
            out |= {k: values[:, 0]} if k != "_" else {}
            start += n * c * t.itemsize
        return out
    raise ValueError(f"PCD: unknown DATA {way}")


def format_pcd(columns: dict[str, np.ndarray], way: str = "binary") -> bytes:
    """A file with the given columns."""
    n = len(next(iter(columns.values())))
    typed = {k: np.ascontiguousarray(v).astype(v.dtype.newbyteorder("<")) for k, v in columns.items()}
    letter = {"f": "F", "i": "I", "u": "U"}
    head = "\n".join(
        ["# .PCD v0.7 - Point Cloud Data file format", "VERSION 0.7", "FIELDS " + " ".join(typed), "SIZE " + " ".join(str(v.dtype.itemsize) for v in typed.values()),
         "TYPE " + " ".join(letter[v.dtype.kind] for v in typed.values()), "COUNT " + " ".join("1" for _ in typed), f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", f"DATA {way}", ""]
    ).encode()
    if way == "ascii":
        return head + "\n".join(" ".join(repr(x) for x in row) for row in zip(*(v.tolist() for v in typed.values()), strict=True)).encode() + b"\n"
    if way == "binary":
        rows = np.zeros(n, [(k, v.dtype) for k, v in typed.items()])
        for k, v in typed.items():
            rows[k] = v
        return head + rows.tobytes()
    body = b"".join(v.tobytes() for v in typed.values())
    packed = pack_lzf(body)
    return head + np.array([len(packed), len(body)], "<u4").tobytes() + packed


def decode_files(files: DataFrame) -> DataFrame:
    """``POINTS`` of a table ``(path, content)``, batch or stream; a missing intensity or ring is null. A file that is no PCD fails the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                found = parse_pcd(content.as_py())
                n = len(found["x"])
                columns = [pa.array([path.as_py()] * n, pa.string()), pa.array(np.arange(n))]
                columns += [pa.array(found[k].astype(np.float64)) if k in found else pa.nulls(n, pa.float64()) for k in ("x", "y", "z", "intensity")]
                columns.append(pa.array(found["ring"].astype(np.int32)) if "ring" in found else pa.nulls(n, pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, ["path", "point_index", "x", "y", "z", "intensity", "ring"])

    return files.select("path", "content").mapInArrow(run, POINTS)


def read_pcd(spark: SparkSession, folder: str) -> DataFrame:
    """``(frame_id, path, point_index, x, y, z, intensity, ring)`` of the ``.pcd`` files right in a folder, numbered from 0 in the order of their paths.

    The numbering sorts one short row for each file; bodies are read by the tasks that decode them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", FILES).load(folder)
    numbers = files.select("path", (F.row_number().over(W.orderBy("path")) - 1).cast("long").alias("frame_id"))
    points = decode_files(files).join(numbers, "path")
    return points.select("frame_id", "path", "point_index", "x", "y", "z", "intensity", "ring")


def write_pcd(points: DataFrame, folder: str, way: str = "binary", digits: int = 9) -> DataFrame:
    """Write one file for each frame, its points in the order of point_index and named by its number; returns ``(frame_id, path, n_points)``.

    All columns but frame_id and point_index are fields. Coordinates keep their type, so a round trip loses nothing.
    """
    fields = [c for c in points.columns if c not in ("frame_id", "point_index")]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("point_index")
        frame = table.column("frame_id")[0].as_py()
        path = f"{folder}/{frame:0{digits}d}.pcd"
        write_bytes(path, format_pcd({c: table.column(c).to_numpy() for c in fields}, way))
        return pa.table({"frame_id": pa.array([frame], pa.int64()), "path": [path], "n_points": pa.array([table.num_rows], pa.int64())})

    return points.groupBy("frame_id").applyInArrow(run, "frame_id long, path string, n_points long")
