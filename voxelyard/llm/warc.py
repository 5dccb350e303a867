"""WARC archives with a two-level capture index.

Archives hold one gzip member per record, so a record can be read by its byte range alone. The index has two levels:
captures sorted by reversed-host URL key are cut into compressed blocks, and a sparse directory keeps the first key of each
block. A lookup searches the directory, reads the one or few blocks that may hold the key, and then the records' ranges.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelyard.llm._shared import RangeReader, new_path, opened_for_writing, partitions_for, released, small_batches, values_of, write_table

CAPTURE = "surt string, page_id {id}, url string, archive string, offset long, length long, record_type string"
RECORD = "page_id {id}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id}, payload binary"
SHARD = "first_key string, last_key string, directory string, blocks long, captures long"
#: Captures in an index block.
BLOCK_LINES = 2000
#: An archive is closed beyond this size.
ARCHIVE_BYTES = 1 << 30
#: Ranges this close together are read by one task.
STRETCH = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str | None) -> str:
    """Sort key of a URL: host labels reversed and comma-joined, then ``)`` and the rest; null or no ``://``: ``)`` and the whole."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return ")" + scheme
    cut = re.search(r"[/?#]", rest)
    host, path = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    return ",".join(reversed(host.lower().split("."))) + ")" + path


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts))}>"


def _member(head: dict, block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": len(block)}).items() if v is not None)
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode("ascii") + b"\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def _information(name: str) -> bytes:
    """The record that opens an archive."""
    head = {"WARC-Type": "warcinfo", "WARC-Record-ID": _record_id(name), "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}
    return _member(head, b"format: WARC File Format 1.1\r\n")


def _record(page_id, url: str | None, payload: bytes | None, size: int, digest: str, copy: int, first, shared: bool) -> bytes:
    """A response with its payload, or, if ``first`` is a tuple of the page id that it revisits, a revisit without one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    own = page_id, digest, *(() if shared and not first else (url, copy))
    head = {
        "WARC-Type": "revisit" if first else "response",
        "WARC-Record-ID": _record_id(*own),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url and "://" in url else f"urn:page:{quote(json.dumps(page_id))}",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": PROFILE if first else None,
        "WARC-Refers-To": _record_id(first[0], digest) if first else None,
        "Refers-To-Page": json.dumps(first[0]) if first else None,
        "Content-Type": "application/http; msgtype=response",
    }
    return _member(head, http if first else http + payload)


def parse_record(member: bytes) -> dict:
    """Headers, payload (empty for a revisit) and what the HTTP head says of its length."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("ascii").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "payload": payload, "http_length": int(re.search(rb"Content-Length: (\d+)", http)[1])}


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0) -> DataFrame:
    """Write one record per row and return the captures table ``(surt, page_id, url, archive, offset, length, record_type)``.

    The payload is the html in UTF-8; null is empty. Of records with equal payloads of ``min_payload`` bytes or more, that with
    the smallest page_id is a response and the others are revisits without a payload; shorter ones are all responses. Of
    repeated rows (same id and payload) that with the smallest url is the response, and of rows alike in the url too the first; a null id or url sorts last. Rows alike in all
    three travel as one row and its number. Other columns are ignored. A task that fails or runs twice leaves an archive that no capture names.
    """
    small_batches(pages.sparkSession)
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    folder = new_path(spark, "archives")
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    # Counted before the shuffle: a payload that very many rows share is a few partial counts.
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    narrow = rows.where(F.length("payload") >= min_payload).groupBy("page_id", "url", "sha").agg(F.count("*").alias("n"))
    shared = narrow.groupBy("sha").agg(F.min(order).alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n")
    told = narrow.join(shared, "sha").select("page_id", "url", "sha", F.struct((order == F.col("first")).alias("is_first"), F.col("first.page_id").alias("first_id")).alias("told"))
    empty = F.lit(None)
    every = rows.select("page_id", "url", "sha", "payload", F.lit(1).alias("n"), empty.cast(told.schema["told"].dataType).alias("told"))
    every = every.union(told.select("page_id", "url", "sha", empty.cast("binary"), F.lit(0), "told"))
    met = every.groupBy("page_id", "url", "sha").agg(F.first("payload", True).alias("payload"), F.sum("n").alias("n"), F.max("told").alias("told"))
    joined = met.select("page_id", "url", "payload", "n", F.col("told").isNotNull().alias("shared"), "told.is_first", "told.first_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        while batch is not None:
            name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            with opened_for_writing(name) as out:
                out.write(head := _information(name))
                at = len(head)
                while batch is not None and at < ARCHIVE_BYTES:
                    found = []
                    for page_id, url, payload, n, shares, is_first, first_id in zip(*map(values_of, batch.columns), strict=True):
                        digest, key = sha1_base32(payload), surt(url)
                        for copy in range(n):
                            revisit = shares and (not is_first or copy > 0)
                            member = _record(page_id, url, payload, len(payload), digest, copy, (first_id,) if revisit else None, shares)
                            out.write(member)
                            found.append((key, page_id, url, name, at, len(member), "revisit" if revisit else "response"))
                            at += len(member)
                            if len(found) >= 10_000:
                                yield _batch(found, capture)
                                found = []
                    yield _batch(found, capture)
                    batch = next(batches, None)

    text = CAPTURE.format(id=kind)
    capture = _arrow(spark, text)
    return write_table(joined.mapInArrow(released(run), text), "captures")


def _arrow(spark: SparkSession, text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], text).schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def build_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort captures by key, write compressed blocks and a block directory per range, and return one row per range of keys."""
    spark, folder = captures.sparkSession, new_path(captures.sparkSession, "index")
    names = captures.columns
    n = partitions_for(spark, captures.agg(F.sum(F.length("surt") + F.length("archive") + F.coalesce(F.length("url"), F.lit(0)))).first()[0])
    ordered = captures.repartitionByRange(n, "surt", "archive", "offset").sortWithinPartitions("surt", "archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, directory, at, total = [], [], 0, 0
        base = f"{folder}/{uuid.uuid4().hex}"
        first = last = None

        def flush(out) -> None:
            nonlocal at, total
            block = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            directory.append((lines[0][0], f"{base}.blocks", at, len(block)))
            out.write(block)
            at, total = at + len(block), total + len(lines)
            lines.clear()

        batch = next(batches, None)
        if batch is None:
            return
        with opened_for_writing(f"{base}.blocks") as out:
            while batch is not None:
                for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    first, last = row[0] if first is None else first, row[0]
                    lines.append(row)
                    if len(lines) >= block_lines:
                        flush(out)
                batch = next(batches, None)
            if lines:
                flush(out)
        if first is not None:
            with opened_for_writing(f"{base}.directory") as out:
                out.write(zlib.compress(json.dumps(directory).encode()))
            yield _batch([(first, last, f"{base}.directory", len(directory), total)], shard)

    shard = _arrow(spark, SHARD)
    return write_table(ordered.mapInArrow(released(run), SHARD), "shards")


def candidate_blocks(firsts: list[str], key: str) -> range:
    """Numbers of the blocks that may hold key, by their first keys: from the last that is smaller to the last that is not larger."""
    low = max(0, bisect.bisect_left(firsts, key) - 1)
    return range(low, bisect.bisect_right(firsts, key))


def lookup(shards: DataFrame, keys: DataFrame, id_type: str = "bigint") -> DataFrame:
    """All captures of the given keys (column ``surt``; repeated and null keys are looked up once or not at all).

    The driver holds one row per range of keys: as many as the index has partitions. A task keeps the directories of the ranges that it
    meets, and a key with very many captures is dealt out by block.
    """
    spark, held_shards = keys.sparkSession, shards.collect()
    n = partitions_for(spark, 256 * sum(r.captures for r in held_shards))
    top = sorted((r.first_key, r.last_key, r.directory) for r in held_shards)
    lasts = [x[1] for x in top]
    text = CAPTURE.format(id=id_type)
    schema = _arrow(spark, text)
    wanted = _arrow(spark, "surt string, file string, at long, size long")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        for batch in batches:
            found = []
            for key in batch.column("surt").to_pylist():
                i = bisect.bisect_left(lasts, key)
                while i < len(top) and top[i][0] <= key:
                    name = top[i][2]
                    if name not in held:
                        if len(held) >= 16:
                            held.pop(next(iter(held)))
                        entries = json.loads(zlib.decompress(_whole(name)))
                        held[name] = [e[0] for e in entries], entries
                    firsts, entries = held[name]
                    found += [(key, *entries[b][1:]) for b in candidate_blocks(firsts, key)]
                    i += 1
            yield _batch(found, wanted)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader()
        rows = ((f, a, s, k) for b in batches for k, f, a, s in zip(*(b.column(c).to_pylist() for c in ("surt", "file", "at", "size")), strict=True))
        for (name, at, size), group in groupby(rows, key=lambda r: r[:3]):
            keys_here = {r[3] for r in group}
            lines = map(json.loads, zlib.decompress(reader.read(name, at, size)).decode().split("\n"))
            yield _batch([tuple(x) for x in lines if x[0] in keys_here], schema)

    sought = keys.select("surt").where("surt is not null").distinct().repartitionByRange(n, "surt").sortWithinPartitions("surt")
    blocks = sought.mapInArrow(search, "surt string, file string, at long, size long")
    dealt = blocks.repartition(n, "file", "at").sortWithinPartitions("file", "at")
    return dealt.mapInArrow(expand, text)


def _whole(uri: str) -> bytes:
    from voxelyard.llm._shared import filesystem

    store, path = filesystem(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def read_records(captures: DataFrame, with_payload: bool = True) -> DataFrame:
    """Read the records of captures by byte range; rows near each other in an archive are read by one task in file order.

    Of a response, bytes and digest are those of the payload read; of a revisit, those that its headers give.
    """
    spark = captures.sparkSession
    n = partitions_for(spark, captures.agg(F.sum("length")).first()[0])
    text = RECORD.format(id=captures.schema["page_id"].dataType.simpleString())
    schema = _arrow(spark, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader()
        for batch in batches:
            rows, held = [], 0
            for page_id, url, name, at, size in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "archive", "offset", "length")), strict=True):
                r = parse_record(reader.read(name, at, size))
                fields, payload = r["fields"], r["payload"]
                kind = fields["WARC-Type"]
                if kind == "response":
                    told = (len(payload), sha1_base32(payload), kind, None)
                else:
                    told = (r["http_length"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), kind, json.loads(fields["Refers-To-Page"]))
                rows.append((page_id, url, *told, payload if with_payload else None))
                held += len(payload)
                if held > STRETCH:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            yield _batch(rows, schema)

    placed = captures.repartition(n, "archive", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("archive", "offset")
    return placed.select("page_id", "url", "archive", "offset", "length").mapInArrow(released(run), text)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", with_payload: bool = False) -> DataFrame:
    """Archive every row, index the captures, look every URL key up again and read the records back: one row per row of ``pages``.

    An empty table gives an empty result.
    """
    captures = write_archives(pages, id_col, url_col, html_col)
    shards = build_index(captures)
    found = lookup(shards, captures, captures.schema["page_id"].dataType.simpleString())
    return read_records(found, with_payload)
