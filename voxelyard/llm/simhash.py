"""SimHash near-duplicate groups by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most two bits have a segment in
which they differ in at most one, so they share a variant of that segment with one bit masked out. Every fingerprint is
indexed under its 2 x 32 one-wildcard variants, equal variants meet by shuffle and sort, and each meeting is verified on
all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelyard.llm._shared import released, small_batches, values_of, words_of, write_table
from voxelyard.operators.components import connected_components

#: Members of one variant that are compared with each other in place; larger ones go to the two-sided variants.
RUN_LIMIT = 2048
#: Texts of more characters are hashed by slices of so many shingles.
LONG_TEXT, SLICE = 1 << 20, 1 << 15
#: A fingerprint that more than one row in so many has is hot; there are fewer of them than this number.
HOT = 1000
SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of one text: see ``fingerprints``."""
    return int(_batch_fingerprints([text], 1, width)[0])


def _batch_fingerprints(texts: Iterable, n_texts: int, width: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(n_texts, dtype=np.uint64)
    held, starts, rows, total = [], [], [], 0

    def flush() -> None:
        if not held:
            return
        bits = np.unpackbits(np.concatenate(held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edges = np.array([*starts, total])
        for a, b, row in zip(edges[:-1], edges[1:], rows, strict=True):
            counts = np.zeros(64, dtype=np.int64)
            for i in range(a, b, 255):
                counts += np.add.reduce(bits[i : min(i + 255, b)], axis=0, dtype=np.uint8)
            out[row] = np.packbits(2 * counts > b - a, bitorder="little").view(np.uint64)[0]
        held.clear(), starts.clear(), rows.clear()

    for row, text in enumerate(texts):
        if text and len(text) > LONG_TEXT:
            out[row] = _long_fingerprint(text, width)
            continue
        words = [w.lower() for w in words_of(text)] if text else []
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        n = max(1, len(words) - width + 1)
        first = np.concatenate(([0], ends[: n - 1])).tolist()
        last = (ends[min(width, len(words)) - 1 :] - 1).tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], dtype=np.uint64)
        held.append(hashes), starts.append(total), rows.append(row)
        total += n
        if total > 1 << 17:
            flush()
            total = 0
    flush()
    return out


def _long_fingerprint(text: str, width: int) -> int:
    """As ``_batch_fingerprints`` of one text, by slices of ``SLICE`` shingles: beside the text, memory does not follow its length."""
    import re

    import xxhash

    words = (m[0] for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode("utf-8", "surrogatepass").lower()))
    counts, total, kept = np.zeros(64, np.int64), 0, []
    while True:
        kept = kept[len(kept) - width + 1 :] if len(kept) >= width else kept
        kept += islice(words, SLICE)
        n = len(kept) - width + 1
        if n < 1:
            if total or not kept:
                break
            kept, n = [b" ".join(kept)], 1  # fewer words than a shingle: their sequence
            hashes = [xxhash.xxh64_intdigest(kept[0], SEED)]
        else:
            hashes = [xxhash.xxh64_intdigest(b" ".join(kept[i : i + width]), SEED) for i in range(n)]
        counts += np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += n
        if len(kept) < width:
            break
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0]) if total else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp long)`` for every row.

    Words of the lower-cased (A-Z) whole text, ``width``-word shingles with repeats; a bit is set if it is set in over half
    of the shingles' XXH64 values (seed 42). Fewer words than ``width``: the whole sequence is the one shingle; no word, an
    empty or a null text: zero. Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _batch_fingerprints(values_of(batch.column("text")), batch.num_rows, width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return picked.mapInArrow(released(run), f"doc_id {kind.simpleString()}, fp long")


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of 64-bit shingle hashes; zero if there are none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        counts += np.unpackbits(hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _variants(fps: DataFrame, segments: int = 2) -> DataFrame:
    """64 rows for each fingerprint: (segment, masked bit, rest of the segment) packed into one long."""
    keys = []
    for s in range(segments):
        low, high = 64 * s // segments, 64 * (s + 1) // segments
        segment = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << high - low) - 1))
        for bit in range(high - low):
            masked = segment.bitwiseAND(F.lit((1 << high - low) - 1 & ~(1 << bit)))
            keys.append(masked.bitwiseOR(F.lit((low + bit) << 32)))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (key, fp) columns, cut where a key begins: no key is spread over two pieces."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut or held and held[-1][0][-1] != key[0]:
            parts = [*held, (key[:cut], fp[:cut])]
            yield tuple(np.concatenate([p[k] for p in parts]) for k in (0, 1))
            held = []
        held.append((key[cut:], fp[cut:]))
    if held:
        yield tuple(np.concatenate([p[k] for p in held]) for k in (0, 1))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified pairs within each run; of runs over the limit the members themselves, with ``dst`` null."""
    for key, fp in _runs(batches):
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        large = sizes > RUN_LIMIT
        hot = np.repeat(large, sizes)
        pairs = []
        single = np.repeat(sizes == 1, sizes)
        keep = ~hot & ~single
        k, f = key[keep], fp[keep]
        for step in range(1, int(sizes[~large].max(initial=1))):
            same = np.flatnonzero(k[step:] == k[:-step])
            if not len(same):
                break
            near = same[_popcount(f[same] ^ f[same + step]) <= 2]
            pairs.append(np.stack([f[near], f[near + step]]))
        found = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.empty((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found[0]), pa.array(found[1]), pa.nulls(found.shape[1], pa.int64())], ["src", "dst", "key"]
        )
        if hot.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp[hot]), pa.nulls(int(hot.sum()), pa.int64()), pa.array(key[hot])], ["src", "dst", "key"]
            )


def _two_sided(hot: DataFrame) -> DataFrame:
    """Keys of which all holders are within two bits of each other: pairs of masked bits, one of them in the segment of the run.

    Members of a run agree on its segment but for the masked bit. A pair within two bits differs there in that bit or not at
    all; masking it and any one bit of the other segment, or any two bits of the other, covers both cases.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("src").to_numpy().view(np.uint64)
            place = (batch.column("key").to_numpy() >> 32).astype(np.uint64)
            other = np.where(place < 32, 32, 0).astype(np.uint64)
            masks = [(i, None) for i in range(32)] + [(i, j) for i in range(32) for j in range(i)]
            for i, j in masks:
                second = place if j is None else other + np.uint64(j)
                first = other + np.uint64(i)
                masked = fp & ~((np.uint64(1) << first) | (np.uint64(1) << second))
                low, high = np.minimum(first, second).astype(np.int32), np.maximum(first, second).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp.view(np.int64)), pa.array(masked.view(np.int64)), pa.array(low * 64 + high)], ["fp", "rest", "bits"]
                )

    return hot.select("src", "key").mapInArrow(released(run), "fp long, rest long, bits int").distinct()


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours in (rest, bits) order that share both: every two holders of a two-sided key are linked, so a chain is enough."""
    last = None
    for batch in batches:
        fp, rest, bits = (batch.column(c).to_numpy() for c in ("fp", "rest", "bits"))
        if last is not None:
            fp, rest, bits = (np.concatenate([[x], y]) for x, y in zip(last, (fp, rest, bits), strict=True))
        if len(fp):
            last = fp[-1], rest[-1], bits[-1]
        same = (rest[1:] == rest[:-1]) & (bits[1:] == bits[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(fp[:-1][same]), pa.array(fp[1:][same])], ["src", "dst"])


def near_links(fps: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` between distinct fingerprints, enough of them that components equal those of all links."""
    met = write_table(
        _variants(fps).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_meet, "src long, dst long, key long"),
        "simhash-met",
    )
    links = met.where("dst is not null").select("src", "dst")
    hot = met.where("dst is null")
    if hot.isEmpty():
        return links
    chained = _two_sided(hot).repartition("rest", "bits").sortWithinPartitions("rest", "bits", "fp")
    return links.union(chained.mapInArrow(_chain, "src long, dst long"))


def closest(fps: DataFrame, segments: int = 2) -> DataFrame:
    """``(src, dst)``: for each distinct fingerprint ``dst`` a closest of those before it in its variants, within ``2 * segments - 1`` bits.

    Two fingerprints so near differ in at most one bit in some segment, so they meet in a variant as in ``near_links``. A member of a variant is compared with the
    ``RUN_LIMIT`` before it; what that leaves out of larger ones is the caller's to find.
    """
    most = 2 * segments - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in _runs(batches):
            bits, before = np.full(len(fp), most + 1, np.uint8), fp.copy()
            for step in range(1, RUN_LIMIT + 1):
                same = np.flatnonzero(key[step:] == key[:-step])
                if not len(same):
                    break
                apart = _popcount(fp[same] ^ fp[same + step])
                less = apart < bits[same + step]
                bits[same[less] + step], before[same[less] + step] = apart[less], fp[same[less]]
            near = bits <= most
            yield pa.RecordBatch.from_arrays([pa.array(before[near]), pa.array(fp[near]), pa.array(bits[near].astype(np.int32))], ["src", "dst", "bits"])

    met = _variants(fps, segments).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(released(run), "src long, dst long, bits int")
    return met.groupBy("dst").agg(F.min(F.struct("bits", "src")).alias("best")).select("best.src", "dst")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``: component_id is the smallest id that links of at most two bits reach.

    Copies meet in one fingerprint first, so a group of exact copies costs one row in the search. Texts without words have
    fingerprint zero and are one group (with whatever is within two bits of zero). Repeated rows and ids stay as they are; a
    null id is a row of its own and never names a component unless all ids of the component are null. An empty table
    gives an empty result.
    """
    fps = write_table(fingerprints(docs, id_col, text_col, width), "simhash-fp")
    classes = write_table(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    reached = connected_components(near_links(classes.select("fp")))
    named = classes.join(reached.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = named.where("component is not null").join(roots, "root").select("fp", "component_id")
    told = classes.join(moved, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    labels = write_table(told, "simhash-labels")
    # Rows of hot fingerprints take their label from a broadcast of under HOT rows; the others meet theirs by a join.
    least = F.lit(fps.count()) / HOT
    hot = labels.where(F.col("n") > least).select("fp", F.col("component_id").alias("label"), F.lit(True).alias("hot"))
    marked = fps.join(F.broadcast(hot), "fp", "left")
    rest = marked.where("hot is null").select("doc_id", "fp").join(labels.where(F.col("n") <= least), "fp")
    return marked.where("hot").select("doc_id", "fp", F.col("label").alias("component_id")).union(rest.select("doc_id", "fp", "component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each near-duplicate group the one with the smallest id (one row, if it is repeated).

    Rows without an id cannot be told apart and all stay.
    """
    kept = near_duplicates(docs, id_col, text_col).where(F.col("doc_id") == F.col("component_id"))
    kept = kept.select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(kept, id_col, "left_semi").dropDuplicates([id_col]).select(docs.columns).union(docs.where(F.col(id_col).isNull()))
