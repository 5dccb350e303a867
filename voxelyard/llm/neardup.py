"""Near-duplicate groups by the Jaccard similarity of word shingles: SimHash first, MinHash for what it cannot reach.

SimHash fingerprints of the shingle sets are searched by deletion variants; nodes that meet are verified on their whole sets and become parts. 64 bits do not
reach all of similarity 0.8 (README has the measured share; an index for the rest would have segments of eight bits), so MinHash bands find the candidates
between the parts, and every link is verified on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelyard.llm import simhash
from voxelyard.llm._shared import released, small_batches, values_of, words_of, write_table
from voxelyard.operators.components import component_of, connected_components

#: Similarity of a link, words of a shingle; bands of the signature and values of a band: a pair of similarity 0.8 shares
#: no band with probability (1 - 0.8 ** 4) ** 28, some 4e-7.
SIMILARITY = 0.8
WIDTH = 5
BANDS, ROWS = 28, 4
#: Segments of a SimHash fingerprint: all within seven bits share a variant of a segment of 16.
SEGMENTS = 4
#: Rounds of comparisons with bucket heads before what is still apart is compared in blocks of so many nodes.
ROUNDS = 2
BLOCK = 2048
#: Shingles of a block, in the mean (16 MB).
WEIGHT = 1 << 21
#: Cells of the matrices by which a block's sets are intersected.
CELLS = 1 << 22
SEED = 42


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 values of the ``width``-word shingles of the lower-cased (A-Z) text; of fewer words, the one of all of them."""
    words = [w.lower() for w in words_of(text)]
    if not words:
        return np.empty(0, np.uint64)
    parts = (b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64))


def _node(values: np.ndarray) -> int:
    """Name of a shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(values.tobytes(), SEED)).view(np.int64))


def _keys(values: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One key for each band of the MinHash signature; none for the empty set."""
    if not len(values):
        return np.empty(0, np.int64)
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(values), 1024):
        # The values are hashes already; a product's high bits, which decide the least, depend on all their bits.
        np.minimum(least, (values[at : at + 1024, None] * factors + offsets).min(axis=0), out=least)
    digests = [xxhash.xxh64_intdigest(b.tobytes(), n) for n, b in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(digests, np.uint64).view(np.int64)


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, node, n, fp, keys)`` of every row of ``(doc_id, text)``; n: distinct shingles, fp: their SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        factors = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        offsets = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
        for batch in batches:
            nodes, sizes, fps, keys = [], [], [], []
            for text in values_of(batch.column("text")):
                values = shingle_set(text, width)
                nodes.append(_node(values)), sizes.append(len(values)), keys.append(_keys(values, factors, offsets))
                fps.append(simhash.fingerprint_of(values))
            ends = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
            columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "node", "n", "fp", "keys"])

    return docs.mapInArrow(released(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, n long, fp long, keys array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``(node, shingles)`` of every row of ``(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingle_set(t, width) for t in batch.column("text").slice(at, 256).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), lists], ["node", "shingles"])

    return docs.select("text").mapInArrow(released(run), "node long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(src, dst)`` whose sets are similar enough."""
    held = sets.withColumn("n", F.size("shingles"))
    left = pairs.join(held.select(F.col("node").alias("src"), F.col("shingles").alias("x"), F.col("n").alias("nx")), "src")
    both = left.join(held.select(F.col("node").alias("dst"), F.col("shingles").alias("y"), F.col("n").alias("ny")), "dst")
    sized = both.where(F.least("nx", "ny") / F.greatest("nx", "ny") >= similarity)
    shared = F.size(F.array_intersect("x", "y"))
    return sized.where(shared / (F.col("nx") + F.col("ny") - shared) >= similarity).select("src", "dst")


def _simhash_pairs(named: DataFrame) -> DataFrame:
    """At most one pair for each node: the first node of a fingerprint with that of the closest one found, the others with their fingerprint's first."""
    heads = named.where("n > 0").groupBy("fp").agg(F.min("node").alias("head"))
    found = simhash.closest(heads.select("fp"), SEGMENTS)
    across = found.join(heads.select(F.col("fp").alias("src"), F.col("head").alias("a")), "src").join(heads.select(F.col("fp").alias("dst"), F.col("head").alias("b")), "dst")
    within = named.where("n > 0").join(heads, "fp").where("node != head")
    return across.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(within.select(F.col("head").alias("src"), F.col("node").alias("dst")))


def _head_pairs(parts: DataFrame, n: int) -> DataFrame:
    """At most one pair for each node: with the head of one of its buckets, if that belongs to another part."""
    heads = parts.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(n), "node").alias("place"), "node", "part")).alias("head"))
    met = parts.join(heads, "key").where(F.col("head.part") != F.col("part"))
    return met.groupBy(F.col("node").alias("dst")).agg(F.min("head").alias("head")).select(F.col("head.node").alias("src"), "dst")


def _split_buckets(parts: DataFrame) -> DataFrame:
    """``(key, node, part, small, q, t)``: the nodes of buckets that hold several parts, dealt out so that each one outside the largest part meets each other.

    A bucket's queries (``small``) and its nodes are cut into blocks; a group ``(key, q, t)`` has one of each, whatever the size of the bucket.
    """
    sizes = parts.groupBy("key", "part").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    most = F.max_by(F.struct("part", "size", "weight"), F.struct("size", "part")).alias("most")
    told = sizes.groupBy("key").agg(most, F.sum("size").alias("size"), F.sum("weight").alias("weight"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda size, weight: F.ceil(F.greatest(size / F.lit(BLOCK), weight / F.lit(WEIGHT))).cast("int")
    all_ = blocks(F.col("size"), F.col("weight")).alias("nt")
    others = blocks(F.col("size") - F.col("most.size"), F.col("weight") - F.col("most.weight")).alias("nq")
    split = parts.join(told.select("key", F.col("most.part").alias("largest"), all_, others), "key")
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    target = split.select("key", "node", "part", F.lit(False).alias("small"), every(F.col("nq")).alias("q"), place(F.col("nt")).alias("t"))
    asked = split.where("part != largest")
    return target.union(asked.select("key", "node", "part", F.lit(True), place(F.col("nq")), every(F.col("nt"))))


def _links_between(similarity: float):
    """A group's links between queries and targets of different parts, as stars: at most one for each node."""

    def run(group: pa.Table) -> pa.Table:
        small, part, node = (group.column(c).to_numpy() for c in ("small", "part", "node"))
        lists = group.column("shingles").combine_chunks()
        sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        code = np.unique(flat, return_inverse=True)[1]
        held = np.bincount(code) > 1  # a shingle of one set is in no intersection
        code = np.where(held, np.cumsum(held) - 1, -1)[code]
        row = np.repeat(np.arange(len(sizes)), sizes)[code >= 0]
        code = code[code >= 0]
        ask, told = np.flatnonzero(small), np.flatnonzero(~small)
        shared = np.zeros((len(ask), len(told)), np.float32)
        step = max(1, min(CELLS // len(sizes), int(held.sum())))
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        for at in range(0, int(held.sum()), step):
            lo, hi = np.searchsorted(code, (at, at + step))
            cells = np.zeros((len(sizes), step), np.float32)
            cells[row[lo:hi], code[lo:hi] - at] = 1
            shared += cells[ask] @ cells[told].T
        links = []
        for i, x in enumerate(ask):
            both = shared[i].astype(np.float64)
            near = told[(part[told] != part[x]) & (both / np.maximum(sizes[x] + sizes[told] - both, 1) >= similarity)]
            links.append(np.stack([np.full(len(near), x), near]))
        a, b = np.concatenate(links, axis=1) if links else np.empty((2, 0), np.int64)
        root = component_of(len(node), a, b)
        inner = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({"src": pa.array(node[root[inner]], pa.int64()), "dst": pa.array(node[inner], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """``(doc_id, component_id)`` per row of ``docs``: component_id is the smallest id that links of at least ``similarity`` reach.

    Rows with the same shingles meet in one node first. Texts without words are one group. Nodes near by SimHash are compared first. Two rounds compare each node with
    one bucket head, so that a large group becomes one part by few pairs; then each node outside its bucket's largest part is compared with all others of the bucket,
    in blocks, and only links leave a block. Repeated rows and ids stay as they are; a null
    id never names a component unless all ids of the component are null. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = write_table(_signatures(picked, width), "neardup-signatures")
    named = signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    near = write_table(_simhash_pairs(named), "neardup-simhash")
    buckets = named.select("node", "n", F.explode("keys").alias("key"))
    several = buckets.groupBy("key").agg(F.count("*").alias("held")).where("held > 1").select("key")
    shared = write_table(buckets.join(several, "key").select("key", "node", "n"), "neardup-buckets")

    # Shingles of candidates alone are needed; their texts are found by the smallest id of the node.
    nodes = shared.select("node").union(near.select("src")).union(near.select("dst")).distinct()
    of = named.join(nodes, "node", "left_semi").select(F.col("least").alias("doc_id")).where("doc_id is not null").distinct()
    texts = picked.join(of, "doc_id", "left_semi").union(picked.where("doc_id is null"))
    sets = write_table(_sets(texts, width).join(nodes, "node", "left_semi").dropDuplicates(["node"]), "neardup-sets")

    # Nodes that meet by SimHash, then by bucket heads, then what is still apart in a bucket.
    reached, parts = None, None
    for n in range(-1, ROUNDS + 1):
        if n < 0:
            links = _verified(near, sets, similarity)
        elif n < ROUNDS:
            links = _verified(_head_pairs(parts, n), sets, similarity)
        else:
            dealt = _split_buckets(parts).join(sets, "node")
            links = dealt.groupBy("key", "q", "t").applyInArrow(_links_between(similarity), "src long, dst long")
        if reached is not None:
            links = links.union(reached.select(F.col("component").alias("src"), F.col("node").alias("dst")))
        reached = connected_components(links)
        if n < ROUNDS:
            parts = write_table(shared.join(reached, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("part")), "neardup-parts")

    rooted = named.select("node", "least").join(reached, "node", "left").withColumn("root", F.coalesce("component", "node"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(roots, "root").select("node", "component_id")
    return signed.select("doc_id", "node").join(labels, "node").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that stay: of each near-duplicate group the one with the smallest id (one row, if it is repeated).

    Rows without an id cannot be told apart and all stay.
    """
    kept = near_duplicates(docs, id_col, text_col, similarity, width).where(F.col("doc_id") == F.col("component_id"))
    kept = kept.select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(kept, id_col, "left_semi").dropDuplicates([id_col]).select(docs.columns).union(docs.where(F.col(id_col).isNull()))
