"""Connected components: of an edge table by contraction and alternating stars, of what fits one task by label propagation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelyard.sources.workdir import drop_table, write_table

#: Edges that one task may hold (some 100 MB with its arrays); what is left of a graph is finished in one task if it is no larger.
TASK_EDGES = 1 << 20
LONGS = ("bigint", "int", "smallint", "tinyint")


def component_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the undirected edges a - b reach: hooking roots and halving paths until nothing changes."""
    parent = np.arange(n)
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(parent, high[apart], low[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as a forest of stars, in pieces of ``TASK_EDGES``: each node with the smallest one reached."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = nodes[component_of(len(nodes), at[: len(u)], at[len(u) :])]
        inner = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(root[inner])], ["u", "v"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= TASK_EDGES:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """Return ``(node, component)``: component is the smallest node reachable from node.

    Whole-number edges are first contracted within their partitions; if at most ``task_edges`` are left, one task finishes them. Else
    large-star and small-star steps (Kiveris et al., 2014) alternate until the edge set stops changing, which takes
    O(log^2 n) rounds whatever the diameter. Neighbour minima are ordinary aggregates, so a node of any degree is
    pre-aggregated before the shuffle and no neighbour list is ever collected. Each round is written to the shared folder.
    Nodes without a partner (and null ends) are absent from the result; self-loops alone give nothing.
    """
    pairs = edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    whole = all(t in LONGS for _, t in pairs.dtypes)
    if whole:
        pairs = pairs.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(_contract, "u long, v long")
    # What many tasks have contracted goes to few files of full size, not to one small file of each task.
    now = write_table(pairs.hint("rebalance"), "components")
    mark = _fingerprint(now)
    if whole and 0 < mark[0] <= task_edges:
        now, mark = write_table(now.coalesce(1).mapInArrow(_contract, "u long, v long"), "components"), (0, None)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        starred = write_table(_small_star(_large_star(now)), "components")
        drop_table(now)
        now, last, mark = starred, mark, _fingerprint(starred)
        if mark == last:
            break
    else:
        raise RuntimeError("connected_components did not converge")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where(F.col("v") > F.col("u"))
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(linked).distinct()
