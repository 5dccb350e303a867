import random
import re

import numpy as np
import xxhash

from tests.llm.data import SF, edge_docs, empty_docs
from voxelyard.llm import simhash


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def brute_components(fps):
    """fps: list of (id, fp); smallest id by links of at most two bits."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), f, str(least.get(root(i)))) for i, (d, f) in enumerate(fps))


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in rows])
    got = sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_driver_rows(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_edges(spark):
    check(edge_docs(spark))
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


def links_of(spark, fps, limit):
    before, simhash.RUN_LIMIT = simhash.RUN_LIMIT, limit
    try:
        signed = np.array(fps, np.uint64).view(np.int64).tolist()
        links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
        return {(r.src % 2**64, r.dst % 2**64) for r in links}
    finally:
        simhash.RUN_LIMIT = before


def test_links_with_and_without_hot_runs(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(60):
        x = centre
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(40)})
    want = brute_components([(f, f) for f in fps])
    for limit in (2048, 1):
        links = links_of(spark, fps, limit)
        assert all(bin(a ^ b).count("1") <= 2 for a, b in links)
        parent = {f: f for f in fps}

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in links:
            parent[root(a)] = root(b)
        least = {}
        for f in fps:
            least[root(f)] = min(f, least.get(root(f), f))
        assert sorted((str(f), f, str(least[root(f)])) for f in fps) == want


def test_one_of_each_group_stays(spark):
    docs = edge_docs(spark)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    want = {c for d, _, c in brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs.where("doc_id is not null").collect()])}
    assert set(ids) >= want - {"None"} and "None" in ids
    assert len([x for x in ids if x != "None"]) == len(want)


def test_long_texts_by_slices(monkeypatch):
    import random

    monkeypatch.setattr(simhash, "SLICE", 5)
    monkeypatch.setattr(simhash, "LONG_TEXT", 0)
    rng = random.Random(2)
    for n in [*range(1, 14), 50, 333]:
        text = " ".join(f"W{rng.randrange(9)}\u00e9" for _ in range(n)) + "\n"
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint("  \t") == 0


def test_closest_by_segments_against_brute_force(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:150]:
        fps |= {f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 10))) for _ in range(2)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    for segments in (2, 3, 4):
        rows = simhash.closest(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3), segments).collect()
        apart = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
        want = {f: min((apart(f, g) for g in signed[:i]), default=64) for i, f in enumerate(signed)}
        assert {r.dst: apart(r.src, r.dst) for r in rows} == {f: d for f, d in want.items() if d < 2 * segments}
        assert all(r.src < r.dst for r in rows)
