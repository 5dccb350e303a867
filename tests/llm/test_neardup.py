import random

from tests.llm.data import SF, edge_docs, empty_docs
from voxelyard.llm import neardup


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) / len(a | b) >= 0.8:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), str(least.get(root(i)))) for i, (d, _) in enumerate(rows))


def check(docs):
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted((str(r.doc_id), str(r.component_id)) for r in neardup.near_duplicates(docs).collect()) == want
    return want


def test_driver_rows_and_edges(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))
    check(edge_docs(spark))
    assert neardup.near_duplicates(empty_docs(spark)).count() == 0


def test_changed_copies_at_and_below_the_threshold(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        rows.append((10 * i, " ".join(base)))
        for j in range(1, 6):
            copy = list(base)
            for _ in range(j * len(base) // 80 + 1):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(5000)}"
            rows.append((10 * i + j, " ".join(copy)))
    # Exactly 0.8: eight words hold four shingles, the ninth adds the fifth.
    rows += [(900, "a b c d e f g h"), (901, "a b c d e f g h i"), (902, "a b c d e f g h i j k l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = dict(check(docs))
    assert groups["901"] == "900" and groups["902"] == "902"
    kept = {r.doc_id for r in neardup.drop_near_duplicates(docs).collect()}
    assert kept == {int(c) for c in groups.values()}


def test_pipeline_stage_drops_changed_copies(spark):
    import corpus_pipeline

    words = [f"word{i}" for i in range(200)]
    changed = [*words[:50], "a", *words[51:100], "b", *words[101:150], "c", *words[151:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()] == [1]


def test_blocks_of_split_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "WEIGHT", 700)
    monkeypatch.setattr(neardup, "CELLS", 64)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(1, 7)):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(5000)}"
        rows.append((i, " ".join(copy)))
    groups = {c for _, c in check(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert len(groups) > 2


def test_signatures_tell_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    factors = rng.integers(0, 1 << 63, 112, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 1 << 63, 112, dtype=np.uint64)
    shared = 0
    for _ in range(300):
        values = rng.integers(0, 1 << 63, 109, dtype=np.uint64) * np.uint64(2)
        a, b = (np.sort(x) for x in (values[:100], values[9:]))
        shared += (neardup._keys(a, factors, offsets) == neardup._keys(b, factors, offsets)).sum()
    want = (91 / 109) ** neardup.ROWS
    assert abs(shared / 300 / neardup.BANDS - want) < 0.03


def test_simhash_finds_groups_and_their_links_are_verified(spark, monkeypatch):
    """Without MinHash keys the fingerprints alone bring near copies together, and none that is under the similarity."""
    import corpus_pipeline

    monkeypatch.setattr(neardup, "_keys", lambda *_: neardup.np.empty(0, neardup.np.int64))
    words = [f"word{i}" for i in range(3000)]
    rows = [(i, " ".join([*words[: 30 * i], *["a"] * (i > 0), *words[30 * i + 1 :]])) for i in range(4)]
    rows += [(10, "one two three four five six"), (11, "one two three four five seven"), (12, " ".join(words[::-1]))]
    rows += [(20, ""), (21, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [0, 10, 11, 12, 20]
    monkeypatch.setattr(neardup.simhash, "closest", lambda fps, segments: fps.selectExpr("min(fp) over () as src", "fp as dst").where("src != dst"))
    assert sorted(set(c for _, c in check(docs))) == ["0", "10", "11", "12", "20"]
