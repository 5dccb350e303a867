import math
import re
from collections import Counter

import pytest

from tests.llm.data import SF, edge_docs, empty_docs
from voxelyard.llm import decontam as d


def brute(docs, items, share=0.5, overlap=0.8, k1=1.2, b=0.75):
    """``{(doc, item): (score, question, answer)}``: BM25 of every window against every item by the formula, without an index."""
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    held = [(i, words(t), d.split_item(t)) for i, t in dict.fromkeys(items) if words(t)]
    mean = sum(len(w) for _, w, _ in held) / max(1, len(held))
    df = Counter(t for _, w, _ in held for t in set(w))
    out = {}
    for item, own, parts in held:
        counts = Counter(own)
        weight = {t: math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * len(own) / mean)) for t, n in counts.items()}
        full, window = sum(weight.values()), 32
        while window < 2 * len(own):
            window *= 2
        for doc, text in docs:
            text = words(text)
            for at in range(0, max(1, len(text) - window // 2), window // 2):
                passage = text[at : at + window]
                score = sum(weight.get(t, 0) for t in set(passage)) / full
                if score < share * (1 - 1e-9):
                    continue
                shares = []
                for part in parts:
                    k = min(5, len(part))
                    wanted = {" ".join(part[i : i + k]) for i in range(len(part) - k + 1)} if part else set()
                    have = {" ".join(passage[i : i + k]) for i in range(len(passage) - k + 1)} if part else set()
                    shares.append(len(wanted & have) / len(wanted) if wanted else 1.0)
                if min(shares) >= overlap:
                    out[doc, item] = max(out.get((doc, item), (0, 0, 0)), (score, *shares))
    return out


def rows_of(found):
    return {(r.doc_id, r.item_id): pytest.approx((r.score, r.question_overlap, r.answer_overlap)) for r in found.collect()}


def test_driver_rows_in_one_and_many_shards(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want
    for size in (20_000, 8, 2):
        assert rows_of(d.contaminated(docs, items, params=d.SearchParams(shard_items=size))) == want


def test_partial_overlaps_score_alike_in_any_shards(spark):
    import random

    rng = random.Random(5)
    bag = [f"t{i}" for i in range(120)]
    items = [(i, " ".join(rng.choices(bag, k=rng.randrange(8, 40)))) for i in range(60)]
    docs = []
    for i in range(40):
        words = rng.choices(bag, k=300)
        for _ in range(3):
            own = rng.choice(items)[1].split()
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = own
        docs.append((i, " ".join(words)))
    frame, found = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, share=0.7)
    assert len(want) > 30
    for size in (20_000, 15, 3):
        assert rows_of(d.contaminated(frame, found, params=d.SearchParams(shard_items=size, share=0.7))) == want


def test_block_maxima_skip_blocks_and_change_nothing():
    import random

    rng = random.Random(1)
    items = [(i, " ".join(rng.choices([f"t{j}" for j in range(4000)], k=20))) for i in range(600)]
    index = d.BlockMaxIndex(items)
    held = {t: k for t, k in index.terms.items()}
    for n in range(0, 600, 7):
        passage = items[n][1].split()[:14] + rng.choices(list(held), k=40)
        terms = sorted({held[t] for t in passage})
        for g in range(len(index.windows)):
            got = dict(index.search(g, terms))
            every = {}
            for t in terms:
                lo, hi = index.lists[g].get(t, (0, 0, 0, 0))[:2]
                for k in range(lo, hi):
                    every[int(index.item[k])] = every.get(int(index.item[k]), 0) + float(index.impact[k])
            assert got == pytest.approx({i: s for i, s in every.items() if s >= index.need[i]})
    assert index.seen["skipped"] > 0.9 * index.seen["blocks"] and index.seen["scored"] < 5 * index.seen["searches"]


def test_planted_leaks_and_edges(spark):
    items = [(1, "what is the tallest hill of the old northern county\nit is the grey fell above the mill"), (2, "short answer item"), (3, None), (4, ""), (5, "alpha beta gamma delta epsilon zeta eta theta. iota kappa lambda mu nu")]
    fill = " ".join(f"filler{i}" for i in range(5000))
    docs = [
        (1, fill + " What is the tallest hill of the OLD northern county? It is the grey fell above the mill. " + fill),
        (2, "what is the tallest hill of the old northern county " + fill), (3, None), (4, ""), (5, "short answer item"), (5, "short answer item"),
        (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), (None, "short answer item"),
    ]
    frame = spark.createDataFrame([(*x, 0, "s") for x in docs], "doc_id long, text string, item_id int, score string")
    found = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in d.contaminated(frame, found).collect())
    assert got == {(1, 1): 1, (5, 2): 2, (6, 5): 1, (None, 2): 1}
    assert sorted(r.doc_id for r in d.drop_contaminated(frame, found).collect()) == [2, 3, 4]
    assert d.contaminated(empty_docs(spark), found).count() == 0
    assert d.contaminated(edge_docs(spark), found.where("item_id < 0")).count() == 0
