import math
import re
import zlib
from collections import Counter

import numpy as np

from tests.llm.data import SF, edge_docs, empty_docs
from voxelyard.llm import lm


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def exponent(contexts, once):
    """g by which the contexts leave as much to unseen words as was seen once; contexts of like size count with their mean, as in the model."""
    classes = {}
    for c in contexts:
        classes.setdefault(int(math.log2(c)), []).append(c)
    low, high = 0.01, 4.0
    for _ in range(60):
        g = (low + high) / 2
        left = sum(sum(c) * (1 + sum(c) / len(c)) ** -g for c in classes.values())
        low, high = (g, high) if left > once else (low, g)
    return (low + high) / 2


def brute(rows):
    """Base scores, and the model's by a plain recursion over words."""
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    docs = [tokens(t) for _, t in rows]
    train = [t for t, h in zip(docs, held) if not h]
    c = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t))
    triples = Counter(p for t in train for p in zip(["<s>", *t], t, t[1:]))
    n = sum(c.values())
    context = {(): n, ("<s>",): len(train)} | {(w,): k for w, k in c.items() if w is not None} | {p: k for p, k in pairs.items() if p[1] is not None}
    g = {1: exponent(c.values(), sum(k == 1 for k in pairs.values())) if n else 1.0, 2: exponent([k for p, k in context.items() if len(p) == 2], sum(k == 1 for k in triples.values())) if n else 1.0}
    new = (sum(k == 1 for k in c.values()) + 1) / (n + 2)
    seen = {2: pairs, 3: triples}

    def p(past, w):
        if not past:
            return (1 - new) * c[w] / n if c[w] else new
        k = context.get(past, 0)
        if not k:
            return p(past[1:], w)
        keep = (1 + k) ** -g[len(past)]
        return (1 - keep) * seen[len(past) + 1][(*past, w)] / k + keep * p(past[1:], w)

    out = []
    for (d, _), t, h in zip(rows, docs, held):
        past = ["<s>", *t]
        total = sum(math.log10(p(tuple(past[max(0, i - 1) : i + 1]), w)) for i, w in enumerate(t))
        base = sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in t)
        out.append((d, h, len(t), sum(c[w] > 0 for w in t), n, base, total))
    return sorted(out, key=str)


def check(docs, **more):
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = sorted((tuple(r) for r in lm.score_documents(docs, **more).collect()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-9)
    return got


def test_driver_rows_in_few_and_many_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(docs)
    got = check(docs.repartition(3), block_bytes=20_000)
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_edges(spark):
    check(edge_docs(spark))
    assert lm.score_documents(empty_docs(spark)).count() == 0
    only_held_out = spark.createDataFrame([(d, "a b a") for d in range(200) if lm.fold_of(d) == 2], "doc_id long, text string")
    check(only_held_out)


def test_probabilities_add_up():
    # words a 0, b 1, end 2, start 3; training: "a b", "a b", "a a"
    totals = np.array([4, 2, 3])
    corpus = lm.Corpus(9, 3, 3, (0.5, 0.7), 0.2)
    pairs = {(3, 0): 3, (3, 1): 0, (0, 0): 1, (0, 1): 2, (0, 2): 1, (1, 0): 0, (1, 1): 0, (1, 2): 2, (3, 2): 0}
    triples = {(3, 0, 0): 1, (3, 0, 1): 2, (0, 0, 2): 1, (0, 1, 2): 2}
    codes = np.array(sorted(x * 4 + y for x, y in pairs))
    number = {(int(k) // 4, int(k) % 4): i for i, k in enumerate(codes)}
    three = {number[p[:2]] * 4 + p[2]: n for p, n in triples.items()}
    keys = np.array(sorted(three))
    a = lm.build_automaton(2, totals, codes, np.array([pairs[int(k) // 4, int(k) % 4] for k in codes]), keys, np.array([three[k] for k in keys.tolist()]), corpus)
    for pair, state in [(-1, 3), (-1, 0), (number[3, 0], 0), (number[0, 0], 0), (number[0, 1], 1), (number[1, 0], 0)]:
        cost, after = a.step(np.full(3, pair), np.full(3, state), np.arange(3))
        assert after.tolist() == [number[state, w] for w in range(3)]
        unknown = 10 ** (a.failure[state] + (a.pair_failure[pair] if pair >= 0 else 0)) * corpus.novelty
        assert abs((10**cost).sum() + unknown - 1) < 1e-12


def test_traversal_follows_failure_arcs_in_a_chain():
    # words 0, 1; end 2; start 3
    pairs = np.array([0 * 4 + 1, 0 * 4 + 2, 1 * 4 + 0, 1 * 4 + 1, 3 * 4 + 0])
    held = np.array([True, False, False, True, True])
    a = lm.BackoffAutomaton(4, pairs, held, np.array([-0.25, 0, 0, -0.75, -0.5]), np.array([-1.0, -2.0, 0.0, -3.0]), np.array([-10.0, -20.0, -30.0, 0.0]), np.array([0 * 4 + 1, 4 * 4 + 1]), np.array([-0.2, -0.1]), np.array([-7.0, -8.0, -9.0, -11.0, -12.0]))
    tokens = np.array([0, 1, 1, 0, 2])
    # start 0: pair arc; (start 0) 1: triple arc; (0 1) 1: triple arc; (1 1) 0: both states fail; (1 0) end: both fail
    want = -0.5 - 0.1 - 0.2 + (-11 - 2 - 10) + (-9 - 1 - 30)
    got = a.traverse(tokens, np.array([-1, 0]), np.array([3, 1]), np.array([0, 2]), np.array([5, 3]))
    assert np.allclose(got, [want, want + 0.5 + 0.1])


def test_texts_seen_twice_score_higher(spark):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=200))) for i in range(200)]
    train = [r for r in rows if lm.fold_of(r[0]) != lm.HELD_OUT]
    twice = [(1000 + i, t) for i, t in train[:20]]
    twice = [(d, t) for d, t in twice if lm.fold_of(d) != lm.HELD_OUT]
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score_documents(spark.createDataFrame(rows + twice, "doc_id long, text string")).collect()}
    copies = {d for d, _ in twice} | {d - 1000 for d, _ in twice}
    once = [s for d, s in got.items() if d not in copies and lm.fold_of(d) != lm.HELD_OUT]
    assert min(got[d] for d in copies) > max(once)


def test_packed_hashes_come_back():
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)) >> np.uint64(lm.SHIFT) << np.uint64(lm.SHIFT)
    assert (lm._unpack_sorted(lm._pack_sorted(hashes), 1000) == hashes >> np.uint64(lm.SHIFT)).all()
    for buckets in (1, 3, 40, 70_000):
        cuts = lm._cuts(hashes, buckets)
        assert len(cuts) == buckets + 1 and cuts[0] == 0 and (np.diff(cuts) >= 0).all()
        assert (np.repeat(np.arange(buckets), np.diff(cuts)) == (hashes >> np.uint64(32)).astype(object) * buckets // (1 << 32)).all()
