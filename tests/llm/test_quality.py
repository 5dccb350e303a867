import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm.data import SF, edge_docs, empty_docs
from voxelyard.llm import quality as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)} if len(windows) < 3000 else None
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, None if covered is None else len(covered)


def test_statistics(spark):
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [r.text for r in edge_docs(spark).collect()]
    docs += ["a b c a b c a b", "x x x x x", "l\nl\n \n \nl", "#*$%&|<>"]
    for t in docs:
        for got, want in zip(q.text_stats(t), brute(t)):
            assert want is None or got == want


def test_verdicts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in q.judge_quality(docs, labels).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    for r in got.values():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    free = [d for d in got if d in known and not got[d].base_failed]
    assert np.mean([got[d].kept for d in free if known[d]]) >= 0.97
    bad = [got[d].kept for d in free if not known[d]]
    assert not bad or np.mean(bad) <= 0.3
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, r in got.items() if r.kept)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in q.judge_quality(docs, labels.where("doc_id % 2 = 0")).where("not base_failed").collect()}
    rest = [(r.quality, got[r.doc_id].kept) for r in labels.where("doc_id % 2 = 1").collect() if r.doc_id in got]
    assert np.mean([k for y, k in rest if y]) >= 0.97
    assert np.mean([not k for y, k in rest if not y]) >= 0.8


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert q.judge_quality(edge_docs(spark), labels).count() == edge_docs(spark).count()
    assert q.judge_quality(empty_docs(spark), labels).count() == 0
    assert q.keep_good(empty_docs(spark), labels.limit(0)).count() == 0
    kept = {r.doc_id for r in q.keep_good(edge_docs(spark), labels.limit(0)).collect()}
    assert kept == {7, 8}


def test_bounded_sample_is_that_of_the_lowest_hashes(spark):
    stats = spark.range(5000).selectExpr("id as doc_id", *[f"cast(60 + id % {k + 3} as long) as {s}" for k, s in enumerate(q.STATS)]).withColumn("n_repeat_words", F.lit(0).cast("long"))
    labels = stats.selectExpr("doc_id", "cast(doc_id % 5 > 0 as int) as quality")
    rows = stats.join(labels, "doc_id").orderBy(F.xxhash64("doc_id"), *q.STATS).limit(300).toPandas()
    x, good = q.features(rows), rows["quality"].to_numpy() == 1
    params = q.ForestParams(trees=8, labelled_rows=300)
    want, got = q.IsolationForest(params).fit(x[good], x).calibrate(x, good), q.fit_forest(stats, labels, params=params)
    assert got.threshold == want.threshold and (got.score(x) == want.score(x)).all()


def test_forest_scores_against_a_slow_walk():
    import math

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    x[:5] += 9
    forest = q.IsolationForest(q.ForestParams(trees=20, sample=64)).fit(x[5:], x)

    def path(tree, row):
        feature, cut, left, right, rest = tree
        at = steps = 0
        while feature[at] >= 0:
            at, steps = int(left[at] if row[feature[at]] < cut[at] else right[at]), steps + 1
        return steps + rest[at]

    c = 2 * (math.log(63) + 0.5772156649) - 2 * 63 / 64
    want = [2 ** -(sum(path(t, row) for t in forest.trees) / 20 / c) for row in x]
    got = forest.score(x)
    assert np.allclose(got, want)
    good = np.arange(300) >= 5
    forest.calibrate(x, good)
    assert (got[~good] >= forest.threshold).all() and (got[good] >= forest.threshold).mean() <= 0.002 + 1 / 295


def test_threshold_ranges_and_draws_are_of_all_labelled_rows(spark):
    n = 30_000
    at = lambda seed, below: f"cast(pmod(xxhash64(id, {seed}), {below}) as long)"
    stats = spark.range(n, numPartitions=7).selectExpr("id as doc_id", *[f"{at(k, 40 + 10 * k)} as {s}" for k, s in enumerate(q.STATS)])
    stats = stats.withColumns({"n_words": F.col("n_words") + 60, "word_chars": F.col("word_chars") + 300, "n_repeat_words": F.col("n_repeat_words") % 20})
    bad = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(99)), F.lit(5)) == 0
    stats = stats.withColumn("n_marks", F.when(bad, F.col("n_marks") * 2).otherwise(F.col("n_marks")))
    # One row of a range of its own: it is not among the 20,000 smallest hashes.
    far = stats.orderBy(F.xxhash64("doc_id").desc()).first().doc_id
    stats = stats.withColumn("word_chars", F.when(F.col("doc_id") == far, 3900).otherwise(F.col("word_chars")))
    labels = stats.select("doc_id", (~bad).cast("int").alias("quality"))
    rows = stats.join(labels, "doc_id").toPandas()
    x, good = q.features(rows), rows["quality"].to_numpy() == 1
    params = q.ForestParams(trees=12)
    got = q.fit_forest(stats, labels, params=params)
    want = q.IsolationForest(params)
    want.trees, want.scale = got.trees, got.scale
    want.calibrate(x, good)
    assert np.isfinite(want.threshold) and got.threshold == want.threshold
    cuts = np.concatenate([cut[feature == 0] for feature, cut, *_ in got.trees])
    assert cuts.max() > np.sort(x[:, 0])[-2]
    again = q.fit_forest(stats.repartition(3), labels, params=params)
    assert again.threshold == got.threshold and (again.score(x[:500]) == got.score(x[:500])).all()


def test_draws_of_few_and_of_repeated_rows(spark):
    stats = spark.range(5).selectExpr("id as doc_id", *[f"60 + id as {s}" for s in q.STATS]).withColumn("n_repeat_words", F.lit(0).cast("long"))
    labels = stats.selectExpr("doc_id", "cast(doc_id < 4 as int) as quality")
    few = q.fit_forest(stats, labels, params=q.ForestParams(trees=3))
    assert len(few.trees) == 3 and few.scale == q._c(4)
    many = stats.crossJoin(spark.range(3000).select()).repartition(4)
    same = q.fit_forest(many, labels, params=q.ForestParams(trees=3))
    assert same.scale == q._c(256)
    only_bad = q.fit_forest(stats, labels.where("quality = 0"), params=q.ForestParams(trees=3))
    assert len(only_bad.trees) == 3 and only_bad.threshold == np.inf
