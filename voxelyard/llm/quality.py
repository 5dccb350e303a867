"""Quality rules with an isolation forest over rule statistics.

Rules that always hold (too few words, mostly repeats) decide alone. What they let through is judged by how easily random splits
isolate its statistics: a short mean path is an anomaly. The cut on the path score is calibrated from labelled rows.
"""

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelyard.llm._shared import released, small_batches, values_of, write_table

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_bars", "n_marks"]
FEATURES = ["mean_word", "symbols", "repeats", "upper", "bars", "marks"]
PASSED = "n_words >= 50 and 100 * n_repeat_words <= 50 * n_words"
#: Bins of the scores; what lies above a bin is counted on the driver.
BINS = 1 << 16
_SYMBOL = re.compile(r"[#*$%&|<>]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class ForestParams:
    """trees and sample: as usual for isolation forests. labelled_rows: None for all labelled rows; a caller's bound takes those of the smallest id hashes.
    clean_loss: share of good labelled rows that the threshold may reject. seed: of the draws and splits."""

    trees: int = 128
    sample: int = 256
    labelled_rows: int | None = None
    clean_loss: float = 0.002
    seed: int = 7


def text_stats(text: str | None) -> tuple:
    """The statistics of ``STATS`` for one whole text; null is a text without words."""
    text = text or ""
    words = _WORD.findall(text)
    chars = sum(map(len, words))
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line and _WORD.search(line):
            if line in seen:
                again += 1
            else:
                seen.add(line)
    return (
        len(words), chars, len(_SYMBOL.findall(text)), again, repeated_words(words), sum(map(str.isupper, words)),
        text.count("|"), text.count("!") + text.count("*") + text.count("$") + text.count("%") + text.count("&") + text.count("#"),
    )


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total = until = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, until)
            until = i + 3
    return total


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """One row per document, one column per entry of ``FEATURES``."""
    x = {k: np.asarray(v, dtype=np.float64) for k, v in stats.items()}
    words = np.maximum(x["n_words"], 1)
    shares = [x[k] / words for k in ("n_symbols", "n_repeat_words", "n_upper_words", "n_bars", "n_marks")]
    return np.stack([np.minimum(x["word_chars"] / words, 40.0), *(np.minimum(s, 2.0) for s in shares)], axis=1)


def _c(n: float) -> float:
    """Mean path of an unsuccessful search in a binary tree of n nodes."""
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


class IsolationForest:
    """Random axis-parallel splits; ``score`` is 2 ** (-mean path / c(sample)): near 1 an anomaly."""

    def __init__(self, params: ForestParams = ForestParams()):
        self.params, self.trees, self.scale, self.threshold = params, [], 1.0, math.inf

    def fit(self, x: np.ndarray, box: np.ndarray) -> "IsolationForest":
        """Grow on rows ``x``; splits are drawn over the range of ``box``, so that values which no row of x has can be split off too."""
        rng = np.random.default_rng(self.params.seed)
        size = min(self.params.sample, len(x))
        draws = (x[rng.choice(len(x), size, replace=False)] for _ in range(self.params.trees if size else 0))
        return self.grow(draws, box.min(axis=0), box.max(axis=0), rng)

    def grow(self, draws: Iterable[np.ndarray], low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> "IsolationForest":
        """One tree for each draw of rows, all of one size."""
        for x in draws:
            self.scale = _c(len(x)) or 1.0
            nodes: list[list] = []
            self._grow(x, low, high, 2 * math.ceil(math.log2(max(len(x), 2))), rng, nodes)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
        return self

    def _grow(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, rng, nodes: list) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, _c(len(x))])
        free = np.flatnonzero(high > low)
        if depth and len(x) > 1 and len(free):
            f = int(rng.choice(free))
            cut = float(rng.uniform(low[f], high[f]))
            left, below, above = x[:, f] < cut, high.copy(), low.copy()
            below[f] = above[f] = cut
            nodes[at][:2] = f, cut
            nodes[at][2] = self._grow(x[left], low, below, depth - 1, rng, nodes)
            nodes[at][3] = self._grow(x[~left], above, high, depth - 1, rng, nodes)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, rest in self.trees:
            at, path = np.zeros(len(x), np.int64), np.zeros(len(x))
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                path += inner
                goes = np.where(x[rows, np.maximum(f, 0)] < cut[at], left[at], right[at])
                at = np.where(inner, goes, at)
            total += path + rest[at]
        return 2.0 ** (-total / max(1, len(self.trees)) / self.scale)

    def calibrate(self, x: np.ndarray, good: np.ndarray) -> "IsolationForest":
        """The cut that separates labelled good and bad rows best, rejecting at most ``clean_loss`` of the good ones."""
        if not good.any() or good.all():
            return self
        s = self.score(x)
        least = np.quantile(s[good], 1 - self.params.clean_loss, method="higher")
        caught = np.sort(s[~good][s[~good] > least])
        if len(caught):
            gain = np.array([(s[~good] >= c).mean() - (s[good] >= c).mean() for c in caught])
            first = caught[int(gain.argmax())]
            self.threshold = (first + s[s < first].max()) / 2
        return self


def rule_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``STATS`` per row, from whole texts."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_stats(t) for t in values_of(batch.column("text"))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(STATS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *STATS])

    return picked.mapInArrow(released(run), f"doc_id {kind}, " + ", ".join(f"{s} long" for s in STATS))


def labelled_ids(labels: DataFrame, label_col: str = "quality", params: ForestParams = ForestParams()) -> DataFrame:
    """``(doc_id, good, place)`` of every labelled id, or of the ``labelled_rows`` of the smallest id hashes; null labels and ids are left out."""
    known = labels.where(f"doc_id is not null and {label_col} is not null").groupBy("doc_id").agg(F.max(label_col).alias("good"))
    known = known.withColumn("place", F.xxhash64("doc_id"))
    return known if params.labelled_rows is None else known.orderBy("place", "doc_id").limit(params.labelled_rows)


def fit_forest(stats: DataFrame, labels: DataFrame, label_col: str = "quality", params: ForestParams = ForestParams()) -> "IsolationForest":
    """Forest over all labelled rows that pass the base rules.

    Trees grow on the good rows, so what they isolate quickly is unlike good text. Each tree draws its rows from all of them; the range of the splits
    and the threshold are those of every labelled row. Only the draws and counts by bin reach the driver.
    """
    rows = stats.join(labelled_ids(labels, label_col, params), "doc_id").where(PASSED)
    forest = IsolationForest(params)
    if params.labelled_rows is not None:
        held = rows.orderBy("place", *STATS).limit(params.labelled_rows).toPandas()
        x, good = features(held), held["good"].to_numpy() == 1
        return forest.fit(x[good] if good.any() else x, x).calibrate(x, good) if len(held) else forest
    rows = write_table(rows.select(F.xxhash64("place", *STATS).alias("place"), (F.col("good") == 1).alias("good"), *STATS), "labelled-stats")
    box = [f(f"x{i}") for f in (F.min, F.max) for i in range(len(FEATURES))]
    n, n_good, *ends = rows.mapInArrow(_by_rows(_feature_columns), _FEATURE_FIELDS).agg(F.count("*"), F.count_if("good"), *box).first()
    if not n:
        return forest
    grown = rows.where("good") if n_good else rows
    low, high = np.array(ends).reshape(2, -1)
    forest.grow(_draws(grown, n_good or n, params), low, high, np.random.default_rng(params.seed))
    if 0 < n_good < n:
        forest.threshold = _threshold(rows, forest, n_good, n - n_good)
    return forest


_FEATURE_FIELDS = "place long, good boolean, " + ", ".join(f"x{i} double" for i in range(len(FEATURES)))


def _by_rows(columns):
    """An Arrow function over batches of ``(place, good, STATS...)``; ``columns`` makes the named output columns from a batch and its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(columns(batch, features({s: batch.column(s).to_numpy() for s in STATS})))

    return released(run)


def _feature_columns(batch: pa.RecordBatch, x: np.ndarray) -> dict:
    return {"place": batch.column("place"), "good": batch.column("good"), **{f"x{i}": x[:, i] for i in range(x.shape[1])}}


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draws(rows: DataFrame, n: int, params: ForestParams) -> Iterator[np.ndarray]:
    """For each tree the features of ``sample`` of the ``n`` rows (all, if there are fewer): those of the smallest hashes by row and tree."""
    size = min(params.sample, n)
    marks = _mixed((np.arange(params.trees, dtype=np.uint64) + np.uint64(params.seed)) * np.uint64(0x9E3779B97F4A7C15))
    x_cols = [f"x{i}" for i in range(len(FEATURES))]
    share = (size + 8 * math.sqrt(size) + 32) / n
    while True:
        # Few rows outside the draw are sent; where too few were (repeated rows), more are asked for.
        bound = np.uint64(min(share, 1.0) * (2**63 - 1024))

        def run(batches: Iterator[pa.RecordBatch], bound=bound) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, place = features({s: batch.column(s).to_numpy() for s in STATS}), batch.column("place").to_numpy().view(np.uint64)
                for tree, mark in enumerate(marks):
                    key = _mixed(place ^ mark) >> np.uint64(1)
                    near = np.arange(len(key)) if share >= 1 else np.flatnonzero(key <= bound)
                    near = near[np.argsort(key[near], kind="stable")[:size]]
                    if len(near):
                        columns = [np.full(len(near), tree, np.int32), key[near].view(np.int64), *x[near].T]
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["tree", "key", *x_cols])

        asked = rows.mapInArrow(released(run), "tree int, key long, " + ", ".join(f"{c} double" for c in x_cols))
        first = F.row_number().over(W.partitionBy("tree").orderBy("key", *x_cols))
        drawn = asked.withColumn("rank", first).where(F.col("rank") <= size).drop("rank").toPandas()
        found = np.bincount(drawn["tree"], minlength=params.trees)
        if share >= 1 or (found == size).all():
            break
        share *= 4
    by_tree = drawn.sort_values(["tree", "key", *x_cols])
    return (by_tree.loc[by_tree["tree"] == t, x_cols].to_numpy() for t in range(params.trees))


def _threshold(rows: DataFrame, forest: IsolationForest, n_good: int, n_bad: int) -> float:
    """The cut of ``IsolationForest.calibrate`` over all rows: scores are ranked by bins, the counts above each bin are added up on the driver."""
    scored = rows.mapInArrow(_by_rows(lambda batch, x: {"score": forest.score(x), "good": batch.column("good")}), "score double, good boolean")
    of_score = [F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad")]
    counts = write_table(scored.groupBy("score").agg(*of_score).withColumn("bin", F.floor(F.col("score") * BINS)), "score-counts")
    bins = counts.groupBy("bin").agg(F.sum("n_good").alias("good_above"), F.sum("n_bad").alias("bad_above")).toPandas().sort_values("bin", ascending=False)
    for c in ("good_above", "bad_above"):
        bins[c] = bins[c].cumsum() - bins[c]
    above = rows.sparkSession.createDataFrame(bins, "bin long, good_above long, bad_above long")
    w = W.partitionBy("bin").orderBy(F.desc("score"))
    reached = [(F.col(f"{k}_above") + F.sum(f"n_{k}").over(w)).alias(f"{k}_from") for k in ("good", "bad")]
    ranked = counts.join(F.broadcast(above), "bin").select("score", "n_good", "n_bad", *reached)
    # The quantile "higher" of the good scores: so many of them reach it.
    most = n_good - math.ceil((n_good - 1) * (1 - forest.params.clean_loss))
    least = ranked.where((F.col("n_good") > 0) & (F.col("good_from") >= most)).agg(F.max("score")).first()[0]
    gain = F.col("bad_from") / n_bad - F.col("good_from") / n_good
    first = ranked.where((F.col("n_bad") > 0) & (F.col("score") > least)).agg(F.max(F.struct(gain, -F.col("score"))).alias("best")).first()["best"]
    if first is None:
        return math.inf
    return (-first[1] + counts.where(F.col("score") < -first[1]).agg(F.max("score")).first()[0]) / 2


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: ForestParams = ForestParams()) -> DataFrame:
    """``(doc_id, STATS..., base_failed, score, kept)`` per row of ``docs``.

    Base rules: under 50 words, or over half of the words repeated. Else kept unless the anomaly score reaches the calibrated threshold; without
    labelled rows of both kinds nothing more is rejected. Null or empty texts fail the base rules; repeated rows are judged
    alike; other columns are ignored; an empty table gives an empty result.
    """
    stats = write_table(rule_stats(docs, id_col, text_col), "rule-stats")
    forest = fit_forest(stats, labels, params=params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {s: batch.column(s).to_numpy() for s in STATS}
            failed, score = base_failed(x), forest.score(features(x))
            kept = ~failed & (score < forest.threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), pa.array(score), pa.array(kept)], [*batch.schema.names, "base_failed", "score", "kept"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema)
    return stats.mapInArrow(released(run), f"{fields}, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: ForestParams = ForestParams()) -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps; the decision is made beside each row, so no text is shuffled.

    For the forest, statistics are computed once more: their rows, not the texts, meet the labels.
    """
    small_batches(docs.sparkSession)
    forest = fit_forest(rule_stats(docs, id_col, text_col), labels, params=params)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        rows = np.array([text_stats(t) for t in values_of(texts)], dtype=np.int64).reshape(-1, len(STATS))
        x = dict(zip(STATS, rows.T, strict=True))
        return pa.array(~base_failed(x) & (forest.score(features(x)) < forest.threshold))

    return docs.where(good(F.col(text_col)))

