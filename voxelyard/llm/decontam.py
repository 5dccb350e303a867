"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Every passage (window) of every training document is a query. Items are grouped by length so that a window of at least twice an
item's length, moved by half, holds every occurrence whole. A window whose terms cannot reach the least threshold of a group even at
their highest impacts is skipped (the bound of WAND, taken from prefix sums over the document and then over its distinct terms); block-max
WAND retrieves from the group's postings what the others score above threshold. Items found are verified by the shingles of question and answer.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from itertools import chain, groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from voxelyard.llm._shared import small_batches, released, values_of, write_table

_WORD = re.compile(r"\w+")
#: Score classes of one index: each costs one prefix sum over a document's terms.
GROUPS = 16
#: Numbers held at a time while windows are looked into; memory does not follow a text's length.
ROW_IDS = 1 << 18
#: Words of texts that are scanned together, whole texts at a time.
SCAN_WORDS = 1 << 17


@dataclass(frozen=True)
class SearchParams:
    """k1, b: of BM25. share: part of an item's own score that a passage must reach. overlap: share of the question's and of the answer's
    ``shingle``-word shingles that the passage must hold. block: items in a posting block. shard_items, shard_bytes: bounds of one broadcast index."""

    k1: float = 1.2
    b: float = 0.75
    share: float = 0.5
    overlap: float = 0.8
    shingle: int = 5
    block: int = 4
    least_window: int = 32
    shard_items: int = 20_000
    shard_bytes: int = 16 << 20


def words_of_text(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of question and answer: parted at the last line break or else after the last sentence that leaves three words; else the last third."""
    head, found, tail = text.rstrip().rpartition("\n")
    if not (found and words_of_text(head) and words_of_text(tail)):
        ends = [m.end() for m in re.finditer(r"[.?!:]\s", text)]
        cut = next((e for e in reversed(ends) if len(words_of_text(text[e:])) >= 3 and words_of_text(text[:e])), None)
        if cut is None:
            words = words_of_text(text)
            n = max(1, len(words) - max(1, len(words) // 3))
            return words[:n], words[n:]
        head, tail = text[:cut], text[cut:]
    return words_of_text(head), words_of_text(tail)


def shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@dataclass
class Statistics:
    """Of all items: in how many each term occurs, how many there are, and their mean number of words."""

    df: Mapping[str, int]
    n: int
    mean: float

    def impact(self, term: str, count: int, size: int, p: SearchParams) -> float:
        """What a term that an item of ``size`` words has ``count`` times adds to its BM25 score."""
        df = self.df[term]
        idf = math.log(1 + (self.n - df + 0.5) / (df + 0.5))
        return idf * count * (p.k1 + 1) / (count + p.k1 * (1 - p.b + p.b * size / self.mean))


class BlockMaxIndex:
    """Postings of BM25 impacts with block maxima, searched by block-max WAND.

    Items are numbered by window and own score, so that the thresholds in a block of ``block`` items are alike. Blocks are gathered in groups of one
    window and like scores; a group has the highest impact of each term (WAND's bound) and its least threshold. ``df``, ``n`` and ``mean`` are those of all items, whatever
    part of them the index holds. ``seen`` counts what searches met and skipped.
    """

    def __init__(self, items: list[tuple[object, str]], params: SearchParams = SearchParams(), statistics: Statistics | None = None):
        self.params = p = params
        texts = [(i, *split_item(t)) for i, t in items if words_of_text(t)]
        counts = [Counter(q + a) for _, q, a in texts]
        sizes = [sum(c.values()) for c in counts]
        self.statistics = s = statistics or Statistics(Counter(chain.from_iterable(counts)), len(texts), sum(sizes) / max(1, len(sizes)))
        weights = [{t: s.impact(t, n, size, p) for t, n in c.items()} for c, size in zip(counts, sizes, strict=True)]
        own = [math.fsum(w.values()) for w in weights]
        window = [max(p.least_window, 1 << (2 * size - 1).bit_length()) for size in sizes]
        order = sorted(range(len(texts)), key=lambda i: (window[i], own[i], str(texts[i][0]), texts[i][1], texts[i][2]))
        self.items = [texts[i] for i in order]
        self.own = [own[i] for i in order]
        self.need = [p.share * own[i] * (1 - 1e-9) for i in order]
        self.parts = [tuple((shingles(x, min(p.shingle, len(x) or 1)), min(p.shingle, len(x) or 1)) for x in texts[i][1:]) for i in order]
        self.terms = {t: k for k, t in enumerate(sorted(set(chain.from_iterable(counts))))}
        self._place([window[i] for i in order])
        self._post([weights[i] for i in order])
        self.seen = Counter()

    def _place(self, window: list[int]) -> None:
        """Blocks and groups: runs of items of one window."""
        starts = [n for n in range(len(window)) if n == 0 or window[n] != window[n - 1]]
        chunk = self.params.block * max(1, -(-len(window) // (GROUPS * self.params.block)))
        self.block_of, self.block_floor, self.group_of, self.windows = [], [], [], []
        for at, end in zip(starts, [*starts[1:], len(window)], strict=False):
            for n in range(at, end):
                if (n - at) % self.params.block == 0:
                    self.block_floor.append(self.need[n])
                if (n - at) % chunk == 0:
                    self.windows.append(window[n])
                self.block_floor[-1] = min(self.block_floor[-1], self.need[n])
                self.block_of.append(len(self.block_floor) - 1)
                self.group_of.append(len(self.windows) - 1)
        self.floor = np.full(len(self.windows), math.inf)
        np.minimum.at(self.floor, np.array(self.group_of, np.int64), self.need)
        blocks = [b for _, b in sorted({(b, g): g for b, g in zip(self.block_of, self.group_of, strict=True)}.items())]
        self.first_block = [blocks.index(g) for g in range(len(self.windows))] + [len(blocks)]

    def _post(self, weights: list[dict[str, float]]) -> None:
        """Postings of each group and term, flat: items with impacts, and blocks with their highest impact."""
        held = sorted((self.group_of[n], self.terms[t], n, w) for n, own in enumerate(weights) for t, w in own.items())
        self.item, self.impact = np.array([h[2] for h in held], np.int32), np.array([h[3] for h in held], np.float64)
        self.lists: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in self.windows]
        self.bounds = np.zeros((len(self.windows), len(self.terms) + 1))
        blocks, maxima = [], []
        for (g, t), run in groupby(range(len(held)), key=lambda k: held[k][:2]):
            places, first = list(run), len(blocks)
            for b, of in groupby(places, key=lambda k: self.block_of[held[k][2]]):
                blocks.append(b - self.first_block[g])
                maxima.append(max(held[k][3] for k in of))
            self.lists[g][t] = (places[0], places[-1] + 1, first, len(blocks))
            self.bounds[g, t] = max(maxima[first:])
        self.block, self.block_max = np.array(blocks, np.int32), np.array(maxima, np.float64)
        self.block_start, self.block_count = (np.zeros(self.bounds.shape, np.int32) for _ in range(2))
        for g, lists in enumerate(self.lists):
            for t, (_, _, a, z) in lists.items():
                self.block_start[g, t], self.block_count[g, t] = a, z - a

    def search(self, g: int, terms: list[int]) -> list[tuple[int, float]]:
        """Items of group g that score at least their threshold for a passage of the given distinct terms."""
        return self._in_blocks(g, terms, self._live(g, np.array([terms], np.int64))[1].tolist())

    def _live(self, g: int, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages (rows of distinct terms) and the blocks of group g whose block maxima let an item reach the least threshold in them."""
        first, blocks = self.first_block[g], self.first_block[g + 1] - self.first_block[g]
        start, size = self.block_start[g][terms], self.block_count[g][terms]
        row = np.repeat(np.arange(len(terms)), size.sum(axis=1))
        size = size.ravel()
        at = np.repeat(start.ravel() - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        bound = np.bincount(row * blocks + self.block[at], self.block_max[at], len(terms) * blocks).reshape(-1, blocks)
        rows, live = np.nonzero(bound >= np.array(self.block_floor[first : first + blocks]))
        self.seen.update(searches=len(terms), blocks=bound.size, skipped=bound.size - len(live))
        return rows, live

    def _in_blocks(self, g: int, terms: list[int], blocks: list[int]) -> list[tuple[int, float]]:
        """WAND over the given blocks: cursors move from pivot to pivot."""
        lists = [held for t in terms if (held := self.lists[g].get(t))]
        first, out = self.first_block[g], []
        for b in blocks:
            cursors = []
            for lo, hi, a, z in lists:
                k = a + int(np.searchsorted(self.block[a:z], b))
                if k < z and self.block[k] == b:
                    start = lo + int(np.searchsorted(self.item[lo:hi], self._first_item(first + b)))
                    cursors.append([start, hi, float(self.block_max[k])])
            out += self._in_block(first + b, cursors)
        return out

    def _first_item(self, block: int) -> int:
        return bisect_left(self.block_of, block)

    def _in_block(self, block: int, cursors: list[list]) -> list[tuple[int, float]]:
        """WAND within one block; a cursor is its place, the end of its list and its highest impact in the block."""
        end, floor, item, out = bisect_left(self.block_of, block + 1), self.block_floor[block], self.item, []
        cursors = [[int(item[c[0]]), *c] for c in cursors]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for i, c in enumerate(cursors):
                bound += c[3]
                if bound >= floor:
                    pivot = i
                    break
            if pivot is None:
                break
            wanted = cursors[pivot][0]
            if cursors[0][0] == wanted:
                score = math.fsum(float(self.impact[c[1]]) for c in cursors if c[0] == wanted)
                self.seen["scored"] += 1
                if score >= self.need[wanted]:
                    out.append((wanted, score))
                wanted += 1
            for c in cursors:
                while c[0] < wanted:
                    c[1] += 1
                    c[0] = int(item[c[1]]) if c[1] < c[2] else end
            cursors = [c for c in cursors if c[0] < end]
        return out

    def verify(self, item: int, passage: list[str]) -> tuple[float, float]:
        """Shares of the question's and of the answer's shingles that the passage holds; a missing part counts as held."""
        seen: dict[int, set] = {}
        got = []
        for part, size in self.parts[item]:
            if size not in seen:
                seen[size] = shingles(passage, size) if len(passage) >= size else set()
            got.append(len(part & seen[size]) / len(part) if part else 1.0)
        return got[0], got[1]

    def scan(self, texts: Iterable[str | None]) -> list[dict[object, tuple[float, float, float]]]:
        """For each text the contaminating items with the best ``(score / own score, question overlap, answer overlap)``."""
        found: list[dict] = []
        held, size = [], 0
        for text in texts:
            held.append(words_of_text(text))
            found.append({})
            size += len(held[-1])
            if size >= SCAN_WORDS:
                self._scan(held, found[-len(held) :])
                held, size = [], 0
        if held:
            self._scan(held, found[-len(held) :])
        return found

    def _scan(self, docs: list[list[str]], found: list[dict]) -> None:
        none = len(self.terms)
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        ids = np.fromiter(map(self.terms.get, chain.from_iterable(docs), repeat(none)), np.int32, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        totals = {}
        for g, window in enumerate(self.windows):
            totals.setdefault(window, []).append((g, np.concatenate([[0.0], np.cumsum(self.bounds[g][ids])])))
        for window, groups in totals.items():
            step = window // 2
            n = np.maximum(1, -(-(sizes - step) // step))
            own = np.repeat(np.arange(len(docs)), n)
            begin = first[own] + (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)) * step
            end = np.minimum(begin + window, (first + sizes)[own])
            # The bound with repeats needs no look into the windows; what it leaves is bound by distinct terms.
            hopeful = [(g, total[end] - total[begin] >= self._least(g)) for g, total in groups]
            left = np.flatnonzero(np.logical_or.reduce([h for _, h in hopeful]))
            rows = max(1, ROW_IDS // window)
            for at in range(0, len(left), rows):
                some = left[at : at + rows]
                terms = self._distinct(ids, begin[some], end[some], window)
                for g, hope in hopeful:
                    picked = np.flatnonzero(hope[some])
                    picked = picked[self.bounds[g][terms[picked]].sum(axis=1) >= self._least(g)]
                    for k, blocks in self._hopeful(g, terms, picked):
                        d, lo, hi = own[some[k]], begin[some[k]], end[some[k]]
                        self._report(g, terms[k][terms[k] < none].tolist(), blocks, docs[d][lo - first[d] : hi - first[d]], found[d])

    def _least(self, g: int) -> float:
        return self.floor[g]

    def _distinct(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
        """One row per window: its terms, sorted; a repeat or a place beyond the end holds the number of no term, whose impacts are zero."""
        none = len(self.terms)
        place = begin[:, None] + np.arange(window)
        terms = np.where(place < end[:, None], ids[np.minimum(place, len(ids) - 1)], none) if len(ids) else np.full(place.shape, none)
        terms.sort(axis=1)
        terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = -1
        terms[terms < 0] = none
        return terms

    def _hopeful(self, g: int, terms: np.ndarray, picked: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Those of the picked passages that have live blocks in group g, with these."""
        rows = max(1, ROW_IDS // max(terms.shape[1], self.first_block[g + 1] - self.first_block[g]))
        for at in range(0, len(picked), rows):
            some = picked[at : at + rows]
            row, live = self._live(g, terms[some])
            for k, run in groupby(zip(row.tolist(), live.tolist(), strict=True), key=lambda x: x[0]):
                yield int(some[k]), [b for _, b in run]

    def _report(self, g: int, terms: list[int], blocks: list[int], passage: list[str], found: dict) -> None:
        """Search one passage, verify what is found and keep the best for each item."""
        for item, score in self._in_blocks(g, terms, blocks):
            question, answer = self.verify(item, passage)
            if min(question, answer) >= self.params.overlap:
                name, now = self.items[item][0], (score / self.own[item], question, answer)
                found[name] = max(found.get(name, now), now)


def index_shards(items: DataFrame, id_col: str, text_col: str, params: SearchParams) -> Iterator[tuple[list[tuple[object, str]], Statistics]]:
    """The items in shards, each within the bounds of ``params``, with the statistics of all items for the terms of the shard.

    A larger table gives more shards, and the corpus is read once for each. Document frequencies are counted over all items, in the cluster;
    the driver holds one shard and the frequencies of its own terms at a time.
    """
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    size = rows.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    n = max(1, -(-(size[0] or 0) // params.shard_items), -(-(size[1] or 0) // params.shard_bytes))
    n = 1 if n == 1 else 2 * n  # hashed shares vary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of_text(t) for t in values_of(batch.column("t"))]
            columns = batch.columns, pa.array(map(len, words), pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*columns[0], *columns[1:]], ["i", "t", "shard", "size", "terms"])

    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int"))
    kind = items.schema[id_col].dataType.simpleString()
    told = write_table(sharded.mapInArrow(run, f"i {kind}, t string, shard int, size long, terms array<string>").where("size > 0"), "benchmark-items")
    total = told.agg(F.count("*"), F.avg("size")).first()
    held = told.select("shard", F.explode("terms").alias("term"))
    frequencies = write_table(held.groupBy("term").agg(F.count("*").alias("df")), "benchmark-terms")
    for k in range(n):
        own = told.where(F.col("shard") == k)
        shard = sorted(((r.i, r.t) for r in own.select("i", "t").toLocalIterator()), key=lambda r: (str(r[0]), r[1]))
        terms = held.where(F.col("shard") == k).select("term").distinct()
        yield shard, Statistics({r.term: r.df for r in frequencies.join(terms, "term").toLocalIterator()}, total[0], total[1] or 1.0)


def _indexes(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, params: SearchParams) -> Iterator:
    for shard, statistics in index_shards(items, item_id, item_text, params):
        yield docs.sparkSession.sparkContext.broadcast(BlockMaxIndex(shard, params, statistics))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", params: SearchParams = SearchParams()) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap)``: one row per row of ``docs`` and item found in it.

    score is the share of the item's own BM25 score, over the best passage. Null or empty texts and items match nothing; whole texts are
    searched; items that repeat under one id are one; repeated rows of ``docs`` are reported each; ids of any type, null
    among them, stay as they are; other columns are ignored, whatever their names; an empty table gives an empty result. An item under ``shingle`` words must occur whole. The number of
    shards changes neither scores nor matches.
    """
    small_batches(docs.sparkSession)
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, question_overlap double, answer_overlap double"
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item_type = to_arrow_schema(items.select(item_id).schema).field(0).type
    out = None
    for index in _indexes(docs, items, item_id, item_text, params):
        found = picked.mapInArrow(_searcher(index, item_type), schema)
        out = found if out is None else out.union(found)
    return out


def _searcher(index, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            found = index.value.scan(values_of(batch.column("text")))
            rows = [(d, i, *x) for d, f in zip(ids, found, strict=True) for i, x in sorted(f.items(), key=lambda y: str(y[0]))]
            d, i, s, q, a = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(d, batch.schema.field("doc_id").type), pa.array(i, item_type), *(pa.array(x, pa.float64()) for x in (s, q, a))],
                ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
            )

    return released(run)


def _cleanness(index):
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([not f for f in index.value.scan(values_of(texts))], pa.bool_())

    return clean


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", params: SearchParams = SearchParams()) -> DataFrame:
    """The rows of ``docs`` in which no item is found; the decision is made beside each row, so nothing is joined or shuffled."""
    small_batches(docs.sparkSession)
    out = docs
    for index in _indexes(docs, items, item_id, item_text, params):
        out = out.where(F.arrow_udf(_cleanness(index), "boolean")(F.col(text_col)))
    return out
