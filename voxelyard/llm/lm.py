"""Language-model scores by a weighted backoff automaton over n-grams of up to three tokens.

Smoothed n-grams are the arcs of an automaton. Its states are the last two words read, the last one, and none; a state without an arc for the
next word follows its failure arc, which costs the backoff weight and leads to the state of one word less. One left-to-right traversal carries the
state and adds up log-probabilities.

No machine holds the model of the corpus. Documents are cut into blocks of bounded size; each block sends its distinct words, pairs and triples
with their training counts to hashed buckets, as many as there are blocks, gets the corpus totals of exactly these back, and builds the part of the automaton
that its own texts can reach. Pairs and triples move as sorted hashes, one row for each block and bucket. They are told apart by 56 bits of a hash:
among n of them some n * n / 2 ** 57 pairs share one and are counted together.

Model: p(w | u v) = (1 - l(u v)) c(u v w) / c(u v) + l(u v) p(w | v), p(w | v) = (1 - l(v)) c(v w) / c(v) + l(v) p(w), with l = (1 + c(context)) ** -g and for each
order a g such that the mass that all its contexts leave to unseen words equals the number of its n-grams seen once (Good-Turing). p(w) gives words that training never
saw, as one class, the share of words seen once, and the others their relative counts of the rest. For any state the
probabilities of the known words, the end and the unknown class add up to one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelyard.llm._shared import release, released, small_batches, values_of, write_table

#: Text bytes after which a block is closed, and tokens that the traversal of one text handles in a lane.
BLOCK_BYTES = 8 << 20
LANE = 64
HELD_OUT, FOLDS = 2, 7
#: Bits that the hashes of pairs and triples lose.
SHIFT = 8
END_HASH, START_HASH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def fold_of(doc_id) -> int:
    """crc32 of the id as text, modulo 7; a null id is the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


class _Numbering(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpack(data: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def make_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block, written to the shared folder: document ids, token counts, token numbers and the block's words."""
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks = TaskContext.get().partitionId(), 0
        numbers, ids, sizes, tokens, held = _Numbering(), [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal numbers, ids, sizes, tokens, held, blocks
            flat, words = np.concatenate(tokens), b"\n".join(numbers)
            row = [
                pa.array([(part << 24) + blocks], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int64())),
                pa.array([_pack(flat)], pa.binary()), pa.array([len(numbers)], pa.int64()), pa.array([len(words)], pa.int64()),
                pa.array([_pack(np.frombuffer(words, np.uint8))], pa.binary()),
            ]
            numbers, ids, sizes, tokens, held = _Numbering(), [], [], [], 0
            blocks += 1
            return pa.RecordBatch.from_arrays(row, ["block", "ids", "sizes", "tokens", "n_words", "n_bytes", "words"])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(values_of(batch.column("doc_id")), values_of(batch.column("text")), strict=True):
                words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
                ids.append(doc_id)
                sizes.append(len(words))
                tokens.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                held += sum(map(len, words)) + len(words) + 16
                if held >= block_bytes:
                    yield flush()
        if ids:
            yield flush()

    schema = f"block long, ids array<{kind}>, sizes array<long>, tokens binary, n_words long, n_bytes long, words binary"
    return write_table(picked.mapInArrow(released(run), schema), "lm-blocks")


@dataclass
class Block:
    """A block unpacked. Words are numbered 0 to n-1; n is the end and n+1 the start state."""

    ids: list
    sizes: np.ndarray
    flat: np.ndarray  # word numbers and ends, document after document
    before: np.ndarray  # the word before each
    inner: np.ndarray  # whether two tokens or the start and a word stand before it
    train: np.ndarray  # whether it belongs to a training document
    held_out: np.ndarray
    words: list[bytes]

    @classmethod
    def of(cls, row: dict) -> Block:
        sizes = np.array(row["sizes"], np.int64)
        n = row["n_words"]
        tokens = _unpack(row["tokens"], int(sizes.sum()), np.uint32)
        ends = np.cumsum(sizes + 1) - 1
        flat = np.full(len(tokens) + len(sizes), n, np.int64)
        inner = np.ones(len(flat), bool)
        inner[ends] = False
        flat[inner] = tokens
        before = np.empty_like(flat)
        before[1:] = flat[:-1]
        before[ends - sizes] = n + 1
        second = np.ones(len(flat), bool)
        second[ends - sizes] = False
        held_out = np.array([fold_of(x) == HELD_OUT for x in row["ids"]], bool)
        words = _unpack(row["words"], row["n_bytes"], np.uint8).tobytes().split(b"\n") if n else []
        return cls(row["ids"], sizes, flat, before, second, np.repeat(~held_out, sizes + 1), held_out, words)

    def word_counts(self) -> np.ndarray:
        """Training count of each word and, last, of the end."""
        return np.bincount(self.flat[self.train], minlength=len(self.words) + 1)

    def hashes(self) -> np.ndarray:
        import xxhash

        own = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        return np.append(own, (END_HASH, START_HASH))

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs as word * (n + 2) + word, the number of the pair that each place ends, distinct triples as pair * (n + 2) + word, and the triple of each inner place."""
        m = len(self.words) + 2
        pairs, pair_at = np.unique(self.before * m + self.flat, return_inverse=True)
        at = np.flatnonzero(self.inner)
        triples, triple_at = np.unique(pair_at[at - 1] * m + self.flat[at], return_inverse=True)
        return pairs, pair_at, triples, triple_at

    def gram_hashes(self, hashes: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """56-bit hashes of pairs and triples; the lowest bit tells whether the last token is the end, which is no context."""
        m = len(self.words) + 2
        two = _mix(_mix(hashes)[pairs // m] * np.uint64(0x9FB21C651E98DF25) + hashes[pairs % m])
        three = _mix((two[triples // m] ^ np.uint64(0xA24BAED4963EE407)) * np.uint64(0x9FB21C651E98DF25) + hashes[triples % m])
        end = np.uint64(1) << np.uint64(SHIFT)
        return tuple((h & ~(end - np.uint64(1)) & ~end) | np.where(codes % m == m - 2, end, np.uint64(0)) for h, codes in ((two, pairs), (three, triples)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted hashes pass from bucket to bucket: equal ranges of the upper 32 bits."""
    edges = (np.arange(buckets, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(buckets - 1)) // np.uint64(buckets) << np.uint64(32)
    return np.append(np.searchsorted(hashes, edges), len(hashes))


def _pack_sorted(hashes: np.ndarray) -> bytes:
    """Sorted hashes by their differences, byte plane after byte plane: the high planes are nearly all zero."""
    steps = np.diff(hashes >> np.uint64(SHIFT), prepend=np.uint64(0))
    return _pack(np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T[:7]))


def _unpack_sorted(data: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :7] = _unpack(data, 7 * n, np.uint8).reshape(7, n).T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


SENT = "bucket int, kind int, block long, n long, keys binary, counts binary"
BACK = "block long, bucket int, kind int, n long, totals binary"


def _send_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """Per block and bucket: the words (newline-joined) and their training counts; the end travels as an empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row)
                counts, hashes = block.word_counts(), block.hashes()[:-1]
                order, names = np.argsort(hashes), [*block.words, b""]
                cuts = _cuts(hashes[order], buckets)
                parts = ((b, order[cuts[b] : cuts[b + 1]]) for b in np.flatnonzero(np.diff(cuts)).tolist())
                yield _sent([(b, 1, row["block"], len(p), b"\n".join(names[i] for i in p.tolist()), counts[p]) for b, p in parts])

    return blocks.mapInArrow(released(run), SENT)


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    columns[5] = [_pack(c.astype(np.uint32)) for c in columns[5]]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], ["bucket", "kind", "block", "n", "keys", "counts"])


def _send_grams(blocks: DataFrame, buckets: int) -> DataFrame:
    """Per block, bucket and kind (2: pairs, 3: triples): sorted hashes and training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row)
                pairs, pair_at, triples, triple_at = block.grams()
                own = block.gram_hashes(block.hashes(), pairs, triples)
                counts = np.bincount(pair_at[block.train], minlength=len(pairs)), np.bincount(triple_at[block.train[block.inner]], minlength=len(triples))
                for kind, hashes, count in zip((2, 3), own, counts, strict=True):
                    order = np.argsort(hashes)
                    hashes, count = hashes[order], count[order]
                    cuts = _cuts(hashes, buckets).tolist()
                    yield _sent([(b, kind, row["block"], z - a, _pack_sorted(hashes[a:z]), count[a:z]) for b, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if z > a])

    return blocks.mapInArrow(released(run), SENT)


def _totals(table: pa.Table, codes: np.ndarray, n: int) -> tuple[np.ndarray, pa.Table]:
    sizes = table.column("n").to_numpy()
    counts = np.concatenate([_unpack(c, k, np.uint32) for c, k in zip(table.column("counts").to_pylist(), sizes.tolist(), strict=True)])
    totals = np.bincount(codes, weights=counts, minlength=n).astype(np.int64)
    ends = np.cumsum(sizes)
    back = [_pack(totals[codes[e - k : e]].astype(np.uint64).view(np.uint8).reshape(-1, 8).T.copy()) for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
    return totals, pa.Table.from_arrays(
        [table.column("block"), table.column("bucket"), table.column("kind"), table.column("n"), pa.array(back, pa.binary())], ["block", "bucket", "kind", "n", "totals"]
    )


def _summary(out: pa.Table, numbers: np.ndarray) -> pa.Table:
    """A row of block -1 with what the whole corpus needs of this bucket."""
    bucket, kind = out.column("bucket")[0].as_py(), out.column("kind")[0].as_py()
    values = [-1], [bucket], [kind], [len(numbers)], [_pack(numbers.astype(np.int64))]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    row = pa.Table.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], out.schema.names)
    return pa.concat_tables([out.combine_chunks().cast(row.schema), row])


def _histogram(totals: np.ndarray) -> np.ndarray:
    """Contexts and their tokens by the logarithm of their count."""
    classes = np.minimum(np.log2(totals).astype(np.int64), 62)
    return np.concatenate([np.bincount(classes, minlength=63), np.bincount(classes, weights=totals, minlength=63)]).astype(np.int64)


def _add_words(table: pa.Table) -> pa.Table:
    names = pa.array(chain.from_iterable(k.split(b"\n") for k in table.column("keys").to_pylist()), pa.binary()).dictionary_encode()
    totals, out = _totals(table, names.indices.to_numpy(), len(names.dictionary))
    known = totals > 0
    ends = [int(t) for w, t in zip(names.dictionary.to_pylist(), totals, strict=True) if not w] if len(totals) else []
    return _summary(out, np.concatenate([[totals.sum(), known.sum(), (totals == 1).sum(), sum(ends)], _histogram(totals[known])]))


def _add_grams(table: pa.Table) -> pa.Table:
    keys = [_unpack_sorted(k, n) for k, n in zip(table.column("keys").to_pylist(), table.column("n").to_pylist(), strict=True)]
    unique, codes = np.unique(np.concatenate(keys), return_inverse=True)
    totals, out = _totals(table, codes, len(unique))
    contexts = totals[(totals > 0) & (unique & np.uint64(1) == 0)]
    return _summary(out, np.concatenate([[(totals == 1).sum()], _histogram(contexts)]))


@dataclass
class Corpus:
    """What every block needs of the whole corpus: training tokens, distinct tokens, training documents, backoff exponents of one and two words, share of unknown words."""

    tokens: int
    distinct: int
    documents: int
    exponents: tuple[float, float]
    novelty: float


def backoff_exponent(histogram: np.ndarray, once: int) -> float:
    """g with sum over contexts of c (1 + c) ** -g equal to the pairs seen once; histogram: contexts and their tokens by log2 of count."""
    contexts, tokens = histogram
    mean = tokens / np.maximum(contexts, 1)
    low, high = 0.01, 4.0
    for _ in range(60):
        g = (low + high) / 2
        low, high = (g, high) if (tokens * (1 + mean) ** -g).sum() > once else (low, g)
    return (low + high) / 2


def gather(words: DataFrame, grams: DataFrame) -> Corpus:
    """Add up the buckets' summaries, a fixed number of figures each."""

    def added(df: DataFrame, kind: int, size: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, np.int64)
            for b in batches:
                for data in b.column("totals").to_pylist():
                    total += _unpack(data, size, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int64()), pa.array(total)], ["k", "v"])

        own = df.where((F.col("block") == -1) & (F.col("kind") == kind)).select("totals")
        out = np.zeros(size, np.int64)
        for r in own.mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect():
            out[r.k] = r.v
        return out

    head, pairs, triples = added(words, 1, 4 + 2 * 63), added(grams, 2, 1 + 2 * 63), added(grams, 3, 1 + 2 * 63)
    tokens, distinct, single, documents = (int(x) for x in head[:4])
    contexts = head[4:].reshape(2, 63).astype(np.float64), pairs[1:].reshape(2, 63).astype(np.float64)
    exponents = tuple(backoff_exponent(c, int(g[0])) if tokens else 1.0 for c, g in zip(contexts, (pairs, triples), strict=True))
    return Corpus(tokens, distinct, documents, exponents, (single + 1) / (tokens + 2))


def _find(held: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Binary search of many keys in their own order: neighbours touch the same memory."""
    order = np.argsort(wanted)
    out = np.empty(len(wanted), np.int64)
    out[order] = np.searchsorted(held, wanted[order])
    return out


class BackoffAutomaton:
    """States: pairs (by number), words, none. ``arcs``: sorted state * width + word of each order with log-probabilities; ``failure``: the cost of a state's failure arc.

    A pair's number is its place in ``pairs``, the sorted codes of all pairs that the texts hold; whether it also is an arc of its first word's state tells ``held``.
    """

    def __init__(self, width: int, pairs: np.ndarray, held: np.ndarray, costs: np.ndarray, failure: np.ndarray, bare: np.ndarray, triples: np.ndarray, triple_costs: np.ndarray, pair_failure: np.ndarray):
        self.width, self.pairs, self.held, self.costs, self.failure, self.bare = width, pairs, held, costs, failure, bare
        self.triples, self.triple_costs, self.pair_failure = triples, triple_costs, pair_failure

    def step(self, pair: np.ndarray, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of reading a word in each lane, and the pairs reached; pair -1: no state of two words."""
        after = _find(self.pairs, state * self.width + word)
        cost = np.where(self.held[after], self.costs[after], self.failure[state] + self.bare[word])
        wanted = pair * self.width + word
        at = np.minimum(_find(self.triples, wanted), max(len(self.triples) - 1, 0))
        found = (self.triples[at] == wanted) & (pair >= 0) if len(self.triples) else np.zeros(len(wanted), bool)
        cost = np.where(pair >= 0, self.pair_failure[pair], 0.0) + cost
        if len(self.triples):
            cost = np.where(found, self.triple_costs[at], cost)
        return cost, after

    def traverse(self, tokens: np.ndarray, pair: np.ndarray, state: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Total log-probability of each lane ``tokens[start : start + size]`` read from a pair and a word state; lanes advance together."""
        order = np.argsort(-sizes, kind="stable")
        pair, state, at, left = pair[order], state[order], starts[order], sizes[order]
        total = np.zeros(len(order))
        for t in range(int(left.max(initial=0))):
            n = np.searchsorted(-left, -t, "left")
            word = tokens[at[:n] + t]
            cost, pair[:n] = self.step(pair[:n], state[:n], word)
            state[:n] = word
            total[:n] += cost
        out = np.empty_like(total)
        out[order] = total
        return out


def _log10(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def build_automaton(words: int, word_totals: np.ndarray, pairs: np.ndarray, pair_totals: np.ndarray, triples: np.ndarray, triple_totals: np.ndarray, corpus: Corpus) -> BackoffAutomaton:
    """The part of the corpus's automaton that texts of these words, pairs and triples can reach."""
    m = words + 2
    context = np.append(word_totals[:words], (0, corpus.documents)).astype(np.float64)  # the end is no context
    keep = (1 + context) ** -corpus.exponents[0]
    bare = np.where(word_totals > 0, (1 - corpus.novelty) * word_totals / max(1, corpus.tokens), corpus.novelty)
    state, word = pairs // m, pairs % m
    two = (1 - keep[state]) * pair_totals / np.maximum(context[state], 1) + keep[state] * bare[word]
    pair_keep = np.where(word == words, 1.0, (1.0 + pair_totals) ** -corpus.exponents[1])
    triples, triple_totals = triples[triple_totals > 0], triple_totals[triple_totals > 0].astype(np.float64)
    pair, last = triples // m, triples % m
    lower = two[_find(pairs, word[pair] * m + last)]
    three = (1 - pair_keep[pair]) * triple_totals / np.maximum(pair_totals[pair], 1) + pair_keep[pair] * lower
    return BackoffAutomaton(m, pairs, pair_totals > 0, _log10(two), _log10(keep), _log10(np.append(bare, 0.0)), triples, _log10(three), _log10(pair_keep))


def score_block(row: dict, sent: dict[int, dict[int, np.ndarray]], corpus: Corpus) -> dict:
    """Scores of a block's documents from the totals that its buckets sent back, by kind and bucket."""
    block = Block.of(row)
    hashes = block.hashes()
    pairs, pair_at, triples, _ = block.grams()
    found = []
    for kind, own in zip((1, 2, 3), (hashes[:-1], *block.gram_hashes(hashes, pairs, triples)), strict=True):
        totals, order = np.zeros(len(own), np.int64), np.argsort(own)
        totals[order] = np.concatenate([sent[kind][b] for b in sorted(sent[kind])]) if sent[kind] else 0
        found.append(totals)
    totals = found[0]
    automaton = build_automaton(len(block.words), totals, pairs, found[1], triples, found[2], corpus)
    ends = np.cumsum(block.sizes + 1)
    first = ends - block.sizes - 1
    lanes = (block.sizes + LANE) // LANE
    own = np.repeat(np.arange(len(lanes)), lanes)
    k = np.arange(len(own)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start = first[own] + k * LANE
    got = automaton.traverse(block.flat, np.where(k > 0, pair_at[start - 1], -1), block.before[start], start, np.minimum(LANE, ends[own] - start))
    base = np.log10((totals + 1) / (corpus.tokens + corpus.distinct + 1))
    return {
        "doc_id": block.ids, "held_out": block.held_out, "n_tokens": block.sizes + 1,
        "n_known": np.add.reduceat((totals > 0)[block.flat].astype(np.int64), first), "train_tokens": np.full(len(first), corpus.tokens),
        "base_score": np.add.reduceat(base[block.flat], first), "score": np.bincount(own, weights=got, minlength=len(first)),
    }


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row.

    Trained on the rows whose crc32(id) mod 7 is not 2, scored over all whole texts (null: empty; every text ends with one end token).
    base_score: add-one word counts; score: the automaton's log10 probability, words unknown to training being one class as in the base. Repeated rows count and are scored as rows of their own; a
    null id counts as the empty text; other columns are ignored, whatever their names; an empty table gives an empty result, and without training rows all words are unknown.
    """
    spark = docs.sparkSession
    blocks = make_blocks(docs, id_col, text_col, block_bytes)
    # As many buckets as blocks: a bucket's share of all entries is about that of a block, so its group stays as bounded as a block at any size.
    buckets = max(1, blocks.count())
    words = write_table(_send_words(blocks, buckets).groupBy("bucket").applyInArrow(_add_words, BACK), "lm-words")
    grams = write_table(_send_grams(blocks, buckets).groupBy("bucket", "kind").applyInArrow(_add_grams, BACK), "lm-grams")
    corpus = spark.sparkContext.broadcast(gather(words, grams))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        sent: dict[int, dict] = {1: {}, 2: {}, 3: {}}
        for r in right.to_pylist():
            sent[r["kind"]][r["bucket"]] = _unpack(r["totals"], 8 * r["n"], np.uint8).reshape(8, -1).T.copy().view("<u8").ravel().astype(np.int64)
        out = score_block(left.to_pylist()[0], sent, corpus.value)
        id_type = left.schema.field("ids").type.value_type
        table = pa.table({k: pa.array(v, id_type) if k == "doc_id" else pa.array(v) for k, v in out.items()})
        release()
        return table

    back = words.where("block >= 0").union(grams.where("block >= 0"))
    return (
        blocks.groupBy("block")
        .cogroup(back.groupBy("block"))
        .applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
