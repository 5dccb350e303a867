"""Concatenate-and-cut packing of documents into token windows.

Pass 1 tokenizes each document once, and records its offset within its partition. The partitions' totals, one number each, give the
partitions' global offsets; pass 2 adds them and cuts at multiples of the window. A document that crosses a boundary leaves a
boundary record (piece) on either side; no text or token moves between machines.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelyard.llm._shared import released, small_batches, values_of, write_table

WINDOW = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _merges_only(spec: dict) -> bool:
    """Whether a tokenizer file is plain byte-level BPE whose ids follow its merges: only then do ids alone decide the merges."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return False
    merged = ("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"])
    return all(model["vocab"].get(token) == n for n, token in enumerate(merged, 256)) and len(model["vocab"]) == 256 + len(model["merges"])


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE files write visible Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class DocumentTokenizer:
    """Token ids of whole texts by a byte-level BPE file.

    Where the file's ids are the order of its merges, a quicker engine merges by the same ids; the tests hold it
    against the file's own. Texts that spell an added token, and long runs of white space, go to the file's own engine.
    """

    #: The pre-tokenizer of byte-level BPE (a fixed pattern).
    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain, self.quick = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if _merges_only(spec):
            import tiktoken

            byte = _byte_of_char()
            ranks = {bytes(byte[c] for c in token): n for token, n in spec["model"]["vocab"].items()}
            self.quick = tiktoken.Encoding(path, pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.rare = re.compile("|".join([r"\s{256}", *(re.escape(t["content"]) for t in spec.get("added_tokens") or [])]))

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.quick is None or self.rare.search(text):
            ids = self.plain.encode(text, add_special_tokens=False).ids
        else:
            ids = self.quick.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


@cache
def document_tokenizer(path: str) -> DocumentTokenizer:
    """One for each worker process, which serves many tasks."""
    return DocumentTokenizer(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pass 1, written to the shared folder: ``(doc_id, part, before, doc_tokens, ids)``.

    ids: 16-bit little-endian if every id of the vocabulary fits, else 32-bit, with the end id; before: ids of the partition that precede the
    document. Null text: the end id alone. Repeated rows are documents of their own.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = document_tokenizer(vocabulary or vocabulary_path())
        wide = tokenizer.plain.get_vocab_size() > 1 << 16
        end = np.array([end_id], "<u4").tobytes()
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            encoded = [tokenizer.encode(t) + end for t in values_of(batch.column("text"))]
            counts = [len(x) // 4 for x in encoded]
            starts = list(accumulate(counts, initial=before))
            before = starts.pop()
            stored = encoded if wide else [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in encoded]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([part] * len(counts), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(stored, pa.binary()), pa.array([wide] * len(counts))],
                ["doc_id", "part", "before", "doc_tokens", "ids", "wide"],
            )

    return write_table(picked.mapInArrow(released(run), f"doc_id {kind}, part int, before long, doc_tokens long, ids binary, wide boolean"), "tokens")


def global_offsets(tokens: DataFrame) -> dict[int, int]:
    """Ids before each partition of pass 1: the prefix sums of the partitions' totals (one number for each partition)."""
    totals = sorted((r.part, r.n) for r in tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())
    return dict(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0), strict=False))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` and, if asked for, its ids.

    Documents are laid end to end in partition order and cut every ``window`` ids, so all sequences but the last are full. An empty table
    gives no piece; other columns are ignored, whatever their names. The tokens of pass 1 stay in the shared folder (about the size of the input) until they are cleared. The crc is that of the ids as little-endian unsigned 32-bit numbers.
    """
    tokens = tokenize(docs, id_col, text_col, vocabulary, end_id)
    offsets = global_offsets(tokens)
    text = PIECE.format(id=docs.schema[id_col].dataType.simpleString()) + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids_out, held = [], [], 0
            for doc_id, part, before, n, stored, wide in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "before", "doc_tokens", "ids", "wide")), strict=True):
                ids = np.frombuffer(stored, "<u4" if wide else "<u2").astype("<u4")
                first, start = offsets[part] + before, 0
                while start < n:
                    sequence, offset = divmod(first + start, window)
                    length = min(window - offset, n - start)
                    piece = ids[start : start + length]
                    rows.append((doc_id, start, length, zlib.crc32(piece.tobytes()), n, sequence, offset))
                    if with_ids:
                        ids_out.append(piece.astype(np.int32))
                    start += length
                    held += length
                if held > 1 << 21:
                    yield _pieces(rows, ids_out, batch.schema.field("doc_id").type, with_ids)
                    rows, ids_out, held = [], [], 0
            yield _pieces(rows, ids_out, batch.schema.field("doc_id").type, with_ids)

    return tokens.select("doc_id", "part", "before", "doc_tokens", "ids", "wide").mapInArrow(released(run), text)


def _pieces(rows: list[tuple], ids: list, id_type: pa.DataType, with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])]
    if with_ids:
        names, arrays = [*names, "ids"], [*arrays, pa.array(ids, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(arrays, names)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, n_tokens, input_ids, document_starts)`` from pieces with ids: at most ``window`` ids meet in a group.

    A sequence is padded to the window, except one whose length is a power of two (a full one is).
    """
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "start", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    starts = F.transform(F.filter("p", lambda x: x["start"] == 0), lambda x: x["offset"])
    packed = whole.select("sequence_id", F.size(ids).cast("long").alias("n_tokens"), ids.alias("ids"), starts.alias("document_starts"))
    power = F.bit_count("n_tokens") == 1
    fill = F.when(power, F.lit(0)).otherwise(F.lit(window) - F.col("n_tokens")).cast("int")
    return packed.select("sequence_id", "n_tokens", F.concat("ids", F.array_repeat(F.lit(pad_id), fill)).alias("input_ids"), "document_starts")
