import struct
import zlib

import numpy as np
import pytest

from tests.llm.data import SF, edge_docs, empty_docs
from voxelyard.llm import packing


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path())


def check(docs, plain):
    texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    pieces = packing.pack(docs).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    seen = 0
    for doc_id, text in dict(texts).items():
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        copies = sum(d == doc_id for d, _ in texts)
        mine = sorted(by_doc[doc_id], key=lambda p: (p.start, p.sequence_id))
        assert sum(p.length for p in mine) == len(ids) * copies
        for p in mine:
            part = ids[p.start : p.start + p.length]
            assert p.doc_tokens == len(ids) and len(part) == p.length > 0
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        seen += len(ids) * copies
    place = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    at = 0
    for s, o, n in place:
        assert s * packing.WINDOW + o == at and o + n <= packing.WINDOW
        at += n
    assert at == seen


def test_driver_rows(spark, plain):
    check(spark.read.parquet(f"{SF}/documents.parquet").repartition(5), plain)


def test_edges(spark, plain):
    check(edge_docs(spark), plain)
    assert packing.pack(empty_docs(spark)).count() == 0


def test_parts_are_encoded_as_the_whole(plain):
    mine = packing.DocumentTokenizer(packing.vocabulary_path())
    for text in [" a  b   c\n\n d", "it's  we'll 've", "é 　 x\x1c y", "a<|endoftext|>b <|endoftext|> c", "12 34.5\n- x\r\n\ty ", "  z ᠎ w", "\n", " "]:
        got = mine.encode(text)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == plain.encode(text, add_special_tokens=False).ids, text


def test_sequences(spark):
    docs = spark.createDataFrame([(i, "word " * (40 * i)) for i in range(1, 20)], "doc_id long, text string")
    pieces = packing.pack(docs, with_ids=True)
    rows = packing.sequences(pieces).orderBy("sequence_id").collect()
    assert all(r.n_tokens == 2048 for r in rows[:-1])
    assert all(len(r.input_ids) == 2048 for r in rows[:-1])
    assert sum(len(r.document_starts) for r in rows) == 19
    last = rows[-1].n_tokens
    assert len(rows[-1].input_ids) == (last if last & (last - 1) == 0 else 2048)


def test_quick_engine_gives_the_same_ids(plain):
    tokenizer = packing.DocumentTokenizer(packing.vocabulary_path())
    assert tokenizer.quick is not None
    every = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}\n{c}'{c}s " for c in every[k : k + 400]) for k in range(0, len(every), 400)]
    texts += ["x" * 100_000, " " * 100_000 + "a", "\n \n  a", "a <|endoftext|> b", "it's I'LL 'Re", "\u0000﻿", "é́" * 5000, " "]
    for text in texts:
        assert tokenizer.encode(text) == struct.pack(f"<{len(ids := plain.encode(text, add_special_tokens=False).ids)}I", *ids)


def test_both_engines_at_their_border():
    """Texts that go to the file's own engine, and those just before, have its ids."""
    import tokenizers

    from voxelyard.llm import packing

    own = tokenizers.Tokenizer.from_file(packing.vocabulary_path())
    quick = packing.document_tokenizer(packing.vocabulary_path())
    for text in ["a" + " " * n + "b" for n in (1, 2, 254, 255, 256, 257, 1000)] + ["\n" * 255, "\t " * 300, "x <|endoftext|> y", "<|endoftext|>", "<|endoftext |>", "\u2003" * 255 + "z"]:
        assert quick.encode(text) == np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
