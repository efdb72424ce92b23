import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hazeflow.llm import tokens

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, rows):
    t = Tokenizer.from_file(PATH)
    _, read = tokens.token_files(docs, PATH, 2)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read.collect())
    ids = [t.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows]
    want = sorted((-1 if r[0] is None else r[0], len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(rows, ids))
    assert sorted((-1 if d is None else d, n, c) for _, d, n, c in got) == want
    at, last = 0, -1
    for start, d, n, _ in got:
        assert start == at and (-1 if d is None else d) >= last
        at, last = at + n, -1 if d is None else d


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(make_docs):
    check(make_docs(ODD, extra=True), ODD)
    check(make_docs([]), [])


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17, 32])
def test_packing(width):
    rng = np.random.default_rng(width)
    docs = [(i if i % 5 else None, rng.integers(0, min(1 << width, 1 << 31), rng.integers(0, 400)).astype(np.uint32)) for i in range(40)]
    sink = io.BytesIO()
    sink.close = lambda: None
    writer = tokens.PackedWriter(sink, width, 64)
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    file = tokens.PackedFile(Source(sink.getvalue()))
    assert [(d, list(i)) for d, _, i in file.documents(500)] == [(d, list(i)) for d, i in docs]
    flat = np.concatenate([i for _, i in docs])
    for a, b in ((0, 0), (0, 1), (63, 65), (64, 128), (100, 3000), (len(flat) - 1, len(flat))):
        assert list(file.ids(a, b)) == list(flat[a:b])


def test_vocabulary_bits():
    assert [tokens.bits_for(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


#: Letters that the tokenizer's normal form or lower case turns into a letter and a mark, marks, and punctuation.
PIECES = ["\u0130", "\u095c", "\u09dc", "\ufb2a", "i\u0307", "\u0301", "e", "\u00e9", "\u017f", "\u1e9e", "\u4e00", "ab", "X", "1", ";", ",", ".", "!?", "'s", "<|endoftext|>", " ", "\u00a0", "\n"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_same_ids_as_direct_encoding(text):
    encoder = tokens.encoder_of(PATH, 2)
    assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [2]
