import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hazeflow.llm import bpe
from hazeflow.llm.queries import op12_bpe

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")

#: Pieces that meet the tokenizer's pattern, its added token and white space of every kind.
PIECES = [
    " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", "　", "᠎", "﻿", "​",
    "'", "'s", "'re", "'LL", "''", "’s", "don't", "x", "qz", "Zq", "the", "été", "à", "ß", "ï", "é", "ü", "日本", "語", "ñ", "İ", "ǆ", "á", "́", "़",
    "1", "12", "½", "²", "٣", ".", ",", "!?", "--", "…", "#", "|", "<", "<|", "|>", "<|endoftext|>", "endoftext", "\x00", "\x7f", "😀", "👩‍🚀", "\U0010ffff", "퟿", "￿",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return bpe.Encoder(vocabulary)


@pytest.fixture(scope="module")
def decoder(vocabulary):
    return bpe.Decoder(vocabulary)


TEXTS = st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PIECES), max_size=25).map("".join))


@settings(max_examples=3000, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_same_ids_as_the_library(library, encoder, decoder, texts):
    ids, counts = encoder.encode([t.encode() for t in texts])
    for t, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        want = library.encode(t, add_special_tokens=False).ids
        assert own.tolist() == want
        assert decoder.decode(own.astype(np.int64)) == library.decode(want, skip_special_tokens=False) == t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_any_ids_decode_as_in_the_library(library, decoder, ids):
    assert decoder.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_ids_outside_the_vocabulary_are_skipped(library, decoder):
    assert decoder.decode(np.array([-1, 262, 60_000, 50257], np.int64)) == library.decode([262], skip_special_tokens=False)


def test_cuts_are_certain(encoder, library):
    """No token of a text covers a cut, and most words are fragments of their own."""
    text = "Qzx the été's end;Wq ñandú <|endoftext|>  été à\xa0b\n\nlast word's"
    raw = text.encode()
    at = bpe.cut_places(np.frombuffer(raw, np.uint8), encoder.cuts).tolist()
    ends = set()
    for a, b in library.encode(text, add_special_tokens=False).offsets:
        ends |= {len(text[:a].encode()), len(text[:b].encode())}
    assert set(at) <= ends and len(at) >= 6
    assert not any(raw.index(b"<|endoftext|>") < x < raw.index(b"|>") + 2 for x in at)


def test_pairs_within_tokens_are_never_cut(vocabulary, encoder):
    tokens = bpe.token_bytes(vocabulary)
    assert len(tokens) == 50257
    for t in list(tokens.values())[::7]:
        assert not any(encoder.cuts[a << 8 | b] for a, b in zip(t, t[1:]))


def test_bounded_cache_and_slices(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_FRAGMENTS", 3)
    small = bpe.Encoder(vocabulary)
    for k in range(6):
        ids, _ = small.encode([f"word{k} and {k} others".encode()])
        assert ids.tolist() == library.encode(f"word{k} and {k} others", add_special_tokens=False).ids
    assert list(bpe._slices([1, bpe.SLICE_BYTES, 0, 5, 2 * bpe.SLICE_BYTES, 1])) == [(0, 1), (1, 3), (3, 4), (4, 5), (5, 6)]
    assert list(bpe._slices([])) == []


def test_documents(spark, make_docs, library, monkeypatch, tmp_path):
    rows = ODD + [(10, "x" * 300_000), (11, "a b " * 150_000), (12, " ".join(PIECES))]
    make_docs(rows, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(
        (repr(d), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        for d, t, *_ in rows
        for ids in [library.encode(t or "", add_special_tokens=False).ids]
    )
    got = [(repr(r.doc_id), *tuple(r)[1:]) for r in op12_bpe(spark, str(tmp_path)).collect()]
    assert sorted(got) == want


def test_empty_table(spark, make_docs):
    tokens = bpe.encode(make_docs([]), PATH)
    assert tokens.count() == 0 and bpe.decode(tokens, PATH).count() == 0


def test_null_ids_list(spark):
    rows = spark.createDataFrame([(1, None), (2, [262, 60_000]), (None, [])], "doc_id long, ids array<int>")
    assert sorted((str(r.doc_id), r.text) for r in bpe.decode(rows, PATH).collect()) == [("1", ""), ("2", " the"), ("None", "")]
