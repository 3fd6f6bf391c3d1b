"""Packing and byte-level BPE."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from hypothesis import given, settings
from hypothesis import strategies as st

from breathline.llm.byte_bpe import ByteBpe, decode_ids, encode_texts
from breathline.llm.packing import WordTokenizer, difference, pack_documents, windows_for

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(bpe):
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def column_ids(coder, texts):
    ids, borders = coder.encode_column(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(borders[:-1], borders[1:], strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é'st  \n\tÉ0123中ß😀.,!?|lLrR", max_size=60), min_size=1, max_size=5))
def test_bpe_equals_the_library(texts):
    bpe = ByteBpe.__new__(ByteBpe)
    bpe.__dict__ = _CODER.__dict__
    assert column_ids(bpe, texts) == [_LIBRARY.encode_ordinary(t) for t in texts]


_CODER = ByteBpe(RANKS, public_tokenizers.PATTERN)
_LIBRARY = tiktoken.Encoding("l", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_CODER.ranks, special_tokens={})


def test_very_long_pre_tokens(bpe, reference):
    rng = random.Random(3)
    texts = ["a" * 20_000, "".join(rng.choice("abcde") for _ in range(20_000)), "-" * 999]
    assert column_ids(bpe, texts) == [reference.encode_ordinary(t) for t in texts]
    assert bpe.merges.merge_many([]) == [] and bpe.merges.merge_many([b"", b"ab"])[0] == b""


def test_bpe_query_on_odd_documents(spark, odd_documents, no_documents, reference):
    rows = encode_texts(odd_documents, RANKS, public_tokenizers.PATTERN).collect()
    texts = {(r.doc_id, r.text) for r in odd_documents.collect()}
    assert len(rows) == odd_documents.count()
    expected = sorted((str(i), np.asarray(reference.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in texts)
    assert sorted({(str(r.doc_id), bytes(r.ids)) for r in rows}) == expected
    assert all(r.n_tokens * 4 == len(r.ids) for r in rows)
    back = decode_ids(encode_texts(odd_documents, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in back) == sorted((str(r.doc_id), (r.text or "").encode()) for r in odd_documents.collect())
    digests = encode_texts(odd_documents.where("doc_id = 4"), RANKS, public_tokenizers.PATTERN, digests=True).first()
    assert digests.decoded_sha256 == hashlib.sha256("naïve café 東京 😀".encode()).hexdigest()
    assert encode_texts(no_documents, RANKS, public_tokenizers.PATTERN).count() == 0


def test_word_tokenizer_equals_the_library():
    coder = WordTokenizer(WORD_FILE)
    rng = random.Random(5)
    alphabet = "ab É'st  \n\t\r09中ßΣİ<|endoftext|>.,!?-\x85\xa0\x1c²­"
    texts = ["", "l'été 'LL"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    assert column_ids(coder, texts) == [e.ids for e in coder.whole.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=120), st.integers(1, 9))
def test_differencing_is_near_equal(sizes, ways):
    sizes = np.asarray(sizes)
    sums = np.bincount(difference(sizes, ways), weights=sizes, minlength=ways)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= sizes.max()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_windows_hold_their_capacity(sizes):
    window, count = windows_for(np.asarray(sizes), 64)
    filled = np.bincount(window, weights=sizes, minlength=count)
    assert filled.max() <= 64 and len(filled) == count


def test_packing_places_each_token_once(spark, odd_documents, no_documents):
    rows = pack_documents(odd_documents.repartition(3), WORD_FILE, window=256, group=4).collect()
    coder = WordTokenizer(WORD_FILE)
    pieces = {}
    for r in rows:
        assert r.length * 4 == len(r.ids) and 0 < r.length <= 256
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for doc in odd_documents.collect():
        ids = coder.whole.encode(doc.text or "", add_special_tokens=False).ids + [1]
        found = sorted(pieces[doc.doc_id, len(ids)])
        copies = 2 if doc.doc_id == 8 else 1
        assert sum(len(p) for _, p in found) == copies * len(ids)
        if copies == 1:
            assert [i for _, p in found for i in p] == ids
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert pack_documents(no_documents, WORD_FILE).count() == 0
