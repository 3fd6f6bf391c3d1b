"""Merge rounds and the SentencePiece operator, against the library and against merging one pair after the other."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import running_text

from breathline.llm.merge_rounds import PairTable, merge_rounds
from breathline.llm.sentence_piece import PieceModel, decode_pieces, encode_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return PieceModel(MODEL)


def same_as_library(model, texts):
    ids, borders = model.encode_column(pa.array(texts, pa.string()))
    raw, ends = model.decode_column(ids, borders)
    for i, text in enumerate(texts):
        wanted = model.library.encode(text or "")
        assert ids[borders[i] : borders[i + 1]].tolist() == wanted
        assert raw[ends[i] : ends[i + 1]].decode() == model.library.decode(wanted)


def test_texts_equal_the_library(model):
    rng = random.Random(1)
    same_as_library(model, [None, "", " ", "  ", "▁", " ▁ a", "x", "naïve café 東京 😀", "a" * 3000, "\n\n\t", "<s> </s> <unk> <0x0A>", "\x00\x01"])
    same_as_library(model, [" " * n + "the" + " " * n for n in range(70)])
    alphabet = "ab é'st   \n\tÉ0123中文字ß😀.,!?|lLrR▁ ionthe-_=*"
    same_as_library(model, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(5000)])
    same_as_library(model, [running_text(n, n) for n in range(60)])


def test_very_long_words_and_runs(model):
    rng = random.Random(2)
    same_as_library(model, ["".join(rng.choice("tionaherst") for _ in range(20_000)), "ab" * 30_000, "-" * 9999, "the" * 3000 + " " * 777, "東京" * 5000])


def test_texts_are_not_cut_where_runs_of_signs_do_not_allow_it(model):
    """The way for models whose pieces hold a space sign inside: whole texts in the same rounds."""
    other = PieceModel(MODEL)
    other.cuts = False
    same_as_library(other, ["", None, "a  b the   end", "x" * 400 + " y", " " * 40])


def test_decoding_any_ids_equals_the_library(model):
    rng = random.Random(3)
    rows = [[rng.choice([rng.randint(0, 258), rng.randint(0, 31_999), 28_705, 3 + 0xE4, 3 + 0xB8, 3 + 0xAD]) for _ in range(rng.randint(0, 12))] for _ in range(500)]
    raw, ends = model.decode_column(np.concatenate([np.array(r, np.int64) for r in rows]), np.cumsum([0, *map(len, rows)]))
    assert [raw[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [model.library.decode(r) for r in rows]


def one_by_one(word, rules):
    word = list(word)
    while True:
        found = [(rules[p][0], i) for i, p in enumerate(zip(word, word[1:], strict=False)) if p in rules]
        if not found:
            return word
        _, i = min(found)
        word[i : i + 2] = [rules[word[i], word[i + 1]][1]]


@settings(max_examples=200, deadline=None)
@given(
    st.dictionaries(st.tuples(st.integers(0, 6), st.integers(0, 6)), st.tuples(st.integers(0, 4), st.integers(0, 6)), max_size=14),
    st.lists(st.lists(st.integers(0, 3), max_size=12), max_size=6),
)
def test_rounds_equal_single_merges(rules, words):
    """Any rules: ties of ranks, merges that make pairs of a lower rank, symbols that come back."""
    table = PairTable(*np.array([(a, b, r, m) for (a, b), (r, m) in rules.items()], np.int64).reshape(-1, 4).T)
    symbols, borders = np.array([s for w in words for s in w], np.int32), np.cumsum([0, *map(len, words)])
    found, at = merge_rounds(symbols, borders, table)
    assert [found[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [one_by_one(w, rules) for w in words]


def test_query_on_odd_documents(spark, odd_documents, no_documents, model):
    docs = {(r.doc_id, r.text) for r in odd_documents.collect()}
    encoded = encode_pieces(odd_documents.repartition(3), MODEL)
    rows = encoded.collect()
    assert len(rows) == odd_documents.count() and all(r.n_tokens == len(r.ids) for r in rows)
    assert sorted({(str(r.doc_id), tuple(r.ids)) for r in rows}) == sorted((str(i), tuple(model.library.encode(t or ""))) for i, t in docs)
    back = decode_pieces(encoded, MODEL).collect()
    assert sorted({(str(r.doc_id), r.text) for r in back}) == sorted((str(i), t or "") for i, t in docs)
    for row in encode_pieces(odd_documents, MODEL, digests=True).collect():
        assert any(
            row.ids_sha256 == hashlib.sha256(",".join(map(str, model.library.encode(t or ""))).encode()).hexdigest()
            and row.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
            for i, t in docs if i == row.doc_id
        )
    assert encode_pieces(no_documents, MODEL).count() == 0
    nothing = decode_pieces(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), MODEL)
    assert [tuple(r) for r in nothing.collect()] == [(1, "")]
