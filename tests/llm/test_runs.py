"""Periodic runs against brute force over all periods and starts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from breathline.llm import periodic_runs as runs_module
from breathline.llm.periodic_runs import WaveletTree, collapsed_words, periodic_runs, planted_source, runs_in
from breathline.llm.queries import op13_periodic_runs

SF = "/root/testdata/sf0.001"


def brute_runs(words):
    """Every maximal stretch of a period, the smallest period of each stretch."""
    n, found = len(words), {}
    for period in range(1, n // 4 + 1):
        same = [words[i] == words[i + period] for i in range(n - period)] + [False]
        i = 0
        while i < len(same):
            if not same[i]:
                i += 1
                continue
            j = i
            while same[j]:
                j += 1
            if j + period - i >= max(6, 4 * period):
                found.setdefault((i, j + period - i), period)
            i = j
    return sorted((s, n, p) for (s, n), p in found.items())


def brute_row(doc_id, text, plant):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def built(rng):
    letters, out = rng.choice([1, 2, 2, 3, 5]), []
    for _ in range(rng.randint(0, 6)):
        block = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
        out += (block * rng.randint(1, 7))[: rng.randint(1, 50)]
        out += [rng.randrange(letters) for _ in range(rng.randint(0, 3))]
    return out


def as_columns(docs):
    return np.array([x for d in docs for x in d], np.int64), np.cumsum([0, *map(len, docs)])


def test_runs_equal_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        docs = [built(rng) for _ in range(rng.randint(1, 4))]
        rows = runs_in(*as_columns(docs)).tolist()
        assert [[tuple(r[1:]) for r in rows if r[0] == i] for i in range(len(docs))] == [brute_runs(d) for d in docs]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=40), min_size=1, max_size=3))
def test_runs_of_two_letters_equal_brute_force(docs):
    rows = runs_in(*as_columns(docs)).tolist()
    assert [[tuple(r[1:]) for r in rows if r[0] == i] for i in range(len(docs))] == [brute_runs(d) for d in docs]


def test_long_runs_of_long_periods():
    rng = random.Random(6)
    base = [rng.randrange(1000) for _ in range(30_000)]
    base[100:20_100] = (base[100:4_100] * 5)[:20_000]
    base[25_000:29_000] = [7] * 4000
    rows = runs_in(np.array(base), np.array([0, len(base)]))
    assert {(s, n, p) for _, s, n, p in rows.tolist()} >= {(100, 20_000, 4000), (25_000, 4000, 1)}
    assert collapsed_words(rows, np.array([0, len(base)])).sum() == 30_000 - 16_000 - 3999


def test_wavelet_tree_gives_neighbours_in_a_range():
    rng = np.random.default_rng(2)
    values = rng.permutation(200).astype(np.int32)
    tree = WaveletTree(values, 200)
    start = rng.integers(0, 190, 300)
    end = np.minimum(200, start + rng.integers(1, 60, 300))
    wanted = values[start]
    before, behind = tree.neighbours(start, end, wanted)
    for a, b, v, low, high in zip(start, end, wanted, before, behind, strict=True):
        inside = values[a:b]
        assert low == max(inside[inside < v], default=-1) and high == min(inside[inside > v], default=-1)


def test_fewer_than_four_periods_are_refused():
    with pytest.raises(ValueError):
        runs_in(np.zeros(5, np.int64), np.array([0, 5]), least_times=3)


def test_slices_do_not_matter(spark, odd_documents, monkeypatch):
    looped = [(i, " ".join(f"w{j % (i + 1)}" for j in range(7 * i)), 1) for i in range(12)] + [(30, "a b " * 40 + "a", 1), (None, "x " * 9, 1)]
    docs = spark.createDataFrame(looped, "doc_id long, text string, period long")
    whole = sorted(map(str, periodic_runs(docs).collect()))
    monkeypatch.setattr(runs_module, "SLICE", 50)
    assert sorted(map(str, periodic_runs(docs.repartition(3)).collect())) == whole
    for row in periodic_runs(docs).collect():
        text = next(t for i, t, _ in looped if i == row.doc_id)
        assert [tuple(r) for r in row.runs] == brute_runs(text.split()) and row.n_words == len(text.split())


@pytest.mark.parametrize("plant", [True, False])
def test_query_on_odd_documents(odd_documents, no_documents, plant):
    rows = periodic_runs(odd_documents.where("length(text) < 10000 OR text IS NULL"), plant=plant, digests=True).collect()
    docs = odd_documents.where("length(text) < 10000 OR text IS NULL").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(str(brute_row(r.doc_id, r.text, plant)) for r in docs)
    assert periodic_runs(odd_documents, plant=plant, digests=True).count() == odd_documents.count()
    assert periodic_runs(no_documents, plant=plant, digests=True).count() == 0


def test_registered_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000").collect()
    wanted = {r.doc_id: brute_row(r.doc_id, r.text, True) for r in docs}
    found = {r.doc_id: tuple(r) for r in op13_periodic_runs(spark, SF).collect()}
    assert len(wanted) > 150 and all(found[i] == row for i, row in wanted.items())
    assert sum(r[1] > 0 for r in wanted.values()) > 5


def test_planting_repeats_the_words_from_its_start():
    source = planted_source([None, 8], np.array([0, 3, 12]))
    assert source[:3].tolist() == [0, 1, 2] and (source[3:] >= 3).all()
