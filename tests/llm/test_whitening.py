"""Whitening against a dense eigenvalue decomposition of the distinct rows."""

import math

import numpy as np
import pytest

from breathline.llm.queries import op12_whitening
from breathline.llm.shared import Workspace
from breathline.llm.whitening import whiten_embeddings

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, x int, v string, component double"


def table(spark, vectors):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, "k", 0.5) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def dense(x, most=16):
    """Rows, their count, exact sums, eigenvalues and vectors of the covariance, total variance; all by plain numpy."""
    unique = np.unique(x, axis=0)
    n, sums = len(unique), unique.sum(axis=0)
    centred = unique - sums / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    return n, sums, values[order], vectors[:, order], np.trace(covariance)


def agree(found, ids, x, most=16):
    n, sums, values, vectors, total = dense(x, most)
    rows = sorted(found, key=lambda r: (r.vec_id, r.component))
    size = len({r.component for r in rows})
    assert size == (values > 1e-12 * max(values.max(), 1e-300)).sum() and len(rows) == size * len(ids)
    got = np.array([r.whitened for r in rows]).reshape(-1, size)
    order = np.argsort(ids, kind="stable")
    wanted = ((x - sums / n) @ vectors[:, :size] / np.sqrt(values[:size]))[order]
    gaps = np.diff(np.concatenate([[np.inf], values, [-np.inf]]))
    alone = np.minimum(-gaps[:-1], -gaps[1:])[:size] > 1e-6 * values[0]  # equal eigenvalues leave the vectors free
    sign = np.sign((got * wanted).sum(axis=0))
    assert np.abs(got - wanted * sign)[:, alone].max(initial=0) < 1e-8
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x[order]]
    assert [r.deviation for r in rows[::size]] == exact and {r.n for r in rows} == {n}
    assert np.allclose([r.explained for r in rows[:size]], values[:size] / total, rtol=1e-9)
    assert all(0 <= r.identity_error < 1e-9 for r in rows)
    return got


def test_registered_query_equals_dense_decomposition(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in r.embedding] for r in data])
    got = agree(op12_whitening(spark, SF).collect(), [r.vec_id for r in data], x)
    assert got.shape[1] == 16


@pytest.mark.parametrize("kind", ["few", "copies", "low_rank", "equal_values", "one_dimension", "far"])
def test_shapes(spark, kind):
    rng = np.random.default_rng(3)
    v = {
        "few": rng.normal(size=(3, 8)),
        "copies": np.repeat(rng.normal(size=(40, 6)), rng.integers(1, 60, 40), axis=0),
        "low_rank": rng.integers(-9, 9, (200, 3)) @ rng.integers(-4, 4, (3, 10)),
        "equal_values": np.vstack([np.eye(7), -np.eye(7)]) * 3,
        "one_dimension": rng.normal(size=(50, 1)) * 5,
        "far": rng.normal(size=(60, 5)) * [1e4, 1, 1e-1, 10, 3] + 1e5,
    }[kind]
    found = whiten_embeddings(table(spark, enumerate(v.tolist())).repartition(3), Workspace(spark, "t")).collect()
    agree(found, list(range(len(v))), np.floor(64 * v).astype(np.int64) + 1_000_000)


def test_rows_that_cannot_be_used_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1, 2]), (1, [3, 5]), (1, [3, 5]), (None, [-2, 0]), (2, [1, 2])]
    odd = [(3, None), (4, []), (5, [nan, 1]), (6, [1, inf]), (7, [None, 1]), (8, [1, 2, 3]), (9, [1e300, 0])]
    found = whiten_embeddings(table(spark, good + odd), Workspace(spark, "t")).collect()
    x = np.array([[64 * c + 1_000_000 for c in v] for _, v in good])
    assert sorted(str(r.vec_id) for r in found if r.component == 1) == ["0", "1", "1", "2", "None"]
    assert {r.n for r in found} == {3} and len({(r.component, r.whitened) for r in found if r.vec_id in (0, 2)}) == 2
    sums = x[[0, 1, 3]].sum(axis=0)
    assert {r.deviation for r in found if r.vec_id is None} == {int(((3 * x[3] - sums) ** 2).sum())}


def test_without_variance_there_are_no_rows(spark):
    columns = {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    for vectors in ([], [(1, None)], [(1, [2, 3])], [(1, [2, 3]), (2, [2, 3]), (3, [2, 3])]):
        found = whiten_embeddings(table(spark, vectors), Workspace(spark, "t"))
        assert set(found.columns) == columns and found.count() == 0


def test_deviations_beyond_64_bits_are_null(spark):
    found = whiten_embeddings(table(spark, [(1, [1e12, 0]), (2, [-1e12, 1]), (3, [0, 5])]), Workspace(spark, "t")).collect()
    assert {r.vec_id: r.deviation for r in found}[1] is None and {r.vec_id: r.deviation for r in found}[3] is not None
