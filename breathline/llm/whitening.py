"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the distinct, centred rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathline.llm.shared import Workspace

#: a singular value or coupling under this share of the largest one counts as zero
NOTHING = 1e-12
#: entries of this size and more do not fit a long after scaling
WIDEST = 2.0**62


@dataclass(frozen=True)
class Whitening:
    """Fitted on ``count`` distinct rows: their sums, unit components by falling variance, and checks."""

    count: int
    sums: tuple[int, ...]
    components: np.ndarray  # a row each
    variances: np.ndarray
    total_variance: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.count for s in self.sums])

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)^2, exact; null beyond 64 bits."""
        gap = max((abs(int(rows.min()) * self.count - s), abs(int(rows.max()) * self.count - s)) for s in self.sums) if rows.size else (0, 0)
        if max(gap) ** 2 * rows.shape[1] < 2**63:
            return (((rows * self.count - np.array(self.sums, np.int64)) ** 2).sum(axis=1)).tolist()
        found = [sum((x * self.count - s) ** 2 for x, s in zip(row, self.sums, strict=True)) for row in rows.tolist()]
        return [x if x < 2**63 else None for x in found]


def scaled_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """(id, x): vectors as longs floor(scale * c) + offset; rows with a null vector or a null or non-finite entry are left out.

    So are vectors without entries, vectors of another length than most, and
    entries whose scaled value does not fit a long.
    """
    doubles = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    kept = vectors.select(F.col(f"`{id_col}`").alias("id"), doubles.alias("v")).where(
        F.col("v").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda c: F.coalesce(F.abs(c * scale) < WIDEST, F.lit(False)) & ~F.isnan(F.coalesce(c, F.lit(0.0))))
    )
    lengths = kept.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    width = lengths[0]["size"] if lengths else 0
    x = F.transform("v", lambda c: F.floor(c * scale) + F.lit(offset).cast("long"))
    return kept.where(F.size("v") == width).select("id", x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy().reshape(len(column), len(flat) // max(1, len(column)))


def _sums_over(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what ``part`` sums over a batch: one row of doubles per task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = part(_matrix(batch.column(0)))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    return np.array([r.sums for r in fit.mapInArrow(run, "sums array<double>").collect()]).sum(axis=0)


def _exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and sums per dimension as whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(0))
            wide = int(np.abs(rows).max()) * len(rows) >= 2**62
            found = [sum(c) for c in rows.T.tolist()] if wide else rows.sum(axis=0).tolist()
            total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
            count += len(rows)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([[str(t) for t in total]])], names=["n", "sums"])

    found = fit.mapInArrow(run, "n long, sums array<string>").collect()
    return sum(r.n for r in found), [sum(map(int, c)) for c in zip(*(r.sums for r in found), strict=True)]


class _Bidiagonal:
    """A V = U B for the centred rows A, built a column at a time.

    The left vectors are long (an entry per row) and never stored: u_i = A y_i,
    and y_i is a short vector that the driver holds. A step is one pass over
    the rows. For the next direction d each task forms A d and all A y_i of
    its rows, and returns their inner products, |A d|^2 and A' (A d); so the
    products with A and its transpose alternate within the pass, and the full
    reorthogonalisation of u against all u_i (as of v against all v_i) is done
    on the short vectors.
    """

    def __init__(self, fit: DataFrame, mean: np.ndarray, seed: int = 1):
        self.fit, self.mean = fit, mean
        self.width = len(mean)
        self.random = np.random.default_rng(seed)
        self.right: list[np.ndarray] = []
        self.short: list[np.ndarray] = []  # y_i, zero where u_i is missing
        self.back: list[np.ndarray] = []  # A' u_i
        self.alpha: list[float] = []
        self.beta: list[float] = []

    def build(self) -> tuple[np.ndarray, np.ndarray]:
        """All right singular vectors (columns) and singular values, falling."""
        v = self._fresh()
        while len(self.right) < self.width:
            self.right.append(v)
            self._left(v)
            w = self._away(self.back[-1] - self.alpha[-1] * v)
            size = float(np.linalg.norm(w))
            if size > NOTHING * max(self.alpha):
                self.beta.append(size)
                v = w / size
            else:  # nothing is left that these directions reach: go on from another one
                self.beta.append(0.0)
                v = self._fresh()
        upper = np.diag(self.alpha) + np.diag(self.beta[:-1], 1)
        _, values, turned = np.linalg.svd(upper)
        return np.array(self.right).T @ turned.T, values

    def _fresh(self) -> np.ndarray:
        """A random unit vector beside all right vectors (zero if they span everything)."""
        if len(self.right) == self.width:
            return np.zeros(self.width)
        v = self._away(self.random.standard_normal(self.width))
        return v / np.linalg.norm(v)

    def _away(self, v: np.ndarray) -> np.ndarray:
        for _ in range(2 * bool(self.right)):
            v = v - np.array(self.right).T @ (np.array(self.right) @ v)
        return v

    def _left(self, v: np.ndarray) -> None:
        """The next left vector, from A v without its share of the vector before."""
        step = v - (self.beta[-1] * self.short[-1] if self.beta else 0)
        ahead = np.column_stack([*self.short, step])
        mean = self.mean

        def part(rows: np.ndarray) -> np.ndarray:
            centred = rows - mean
            made = centred @ ahead
            return np.concatenate([made.T @ made[:, -1], centred.T @ made[:, -1]])

        found = _sums_over(self.fit, part)
        inner, square, back = found[: ahead.shape[1] - 1], found[ahead.shape[1] - 1], found[ahead.shape[1] :]
        for c, y, t in zip(inner, self.short, self.back, strict=True):
            step, back = step - c * y, back - c * t
        length = math.sqrt(max(0.0, float(square - inner @ inner)))
        if length > NOTHING * max(self.alpha, default=0.0):
            self.short.append(step / length)
            self.back.append(back / length)
        else:
            length = 0.0
            self.short.append(np.zeros(self.width))
            self.back.append(np.zeros(self.width))
        self.alpha.append(length)


def fit_whitening(rows: DataFrame, work: Workspace, components: int = 16) -> Whitening | None:
    """The whitening of the distinct ``x`` of ``rows`` (id, x); None without rows.

    Equal rows are combined before the shuffle, so one vector may hold any
    share of the table. The distinct rows are written to the shared folder;
    the sums are exact; all passes centre a row before they multiply. One
    pass per dimension: only short vectors reach the driver.
    """
    fit = work.write(rows.select("x").distinct())
    count, sums = _exact_sums(fit)
    if not count:
        return None
    mean = np.array([s / count for s in sums])
    total = float(_sums_over(fit, lambda rows: np.array([((rows - mean) ** 2).sum()]))[0]) / count
    vectors, values = _Bidiagonal(fit, mean).build() if total > 0 else (np.zeros((len(sums), 0)), np.zeros(0))
    kept = np.flatnonzero(values > NOTHING * values.max(initial=0))[:components]
    found = vectors[:, kept].T
    if len(found):  # one sign for all runs: the largest entry is positive
        found = found * np.sign(found[np.arange(len(found)), np.abs(found).argmax(axis=1)])[:, None]
    variances = values[kept] ** 2 / count
    error = _identity_error(fit, mean, found, variances, count)
    work.drop(fit)
    return Whitening(count, tuple(sums), found, variances, total, error)


def _identity_error(fit: DataFrame, mean: np.ndarray, found: np.ndarray, variances: np.ndarray, count: int) -> float:
    size = len(found)
    if not size:
        return 0.0
    turn = found.T / np.sqrt(variances)
    middle = _sums_over(fit, lambda rows: ((rows - mean) @ turn).sum(axis=0)) / count

    def part(rows: np.ndarray) -> np.ndarray:
        made = (rows - mean) @ turn - middle
        return (made.T @ made).ravel()

    covariance = _sums_over(fit, part).reshape(size, size) / count
    return float(np.abs(covariance - np.eye(size)).max())


def whiten_embeddings(
    vectors: DataFrame, work: Workspace, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per kept vector and component.

    Vectors become longs x = floor(scale * c) + offset. The fit takes each
    distinct x once (n of them, sums S per dimension); ``deviation`` is the
    sum of (n x - S)^2, exact (null beyond 64 bits); ``whitened`` the centred
    x along a unit eigenvector of the covariance over the root of its
    eigenvalue; ``explained`` the eigenvalue's share of all variance;
    ``identity_error`` the largest entry of the whitened covariance minus the
    identity. Components are numbered from 1 by falling eigenvalue, at most
    ``components``; those without variance cannot be whitened and are left
    out, so a table of one distinct vector, or an empty one, gives no rows.

    Left out are vectors that are null, hold null or non-finite entries, have
    no entries or another length than most. Repeated rows give equal rows, in
    any number, and count once in the fit; null ids stay null; other columns
    are not read.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = scaled_rows(vectors, id_col, vector_col, scale, offset)
    model = fit_whitening(rows, work, components)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    fields = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.components):
        return rows.limit(0).select(
            F.col("id").alias(id_col), F.lit(0).alias("component"), *[F.lit(0).cast("long").alias(c) for c in names[2:4]],
            *[F.lit(0.0).alias(c) for c in names[4:]],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, turn = model.mean, model.components.T / np.sqrt(model.variances)
        size = len(model.components)
        explained = model.variances / model.total_variance
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            owner = pa.array(np.repeat(np.arange(len(x)), size))
            long_rows = len(x) * size
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(owner), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))), pa.array(np.full(long_rows, model.count)),
                    pc.take(pa.array(model.deviations(x), pa.int64()), owner), pa.array(((x - mean) @ turn).ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(long_rows, model.identity_error)),
                ],
                names=names,
            )

    return rows.mapInArrow(run, fields)
