"""Exact k-nearest-neighbour voting without comparing every pair of rows.

Training rows are grouped by their nearest pivot. From the distances to the
pivots and the cells' radii, each query row derives a distance within which it
surely finds k neighbours, and visits only rings that can hold anything nearer
(triangle inequality). A ring is the part of a cell between two distances from
its pivot, so a large cell is not visited whole. A ring's rows are cut into
chunks, so tasks stay small however large it is; each task returns at most k
rows per query.

Without structure nearly every ring is visited, and copying each query to each
of them costs more than it spares. A sample of queries tells beforehand: then
blocks of queries meet chunks of all points. That is quadratic work in matrix
products, with copies that grow as blocks times chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from breathline.session import cut_lineage

CHUNK_ROWS = 20_000
PIVOTS, MOST_PIVOTS = 16, 256
RING_ROWS, MOST_RINGS = 2_000, 16
#: share of all rows that a query visits on average, from which on blocks of queries meet all rows
DENSE_SHARE = 0.25
#: queries that the share is estimated on; rows of a block of queries and of a chunk of points of the dense search
ASKED_FIRST, BLOCK_QUERIES, BLOCK_POINTS = 1_000, 20_000, 100_000


def _distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances in slices that bound the memory."""
    out = np.empty((len(queries), len(points)))
    step = max(1, 2_000_000 // max(1, points.size))
    for i in range(0, len(queries), step):
        gap = queries[i : i + step, None, :] - points[None, :, :]
        out[i : i + step] = np.sqrt((gap * gap).sum(axis=2))
    return out


def _nearest_pivot(pivots: np.ndarray):
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = _distances(np.stack(batch["vector"].to_numpy()).astype(float), pivots)
                batch = batch.assign(cell=d.argmin(axis=1).astype("int32"), reach=d.min(axis=1))
            else:
                batch = batch.assign(cell=pd.Series(dtype="int32"), reach=pd.Series(dtype="float64"))
            yield batch

    return assign


def _rings_to_visit(pivots: np.ndarray, rings: pd.DataFrame, k: int):
    """Per query the rings that may hold one of its k nearest rows of other folds.

    ``rings`` has one row per (ring, fold): its cell, rows ``n`` and the least and
    largest distance from the pivot.
    """
    spans = rings.groupby("ring").agg(cell=("cell", "first"), low=("low", "min"), high=("high", "max"), n=("n", "sum"))
    names, centre = spans.index.to_numpy(), spans["cell"].to_numpy()
    low, high, total = (spans[c].to_numpy() for c in ("low", "high", "n"))
    by_fold = {fold: part.set_index("ring")["n"].reindex(names, fill_value=0).to_numpy() for fold, part in rings.groupby("fold")}

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                yield batch.assign(rings=pd.Series(dtype=object))
                continue
            to_pivots = _distances(np.stack(batch["vector"].to_numpy()).astype(float), pivots)
            out = []
            for row, fold in zip(to_pivots, batch["fold"].to_numpy(), strict=True):
                usable = total - by_fold.get(fold, 0)
                away = row[centre]
                far = away + high
                by_far = np.argsort(far, kind="stable")
                enough = np.searchsorted(usable[by_far].cumsum(), k)
                limit = far[by_far[enough]] if enough < len(names) else np.inf
                # a hair of slack keeps rows whose distance equals the limit
                nearest = np.maximum(away - high, low - away)
                near = (nearest <= limit * (1 + 1e-9) + 1e-9) & (usable > 0)
                out.append(names[near].tolist())
            yield batch.assign(rings=out)

    return visit


def _nearest(queries: np.ndarray, points: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query (number, places of its k nearest points, their distances), ties by place; rows with a distance that is not finite are left out.

    A matrix product gives distances up to rounding. All points within the k-th
    of them plus a bound of that rounding are candidates; these are compared by
    the differences themselves.
    """
    square = (points * points).sum(axis=1)
    most = square[np.isfinite(square)].max(initial=0.0)
    flipped = np.ascontiguousarray(points.T) * -2.0
    thin = max(1, min(8, len(points) // (8 * k)))
    step = max(1, 1_000_000 // max(1, len(points)))
    for start in range(0, len(queries), step):
        some = queries[start : start + step]
        near = some @ flipped
        near += square
        part = near[:, ::thin]
        # a k-th nearest of some points is no nearer than that of all
        limits = np.partition(part, k - 1, axis=1)[:, k - 1] if part.shape[1] > k else np.full(len(some), np.inf)
        for i, (row, limit) in enumerate(zip(near, limits, strict=True)):
            slack = 1e-11 * (most + float(some[i] @ some[i]))
            kept = np.flatnonzero(~(row > limit + slack))
            if len(kept) > k:
                kth = np.partition(row[kept], k - 1)[k - 1]
                kept = kept[~(row[kept] > kth + slack)]
            gap = some[i] - points[kept]
            found = np.sqrt((gap * gap).sum(axis=1))
            best = np.argsort(found, kind="stable")[:k]
            best = best[np.isfinite(found[best])]
            yield start + i, kept[best], found[best]


def _chunk_neighbours(k: int):
    def search(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "neighbour_id", "neighbour_label", "distance"]
        empty = pd.DataFrame({c: [] for c in columns}).astype(
            {"query_id": "int64", "neighbour_id": "int64", "neighbour_label": "int32", "distance": "float64"}
        )
        if queries.empty or points.empty:
            return empty
        points = points.sort_values("id", kind="stable")
        vectors = np.stack(points["vector"].to_numpy()).astype(float)
        ids, labels, folds = (points[c].to_numpy() for c in ("id", "label", "fold"))
        parts = [empty]
        for fold, own in queries.groupby("fold"):
            other = np.flatnonzero(folds != fold)
            if not len(other):
                continue
            asked = own["id"].to_numpy()
            found = list(_nearest(np.stack(own["vector"].to_numpy()).astype(float), vectors[other], k))
            places = other[np.concatenate([p for _, p, _ in found])]
            who = np.repeat(asked[[i for i, _, _ in found]], [len(p) for _, p, _ in found])
            parts.append(
                pd.DataFrame(
                    {
                        "query_id": who, "neighbour_id": ids[places], "neighbour_label": labels[places],
                        "distance": np.concatenate([d for _, _, d in found]),
                    }
                )
            )
        return pd.concat(parts)[columns]

    return search


def _plan_blocks(rows: DataFrame, written: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Queries and points under the keys ``KEYS``: every block of queries meets every chunk of points.

    The points are read from the ``written`` copy of the rows, so that the two
    sides of the search share no column.
    """
    chunks = max(1, -(-total // BLOCK_POINTS))
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-total // BLOCK_QUERIES), min(-(-tasks // chunks), -(-total // 100)), 1)

    def dealt(numbers: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(numbers)).cast("int")

    def each(numbers: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(numbers - 1)))

    points = written.select("id", "vector", "label", "fold", F.lit(0).alias("ring"), dealt(chunks, 0).alias("chunk"), each(blocks).alias("block"))
    queries = rows.select("id", "vector", "fold", F.lit(0).alias("ring"), each(chunks).alias("chunk"), dealt(blocks, 1).alias("block"))
    return queries, points


def _plan_search(rows: DataFrame, k: int, chunk_rows: int, ring_rows: int) -> tuple[DataFrame, DataFrame]:
    """Queries and points under the keys ``KEYS``: each query once per chunk that may hold a near row."""
    # about sqrt(rows) pivots, within fixed bounds: the rows with the smallest hash
    total = rows.count()
    wanted = min(MOST_PIVOTS, max(PIVOTS, math.isqrt(total)))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vector").toPandas()
    pivots = np.stack(picked["vector"].to_numpy()).astype(float)
    celled = cut_lineage(
        rows.mapInPandas(_nearest_pivot(pivots), "id bigint, vector array<double>, label int, fold int, cell int, reach double")
    )
    marks = [i / MOST_RINGS for i in range(1, MOST_RINGS)]
    # at most MOST_PIVOTS rows
    shapes = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("reach", marks, 1000).alias("marks")).collect()

    def borders(n: int, at: Sequence[float]) -> list[float]:
        rings = min(MOST_RINGS, max(1, n // ring_rows))
        return [at[MOST_RINGS * i // rings - 1] for i in range(1, rings)]

    cut = {r.cell: borders(r.n, r.marks) for r in shapes}
    several = [F.lit(x) if j else F.lit(c) for c, at in cut.items() if at for j, x in enumerate((c, at))]
    ring = F.coalesce(F.size(F.filter(F.try_element_at(F.create_map(*several), F.col("cell")), lambda x: x < F.col("reach"))), F.lit(0)) if several else F.lit(0)
    celled = celled.withColumn("ring", F.col("cell") * MOST_RINGS + F.when(F.col("cell").isin([c for c, at in cut.items() if at]), ring).otherwise(0))
    # at most MOST_PIVOTS x MOST_RINGS x folds rows
    rings = celled.groupBy("ring", "fold").agg(
        F.first("cell").alias("cell"), F.count(F.lit(1)).alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high")
    ).toPandas()
    sizes = rings.groupby("ring")["n"].sum().to_dict()
    visits = "id bigint, vector array<double>, fold int, rings array<int>"
    visit = _rings_to_visit(pivots, rings, k)
    first = rows.select("id", "vector", "fold").orderBy(F.xxhash64("id"), "id").limit(ASKED_FIRST).mapInPandas(visit, visits)
    seen = [sum(sizes[x] for x in r.rings) for r in first.select("rings").collect()]
    if sum(seen) >= DENSE_SHARE * total * len(seen):
        return _plan_blocks(rows, celled, total)
    queries = rows.select("id", "vector", "fold").mapInPandas(visit, visits)
    queries = cut_lineage(queries.select("id", "vector", "fold", F.explode("rings").alias("ring")))
    asked = {r.ring: r["count"] for r in queries.groupBy("ring").count().collect()}  # at most one row per ring

    def per_ring(numbers: dict[int, int]) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(int(x)) for c, n in numbers.items() for x in (c, n)]), F.col("ring"))

    # a ring's points are copied once per block of the queries that visit it, and not at all if none does
    chunk_count = per_ring({c: -(-n // chunk_rows) for c, n in sizes.items()})
    block_count = per_ring({c: -(-n // chunk_rows) for c, n in asked.items()})
    points = celled.filter(block_count.isNotNull()).select(
        "id", "vector", "label", "fold", "ring",
        F.pmod(F.xxhash64("id"), chunk_count).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), block_count - 1)).alias("block"),
    )
    queries = queries.select(
        "*",
        F.explode(F.sequence(F.lit(0), chunk_count.cast("int") - 1)).alias("chunk"),
        F.pmod(F.xxhash64("id", F.lit(1)), block_count).cast("int").alias("block"),
    )
    return queries, points


KEYS = ["ring", "chunk", "block"]


def _search_rows(df: DataFrame, id_col: str, vector: str, label: str, fold: str) -> DataFrame:
    return df.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.col(label).cast("int").alias("label"),
        F.col(fold).cast("int").alias("fold"),
    )


def out_of_fold_neighbours(
    df: DataFrame, id_col: str, vector: str, label: str, fold: str, k: int, chunk_rows: int = CHUNK_ROWS, ring_rows: int = RING_ROWS
) -> DataFrame:
    """The k nearest rows of other folds for every row: (query_id, neighbour_id, label, distance, rank).

    With a constant fold for training rows and another for test rows this is
    the plain train/test search; ties in distance go to the smaller id.
    """
    queries, points = _plan_search(_search_rows(df, id_col, vector, label, fold), k, chunk_rows, ring_rows)
    found = (
        queries.groupBy(*KEYS)
        .cogroup(points.groupBy(*KEYS))
        .applyInPandas(
            _chunk_neighbours(k),
            "query_id bigint, neighbour_id bigint, neighbour_label int, distance double",
        )
    )
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def compared_pairs(
    df: DataFrame, id_col: str, vector: str, label: str, fold: str, k: int, chunk_rows: int = CHUNK_ROWS, ring_rows: int = RING_ROWS
) -> DataFrame:
    """(rows, pairs): how many rows there are and how many pairs the search would compare."""
    rows = _search_rows(df, id_col, vector, label, fold)
    queries, points = (side.groupBy(*KEYS).count() for side in _plan_search(rows, k, chunk_rows, ring_rows))
    pairs = queries.withColumnRenamed("count", "q").join(points, KEYS).agg(F.sum(F.col("q") * F.col("count")).alias("pairs"))
    return rows.agg(F.count(F.lit(1)).alias("rows")).select("rows", pairs.scalar().alias("pairs"))


def vote(neighbours: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Majority label for every k at once: (query_id, k, prediction); ties go to the smaller label."""
    votes = neighbours.select(
        "query_id", "neighbour_label",
        F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank"))).alias("k"),
    )
    counts = votes.groupBy("query_id", "k", "neighbour_label").agg(F.count(F.lit(1)).alias("n"))
    winner = F.max(F.struct(F.col("n"), (-F.col("neighbour_label")).alias("low"))).alias("w")
    return counts.groupBy("query_id", "k").agg(winner).select(
        "query_id", "k", (-F.col("w.low")).alias("prediction")
    )


def vote_share(neighbours: DataFrame, k: int, positive: int = 1) -> DataFrame:
    """Share of the positive label among the k nearest: (query_id, score)."""
    return neighbours.filter(F.col("rank") <= k).groupBy("query_id").agg(
        F.avg((F.col("neighbour_label") == positive).cast("double")).alias("score")
    )


def accuracy_by_k(votes: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """(k, hits, accuracy): the grid over k read off one search."""
    truth = labels.select(F.col(id_col).cast("bigint").alias("query_id"), F.col(label).alias("_label"))
    hit = (F.col("prediction") == F.col("_label")).cast("int")
    return votes.join(truth, "query_id").groupBy("k").agg(
        F.sum(hit).alias("hits"), F.avg(hit.cast("double")).alias("accuracy")
    )
