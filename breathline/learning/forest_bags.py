"""Bags of forests: every bag a bootstrap of the rows, every tree a bootstrap of its bag, all trees of a chunk grown together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breathline.learning.boosting import BinnedRows, bin_numbers, binned_rows

#: fixed values of the weights: a multiplicative generator modulo 2**31 - 1, and the steps that mix row, bag and tree
MODULUS, FACTOR = 2_147_483_647, 48_271
STEPS = (1_299_709, 15_485_863, 32_452_843)
#: cumulative probabilities of a Poisson draw of mean 1
POISSON = tuple(float(x) for x in np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)])))
#: trees whose rows are looked at together
CLOSE = 4
#: rows times trees of the bags that a task grows one after the other, if these are more than one
TOGETHER = 400_000_000
#: rows times trees that are grown, or scored, at once
HELD = 4_000_000
#: rows that are scored at once
BLOCK_ROWS = 100_000


def uniform(row: np.ndarray, bag: np.ndarray | int, tree: np.ndarray | int) -> np.ndarray:
    """Even draws in (0, 1) from whole numbers alone, so that any engine repeats them."""
    x = (row * STEPS[0] + bag * STEPS[1] + tree * STEPS[2]) % MODULUS
    for _ in range(4):
        x = ((x + 1) * FACTOR + x % 1021 * STEPS[1]) % MODULUS
    return (x + 0.5) / MODULUS


def uniform_column(row: Column, bag: Column | int, tree: Column | int) -> Column:
    """``uniform`` as a column."""
    bag, tree = (F.lit(x).cast("long") if isinstance(x, int) else x.cast("long") for x in (bag, tree))
    x = (row.cast("long") * STEPS[0] + bag * STEPS[1] + tree * STEPS[2]) % MODULUS
    for _ in range(4):
        x = ((x + 1) * FACTOR + x % 1021 * STEPS[1]) % MODULUS
    return (x + 0.5) / MODULUS


def bag_weight(row: np.ndarray, bag: np.ndarray | int) -> np.ndarray:
    """How often a row stands in a bag: a Poisson draw of mean 1."""
    return np.searchsorted(POISSON, uniform(row, bag, 0))


def bag_weight_column(row: Column, bag: Column | int) -> Column:
    draw = uniform_column(row, bag, 0)
    return sum(((draw > F.lit(p)).cast("int") for p in POISSON[1:]), (draw > F.lit(POISSON[0])).cast("int"))


def tree_weight(row: np.ndarray, bag: np.ndarray | int, tree: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often a row stands in a tree of a bag that holds it ``times`` times: that many Poisson draws of mean 1."""
    shape = np.broadcast_shapes(row.shape, np.shape(bag), tree.shape, times.shape)
    out = np.zeros(shape, np.int64)
    row, bag, tree, times = (np.broadcast_to(x, shape) for x in (row, bag, tree, times))
    for k in range(int(times.max(initial=0))):
        held = np.nonzero(times > k)  # the others draw nothing
        out[held] += np.searchsorted(POISSON, uniform(row[held], bag[held], tree[held] * 16 + k + 1))
    return out


class GrownTrees:
    """Trees of a chunk: children, split and share of label 1 of every node; node t is the root of tree t."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, share: np.ndarray, trees: int):
        self.feature, self.cut, self.child, self.share, self.trees = feature, cut, child, share, trees

    def leaf_shares(self, bins: np.ndarray) -> np.ndarray:
        """Share of label 1 of the leaf that each row falls to: (trees, rows)."""
        n, width = bins.shape
        flat = np.ascontiguousarray(bins, np.uint16 if bins.max(initial=0) < 1 << 16 else np.int64).ravel()
        out = np.empty((self.trees, n), self.share.dtype)
        for a in range(0, self.trees, CLOSE):  # few enough to stay in the cache
            some = range(a, min(self.trees, a + CLOSE))
            at = np.repeat(np.array(some), n)
            start = np.tile(np.arange(n) * width, len(some))
            going = np.flatnonzero(self.child[at] >= 0)
            node, place = at[going], start[going]
            while len(going):
                node = self.child[node] + (flat[place + self.feature[node]] > self.cut[node])
                on = self.child[node] >= 0
                at[going[~on]] = node[~on]
                going, node, place = going[on], node[on], place[on]
            out[some.start : some.stop] = self.share[at].reshape(len(some), n)
        return out


    def pruned(self) -> GrownTrees:
        """Sibling leaves of one class are one leaf, from the lowest up; their places stay, unreached."""
        child, ones = self.child.copy(), self.share > 0.5
        while True:
            inner = np.flatnonzero(child >= 0)
            low = child[inner]
            joined = inner[(child[low] < 0) & (child[low + 1] < 0) & (ones[low] == ones[low + 1])]
            if not len(joined):
                return GrownTrees(self.feature, self.cut, child, self.share, self.trees)
            child[joined] = -1

    def height(self) -> int:
        """Nodes on the longest way down."""
        level, height = np.arange(self.trees), 0
        while len(level):
            height += 1
            low = self.child[level]
            low = low[low >= 0]
            level = np.concatenate([low, low + 1])
        return height


def best_cuts(
    flat: np.ndarray, row: np.ndarray, w: np.ndarray, wy: np.ndarray, node: np.ndarray, feature: np.ndarray, all_w: np.ndarray, all_y: np.ndarray, width: int, count: int
) -> tuple[np.ndarray, np.ndarray]:
    """Largest Gini gain, and the first bin that gives it, for every (node, feature); gains are -1 where nothing splits or no entry asks.

    ``flat`` has the bins of row after row. The entries (row, weights, node,
    feature) are summed by node, feature and bin: in cells while these are few, else in order, so that the work grows
    with the rows of a level, not with its nodes times bins.
    """
    slots = len(all_w)
    gain, cell = np.full((slots, width), -1.0), np.zeros((slots, width), np.int64)
    if not len(node):
        return gain, cell
    keys = (node.astype(np.int64) * width + feature) * count + flat[row.astype(np.int64) * width + feature]
    if slots * width * count <= 4 * len(keys):
        left = np.bincount(keys, w, slots * width * count)
        left_y = np.bincount(keys, wy, slots * width * count)
        keys = np.flatnonzero(left)
        left, left_y = left[keys].cumsum(), left_y[keys].cumsum()
    else:
        keys, order = _in_order(keys)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys = keys[starts]
        left, left_y = (np.add.reduceat(x[order], starts).cumsum() for x in (w, wy))
    group = keys // count
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    run = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(group)]])))
    # sums before the first bin of a group; weights are whole numbers, so sums and differences are exact
    left -= np.concatenate([[0.0], left])[first][run]
    left_y -= np.concatenate([[0.0], left_y])[first][run]
    n, h = all_w[group // width], all_y[group // width]
    valid = (left > 0.5) & (n - left > 0.5)
    gains = np.where(valid, left_y**2 / np.where(valid, left, 1) + (h - left_y) ** 2 / np.where(valid, n - left, 1) - h * h / n, -1.0)
    top = np.maximum.reduceat(gains, first)
    hit = np.flatnonzero(gains == top[run])
    _, lowest = np.unique(run[hit], return_index=True)
    place = np.divmod(group[first], width)
    gain[place], cell[place] = top, (keys % count)[hit[lowest]]
    return gain, cell


def _in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in ascending order, and their old places: sorted as one number each."""
    bits = max(1, int(len(keys) - 1).bit_length())
    if int(keys.max()).bit_length() + bits > 62:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    packed = np.sort((keys << bits) | np.arange(len(keys)))
    return packed >> bits, packed & ((1 << bits) - 1)


def grow_trees(bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, count: int, features_each: int, depth: int = 30, seed: int = 0, look_on: bool = True) -> GrownTrees:
    """Grow a tree for each row of ``weights`` (trees, rows), level by level, the open nodes of a few trees at a time.

    Gini impurity; a node looks at ``features_each`` random features, and on
    at others only if these cannot split it (not without ``look_on``). Nodes end when they are pure,
    cannot be split or are ``depth`` deep.
    """
    trees, _ = weights.shape
    width = bins.shape[1]
    rng = np.random.default_rng(seed)
    tree, row = np.nonzero(weights)
    tree, row = tree.astype(np.int32), row.astype(np.int32)
    w = weights[tree, row].astype(float)
    wy = w * labels[row]
    flat = np.ascontiguousarray(bins, np.int16 if bins.max(initial=0) < 1 << 15 else np.int64).ravel()
    node = tree  # of the level; -1 under a leaf
    total, ones = np.bincount(node, w, trees), np.bincount(node, wy, trees)
    feature, cut, child, sums, hits = [np.zeros(trees, np.int64)], [np.zeros(trees, np.int64)], [np.full(trees, -1)], [total], [ones]
    made, first, owner = trees, 0, np.arange(trees)  # nodes so far, the first of the level, and the trees of the level's nodes
    for _ in range(depth):
        size = made - first
        open_ = (hits[-1] > 1e-9) & (sums[-1] - hits[-1] > 1e-9)
        number = np.full(size + 1, -1, np.int32)  # the last one for rows under a leaf
        number[:-1][open_] = np.arange(open_.sum())
        mine = number[node]
        keep = mine >= 0
        if not keep.all():
            keep = np.flatnonzero(keep)
            tree, row, w, wy, mine = (x[keep] for x in (tree, row, w, wy, mine))
        slots = int(open_.sum())
        if not slots:
            break
        best_gain, best = np.full(slots, 1e-12), np.full(slots, -1)
        turn = rng.random((slots, width)).argsort(axis=1)  # each node's order of features
        all_w, all_y = sums[-1][open_], hits[-1][open_]
        for a in range(0, trees, CLOSE):  # rows and nodes stay in the order of their trees
            rows = slice(*np.searchsorted(tree, [a, a + CLOSE]))
            nodes = slice(*np.searchsorted(owner[open_], [a, a + CLOSE]))
            each_w, each_y, at = w[rows], wy[rows], mine[rows] - nodes.start
            # the features of a node's draw first, and where none of them can split, one of the others after the other
            asking = np.ones(nodes.stop - nodes.start, bool)
            for first_draw, some in ((True, turn[nodes, :features_each]), (False, turn[nodes, features_each:])):
                if not some.shape[1] or not asking.any() or not (first_draw or look_on):
                    break
                of = np.repeat(np.flatnonzero(asking[at]), some.shape[1])
                asked = some[at[of[:: some.shape[1]]]].ravel()
                gain, cell = best_cuts(flat, row[rows][of], each_w[of], each_y[of], at[of], asked, all_w[nodes], all_y[nodes], width, count)
                own = np.arange(len(asking))
                if first_draw:
                    chosen = gain.argmax(axis=1)
                else:
                    chosen = some[own, (np.take_along_axis(gain, some, axis=1) > 1e-12).argmax(axis=1)]
                found = asking & (gain[own, chosen] > 1e-12)
                best_gain[nodes][found] = gain[own, chosen][found]
                best[nodes][found] = chosen[found] * count + cell[own, chosen][found]
                asking &= ~found
        split = best_gain > 1e-12
        nodes = np.flatnonzero(open_)[split]
        if not len(nodes):
            break
        feature[-1][nodes], cut[-1][nodes] = best[split] // count, best[split] % count
        child[-1][nodes] = made + 2 * np.arange(len(nodes))
        place = np.full(len(split), -1, np.int32)
        place[split] = 2 * np.arange(len(nodes))
        right = flat[row.astype(np.int64) * width + (best // count)[mine]] > (best % count)[mine]
        node = np.where(split[mine], place[mine] + right, -1)
        first, made, owner = made, made + 2 * len(nodes), np.repeat(owner[nodes], 2)
        sums.append(np.bincount(node + 1, w, made - first + 1)[1:])
        hits.append(np.bincount(node + 1, wy, made - first + 1)[1:])
        feature.append(np.zeros(made - first, np.int64))
        cut.append(np.zeros(made - first, np.int64))
        child.append(np.full(made - first, -1))
    sums, hits = np.concatenate(sums), np.concatenate(hits)
    # a tree without rows votes for neither label
    share = np.where(sums > 0, hits / np.maximum(sums, 1e-300), 0.5)
    return GrownTrees(np.concatenate(feature), np.concatenate(cut), np.concatenate(child), share, trees)


def bag_scores(
    df: DataFrame, id_col: str, features: list[str], label: str, learn: Column, bags: int = 500, trees: int = 150, features_each: int = 2, depth: int = 30, most: int = BLOCK_ROWS, bins: int = 64
) -> DataFrame:
    """(id, score, low, high) of every row: the mean of the bags' scores, and the least and the greatest of them.

    A bag is a forest of ``trees`` trees on a bootstrap of all rows that
    ``learn`` picks. The bootstraps are nested weights drawn from the row's id,
    bag and tree, so no sample is stored and a lost task draws the same ones.
    All rows reach every task as bins, a byte each. Chunks of bags are dealt to
    tasks; a task grows a bag, scores all rows with it, ``most`` at once, and
    keeps three numbers a row, so no tree is stored or sent. Missing values are
    a bin of their own; ids are whole numbers and name a row; an empty table
    gives no rows.
    """
    rows = binned_rows(df.where(learn), id_col, features, label, None, bins)
    asked = df.select(F.col(id_col).cast("long").alias("id"), *[F.col(f).cast("double").alias(f) for f in features]).toArrow()
    ids, asked = asked.column("id").combine_chunks(), _narrow(bin_numbers(asked, rows.cuts))
    rows = BinnedRows(rows.ids, _narrow(rows.bins), rows.labels, rows.folds, rows.count)
    spark = df.sparkSession
    size = max(1, min(TOGETHER // max(1, trees * len(rows.ids)), -(-bags // (4 * spark.sparkContext.defaultParallelism))))
    parts = -(-bags // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                own = range(part * size, min(bags, (part + 1) * size))
                total, low, high = np.zeros(len(asked)), np.full(len(asked), np.inf), np.full(len(asked), -np.inf)
                for bag in own:
                    found = np.zeros(len(asked), np.float32)
                    for some in tree_groups(trees, len(rows.ids)):
                        grown = forest(rows, bag, trees, features_each, depth, some)
                        step = max(1, min(most, HELD // len(some)))
                        for a in range(0, len(asked), step):
                            found[a : a + step] += grown.leaf_shares(asked[a : a + step]).sum(axis=0)
                    found /= np.float32(trees)
                    total += found
                    low, high = np.minimum(low, found), np.maximum(high, found)
                for a in range(0, len(asked), most):
                    at = slice(a, a + most)
                    yield pa.RecordBatch.from_arrays([ids.slice(a, most), pa.array(total[at]), pa.array(low[at]), pa.array(high[at]), pa.array(np.full(len(total[at]), len(own)))], names=["id", "sum", "low", "high", "n"])

    each = spark.range(0, parts, 1, parts).mapInArrow(run, "id long, sum double, low double, high double, n long")
    return each.groupBy(F.col("id").alias(id_col)).agg((F.sum("sum") / F.sum("n")).alias("score"), F.min("low").alias("low"), F.max("high").alias("high"))


def _narrow(bins: np.ndarray) -> np.ndarray:
    """Bins in a byte each where they fit."""
    return bins.astype(np.uint8) if bins.max(initial=0) < 256 else bins


def tree_groups(trees: int, rows: int) -> list[range]:
    """The trees of a bag that are grown at once: as many as ``HELD`` lets, whatever the cores."""
    step = max(1, HELD // max(1, rows))
    return [range(a, min(trees, a + step)) for a in range(0, trees, step)]


def forest(rows: BinnedRows, bag: int, trees: int, features_each: int, depth: int, own: range | None = None) -> GrownTrees:
    """The trees of a bag, or those of ``own`` alone."""
    own = range(trees) if own is None else own
    ids = rows.ids.astype(np.int64)
    weights = tree_weight(ids[None, :], bag, np.arange(own.start, own.stop)[:, None], np.broadcast_to(bag_weight(ids, bag), (len(own), len(ids))))
    grown = grow_trees(rows.bins, rows.labels, weights, rows.count, features_each, depth, seed=[bag, own.start] if own.start else bag)
    return GrownTrees(grown.feature.astype(np.uint16), grown.cut.astype(np.uint16), grown.child.astype(np.int32), grown.share.astype(np.float32), len(own))
