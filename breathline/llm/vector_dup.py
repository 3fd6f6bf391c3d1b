"""Near-duplicate vectors: a navigable small-world graph per shard, queries against every shard, exact cosines, components."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from breathline.llm.shared import Workspace, connected_components

#: links a node gets when it is added; the ground level holds twice as many
LINKS = 12
#: nodes of one level per node of the next
SPREAD = 16
#: nodes that expand at once in a step of a search, and queries that search together
WIDTH, TOGETHER = 4, 256
#: similarities that an audit holds at once
CELLS = 2_000_000
#: bytes of a packed graph in one row
PIECE = 1 << 20


class Level:
    """Neighbour lists of the first ``len(links)`` vectors of a shard; -1 where a list is short."""

    def __init__(self, vectors: np.ndarray, size: int, degree: int):
        self.vectors = vectors[:size]
        self.links = np.full((size, degree), -1, np.int32)

    def search(self, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities (queries, beam), best first, by beam search in lock step; -1 where fewer were reached."""
        n = len(self.vectors)
        beam = min(beam, n)
        rows = np.arange(len(queries))
        ids = np.full((len(queries), beam), -1, np.int64)
        sims = np.full((len(queries), beam), -2, np.float32)
        done = np.ones((len(queries), beam), bool)
        seen = np.zeros((len(queries), n), bool)
        width = min(entry.shape[1], beam)
        ids[:, :width] = entry[:, :width]
        good = ids[:, :width] >= 0
        at = np.maximum(ids[:, :width], 0)
        sims[:, :width] = np.where(good, np.einsum("qkd,qd->qk", self.vectors[at], queries), -2)
        done[:, :width] = ~good
        np.put_along_axis(seen, at, good, axis=1)
        while len(rows):
            waiting = np.where(done[rows], -3, sims[rows])
            k = min(WIDTH, beam)
            pick = np.argpartition(-waiting, k - 1, axis=1)[:, :k]
            fresh = np.take_along_axis(waiting, pick, 1) > -2
            active = fresh.any(axis=1)
            rows, pick, fresh = rows[active], pick[active], fresh[active]
            if not len(rows):
                break
            done[rows[:, None], pick] = True
            nodes = np.where(fresh, ids[rows[:, None], pick], -1)
            near = self.links[np.maximum(nodes, 0)]
            near[nodes < 0] = -1
            near = np.sort(near.reshape(len(rows), -1), axis=1).astype(np.int64)
            new = near >= 0
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            at = np.maximum(near, 0)
            new &= ~seen[rows[:, None], at]
            which, column = np.nonzero(new)
            seen[rows[which], at[which, column]] = True
            value = np.full(near.shape, -2, np.float32)
            value[which, column] = np.einsum("kd,kd->k", self.vectors[at[which, column]], queries[rows[which]])
            all_sims = np.concatenate([sims[rows], value], axis=1)
            all_ids = np.concatenate([ids[rows], np.where(new, near, -1)], axis=1)
            all_done = np.concatenate([done[rows], ~new], axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[rows], ids[rows], done[rows] = (np.take_along_axis(x, best, 1) for x in (all_sims, all_ids, all_done))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates (best first) those nearer to the node than to any chosen before; then the best of the rest."""
        count = ids.shape[1]
        between = np.einsum("qid,qjd->qij", self.vectors[np.maximum(ids, 0)], self.vectors[np.maximum(ids, 0)])
        taken = np.zeros(ids.shape, bool)
        for c in range(count):
            blocked = (taken[:, :c] & (between[:, c, :c] > sims[:, c : c + 1])).any(axis=1)
            taken[:, c] = (ids[:, c] >= 0) & ~blocked & (taken[:, :c].sum(axis=1) < most)
        rank = np.argsort(np.where(ids < 0, 2, ~taken), axis=1, kind="stable")[:, :most]
        out = np.full((len(ids), most), -1, np.int64)
        out[:, : rank.shape[1]] = np.take_along_axis(ids, rank, 1)
        return out

    def add(self, first: int, last: int, found: np.ndarray, sims: np.ndarray) -> None:
        """Link the vectors ``first .. last`` with what a search found for them, and back."""
        own = np.arange(first, last)
        degree = self.links.shape[1]
        inner = self.vectors[first:last] @ self.vectors[first:last].T
        inner[np.arange(len(own)), np.arange(len(own))] = -2
        k = min(LINKS, len(own) - 1)
        if k > 0:
            beside = np.argpartition(-inner, k - 1, axis=1)[:, :k]
            found = np.concatenate([found, beside + first], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(inner, beside, 1)], axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
        chosen = self.choose(found, sims, LINKS)
        self.links[first:last, :LINKS] = chosen
        ahead, back = np.repeat(own, LINKS), chosen.ravel()
        ahead, back = ahead[back >= 0], back[back >= 0]
        order = np.argsort(back, kind="stable")
        back, ahead = back[order], ahead[order]
        nodes, starts, counts = np.unique(back, return_index=True, return_counts=True)
        for a in range(0, len(nodes), 1024):
            part, sizes = nodes[a : a + 1024], counts[a : a + 1024]
            more = np.full((len(part), int(sizes.max())), -1, np.int64)
            column = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            more[np.repeat(np.arange(len(part)), sizes), column] = ahead[starts[a] : starts[a] + int(sizes.sum())]
            lists = np.sort(np.concatenate([self.links[part].astype(np.int64), more], axis=1), axis=1)[:, ::-1]
            lists[:, 1:][lists[:, 1:] == lists[:, :-1]] = -1
            near = np.where(lists >= 0, np.einsum("nkd,nd->nk", self.vectors[np.maximum(lists, 0)], self.vectors[part]), -2)
            order = np.argsort(-near, axis=1, kind="stable")[:, : 3 * degree]
            self.links[part] = self.choose(np.take_along_axis(lists, order, 1), np.take_along_axis(near, order, 1), degree)


    def join_islands(self) -> None:
        """Link every part that no path from the first vector reaches, from the vector nearest to it that one does."""
        reached = np.zeros(len(self.vectors), bool)
        edge = np.zeros(1, np.int64)
        while True:
            while len(edge):
                reached[edge] = True
                edge = np.unique(self.links[edge])
                edge = edge[edge >= 0]
                edge = edge[~reached[edge]]
            left = np.flatnonzero(~reached)
            if not len(left):
                return
            known = np.flatnonzero(reached)
            near = known[np.argmax(self.vectors[known] @ self.vectors[left[0]])]
            free = np.flatnonzero(self.links[near] < 0)
            if not len(free):
                self.links = np.concatenate([self.links, np.full((len(self.links), 1), -1, np.int32)], axis=1)
                free = [self.links.shape[1] - 1]
            self.links[near, free[0]] = left[0]
            edge = left[:1]


class SmallWorld:
    """Hierarchical navigable small-world graph of unit vectors; level l holds the first n / SPREAD**l of them."""

    def __init__(self, vectors: np.ndarray, beam: int = 48):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        self.levels: list[Level] = []
        size = len(vectors)
        sizes = [size]
        while size > 2 * SPREAD * SPREAD:
            size //= SPREAD
            sizes.append(size)
        for at, size in enumerate(reversed(sizes)):  # from the smallest level down
            level = Level(self.vectors, size, 2 * LINKS if at == len(sizes) - 1 else LINKS + LINKS // 2)
            first = 0
            while first < size:
                last = min(size, first + max(64, min(512, first)))
                held = Level.__new__(Level)
                held.vectors, held.links = self.vectors[:first], level.links[:first]
                found, sims = np.zeros((last - first, 0), np.int64), np.zeros((last - first, 0), np.float32)
                if first:
                    parts = []
                    for a in range(first, last, TOGETHER):
                        asked = self.vectors[a : min(last, a + TOGETHER)]
                        entry = self._enter(asked) if self.levels else np.zeros((len(asked), 1), np.int64)
                        entry = np.where(entry < first, entry, 0)
                        parts.append(held.search(asked, entry, beam))
                    found, sims = (np.concatenate(x) for x in zip(*parts, strict=True))
                level.add(first, last, found, sims)
                first = last
            level.join_islands()
            self.levels.append(level)

    def _enter(self, queries: np.ndarray, levels: int | None = None) -> np.ndarray:
        """Entry points below the given number of upper levels."""
        entry = np.zeros((len(queries), 1), np.int64)
        for level in self.levels[: len(self.levels) if levels is None else levels]:
            entry = level.search(queries, entry, 8)[0][:, :4]
        return entry

    def within(self, queries: np.ndarray, least: float, beam: int) -> Iterator[tuple[int, np.ndarray]]:
        """(query, ids of similarity ``least`` or more). A query whose beam is full of such ids is asked again with a wider one."""
        for a in range(0, len(queries), TOGETHER):
            part = queries[a : a + TOGETHER]
            if beam >= len(self.vectors):  # no narrower beam passed the audit: all are compared
                for row, sims in enumerate(part @ self.vectors.T):
                    yield a + row, np.flatnonzero(sims >= least)
                continue
            entry = self._enter(part, len(self.levels) - 1)
            asked, width = np.arange(len(part)), beam
            while len(asked):
                step = max(1, TOGETHER * beam // width)
                again = []
                for b in range(0, len(asked), step):
                    rows = asked[b : b + step]
                    ids, sims = self.levels[-1].search(part[rows], entry[rows], width)
                    full = (sims[:, -1] >= least) & (ids[:, -1] >= 0) & (ids.shape[1] < len(self.vectors))
                    again.append(rows[full])
                    for row, found, value in zip(rows[~full].tolist(), ids[~full], sims[~full], strict=True):
                        yield a + row, found[(value >= least) & (found >= 0)]
                asked, width = np.concatenate(again), width * 4

    def audited_beam(self, least: float, beam: int, sample: int = 384, recall: float = 0.999) -> int:
        """The first of beam, 2 beam, .. with which a bounded sample of members finds what brute force finds.

        Recall is taken member by member, without the member itself, and
        averaged over those that have others within ``least``, so no large
        group speaks for small ones. If none of the sample has, their ten
        nearest count instead (0.9).
        """
        n = len(self.vectors)
        at = np.linspace(0, n - 1, min(n, sample)).astype(np.int64)
        k = min(10, n - 1)
        near, nearest = np.zeros(len(at), np.int64), np.zeros((len(at), max(k, 0)), np.int64)
        for a in range(0, len(at), step := max(1, CELLS // n)):
            some = at[a : a + step]
            truth = self.vectors[some] @ self.vectors.T
            truth[np.arange(len(some)), some] = -2
            near[a : a + step] = (truth >= least).sum(axis=1)
            if k > 0 and not near.any():
                nearest[a : a + step] = np.argpartition(truth, n - k, axis=1)[:, n - k :]
        if near.any():
            at, near = at[near > 0], near[near > 0]
        while beam < n:
            if near.any():
                hit = np.zeros(len(at))
                for row, found in self.within(self.vectors[at], least, beam):
                    hit[row] = (found != at[row]).sum()
                if (hit / near).mean() >= recall:
                    break
            else:
                found = self.levels[-1].search(self.vectors[at], self._enter(self.vectors[at], len(self.levels) - 1), beam)[0]
                if np.mean([len(np.intersect1d(a, b)) / k for a, b in zip(nearest, found, strict=True)]) >= 0.9:
                    break
            beam *= 2
        return min(beam, max(n, 1))


def tight_balls(vectors: np.ndarray, least: float, sample: int = 1024, smallest: int = 3) -> np.ndarray:
    """For each unit vector the number of its ball's centre, or its own.

    A ball holds vectors within half the angle of ``least`` around its centre,
    so all its members link with each other. Centres come from the first
    ``sample`` vectors that are in no ball yet (the caller shuffles): one with
    at least ``smallest`` of the sample around it, the fullest first. Rounds
    end when one takes in little. Groups too small to show in a sample stay
    single vectors.
    """
    tight = np.cos(np.arccos(least) / 2 - 1e-3)
    owner = np.arange(len(vectors))
    left = owner
    while len(left) >= 8 * smallest:
        at = left[:sample]
        near = vectors[at] @ vectors[at].T >= tight
        centres = []
        while True:
            counts = near.sum(axis=1)
            best = int(counts.argmax())
            if counts[best] < smallest:
                break
            centres.append(at[best])
            near[:, near[best].copy()] = False
        if not centres:
            break
        centres = np.array(centres)
        taken = np.zeros(len(left), bool)
        for a in range(0, len(left), 8192):
            sims = vectors[left[a : a + 8192]] @ vectors[centres].T
            best = sims.argmax(axis=1)
            inside = sims[np.arange(len(best)), best] >= tight
            inside |= np.isin(left[a : a + 8192], centres)
            owner[left[a : a + 8192][inside]] = centres[best[inside]]
            taken[a : a + 8192] = inside
        owner[centres] = centres
        if taken.sum() < 0.05 * len(left):
            break
        left = left[~taken]
    return owner


def _matrix(table: pa.Table | pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    values = table.column(column)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Forest:
    """Edges that connect what the pairs seen so far connect, one fewer than the nodes of each tree."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    def add(self, x: int, others: np.ndarray) -> None:
        """Pairs of ``x`` with each of the others."""
        for y in others.tolist():
            u, v = self._root(x), self._root(y)
            if u != v:
                self.parent[max(u, v)] = min(u, v)
                self.edges.append((x, y))


def _unit(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, np.float64)
    for a in range(0, len(x), 4096):
        part = np.asarray(x[a : a + 4096], np.float64)
        part = part / np.abs(part).max(axis=1, keepdims=True)  # keeps tiny and huge values in range
        out[a : a + 4096] = part / np.linalg.norm(part, axis=1, keepdims=True)
    return out


class Shard:
    """The nodes of a shard, those of a ball beside each other with its centre first, and a graph of centres and single nodes."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, exact: np.ndarray, least: float, beam: int):
        order = np.argsort(ids * 0x9E3779B1 % 0x7FFFFFFF, kind="stable")  # a fixed shuffle
        unit = _unit(exact[order])
        owner = tight_balls(unit.astype(np.float32), least)
        first = np.lexsort((owner != np.arange(len(owner)), owner))
        order, owner = order[first], owner[first]
        self.ids, self.copies, self.exact = ids[order], copies[order], exact[order]
        del unit
        self.starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        self.prepare(least)
        world = SmallWorld(self.unit.astype(np.float32)[self.starts], beam)
        self.links = [level.links for level in world.levels]
        self.beam = world.audited_beam(self.wide, beam)

    def prepare(self, least: float) -> None:
        self.least = least
        self.unit = _unit(self.exact)
        self.sizes = np.diff(np.append(self.starts, len(self.ids)))
        point = np.repeat(np.arange(len(self.starts)), self.sizes)
        inner = np.ones(len(point))
        members = np.flatnonzero(self.sizes[point] > 1)
        for a in range(0, len(members), 4096):
            some = members[a : a + 4096]
            inner[some] = np.einsum("nd,nd->n", self.unit[some], self.unit[self.starts[point[some]]])
        self.radius = np.where(self.sizes > 1, np.arccos(np.clip(np.minimum.reduceat(inner, self.starts), -1, 1)), 0.0)
        self.totals = np.add.reduceat(self.copies, self.starts)
        self.point = point
        self.reach = np.arccos(least)
        # a ball can hold links if its centre is this near
        self.wide = float(np.cos(self.reach + self.radius.max()) - 1e-4)

    def world(self) -> SmallWorld:
        world = SmallWorld.__new__(SmallWorld)
        world.vectors = self.unit.astype(np.float32)[self.starts]
        world.levels = []
        for links in self.links:
            level = Level.__new__(Level)
            level.vectors, level.links = world.vectors[: len(links)], links
            world.levels.append(level)
        return world

    def packed(self) -> list[bytes]:
        """What ``unpacked`` takes, in pieces; vectors as they came, not their unit vectors."""
        whole = pickle.dumps({k: getattr(self, k) for k in ("ids", "copies", "exact", "starts", "links", "beam")}, 5)
        return [whole[a : a + PIECE] for a in range(0, len(whole), PIECE)]

    @classmethod
    def unpacked(cls, pieces: list[bytes], least: float) -> Shard:
        held = cls.__new__(cls)
        held.__dict__ = pickle.loads(b"".join(pieces))
        held.prepare(least)
        return held

    def links_of(self, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """How many rows each query links with here, without itself, and edges (query, node) of a forest that connects it with all of them.

        A ball that lies within reach as a whole is counted as a whole, and
        its centre stands for its members, which link with it. Of a ball that
        lies partly within reach the members are compared.
        """
        counts = np.zeros(len(ids), np.int64)
        by_id = np.argsort(self.ids)
        place = np.minimum(np.searchsorted(self.ids[by_id], ids), len(by_id) - 1)
        own = np.where(self.ids[by_id][place] == ids, by_id[place], -1)
        forest, float_vectors = Forest(), vectors.astype(np.float32)
        for row, found in self.world().within(float_vectors, self.wide, self.beam):
            if own[row] >= 0 and not (found == self.point[own[row]]).any():
                found = np.append(found, self.point[own[row]])
            if not len(found):
                continue
            near = self.unit[self.starts[found]] @ vectors[row]
            single = self.sizes[found] == 1
            hit = single & (near >= self.least)
            balls = np.flatnonzero(~single)
            met = [self.starts[found[hit]]]
            counts[row] = self.totals[found[hit]].sum()
            if len(balls):
                angle, radius = np.arccos(np.clip(near[balls], -1, 1)), self.radius[found[balls]]
                whole = found[balls[angle + radius <= self.reach - 1e-7]]
                counts[row] += self.totals[whole].sum()
                met.append(self.starts[whole])
                for p in found[balls[(angle + radius > self.reach - 1e-7) & (angle - radius <= self.reach + 1e-7)]].tolist():
                    members = np.arange(self.starts[p], self.starts[p] + self.sizes[p])
                    members = members[self.unit[members] @ vectors[row] >= self.least]
                    counts[row] += self.copies[members].sum()
                    met.append(members)
            if own[row] >= 0:
                counts[row] -= self.copies[own[row]]
            others = self.ids[np.concatenate(met)]
            forest.add(int(ids[row]), others[others != ids[row]])
        return counts, forest.edges


def vector_duplicates(
    table: DataFrame, work: Workspace, id_col: str = "vec_id", vector_col: str = "embedding",
    least: float = 0.95, beam: int = 48, shard_rows: int = 50_000, least_shards: int = 4, block_rows: int = 25_000,
) -> DataFrame:
    """(id, n_links, component_id, kept) per vector; linked are vectors with cosine ``least`` or more.

    Equal vectors are one node with a count. Nodes are dealt to shards by a
    hash; in each shard of about ``shard_rows`` nodes at most, groups of near
    copies become balls (``tight_balls``), and their centres and the other
    nodes a graph, whose beam is doubled until an audit against brute force
    passes. Then every node asks every shard; what a search returns is
    verified in double precision. A large group costs a query a few balls, not
    a list of its members. A task holds and sends on one count a query and the
    edges of a spanning forest, not the pairs. Graphs travel in pieces of a
    mebibyte, with the vectors in the type of the table. Components come from those edges.

    Vectors that are null, empty or zero, or hold a null or non-finite value,
    link with nothing (0 links, a component of their own), as do vectors of
    different lengths with each other. Repeated rows are copies; rows that
    share an id but not the vector are judged each by its own vector; other
    columns are not read; an empty table gives an empty result.
    """
    given = table.select(f"`{vector_col}`").schema[0].dataType
    kind = "array<float>" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "array<double>"
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    usable = (
        F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("node", F.xxhash64(F.xxhash64("v"), F.xxhash64(F.lit(1), F.reverse("v"))))
    classes = rows.where("ok").groupBy("node").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("v").cast(kind).alias("v"))
    nodes = classes.select(F.col("node").alias("id"), "least_id", F.size("v").alias("dim"), "v", "copies")
    nodes = work.write(nodes)
    total = max(1, nodes.count())
    shards, blocks = max(least_shards, -(-total // shard_rows)), -(-total // block_rows)
    dealt = nodes.drop("least_id").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(blocks)))

    def build(shard: pa.Table) -> pa.Table:
        dim = shard.column("dim")[0].as_py()
        held = Shard(shard.column("id").to_numpy(), shard.column("copies").to_numpy(), _matrix(shard, "v", dim), least, beam)
        pieces = held.packed()
        number = shard.column("shard")[0].as_py()
        return pa.table({"dim": pa.array([dim] * len(pieces), pa.int32()), "shard": pa.array([number] * len(pieces)), "piece": pa.array(range(len(pieces)), pa.int32()), "graph": pa.array(pieces, pa.binary())})

    built = dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard long, piece int, graph binary")
    # a file is read in one batch: a few pieces each
    graphs = work.write(built.repartition(max(table.sparkSession.sparkContext.defaultParallelism, total * 10 // shard_rows), "shard", "piece"))
    asked = dealt.select("dim", "block", "id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    spread = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def ask(graph: pa.Table, queries: pa.Table) -> pa.Table:
        if not graph.num_rows or not queries.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "n")})
        held = Shard.unpacked(graph.sort_by("piece").column("graph").to_pylist(), least)
        ids = queries.column("id").to_numpy()
        counts, edges = held.links_of(ids, _unit(_matrix(queries, "v", held.unit.shape[1])))
        edges = np.array(edges, np.int64).reshape(-1, 2)
        some = np.flatnonzero(counts)
        return pa.table({
            "a": pa.array(np.concatenate([ids[some], edges[:, 0]])), "b": pa.array(np.concatenate([ids[some], edges[:, 1]])),
            "n": pa.array(np.concatenate([counts[some], np.zeros(len(edges), np.int64)])),
        })

    keys = ["dim", "shard", "block"]
    found = work.write(spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(ask, "a long, b long, n long"))
    links = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    components = connected_components(found.where("a <> b").select("a", "b"), work)
    known = work.write(
        nodes.select("id", "least_id", "copies").join(links, "id", "left").join(components, "id", "left")
        .select(F.col("id").alias("node"), "least_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component"))
    )
    work.drop(nodes, graphs, found)
    smallest = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    joined = rows.select("id", "ok", "node").join(known.join(smallest, "component").select("node", "n_links", "component_id"), "node", "left").select(
        "id", F.when(F.col("ok"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )
    return joined.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
