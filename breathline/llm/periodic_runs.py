"""Periodic runs of words, found by internal pattern matching over a slice of documents."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from breathline.llm.shared import arrow_map, coded_words, text_slices

#: a run has at least so many words, and so many times its period
LEAST_WORDS, LEAST_TIMES = 6, 4
#: bytes of text that are searched together
SLICE = 1 << 20


class Suffixes:
    """Suffix array of a sequence of codes by prefix doubling, and the classes of its blocks of 2**k codes.

    ``ranks[k][i]`` is the first place, in the suffix array, of the suffixes
    that share their first 2**k codes with suffix i; equal ranks are equal
    blocks. Only suffixes that share their block with another are ordered
    further; doubling ends when none does or blocks are ``longest`` long.
    """

    def __init__(self, codes: np.ndarray, longest: int):
        n = len(codes)
        self.order = np.argsort(codes, kind="stable").astype(np.int32)
        sorted_codes = codes[self.order]
        heads = np.append(True, sorted_codes[1:] != sorted_codes[:-1]) if n else np.zeros(0, bool)
        first = np.maximum.accumulate(np.where(heads, np.arange(n), 0)).astype(np.int32)
        rank = np.empty(n, np.int32)
        rank[self.order] = first
        self.ranks = [rank]
        self.sizes = [np.bincount(first, minlength=n).astype(np.int32)]  # by first place
        width = 1
        open_ = np.flatnonzero(self.sizes[0][first] > 1)  # places in the suffix array
        while len(open_) and 2 * width <= longest:
            at = self.order[open_]
            group = rank[at].astype(np.int64)
            behind = np.where(at + width < n, rank[np.minimum(at + width, n - 1)].astype(np.int64) + 1, 0)
            key = group * (n + 1) + behind
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            self.order[open_] = at
            heads = np.append(True, key[1:] != key[:-1])
            first = open_[np.maximum.accumulate(np.where(heads, np.arange(len(at)), 0))].astype(np.int32)
            rank = rank.copy()
            rank[at] = first
            sizes = np.ones(n, np.int32)
            sizes[first[heads]] = np.diff(np.append(np.flatnonzero(heads), len(at)))
            self.ranks.append(rank)
            self.sizes.append(sizes)
            open_ = open_[sizes[first] > 1]
            width *= 2


class WaveletTree:
    """Bits of a sequence of numbers level by level, highest bit first, for successors in a range of places.

    On each level the numbers stand ordered by the bits above, zeros first;
    ``zeros[level][i]`` counts the zero bits among the first i.
    """

    def __init__(self, values: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.zeros: list[np.ndarray] = []
        for level in range(self.bits - 1, -1, -1):
            low = (values >> level) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(low)]).astype(np.int32))
            values = np.concatenate([values[low], values[~low]])

    def below(self, start: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the numbers at places start .. end - 1 are under ``bound``."""
        count = np.zeros(len(start), np.int32)
        for depth, zeros in enumerate(self.zeros):
            a, b = zeros[start], zeros[end]
            one = (bound >> (self.bits - 1 - depth)) & 1 == 1
            count += np.where(one, b - a, 0)
            start, end = np.where(one, zeros[-1] + start - a, a), np.where(one, zeros[-1] + end - b, b)
        return count

    def nth(self, start: np.ndarray, end: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The number that n others at places start .. end - 1 are under."""
        value = np.zeros(len(start), np.int32)
        for zeros in self.zeros:
            a, b = zeros[start], zeros[end]
            one = n >= b - a
            value = value * 2 + one
            n = np.where(one, n - (b - a), n)
            start, end = np.where(one, zeros[-1] + start - a, a), np.where(one, zeros[-1] + end - b, b)
        return value

    def neighbours(self, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next smaller and the next larger number beside each ``value`` (which is there); -1 where there is none."""
        under = self.below(start, end, value)
        before = np.full(len(value), -1, np.int32)
        behind = np.full(len(value), -1, np.int32)
        has = np.flatnonzero(under > 0)
        before[has] = self.nth(start[has], end[has], under[has] - 1)
        has = np.flatnonzero(under + 1 < end - start)
        behind[has] = self.nth(start[has], end[has], under[has] + 1)
        return before, behind


def _candidates(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) such that the blocks at ``place`` and ``place + period`` are equal.

    A run of smallest period q that is at least 4q long holds, for the power
    of two w with q < w <= 2q, a block of w words at a multiple of w, and the
    run reaches q words beyond the block on one side at least. There the block
    occurs again, and nowhere nearer on that side: an occurrence at a distance
    d < q would give d + w >= d + q words both periods, hence the run a
    smaller one. So the occurrences next to a block, on both sides, in a
    window of w words, give every period.
    """
    n = len(suffixes.order)
    rank, sizes = suffixes.ranks[0], suffixes.sizes[0]
    # equal single words, by place in the suffix array: all blocks that occur again lie among them
    held = np.flatnonzero(sizes[rank[suffixes.order]] > 1)
    if not len(held):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new_place = np.zeros(n + 1, np.int32)
    new_place[held] = np.arange(len(held))
    tree = WaveletTree(suffixes.order[held], n)
    places, periods = [], []
    for k in range(1, len(suffixes.ranks)):
        width = 1 << k
        block = np.arange(0, n - width + 1, width)
        first = suffixes.ranks[k][block]
        size = suffixes.sizes[k][first]
        again = size > 1
        block, first, size = block[again].astype(np.int32), first[again], size[again]
        start = new_place[first]
        before, behind = tree.neighbours(start, start + size, block)
        for near, gap, low in ((before >= 0, block - before, before), (behind >= 0, behind - block, block)):
            fits = near & (gap >= width // 2) & (gap < width)
            places.append(low[fits].astype(np.int64))
            periods.append(gap[fits].astype(np.int64))
    return np.concatenate(places), np.concatenate(periods)


def _reach(suffixes: Suffixes, place: np.ndarray, period: np.ndarray, forward: bool) -> np.ndarray:
    """How many codes from ``place`` on (or before it) equal those ``period`` further on, by falling powers of two."""
    n = len(suffixes.order)
    moved = np.zeros(len(place), np.int64)
    for k in range(len(suffixes.ranks) - 1, -1, -1):
        rank, width = suffixes.ranks[k], 1 << k
        going = np.arange(len(place))
        while len(going):
            at = place[going] + moved[going] if forward else place[going] - moved[going] - width
            ok = (at >= 0) & (at + period[going] + width <= n)
            at, going = at[ok], going[ok]
            same = rank[at] == rank[at + period[going]]
            going = going[same]
            moved[going] += width
            if k < len(suffixes.ranks) - 1:
                break  # one step of each size is enough below the largest
    return moved


def runs_in(codes: np.ndarray, borders: np.ndarray, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> np.ndarray:
    """Rows (document, start, length, period) of all runs of the documents codes[borders[i]:borders[i + 1]].

    A run is a stretch of smallest period q, of at least ``least_words`` words
    and ``least_times`` (4 or more) periods, that no neighbouring word of the
    document extends. Ordered by document, start, period.
    """
    if least_times < 4:
        raise ValueError("blocks find periods that occur four times or more")
    sizes = np.diff(borders)
    if not len(codes) or not len(sizes):
        return np.zeros((0, 4), np.int64)
    suffixes = Suffixes(codes, max(2, 2 * (int(sizes.max()) // least_times)))
    place, period = _candidates(suffixes)
    if not len(place):
        return np.zeros((0, 4), np.int64)
    doc = np.searchsorted(borders, place, "right") - 1
    start = np.maximum(place - _reach(suffixes, place, period, False), borders[doc])
    end = np.minimum(place + _reach(suffixes, place, period, True) + period, borders[doc + 1])
    good = end - start >= np.maximum(least_words, least_times * period)
    rows = np.column_stack([doc, start - borders[doc], end - start, period])[good]
    rows = np.unique(rows, axis=0)  # ordered by all columns, so the smallest period of a stretch comes first
    if len(rows):
        rows = rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def collapsed_words(rows: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Which words stay when each run keeps its first period."""
    change = np.zeros(int(borders[-1]) + 1, np.int64)
    first = borders[rows[:, 0]] + rows[:, 1]
    np.add.at(change, first + rows[:, 3], 1)
    np.add.at(change, first + rows[:, 2], -1)
    return np.cumsum(change)[:-1] == 0


def planted_source(ids: list, borders: np.ndarray) -> np.ndarray:
    """The original word that stands at each place after the tails of a tenth of the documents are made periodic.

    With h = crc32 of the decimal id and g = h // 10: if h % 10 is 0, words from
    a = g % n on repeat the words a .. a + p - 1, p = 1 + (n - a) // (3 + g % 8).
    A null id plants nothing.
    """
    source = np.arange(int(borders[-1]))
    for i, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)):
        h = 1 if ids[i] is None else zlib.crc32(str(ids[i]).encode())
        n = b - a
        if n and h % 10 == 0:
            g = h // 10
            from_word = g % n
            period = 1 + (n - from_word) // (3 + g % 8)
            source[a + from_word : b] = a + from_word + np.arange(n - from_word) % period
    return source


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, digests: bool = False) -> DataFrame:
    """(id, n_words, runs, collapsed) per document: all runs as (start, length, period), and the text that is left.

    Words are what stands between runs of ``[\\x20\\x09-\\x0D]``. A run has six
    words or more and is at least four times its smallest period; words behind
    its first period are dropped from ``collapsed``, whose words are joined by
    one space. ``plant`` first makes the tails of a tenth of the documents
    periodic (``planted_source``). With ``digests`` the longest run (smallest
    start, then period, of equal ones; nulls without a run) and SHA-256 digests
    take the place of runs and text.

    One scan, no shuffle: documents are searched in slices of text, a longer
    document by itself, with about 4 n log2(n) bytes for n words. A row depends
    on its document alone, so repeated rows give equal rows. Null and empty
    texts have no words; null ids stay null (and plant nothing); other columns
    are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=SLICE):
            ids = part.column("id").to_pylist()
            words, codes, borders = coded_words(part.column("text"))
            if plant:
                codes = codes[planted_source(ids, borders)]
            rows = runs_in(codes, borders)
            keep = collapsed_words(rows, borders)
            kept = [words[c] for c in codes[keep].tolist()]
            ends = np.concatenate([[0], np.cumsum(keep)])[borders].tolist()
            texts = [" ".join(kept[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            counts = np.bincount(rows[:, 0], minlength=len(ids))
            edges = np.concatenate([[0], np.cumsum(counts)])
            if digests:
                columns = [pa.array(counts), *_longest(rows, len(ids)), _run_digests(rows, edges), pa.array([_sha(t) for t in texts], pa.string())]
            else:
                listed = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in (1, 2, 3)], names=["start", "length", "period"])
                columns = [pa.array(np.diff(borders)), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), listed), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=names)

    if digests:
        names = [id_col, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        fields = f"`{id_col}` {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    else:
        names = [id_col, "n_words", "runs", "collapsed"]
        fields = f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return arrow_map(docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), run, fields)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _longest(rows: np.ndarray, count: int) -> list[pa.Array]:
    """start, length, period and 1000 * length // period of each document's longest run; null without a run."""
    by = np.lexsort((rows[:, 3], rows[:, 1], -rows[:, 2], rows[:, 0]))
    best = rows[by][np.append(True, np.diff(rows[by, 0]) > 0)[: len(rows)]]
    missing = np.ones(count, bool)
    missing[best[:, 0]] = False
    columns = []
    for values in (best[:, 1], best[:, 2], best[:, 3], 1000 * best[:, 2] // best[:, 3]):
        full = np.zeros(count, np.int64)
        full[best[:, 0]] = values
        columns.append(pa.array(full, mask=missing))
    return columns


def _run_digests(rows: np.ndarray, edges: np.ndarray) -> pa.Array:
    lines = [f"{s},{n},{p}\n" for s, n, p in rows[:, 1:].tolist()]
    return pa.array([_sha("".join(lines[a:b])) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.string())
