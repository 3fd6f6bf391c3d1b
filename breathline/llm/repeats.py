"""Removal of byte strings that occur more than once, over all documents.

The suffixes that matter are those whose first ``length`` bytes occur again.
Ordering all suffixes of a corpus by sampled triples shuffles two thirds of
its bytes as rows of sixteen and more bytes, several times over; that does not
fit the disk a job may use. Here positions are sampled by content instead of
by number, sampled suffixes are named by hashes of their prefixes, and only
what stays undecided is named in finer steps down to single positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breathline.llm.shared import Workspace, arrow_map, small_side, text_slices

#: starts that are decided together
BLOCK = 24
#: bytes at the front of a position that choose the sample
GRAM = 16
#: bytes of a text that are hashed at once
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_KEY = ["h1", "h2"]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefixes:
    """Hashes of any substring of a piece of text, from running sums of a polynomial modulo 2**64."""

    _up = _powers(_BASE, 1 << 12)
    _down = _powers(pow(_BASE, -1, 1 << 64), 1 << 12)

    def __init__(self, piece: np.ndarray):
        n = len(piece)
        if n >= len(Prefixes._up):
            Prefixes._up, Prefixes._down = _powers(_BASE, 2 * n), _powers(pow(_BASE, -1, 1 << 64), 2 * n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * Prefixes._up[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, size: int, salt: np.ndarray | int = 0) -> np.ndarray:
        return _mixed((self.sums[start + size] - self.sums[start]) * Prefixes._down[start] + np.asarray(salt).astype(np.uint64))


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every window of ``width`` values."""
    done = 1
    while 2 * done <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


class Sampled:
    """A piece of a text: for each start in it, the sampled position that its first ``length`` bytes choose.

    That is the leftmost position of the smallest hash of GRAM bytes among the
    first ``reach`` positions, so it depends on those bytes alone: equal
    strings choose equal places, and a string of ``length`` bytes holds the
    ``key`` bytes behind its place.
    """

    def __init__(self, piece: np.ndarray, length: int):
        self.key = max(1, length * 8 // 25)
        reach = length - self.key
        n = len(piece)
        self.hashes = Prefixes(piece)
        front = self.hashes.at(np.arange(n - self.key + 1), min(GRAM, self.key))
        low = _slide(front, reach, np.minimum)[: n - length + 1]
        edge = np.zeros(reach - 1, np.uint64)
        chosen = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), reach, np.maximum)[: len(front)] == front[: len(low) + reach - 1])
        values, rank = np.unique(front[chosen], return_inverse=True)
        ordered = np.sort(rank.astype(np.int64) * (n + 1) + chosen)
        wanted = np.searchsorted(values, low).astype(np.int64) * (n + 1) + np.arange(len(low))
        self.place = ordered[np.searchsorted(ordered, wanted)] % (n + 1)


def _pieces(text: bytes, length: int, chunk: int | None = None) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(offset, first start, end of starts, bytes) of the pieces of a text; starts are offsets in the piece."""
    data, chunk = np.frombuffer(text, np.uint8), chunk or CHUNK
    for at in range(0, max(0, len(data) - length + 1), chunk):
        before = max(0, at - BLOCK)
        piece = data[before : at + chunk + 2 * length]
        yield before, at - before, min(at - before + chunk, len(piece) - length + 1, len(data) - length + 1 - before), piece


def _spans(marks: np.ndarray, length: int) -> np.ndarray:
    """Maximal covered runs (start, end) from ranges (first, last) of starts."""
    marks = marks[np.argsort(marks[:, 0], kind="stable")]
    ends = np.maximum.accumulate(marks[:, 1] + length)
    new = np.append(True, marks[1:, 0] > ends[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(marks) - 1)
    return np.column_stack([marks[new, 0], ends[last]])


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    sizes = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat).cast(kind))


def _rows(batch: pa.RecordBatch, counts: list[int], columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """The text keys of a slice repeated, beside flat columns."""
    owner = pa.array(np.repeat(np.arange(batch.num_rows), counts))
    keys = [batch.column(k).take(owner) for k in _KEY]
    return pa.RecordBatch.from_arrays([*keys, *map(pa.array, columns)], names=[*_KEY, *names])


def _seen_twice(rows: DataFrame, name: str) -> DataFrame:
    """Names that occur at two places or more; ``o`` is the place. Two longs per name and task are shuffled."""
    return rows.groupBy(name).agg(F.min("o").alias("_low"), F.max("o").alias("_high")).where("_low < _high").select(name)


def hashed_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """Add ``text`` bytes (null: empty) and the two hashes by which equal texts are known."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return docs.withColumn("text", text).withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), F.crc32("text"), F.length("text")))


def repeated_spans(docs: DataFrame, work: Workspace, text_col: str = "text", length: int = 400) -> DataFrame:
    """(h1, h2, spans) of every text with bytes under a repeated string of ``length`` bytes; spans are byte offsets.

    1. Equal texts are one (``hashed_texts``); of one with copies and
       ``length`` bytes or more everything is covered.
    2. The places that starts choose (``Sampled``) are named by the bytes
       behind them. Only texts with a name seen twice go on.
    3. Starts of one place are taken in blocks. A block has a name for what
       all its strings share and one for what they span together. The first
       unique: none repeats. The second repeated: all do.
    4. The starts of other blocks are named one by one by their ``length`` bytes.

    Names are 64-bit hashes, counted with map-side combined minima and
    maxima: a passage in a third of all documents is one name. Texts longer
    than a mebibyte are hashed piece by piece; a block that a border cuts is
    two rows of one place.
    """
    chunk = CHUNK
    texts = hashed_texts(docs.select(F.col(text_col).alias("_t")), "_t").select("text", *_KEY)
    keys = f"{_KEY[0]} long, {_KEY[1]} long"

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per slice: the places of its texts, and its distinct names with the least and the largest place of each."""
        number = TaskContext.get().partitionId() << 32
        for part in text_slices(batches, limit=1 << 20):
            names, counts, at = [], [], []
            for text in part.column("text").to_pylist():
                found = 0
                for offset, first, end, piece in _pieces(text, length, chunk):
                    s = Sampled(piece, length)
                    place = np.unique(s.place[first:end])
                    names.append(s.hashes.at(place, s.key).view(np.int64))
                    at.append(place + offset)
                    found += len(place)
                counts.append(found)
            if names:
                name, spot = np.concatenate(names), np.concatenate(at)
                h1, h2 = (np.repeat(part.column(k).to_numpy(), counts) for k in _KEY)
                whole = _mixed(h1.view(np.uint64) ^ _mixed(h2.view(np.uint64) + _mixed(spot.astype(np.uint64)))).view(np.int64)
                order = np.lexsort((whole, name))
                edge = np.flatnonzero(np.append(True, name[order][1:] != name[order][:-1]))
                last = np.append(edge[1:], len(name)) - 1
                lists = [name, h1, h2, spot, name[order][edge], whole[order][edge], whole[order][last]]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *(_lists([x], pa.int64()) for x in lists)], names=slice_names)
                number += 1

    slice_names = ["slice", "names", *_KEY, "at", "name", "low", "high"]
    sampled = work.write(arrow_map(texts, places, "slice long, " + ", ".join(f"{c} array<long>" for c in slice_names[1:])))
    # equal names of a slice are one row, so a passage in many documents is a few rows a task
    parts = sampled.select("slice", F.explode(F.arrays_zip("name", "low", "high")).alias("p")).select("slice", "p.*")
    again = parts.groupBy("name").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("name")
    named = parts.select("slice", "name").join(again, "name").groupBy("slice").agg(F.collect_list("name").alias("again"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                names, h1, h2, at, seen = (batch.column(k)[row].values.to_numpy() for k in ("names", *_KEY, "at", "again"))
                kept = np.isin(names, seen)
                h1, h2, at = h1[kept], h2[kept], at[kept]
                edge = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
                groups = [np.unique(x) for x in np.split(at, edge[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(h1[edge]), pa.array(h2[edge]), _lists(groups, pa.int64())], names=[*_KEY, "at"])

    picked = arrow_map(sampled.select("slice", "names", *_KEY, "at").join(named, "slice"), pick, f"{keys}, at array<long>")
    open_places = work.write(picked.dropDuplicates(_KEY))  # copies of a text have the same places
    chosen = texts.join(small_side(open_places.select(*_KEY)), _KEY, "left_semi").dropDuplicates(_KEY)
    open_texts = work.write(chosen.join(open_places, _KEY).select(*_KEY, "text", "at"))
    work.drop(sampled)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            counts, columns = [], [[], [], [], [], []]
            for text, at in zip(part.column("text").to_pylist(), part.column("at"), strict=True):
                found = 0
                wanted = np.sort(at.values.to_numpy())
                for offset, first, end, piece in _pieces(text, length, chunk):
                    s = Sampled(piece, length)
                    start = np.arange(first, end)
                    place = s.place[start]
                    near = np.minimum(np.searchsorted(wanted, place + offset), len(wanted) - 1)
                    here = wanted[near] == place + offset
                    start, place = start[here], place[here]
                    if not len(start):
                        continue
                    block = (place - start) // BLOCK
                    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (block[1:] != block[:-1]) | (np.diff(start) != 1)))
                    low, high = start[new], start[np.append(new[1:], len(start)) - 1]
                    top = place[new] - block[new] * BLOCK  # the last start that the block can have
                    salt = block[new] + 1
                    shared = s.hashes.at(top, length - BLOCK + 1, salt)
                    inside = (top - BLOCK + 1 >= 0) & (top + length <= len(piece))
                    # a span that leaves the text is named by its own place: never seen twice
                    lone = s.hashes.at(low, length, -salt) ^ (np.uint64(offset) + low.astype(np.uint64)) * np.uint64(_BASE) ^ np.uint64(part.column("h1")[len(counts)].as_py() & (1 << 64) - 1)
                    span = np.where(inside, s.hashes.at(np.where(inside, top - BLOCK + 1, 0), min(length + BLOCK - 1, len(piece)), salt), lone) if len(piece) >= length + BLOCK - 1 else lone
                    for column, values in zip(columns, (low + offset, high + offset, top + offset, shared.view(np.int64), span.view(np.int64)), strict=True):
                        column.append(values)
                    found += len(low)
                counts.append(found)
            if columns[0]:
                yield _rows(part, counts, [np.concatenate(c) for c in columns], ["low", "high", "top", "shared", "span"])

    cut = arrow_map(open_texts, blocks, f"{keys}, low long, high long, top long, shared long, span long")
    named = cut.select("shared", "span", F.xxhash64(*_KEY, "top").alias("o"))
    flagged = work.write(
        cut.join(_seen_twice(named, "shared"), "shared", "left_semi")
        .join(_seen_twice(named, "span").withColumn("whole", F.lit(True)), "span", "left")
        .select(*_KEY, "low", "high", "shared", "span", F.coalesce("whole", F.lit(False)).alias("whole"), F.xxhash64(*_KEY, "top").alias("o"))
    )
    undecided = flagged.where("NOT whole")
    # a start of an undecided block can repeat inside a decided one: one decided block of each span stands for all
    probes = flagged.where("whole").join(undecided.select("shared").distinct(), "shared", "left_semi").groupBy("span").agg(F.min("o").alias("o"))
    probed = flagged.where("whole").join(probes.select("o"), "o", "left_semi")
    ranges = [*_KEY, "low", "high"]
    marked = undecided.select(*ranges).union(probed.select(*ranges)).groupBy(*_KEY).agg(F.collect_list(F.struct("low", "high")).alias("marks"))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            counts, at, names = [], [], []
            for text, marks in zip(part.column("text").to_pylist(), part.column("marks"), strict=True):
                low, high = (marks.values.field(k).to_numpy().tolist() for k in ("low", "high"))
                each = np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high, strict=True)])
                found = 0
                for offset, first, end, piece in _pieces(text, length, chunk):
                    here = each[(each >= offset + first) & (each < offset + end)]
                    at.append(here)
                    names.append(Prefixes(piece).at(here - offset, length).view(np.int64))
                    found += len(here)
                counts.append(found)
            if at:
                yield _rows(part, counts, [np.concatenate(at), np.concatenate(names)], ["at", "name"])

    single = work.write(arrow_map(open_texts.drop("at").join(marked, _KEY), starts, f"{keys}, at long, name long"))
    twice = _seen_twice(single.select("name", F.xxhash64(*_KEY, "at").alias("o")), "name")
    hits = single.join(twice, "name", "left_semi").select(*_KEY, F.struct(F.col("at").alias("low"), F.col("at").alias("high")).alias("mark"))
    wholes = flagged.where("whole").select(*_KEY, F.struct("low", "high").alias("mark"))
    found = wholes.union(hits).groupBy(*_KEY).agg(F.collect_list("mark").alias("marks"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                _spans(np.column_stack([m.values.field(k).to_numpy() for k in ("low", "high")]), length).tolist()
                for m in batch.column("marks")
            ]
            column = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in _KEY), column], names=[*_KEY, "spans"])

    spans = arrow_map(found, merge, f"{keys}, spans array<struct<start:bigint,end:bigint>>")
    copied = (
        texts.select(*_KEY, F.length("text").cast("long").alias("n")).groupBy(*_KEY, "n").agg(F.count("*").alias("copies"))
        .where(f"copies > 1 AND n >= {length}")
        .select(*_KEY, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))).alias("spans"))
    )
    kept = work.write(spans.join(copied, _KEY, "left_anti").union(copied))
    work.drop(open_places, open_texts, flagged, single)
    return kept


def _to_character(at: Column, step: int) -> Column:
    """The border of a character at the byte offset ``at`` of ``_bytes``, or the nearest one on (step 1) or back (step -1)."""

    def inside(moved: Column) -> Column:  # the byte goes on with a character: 0x80 to 0xBF
        return F.substring(F.hex(F.substring("_bytes", (moved + 1).cast("int"), 1)), 1, 1).isin("8", "9", "A", "B")

    steps = F.when(~inside(at), 0).when(~inside(at + step), 1).when(~inside(at + 2 * step), 2).otherwise(3)
    return at + step * steps


def remove_repeats(docs: DataFrame, work: Workspace, text_col: str = "text", length: int = 400, characters: bool = False) -> DataFrame:
    """The documents with two more columns: ``_kept`` (bytes of the text without every covered byte) and ``_spans``.

    A byte goes if a string of ``length`` bytes over it also starts anywhere
    else, in the same document or another; strings are judged on the input,
    so of copies none stays. Null and empty texts keep empty bytes and have no
    spans; texts shorter than ``length`` stay whole; repeated rows count as
    copies of each other; all columns and rows are returned, but for columns
    named ``_kept`` or ``_spans``, which the new ones replace. With
    ``characters`` the rest of a character that a cut goes through goes too.
    """
    spans = repeated_spans(docs, work, text_col, length)
    inner = hashed_texts(docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("_kept", "_spans")]).alias("_row"), F.col(text_col).alias("_t")), "_t").drop("_t")
    weight = F.lit(48) + 24 * F.size("spans")
    joined = inner.join(small_side(spans, weight), _KEY, "left").select("_row", F.col("text").alias("_bytes"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("_spans"))
    ends = F.transform("_spans", lambda s: s["end"])
    begins = F.transform("_spans", lambda s: s["start"])
    # what stays: from each end to the next begin
    if characters:
        ends, begins = F.transform(ends, lambda at: _to_character(at, 1)), F.transform(begins, lambda at: _to_character(at, -1))
    pieces = F.zip_with(
        F.concat(F.array(F.lit(0).cast("long")), ends), F.concat(begins, F.array(F.length("_bytes").cast("long"))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    joined = joined.select("_row", "_bytes", "_spans", pieces.alias("_pieces"))
    kept = F.aggregate(
        "_pieces", F.lit(b"").cast("binary"), lambda done, p: F.concat(done, F.substring("_bytes", (p["a"] + 1).cast("int"), F.greatest(p["b"] - p["a"], F.lit(0)).cast("int")))
    )
    return joined.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in ("_kept", "_spans")], F.when(F.size("_spans") == 0, F.col("_bytes")).otherwise(kept).alias("_kept"), "_spans")
