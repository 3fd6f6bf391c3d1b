"""What the operators have in common: tables in the shared folder, bounded Arrow batches, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breathline.session import use_checkpoint_dir

#: bytes of text that a Python task handles at once; a longer text is a slice of its own
SLICE_BYTES = 4 << 20
#: rows of an Arrow batch, so that a batch of long texts stays small
BATCH_ROWS = 256


class Workspace:
    """Tables written to the folder that driver and executors share.

    A written table cuts the lineage and survives lost executors. ``drop``
    deletes a table that no later step reads. Nothing is kept on one machine.
    """

    def __init__(self, spark: SparkSession, name: str):
        use_checkpoint_dir(spark)
        self.spark = spark
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._count = 0

    def write(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.folder}/{self._count}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self._paths.pop(id(table), None)
            if path:
                jvm = self.spark._jvm
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with small batches, so that long texts do not fill a worker."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def small_side(table: DataFrame, weight: Column | None = None, most: int = 48 << 20) -> DataFrame:
    """Hint a broadcast if the table has been weighed and is at most ``most`` bytes; a larger one is left to the planner's shuffle join.

    ``weight`` is the size of a row; without it the columns have a fixed width and count 24 bytes each.
    """
    weighed = table.agg(F.sum(F.lit(24 * len(table.columns)) if weight is None else weight)).first()[0]
    return F.broadcast(table) if (weighed or 0) <= most else table


def bounded_sample(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of ``keys``; repeatable, and of every part of the table.

    Rows are first thinned to about a quarter more than wanted, by their count,
    so that the tasks of a large table do not each offer ``most`` rows.
    """
    total = df.count()
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    if total > most:
        share = int(min(1.0, (1.25 * most + 100) / total) * 1_000_000)
        hashed = hashed.where(F.pmod("_hash", F.lit(1_000_003)) < share)
    return hashed.orderBy("_hash", *keys).limit(most).drop("_hash")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows that hold at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if row > start and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if len(sizes) > start:
            yield batch.slice(start)


def coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words between runs of ``[\\x20\\x09-\\x0D]``: the distinct words, a code per word, and the borders of the rows.

    Null and empty texts have no words.
    """
    return coded_parts(pc.ascii_split_whitespace(pc.fill_null(texts, "")))


def coded_parts(parts: pa.ListArray, keep_empty: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As ``coded_words``, for texts that are split already."""
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    borders = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values.slice(borders[0], borders[-1] - borders[0]).dictionary_encode()
    borders -= borders[0]
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not keep_empty and "" in words:
        full = codes != words.index("")
        borders = np.concatenate([[0], np.cumsum(full)])[borders]
        codes = codes[full]
    return words, codes, borders


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs ``starts[i] .. starts[i] + lengths[i]``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Memo:
    """Ids by word, filled by ``encode`` (words -> ids as packed unsigned 32-bit integers) for words not met before.

    When ``most`` words are held, those asked for once only are forgotten (all,
    if that leaves more than half).
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = 600_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.asked = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _thin(self) -> None:
        words = list(self.at)  # in the order of their places
        kept = np.flatnonzero(self.asked[: len(words)] > 1)
        if len(kept) > self.most // 2:
            self.clear()
            return
        lengths = self.length[kept]
        pool = self.pool[ragged_take(self.start[kept], lengths)]
        self.clear()
        self._add([words[i] for i in kept.tolist()], pool, lengths)

    def _add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, held = len(self.at), len(self.at) + len(words)
        if held > len(self.start):
            self.start, self.length, self.asked = (np.concatenate([x, np.zeros(2 * held - len(x), np.int64)]) for x in (self.start, self.length, self.asked))
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.used + len(ids)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[first:held] = self.used + np.cumsum(lengths) - lengths
        self.length[first:held] = lengths
        self.used += len(ids)
        self.at.update(zip(words, range(first, held), strict=True))

    def places(self, words: list[str]) -> np.ndarray:
        if len(self.at) + len(words) > self.most:
            self._thin()
        known = self.at
        new = [w for w in words if w not in known]
        if new:
            packed = self.encode(new)
            lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            self._add(new, np.frombuffer(b"".join(packed), np.uint32), lengths)
        places = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        self.asked[places] += 1
        return places

    def ids_of(self, words: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order, and how many each word has."""
        places = self.places(words)[codes]
        lengths = self.length[places]
        return self.pool[ragged_take(self.start[places], lengths)], lengths


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(id, component_id) of every node of ``edges`` (a, b): the smallest id that it can reach.

    Alternating large-star and small-star rounds; each round hangs neighbours
    on the smallest id known near them, so the number of rounds grows with the
    logarithm of the longest path. All steps are joins and map-side combined
    minima: no neighbour list is built and nothing but one count per round
    reaches the driver.
    """
    def nearest(links: DataFrame) -> DataFrame:
        return links.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))

    def state(links: DataFrame) -> tuple:
        """Count and checksums of a set of links: equal for equal sets, one row per task to the driver."""
        h = F.xxhash64("u", "v")
        return tuple(links.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 32))).first())

    links = work.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while before != (before := state(links)):
        # large star: larger neighbours move to the smallest neighbour
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours and the node itself move to the smallest neighbour
        low = nearest(large.where("u <> v"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        old, links = links, work.write(small)
        work.drop(old)
    roots = links.select(F.col("v").alias("id")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(
        roots.select("id", F.col("id").alias("component_id"))
    )
