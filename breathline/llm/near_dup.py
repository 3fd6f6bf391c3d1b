"""Near-duplicate documents by banded MinHash, sequential Bayesian pruning and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breathline.llm.shared import Workspace, arrow_map, coded_words, connected_components, small_side, text_slices

#: bands and rows a band: a pair of similarity 0.8 shares no band with probability 7e-7
BANDS, ROWS = 60, 7
#: signature values compared by the pruning, in batches of STEP, eight bits each
COMPARED, STEP = 256, 32
#: bits of the parities by which pairs around a lead are ruled out
PARITY_BITS = 256
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words_each: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text, A-Z lower-cased; a shorter text is one shingle, an empty one none."""
    words, codes, borders = coded_words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))[codes]
    with np.errstate(over="ignore"):
        rolled = hashed[: max(0, len(hashed) - words_each + 1)].copy()
        for k in range(1, words_each):
            rolled = rolled * _PRIME + hashed[k : k + len(rolled)]
        rolled = _mix(rolled)
        found = []
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            if b - a >= words_each:
                found.append(np.unique(rolled[a : b - words_each + 1]))
            elif b > a:
                short = np.uint64(b - a)  # the length is part of it, so no full shingle is equal
                for h in hashed[a:b]:
                    short = short * _PRIME + h
                found.append(_mix(np.array([short ^ np.uint64(0xA5A5A5A5)])))
            else:
                found.append(hashed[:0])
    return found


class MinHash:
    """BANDS x ROWS minima of linear hashes of the shingles, band keys and short signatures."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        count = BANDS * ROWS
        self.factor = (rng.integers(0, 1 << 32, count, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.shift = rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)
        self.weights = rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
        self.salts = rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 256):
            np.minimum(low, (short[at : at + 256, None] * self.factor + self.shift).min(axis=0), out=low)
        return low

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            sums = (_mix(minima.astype(np.uint64).reshape(BANDS, ROWS) + self.weights) * self.weights).sum(axis=1, dtype=np.uint64)
            return _mix(sums + self.salts).view(np.int64)


def sketch(docs: DataFrame, id_col: str, text_col: str, words_each: int) -> DataFrame:
    """(id, text_key, n, node, signature, keys): hash of the text, set size, hash of the set, short signature, band keys; none for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash()
        for part in text_slices(batches):
            sets = shingle_sets(part.column("text"), words_each)
            nodes, signatures, keys = [], [], []
            for s in sets:
                if len(s):
                    low = hasher.minima(s)
                    nodes.append(set_node(s))
                    signatures.append(low[:COMPARED].astype(np.uint8).tobytes())
                    keys.append(hasher.band_keys(low))
                else:
                    nodes.append(None)
                    signatures.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()),
                    pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["id", "text_key", "n", "node", "signature", "keys"],
            )

    return arrow_map(_keyed_texts(docs, id_col, text_col), run, "id long, text_key long, n long, node long, signature binary, keys array<long>")


def set_node(shingles: np.ndarray) -> int:
    """By which a set is known: equal sets have one node, whatever the ids of their documents."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=1) - (1 << 63)


def _keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def least_matches(threshold: float, miss: float) -> list[int]:
    """For STEP, 2 STEP, .. compared values: the fewest matches for which P(similarity >= threshold) is still ``miss``.

    Uniform prior; eight-bit values of different minima agree by chance in one
    of 256 cases. The posterior tail is a binomial sum:
    P(Beta(m+1, n-m+1) > t) = P(Binomial(n+1, t) <= m).
    """
    t = threshold + (1 - threshold) / 256
    found = []
    for n in range(STEP, COMPARED + 1, STEP):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log(1 - t))
        found.append(m)
    return found


def prune_pairs(pairs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs (a, b, na, nb, sa, sb) whose signatures leave the threshold possible; later batches see only what earlier ones left."""
    least = least_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COMPARED) for c in ("sa", "sb"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            left = np.flatnonzero(np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)
            same = np.zeros(len(a), np.int64)
            for k, need in enumerate(least):
                cut = slice(k * STEP, (k + 1) * STEP)
                same[left] += (a[left, cut] == b[left, cut]).sum(axis=1)
                left = left[same[left] >= need]
            yield batch.select(["a", "b"]).take(pa.array(left))

    return arrow_map(pairs, run, "a long, b long")


def exact_links(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, xa, xb) of sorted shingle sets with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for row, (x, y) in enumerate(zip(batch.column("xa"), batch.column("xb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    good.append(row)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return arrow_map(pairs, run, "a long, b long")


def relate_to_lead(stars: DataFrame, percent: int) -> DataFrame:
    """(lead, id, comp, n, linked, differ, parity) of each set around a lead.

    Its size, whether it reaches the threshold with the lead's, the shingles
    that only one of both has, and for each of PARITY_BITS whether an odd number
    of its shingles falls on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, linked, differ, parity = [], [], [], []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                apart = np.setxor1d(x, y, assume_unique=True)
                n.append(len(y))
                linked.append((100 + percent) * len(apart) <= (100 - percent) * (len(x) + len(y)))
                differ.append(apart.view(np.int64))
                odd = np.bincount((y % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
                parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in ("lead", "id", "comp")), pa.array(n, pa.int64()), pa.array(linked, pa.bool_()),
                    pa.array(differ, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64())),
                ],
                names=["lead", "id", "comp", "n", "linked", "differ", "parity"],
            )

    schema = "lead long, id long, comp long, n long, linked boolean, differ array<long>, parity array<long>"
    return arrow_map(stars.select("lead", "id", "comp", "xa", "xb"), run, schema)


def open_pairs(stars: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) around one lead, of different components, that can still reach the threshold.

    With d shingles in which a set differs from the lead and o of them common to
    both, two sets differ in da + db - 2o shingles, which the threshold limits to
    q (na + nb), q = (100 - percent) / (100 + percent). So with x = d - q n a pair
    needs o >= (xa + xb) / 2. If that is 0 or less, both are linked with the lead.
    Else, rarest first, a common one is among the first q na + 1 of the set with
    the smaller x and the first q (na + nb) + 1 of the other, nb <= na 100 / percent.
    Copies edited in different places differ from the lead in different shingles,
    so a large group of them makes few pairs. Where parities differ there is a
    shingle that only one of both has, so their number too may not pass the limit.

    A pair is judged around one lead: the first of both sets, if it is the same,
    else any that they share. Sets of a star's most frequent component are only
    joined with others, so that a large group that is linked already is not
    joined with itself.
    """
    frequent = stars.groupBy("lead", "comp").agg(F.count("*").alias("f")).groupBy("lead").agg(F.max_by("comp", F.struct("f", "comp")).alias("most"))
    own = stars.groupBy("id").agg(F.min("lead").alias("home"))
    at = stars.join(own, "id")
    useful = at.groupBy("lead").agg(F.min("home").alias("low"), F.max("home").alias("high")).where("low < high OR low = lead").select("lead")
    at = at.join(useful, "lead", "left_semi").join(frequent, "lead").withColumn("other", F.expr("comp <> most"))
    of_set = ["id", "comp", "home", "other", "n", "d", "parity"]
    at = at.withColumn("d", F.size("differ").cast("long"))
    # alone, so that nothing else is shuffled with every shingle; those that no other set has come first and are not ranked
    items = at.select("lead", "id", F.explode("differ").alias("shingle"))
    often = items.groupBy("lead", "shingle").agg(F.count("*").alias("f")).where("f > 1")
    place = Window.partitionBy("lead", "id")
    common = items.join(often, ["lead", "shingle"]).select(
        "lead", "id", "shingle", F.row_number().over(place.orderBy("f", "shingle")).alias("rank"), F.count("*").over(place).alias("several")
    )
    q = f"{100 - percent} / {100 + percent}"
    ranked = common.join(at.select("lead", *of_set), ["lead", "id"]).withColumn("rank", F.expr("d - several + rank"))
    ranked = ranked.where(f"rank <= {q} * n * {100 + percent} / {percent} + 1").withColumn("x", F.expr(f"{100 + percent} * d - {100 - percent} * n"))
    a, b = (ranked.select("lead", "shingle", *[F.col(k).alias(f"{k}_{s}") for k in (*of_set, "rank", "x")]) for s in "ab")
    a = a.where(f"rank_a <= {q} * n_a + 1").withColumn("other", F.explode(F.when(F.col("other_a"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    # at the first common shingle, what both still have from it on limits o
    most = "(least(d_a - rank_a, d_b - rank_b) + 1)"
    odd = " + ".join(f"bit_count(parity_a[{k}] ^ parity_b[{k}])" for k in range(PARITY_BITS // 64))
    pairs = a.join(b.withColumnRenamed("other_b", "other"), ["lead", "shingle", "other"]).where(
        f"comp_a <> comp_b AND (home_a <> home_b OR home_a = lead) AND (x_a < x_b OR x_a = x_b AND id_a < id_b) "
        f"AND {100 + percent} * (d_a + d_b - 2 * {most}) <= {100 - percent} * (n_a + n_b) "
        f"AND {100 + percent} * ({odd}) <= {100 - percent} * (n_a + n_b)"
    )
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text",
    words_each: int = 5, percent: int = 80, miss: float = 1e-6,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) per document; components of documents linked by Jaccard similarity of shingle sets.

    1. Equal sets are one node, under the smallest id of its documents.
    2. Nodes that share a band key meet in a bucket. First each is compared
       with its bucket's smallest node, which joins most of a large group of
       near copies. Then pairs inside a bucket are compared if their
       components still differ and ``open_pairs`` cannot rule them out. No
       link between components is left out; more links inside a component
       change nothing.
    3. A pair is dropped as soon as the posterior probability of reaching the
       threshold, given the signature values compared so far, falls below
       ``miss``. What remains is verified on whole sets.

    Nulls and texts without words have empty sets and link with nothing. A
    null id takes part under no name: it is kept unless a document with an id
    is in its component. Repeated rows are one node; rows that share an id but
    not the text are judged each by its own text; other columns are not read;
    an empty table gives an empty result. Groups of copies are counted with
    map-side combined aggregates; buckets are only joined, so that a hot one
    can be split; nothing is collected.
    """
    return judged_documents(docs, work, id_col, text_col, words_each, percent, miss).select(id_col, "n_shingles", "component_id", "kept")


def judged_documents(
    docs: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text",
    words_each: int = 5, percent: int = 80, miss: float = 1e-6,
) -> DataFrame:
    """``near_duplicates`` with two more columns: ``text_key``, the hash of the text, and ``component``, a number per component."""
    threshold = percent / 100
    sketches = work.write(sketch(docs, id_col, text_col, words_each))
    leaders = work.write(sketches.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("leader")))
    led = sketches.join(leaders.select("node", F.col("leader").alias("id")), ["node", "id"], "left_semi").unionByName(
        sketches.where("id IS NULL").join(leaders.where("leader IS NULL").select("node"), "node", "left_semi")
    )
    keyed = led.select("node", F.explode("keys").alias("key"))
    firsts = keyed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    members = work.write(keyed.join(firsts.select("key", "first"), "key").select("key", F.col("node").alias("id"), "first"))
    busy = members.select(F.col("id").alias("node")).distinct()
    busy = work.write(led.select("node", "id", "text_key", "n", "signature").join(busy, "node", "left_semi").dropDuplicates(["node"]))
    signatures = busy.select(F.col("node").alias("id"), "n", "signature")
    of_busy = F.expr("id <=> busy_id AND text_key = busy_key")
    named = small_side(busy.select(F.col("id").alias("busy_id"), F.col("text_key").alias("busy_key")))
    texts = _keyed_texts(docs, id_col, text_col).join(named, of_busy, "left_semi").select("text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sets = [s for s in shingle_sets(part.column("text"), words_each) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"]
            )

    sets = work.write(arrow_map(texts, to_sets, "id long, shingles binary"))

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (signatures.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("signature").alias(f"s{s}")) for s in "ab")
        left = work.write(prune_pairs(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb"), threshold, miss))
        xa, xb = (sets.dropDuplicates(["id"]).select(F.col("id").alias(s), F.col("shingles").alias(f"x{s}")) for s in "ab")
        return work.write(exact_links(left.join(xa, "a").join(xb, "b").select("a", "b", "xa", "xb"), percent))

    tried = work.write(members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    links = verify(tried)
    known = work.write(connected_components(links, work))
    placed = work.write(
        members.join(known, "id", "left")
        .select("key", F.col("first").alias("lead"), "id", F.coalesce("component_id", "id").alias("comp"))
    )
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    stars = placed.join(mixed, "key").where("id <> lead").select("lead", "id", "comp").distinct()
    whole = sets.dropDuplicates(["id"])
    stars = stars.join(whole.select(F.col("id").alias("lead"), F.col("shingles").alias("xa")), "lead")
    related = work.write(relate_to_lead(stars.join(whole.select("id", F.col("shingles").alias("xb")), "id"), percent))
    rest = open_pairs(related, percent).join(tried, ["a", "b"], "left_anti")
    # what is linked already counts as one node from here on
    to_lead = related.where("linked").select(F.col("lead").alias("a"), F.col("comp").alias("b")).distinct()
    across = to_lead.union(verify(work.write(rest)))
    for side in "ab":
        root = known.select(F.col("id").alias(side), F.col("component_id").alias("_root"))
        across = across.join(root, side, "left").withColumn(side, F.coalesce("_root", side)).select("a", "b")
    merged = connected_components(across, work).select(F.col("id").alias("_root"), F.col("component_id").alias("_last"))
    of_node = work.write(
        leaders.join(known.select(F.col("id").alias("node"), F.col("component_id").alias("_root")), "node", "left")
        .withColumn("_root", F.coalesce("_root", "node")).join(merged, "_root", "left")
        .select("node", "leader", F.coalesce("_last", "_root").alias("component"))
    )
    work.drop(members, busy, sets, known, placed, related)
    smallest = of_node.groupBy("component").agg(F.min("leader").alias("component_id"))
    judged = sketches.select("id", "text_key", "n", "node").join(of_node.join(smallest, "component").select("node", "component", "component_id"), "node", "left")
    found = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return judged.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), found.alias("component_id"), "text_key", "component").withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull())
    )


def keep_one_of_each(docs: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row, with all columns, of each group of near copies: one of its smallest id, and texts without words all.

    Rows are told apart by id and text, so one of two texts under an id can go
    and the other stay. Of rows that repeat an id and a text one stays; so of
    null ids with equal texts. Null and empty texts stay, an empty table stays empty.
    """
    found = work.write(judged_documents(docs, work, id_col, text_col, **options))
    kept = found.where("kept").withColumn("component", F.coalesce("component", "text_key"))
    # more than one row of the smallest id: the texts with the smallest hash stay, one row of these
    several = work.write(kept.groupBy(id_col, "component").agg(F.count("*").alias("_n"), F.min("text_key").alias("_first")).where("_n > 1"))
    key = F.xxhash64(F.col(f"`{text_col}`"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), key.alias("_key"))
    columns = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    gone = found.where("NOT kept").select(F.col(id_col).alias("_gone"), "text_key").distinct()
    if several.isEmpty():
        return rows.join(small_side(gone), F.expr("_id <=> _gone AND _key = text_key"), "left_anti").select(*columns)
    same = F.col("k._of").eqNullSafe(F.col("s._of")) & (F.col("k.component") == F.col("s.component"))
    repeated = work.write(
        kept.withColumnRenamed(id_col, "_of").alias("k").join(several.withColumnRenamed(id_col, "_of").alias("s"), same)
        .select(F.col("k._of").alias("_gone"), F.col("k.text_key").alias("text_key"), (F.col("k.text_key") == F.col("s._first")).alias("_first")).distinct()
    )
    gone = gone.union(repeated.where("NOT _first").select("_gone", "text_key"))
    stay = rows.join(small_side(gone), F.expr("_id <=> _gone AND _key = text_key"), "left_anti")
    few = small_side(repeated.where("_first").select("_gone", "text_key"))
    match = F.expr("_id <=> _gone AND _key = text_key")
    one = stay.join(few, match, "left_semi").dropDuplicates(["_id", "_key"])
    return stay.join(few, match, "left_anti").unionByName(one).select(*columns)
