"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from breathline.llm.merge_rounds import PairTable, merge_rounds
from breathline.llm.shared import Memo, arrow_map, coded_words, text_slices


#: fixed values: the letters and digits of the Latin-1 page, how the tokenizer's file tells pieces apart, and its contractions
LETTER, NUMBER, OTHER, GAP = range(4)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _latin_kinds() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER, "Z": GAP, "C": GAP}
    return np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(256)], np.int8)


class WordTokenizer:
    """Ids of texts by a ``tokenizers`` file of the lower-casing, white-space-dropping kind, word by word.

    Such a tokenizer never merges across white space, so a word's ids do not
    depend on its neighbours. Words of printable Latin-1 characters (NFC leaves
    these as they are) are cut into pieces and merged together, in vectorised
    rounds by the file's merges; all others take the library's whole path.
    """

    PLAIN = re.compile("[!-~\xa1-\xac\xae-\xff]+")
    KINDS = _latin_kinds()
    LOWER = np.array([ord(chr(c).lower()) for c in range(256)], np.uint8)

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        # characters that stand for bytes in the vocabulary: printable ones for themselves, the others moved up
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        moved = [b for b in range(256) if b not in kept]
        shown = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[shown[b] + end] for b in range(256)], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = PairTable(*np.array([(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)], np.int64).reshape(-1, 4).T)
        self.memo = Memo(self.encode_words)

    def _piece_starts(self, points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Which Latin-1 characters begin a piece: runs of letters, single digits, runs of others, and contractions."""
        before = np.append(GAP, kinds[:-1])
        starts = (kinds != before) | (kinds == NUMBER)
        # an apostrophe that begins a piece takes the letters of a contraction with it; what follows is a piece of its own
        for at in np.flatnonzero(starts & (points == ord("'"))).tolist():
            for tail in CONTRACTIONS:
                if points[at + 1 : at + 1 + len(tail)].tobytes() == tail.encode():
                    starts[at + 1] = False
                    if at + 1 + len(tail) < len(points):
                        starts[at + 1 + len(tail)] = True
                    break
        return starts & (kinds != GAP)

    def _encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of printable Latin-1 characters, and the borders of the words."""
        points = self.LOWER[np.frombuffer(" ".join(words).encode("latin-1"), np.uint8)]
        kinds = self.KINDS[points]
        starts = self._piece_starts(points, kinds)
        space = points == 0x20
        piece = np.flatnonzero(starts)
        # bytes of the characters: two beyond ASCII
        sizes = np.where(space, 0, 1 + (points >= 0x80)).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        symbols = np.empty(int(at[-1]), np.int32)
        first = at[:-1][~space]
        chars = points[~space]
        wide = chars >= 0x80
        symbols[first] = self.inner[np.where(wide, 0xC0 | chars >> 6, chars)]
        symbols[first[wide] + 1] = self.inner[0x80 | chars[wide] & 0x3F]
        borders = np.append(at[piece], at[-1])
        ends = borders[1:] - 1
        final = points[np.append(piece[1:], len(points)) - 1]
        spaced = np.append(space[piece[1:] - 1], False)  # the character before the next piece is the gap between words
        final[spaced] = points[np.append(piece[1:], len(points))[spaced] - 2]
        symbols[ends] = self.last[np.where(final >= 0x80, 0x80 | final & 0x3F, final)]
        ids, id_at = merge_rounds(symbols, borders, self.pairs)
        word_piece = np.searchsorted(piece, np.concatenate([[0], np.flatnonzero(space) + 1, [len(points)]]))
        return ids, id_at[word_piece]

    def encode_words(self, words: list[str]) -> list[bytes]:
        plain = [i for i, w in enumerate(words) if self.PLAIN.fullmatch(w)]
        found: list[bytes] = [b""] * len(words)
        if plain:
            ids, ends = self._encode_plain([words[i] for i in plain])
            flat, cuts = ids.astype(np.uint32).tobytes(), (4 * ends).tolist()
            for i, a, b in zip(plain, cuts[:-1], cuts[1:], strict=True):
                found[i] = flat[a:b]
        if len(plain) < len(words):
            odd = [i for i, w in enumerate(words) if not self.PLAIN.fullmatch(w)]
            for i, coded in zip(odd, self.whole.encode_batch([words[i] for i in odd], add_special_tokens=False), strict=True):
                found[i] = array("I", coded.ids).tobytes()
        return found

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the borders of the texts in it; null and empty texts have none."""
        words, codes, borders = coded_words(texts)
        ids, lengths = self.memo.ids_of(words, codes)
        return ids, np.concatenate([[0], np.cumsum(lengths)])[borders]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker; what it has learnt about words serves the worker's later tasks."""
    return WordTokenizer(path)


def difference(sizes: np.ndarray, ways: int) -> np.ndarray:
    """Karmarkar-Karp differencing: the way (0 .. ways-1) of each item.

    A partial partition has a sum for each way, in falling order. The two with
    the largest difference between first and last sum merge, the largest sums
    of one with the smallest of the other, so that imbalances cancel. The
    merges form a tree; ways are handed down from its root.
    """
    n = len(sizes)
    if ways == 1 or not n:
        return np.zeros(n, np.int64)
    sums: dict[int, np.ndarray] = {}
    for i, size in enumerate(sizes.tolist()):
        sums[i] = np.zeros(ways, np.int64)
        sums[i][0] = size
    heap = [(-int(size), i) for i, size in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    tree: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        node = n + len(tree)
        tree.append((a, b, order))
        sums[node] = both
        heapq.heappush(heap, (int(both[-1] - both[0]), node))
    ways_of: dict[int, np.ndarray] = {heap[0][1]: np.arange(ways)}
    for k in range(len(tree) - 1, -1, -1):
        a, b, order = tree[k]
        given = np.empty(ways, np.int64)
        given[order] = ways_of.pop(n + k)  # by place before sorting
        ways_of[a], ways_of[b] = given, given[::-1]
    return np.fromiter((ways_of[i][0] for i in range(n)), np.int64, n)


def windows_for(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(window of each item, number of windows): as few as hold all; one more for as long as some window is too full."""
    total = int(sizes.sum())
    count = max(1, -(-total // capacity))
    while True:
        window = difference(sizes, count)
        if np.bincount(window, weights=sizes, minlength=count).max(initial=0) <= capacity:
            return window, count
        count += 1


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
    piece: int | None = None,
    group: int = 512,
) -> DataFrame:
    """Pieces of documents in windows of at most ``window`` tokens.

    Columns: id, start (tokens of the document before the piece), length, ids
    (little-endian unsigned 32-bit), doc_tokens (with the end id), sequence_id,
    offset (place in the sequence, without gaps from 0).

    Full windows are cut off the front of a document, each a sequence of its
    own. The rest is cut into pieces of at most ``piece`` (a quarter window)
    and waits; when ``group`` documents wait, their pieces are partitioned
    into near-equal windows, as few as hold them. All windows of a group are
    about equally full, so their padding adds up to less than one or two
    windows a group.

    Groups are formed inside a scan task, so nothing is shuffled, any number
    of rows may share an id, and no task holds more than a group and a slice
    of text. A lost task that is run again reads the same rows and forms the
    same groups. Null and empty texts are one piece (the end id). Repeated
    rows are packed as often as they occur; other columns are not read; an
    empty table has no pieces.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    piece = piece or max(1, window // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []  # (id, start, ids, doc_tokens)
        held = 0  # documents among them

        def settle() -> list[tuple]:
            nonlocal sequence
            sizes = np.fromiter((len(w[2]) for w in waiting), np.int64, len(waiting))
            place, count = windows_for(sizes, window)
            out = []
            order = np.argsort(place, kind="stable")
            last, offset = -1, 0
            for at in order.tolist():
                if place[at] != last:
                    last, offset = place[at], 0
                doc, start, ids, total = waiting[at]
                out.append((doc, start, ids, total, sequence + int(last), offset))
                offset += len(ids)
            sequence += count
            waiting.clear()
            return out

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, total, seq, offset = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, id_type), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(offset, pa.int64()),
                ],
                names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        id_type = pa.int64()
        for part in text_slices(batches):
            id_type = part.column("id").type
            flat, borders = coder.encode_column(part.column("text"))
            flat = flat.astype("<u4")
            rows: list[tuple] = []
            for doc, a, b in zip(part.column("id").to_pylist(), borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                ids = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                total = len(ids)
                start = 0
                while total - start >= window:
                    rows.append((doc, start, ids[start : start + window], total, sequence, 0))
                    sequence += 1
                    start += window
                while start < total:
                    cut = min(piece, total - start)
                    waiting.append((doc, start, ids[start : start + cut], total))
                    start += cut
                held += 1
                if held == group:
                    if waiting:
                        rows += settle()
                    held = 0
            if rows:
                yield batch(rows)
        if waiting:
            yield batch(settle())

    fields = f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return arrow_map(docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), run, fields)
