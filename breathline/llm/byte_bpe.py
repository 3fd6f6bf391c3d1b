"""Byte-level BPE: encoding by a rank queue made of a hierarchical bitmap, and decoding."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from breathline.llm.shared import Memo, arrow_map, coded_parts, ragged_take, text_slices

#: bits of one bitmap word; the upper level has one word for every FANOUT ranks
FANOUT = 256
#: longer pre-tokens are merged one by one and not remembered
LONG = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file with lines of base64 text and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Merges:
    """Ranks of token pairs, and the merging of one pre-token by them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = [ranks.get(bytes([b]), 0) for b in range(256)]
        #: (left id << 32 | right id) -> id of both together
        self.pairs = {
            ranks[token[:cut]] << 32 | ranks[token[cut:]]: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        }
        self.pair_keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(self.pair_keys)
        self.pair_keys = self.pair_keys[order]
        self.pair_values = np.fromiter(self.pairs.values(), np.int64, len(self.pairs))[order]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where there is none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_values[at], -1)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """``merge`` for many short pre-tokens at once, ids packed: they share one linked list and one queue.

        Pre-tokens do not touch each other, so a bucket is worked off for all
        of them in one step: per pre-token its leftmost position. The others
        stay in the bucket, since that merge may have made a lower rank.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(sizes.sum())
        owner = np.append(np.repeat(np.arange(len(pieces)), sizes), -1)
        ids = np.append(np.asarray(self.byte_ids)[np.frombuffer(b"".join(pieces), np.uint8)], 0)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        now = np.full(n + 1, -1)
        at = np.flatnonzero(owner[:-1] == owner[1:])
        now[at] = self.ranks_of(ids[at], ids[at + 1])
        at = at[now[at] >= 0]
        at = at[np.argsort(now[at], kind="stable")]
        ranks, cuts = np.unique(now[at], return_index=True)
        buckets = dict(zip(ranks.tolist(), np.split(at, cuts[1:]), strict=True)) if len(at) else {}
        added: dict[int, list[int]] = {}
        top, words = 0, {}
        for rank in buckets:
            group = rank // FANOUT
            words[group] = words.get(group, 0) | 1 << rank % FANOUT
            top |= 1 << group
        while top:
            group = (top & -top).bit_length() - 1
            word = words[group]
            rank = group * FANOUT + (word & -word).bit_length() - 1
            p = buckets.pop(rank, None)
            if rank in added:
                more = np.asarray(added.pop(rank))
                p = np.unique(more if p is None else np.concatenate([p, more]))
            p = p[now[p] == rank]  # the others are stale
            if len(p) > 1:
                own = owner[p]
                first = np.append(True, own[1:] != own[:-1])
                if not first.all():
                    buckets[rank] = p[~first]
                    p = p[first]
            if rank not in buckets:
                word &= word - 1
                words[group] = word
                if not word:
                    top &= top - 1
            if not len(p):
                continue
            gone = after[p]
            end = after[gone]
            ids[p], after[p], now[gone], now[p] = rank, end, -1, -1
            left, own = before[p], owner[p]
            right_is, left_is = owner[end] == own, owner[left] == own
            before[end[right_is]] = p[right_is]
            lefts = np.concatenate([left[left_is], p[right_is]])
            fresh = self.ranks_of(ids[lefts], ids[np.concatenate([p[left_is], end[right_is]])])
            now[lefts] = fresh
            for new, position in zip(fresh.tolist(), lefts.tolist(), strict=True):
                if new >= 0:
                    waiting = added.get(new)
                    if waiting is not None:
                        waiting.append(position)
                        continue
                    added[new] = [position]
                    if new not in buckets:
                        group = new // FANOUT
                        words[group] = words.get(group, 0) | 1 << new % FANOUT
                        top |= 1 << group
        # tokens that are left: the starts that no merge has swallowed
        start = np.cumsum(sizes) - sizes
        heads = np.zeros(n + 1, bool)
        heads[start[sizes > 0]] = True
        at = np.flatnonzero(heads[:n])
        while len(at):
            at = after[at]
            at = at[(at < n) & ~heads[np.minimum(at, n)]]
            heads[at] = True
        flat = ids[:n][heads[:n]].astype(np.uint32).tobytes()
        borders = np.concatenate([[0], np.cumsum(heads[:n])])
        ends = borders[start + sizes].tolist()
        return [flat[4 * a : 4 * b] for a, b in zip(borders[start].tolist(), ends, strict=True)]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: the pair of lowest rank merges first, of equal ranks the leftmost.

        Waiting pairs stand in a bucket per rank, by the start of their left
        token; tokens are a linked list of starts. Two bitmap levels say which
        buckets are filled: the lowest set bit of ``top`` names a group of
        ranks, the lowest set bit of the group's word the rank. So the next
        rank costs two find-first-set steps however many pairs wait. An entry
        is stale if the pair that starts there has another rank by now
        (``now``); it is skipped. A bucket is a heap: leftmost first.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, pair_rank, byte_ids = len(piece), self.pairs.get, self.byte_ids
        ids = [byte_ids[b] for b in piece]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        now: list[int | None] = [None] * n
        top, words, buckets = 0, {}, {}
        for p in range(n - 1):
            rank = pair_rank(ids[p] << 32 | ids[p + 1])
            if rank is not None:
                now[p] = rank
                bucket = buckets.get(rank)
                if bucket:
                    bucket.append(p)  # ascending, so still a heap
                else:
                    buckets[rank] = [p]
                    group = rank // FANOUT
                    words[group] = words.get(group, 0) | 1 << rank % FANOUT
                    top |= 1 << group
        while top:
            group = (top & -top).bit_length() - 1
            word = words[group]
            rank = group * FANOUT + (word & -word).bit_length() - 1
            bucket = buckets[rank]
            p = heappop(bucket) if len(bucket) > 1 else bucket.pop()
            if not bucket:
                word &= word - 1
                words[group] = word
                if not word:
                    top &= top - 1
            if now[p] != rank:
                continue
            gone = after[p]
            end = after[gone]
            ids[p], after[p], now[p], now[gone] = rank, end, None, None
            if end < n:
                before[end] = p
            for left, right in ((before[p], p), (p, end)):
                if left >= 0 and right < n:
                    fresh = pair_rank(ids[left] << 32 | ids[right])
                    now[left] = fresh
                    if fresh is not None:
                        bucket = buckets.get(fresh)
                        if bucket:
                            heappush(bucket, left)
                        else:
                            buckets[fresh] = [left]
                            group = fresh // FANOUT
                            words[group] = words.get(group, 0) | 1 << fresh % FANOUT
                            top |= 1 << group
        found, p = [], 0
        while p < n:
            found.append(ids[p])
            p = after[p]
        return found


class ByteBpe:
    """Encoder and decoder of one rank file and one pre-token pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks = read_ranks(ranks_path)
        self.merges = Merges(self.ranks)
        self.pattern = regex.compile(pattern)
        by_id = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.sizes = np.fromiter(map(len, by_id), np.int64, len(by_id))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(by_id), np.uint8)
        self.tokens: dict[str, bytes] = {}
        self.memo = Memo(self.encode_words)

    def merged(self, token: str) -> bytes:
        return array("I", self.merges.merge(token.encode())).tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of many parts of texts; short pre-tokens not met before are merged together."""
        found = [self.pattern.findall(w) for w in words]
        new = {t for tokens in found for t in tokens} - self.tokens.keys()
        short = [t for t in new if len(t) <= LONG]
        if len(self.tokens) + len(short) > 300_000:
            self.tokens.clear()
            short = list({t for tokens in found for t in tokens if len(t) <= LONG})
        self.tokens.update(zip(short, self.merges.merge_many([t.encode() for t in short]), strict=True))
        known, merged = self.tokens, self.merged
        return [b"".join([known[t] if t in known else merged(t) for t in tokens]) for tokens in found]

    def encode_text(self, text: str) -> bytes:
        """Packed ids of one text."""
        ids, tokens = [], self.tokens
        for match in self.pattern.findall(text):
            known = tokens.get(match)
            if known is None:
                known = self.merged(match)
                if len(match) <= LONG:
                    tokens[match] = known
            ids.append(known)
        return b"".join(ids)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the borders of the texts in it.

        Texts are cut at single spaces: where no part is empty or begins or
        ends with white space, the pattern never matches across such a cut
        other than by taking the space to the part behind it. So equal parts
        have equal ids and are encoded once. Texts with other white space are
        encoded in one piece.
        """
        texts = pc.fill_null(texts, "")
        parts, codes, borders = coded_parts(pc.split_pattern(texts, " "), keep_empty=True)
        odd = np.fromiter((not w or w[0].isspace() or w[-1].isspace() for w in parts), bool, len(parts))
        odd_before = np.concatenate([[0], np.cumsum(odd[codes])])
        plain = odd_before[borders[1:]] == odd_before[borders[:-1]]
        rows = np.repeat(np.arange(len(plain)), np.diff(borders))
        first = np.zeros(len(codes), bool)
        first[borders[:-1]] = True  # every text has a part
        inner = codes[plain[rows] & ~first]
        used = np.unique(inner)
        place_of = np.zeros(len(parts), np.int64)
        place_of[used] = self.memo.places([" " + parts[c] for c in used.tolist()])
        lengths = np.zeros(len(codes), np.int64)
        starts = np.zeros(len(codes), np.int64)
        at = plain[rows] & ~first
        lengths[at], starts[at] = self.memo.length[place_of[codes[at]]], self.memo.start[place_of[codes[at]]]
        pool = self.memo.pool
        extra: list[bytes] = []
        base = added = self.memo.used
        heads = borders[:-1]
        for row, (ok, head) in enumerate(zip(plain.tolist(), heads.tolist(), strict=True)):
            ids = self.encode_text(parts[codes[head]] if ok else texts[row].as_py())
            starts[head], lengths[head] = added, len(ids) // 4
            added += lengths[head]
            extra.append(ids)
        pool = np.concatenate([pool[:base], np.frombuffer(b"".join(extra), np.uint32)])
        ids = pool[ragged_take(starts, lengths)]
        return ids, np.concatenate([[0], np.cumsum(lengths)])[borders]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.pool[ragged_take(self.starts[ids], self.sizes[ids])].tobytes()


@lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str) -> ByteBpe:
    """One coder per Python worker; what it has learnt about words serves the worker's later tasks."""
    return ByteBpe(ranks_path, pattern)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, n_tokens, ids) per document: ids as little-endian unsigned 32-bit integers; null and empty texts have none.

    With ``digests`` the two SHA-256 digests (of the ids, and of the bytes
    that the ids decode to) are returned in place of the ids. One scan, no
    shuffle; a row depends on its text alone, so repeated rows and lost tasks
    need no care. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for part in text_slices(batches, limit=8 << 20):
            ids, borders = bpe.encode_column(part.column("text"))
            ids = ids.astype("<u4")
            pieces = [ids[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
            columns = [part.column("id"), pa.array(np.diff(borders))]
            if digests:
                columns += [
                    pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(p)).hexdigest() for p in pieces], pa.string()),
                ]
            else:
                columns.append(pa.array([p.tobytes() for p in pieces], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids"])]
    fields = f"`{id_col}` {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary")
    return arrow_map(docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), run, fields)


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes): the inverse of ``encode_texts``; null ids give empty bytes."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.binary())], names=[id_col, "bytes"])

    return arrow_map(encoded.selectExpr(f"`{id_col}` AS id", f"`{ids_col}` AS ids"), run, f"`{id_col}` {kind}, bytes binary")
