"""Byte-pair merges of many words at once, in vectorised rounds."""

from __future__ import annotations

import numpy as np

#: rank of a pair that does not merge
NEVER = np.int32(2**31 - 1)


class PairTable:
    """Which pairs of symbols merge: rank (lower merges first) and the symbol that the pair becomes.

    Keys stand in hash tables of growing depth: a pair whose place is taken in
    one stands in the next, so an empty place ends a look-up.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, bits: int = 20):
        self.keys = np.asarray(left, np.uint64) << np.uint64(32) | np.asarray(right, np.uint64)
        self.rank, self.merged = np.asarray(rank, np.int32), np.asarray(merged, np.int32)
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        self.shift = np.uint64(64 - bits)
        waiting = np.arange(len(self.keys))
        salt = 0x9E3779B97F4A7C15
        while len(waiting) or not self.tables:
            table = np.full(1 << bits, -1, np.int32)
            place = (self.keys[waiting] * np.uint64(salt)) >> self.shift
            table[place] = waiting
            self.tables.append((np.uint64(salt), table))
            waiting = waiting[table[place] != waiting]
            salt = (salt * 0xD1342543DE82EF95 + 2) % (1 << 64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of each pair, -1 if it does not merge."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        return self._look(0, keys)

    def _look(self, depth: int, keys: np.ndarray) -> np.ndarray:
        salt, table = self.tables[depth]
        found = table[(keys * salt) >> self.shift]
        other = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        if len(other):
            found[other] = self._look(depth + 1, keys[other]) if depth + 1 < len(self.tables) else -1
        return found


def merge_rounds(symbols: np.ndarray, borders: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every word ``symbols[borders[i]:borders[i + 1]]`` until no pair is left; (symbols, borders) of the results.

    The result is that of merging one pair after the other, the lowest rank of
    a word first and of equal ranks the leftmost. A round finds the least rank
    of each word by a segmented minimum and merges all its places at once,
    leftmost first where they overlap; words without a pair leave the arrays.
    If a merge would make a pair of the same or a lower rank, which has to go
    before the word's other places, only the leftmost place of that word is
    merged in the round.
    """
    sizes = np.diff(borders)
    out_sizes = sizes.copy()
    done: list[tuple[np.ndarray, np.ndarray]] = []  # (words, their symbols)
    word = np.flatnonzero(sizes > 0)
    size = sizes[word]
    sym = np.asarray(symbols, np.int32)[borders[0] : borders[-1]]
    start = np.cumsum(size) - size
    last = start + size - 1
    pair = pairs.find(sym, np.append(sym[1:], 0)) if len(sym) else np.zeros(0, np.int32)
    pair[last] = -1
    rank = np.where(pair >= 0, pairs.rank[pair], NEVER) if len(pairs.rank) else np.full(len(pair), NEVER)
    while len(word):
        least = np.minimum.reduceat(rank, start)
        open_ = least < NEVER
        if not open_.all():
            keep = np.repeat(open_, size)
            gone = ~open_
            out_sizes[word[gone]] = size[gone]
            done.append((word[gone], sym[~keep]))
            word, size, least = word[open_], size[open_], least[open_]
            if not len(word):
                break
            sym, pair, rank = sym[keep], pair[keep], rank[keep]
            start = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(word)), size)
        at = np.flatnonzero(rank == least[owner])
        # of places that overlap, every other one from the left
        linked = np.append(False, np.diff(at) == 1)
        if linked.any():
            head = np.flatnonzero(~linked)
            run = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
            at = at[run % 2 == 0]
        at = _unless_early(at, owner, sym, pair, least, pairs)
        # the pair becomes one symbol
        sym[at] = pairs.merged[pair[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, pair, owner = sym[keep], pair[keep], owner[keep]
        at -= np.arange(len(at))
        size = size - np.bincount(np.searchsorted(start, at + np.arange(len(at)), "right") - 1, minlength=len(size))
        start = np.cumsum(size) - size
        rank = rank[keep]
        # pairs that a new symbol is part of
        look = np.concatenate([at, at[at > 0] - 1])
        right = np.minimum(look + 1, len(sym) - 1)
        fresh = pairs.find(sym[look], sym[right])
        fresh[(right == look) | (owner[look] != owner[right])] = -1
        pair[look] = fresh
        rank[look] = np.where(fresh >= 0, pairs.rank[fresh], NEVER)
    return _gather(done, out_sizes)


def _unless_early(at: np.ndarray, owner: np.ndarray, sym: np.ndarray, pair: np.ndarray, least: np.ndarray, pairs: PairTable) -> np.ndarray:
    """The places that may merge together: all, or the leftmost of a word where a merge makes a pair of no higher rank."""
    words = owner[at]
    several = np.append(words[1:] == words[:-1], False) | np.append(False, words[1:] == words[:-1])
    if not several.any():
        return at
    many, own = at[several], words[several]
    made = pairs.merged[pair[many]]
    beside = np.append(False, np.diff(many) == 2)  # the merge before ends where this one begins
    left = np.where(beside, np.append(0, made[:-1]), sym[np.maximum(many - 1, 0)])
    left_ok = beside | ((many > 0) & (owner[np.maximum(many - 1, 0)] == own))
    end = np.minimum(many + 2, len(sym) - 1)
    right_ok = (many + 2 < len(sym)) & (owner[end] == own)
    early = np.zeros(len(many), bool)
    for ok, a, b in ((left_ok, left, made), (right_ok, made, sym[end]), (beside, sym[np.maximum(many - 1, 0)], made)):
        found = pairs.find(a, b)
        early |= ok & (found >= 0) & (pairs.rank[found] <= least[own])
    if not early.any():
        return at
    stop = np.zeros(len(least), bool)
    stop[own[early]] = True
    return at[~stop[words] | np.append(True, words[1:] != words[:-1])]


def _gather(done: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that were finished in different rounds, in their first order."""
    borders = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = np.zeros(int(borders[-1]), np.int32)
    for words, symbols in done:
        own = sizes[words]
        ends = np.cumsum(own)
        out[np.arange(len(symbols)) + np.repeat(borders[words] - (ends - own), own)] = symbols
    return out, borders
