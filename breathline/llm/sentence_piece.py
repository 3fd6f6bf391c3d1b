"""Encoding and decoding by a SentencePiece model of the BPE kind, without the library's encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from breathline.llm.merge_rounds import PairTable, merge_rounds
from breathline.llm.shared import Memo, arrow_map, coded_parts, ragged_take, text_slices

#: stands for a space in pieces (fixed value of the format)
SPACE = "▁"
#: characters beyond which a word is cut where no piece can cross
LONG = 256


class PieceModel:
    """Pieces and scores of a model file; the library reads the file and normalises, the merges are done here."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, count = self.library, self.library.vocab_size()
        pieces = [lib.id_to_piece(i) for i in range(count)]
        plain = [not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i)) for i in range(count)]
        self.size = count
        self.ids = {p: i for i, (p, ok) in enumerate(zip(pieces, plain, strict=True)) if ok}
        scores = np.array([lib.get_score(i) for i in range(count)])
        _, level = np.unique(-scores, return_inverse=True)
        known = self.ids.get
        found = [(a, b, level[i], i) for p, i in self.ids.items() for k in range(1, len(p)) if (a := known(p[:k])) is not None and (b := known(p[k:])) is not None]
        self.pairs = PairTable(*np.array(found, np.int64).reshape(-1, 4).T)
        # a character that is no piece is a symbol beyond the vocabulary
        self.symbol = np.arange(0x110000, dtype=np.int32) + count
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.byte_id = np.full(256, lib.unk_id(), np.int64)
        self.falls_back = False
        for i in range(count):
            if lib.is_byte(i):
                self.byte_id[int(pieces[i][1:-1], 16)] = i
                self.falls_back = True
        self._decoding(pieces, plain)
        self._spaces(pieces, plain, scores)
        inside = np.array(sorted({ord(a) << 21 | ord(b) for p, i in self.ids.items() for a, b in zip(p, p[1:], strict=False)}), np.int64)
        self.inside = inside
        self.memo = Memo(self.encode_words)

    def _decoding(self, pieces: list[str], plain: list[bool]) -> None:
        """Bytes of each id: spaces for their signs, the byte of a byte piece, nothing for control pieces."""
        lib = self.library
        shown = []
        for i, (p, ok) in enumerate(zip(pieces, plain, strict=True)):
            if ok:
                shown.append(p.replace(SPACE, " ").encode())
            elif lib.is_byte(i):
                shown.append(bytes([int(p[1:-1], 16)]))
            else:
                shown.append(lib.decode([i]).encode() if lib.is_unknown(i) else b"")
        self.shown_size = np.fromiter(map(len, shown), np.int64, len(shown))
        self.shown_start = np.cumsum(self.shown_size) - self.shown_size
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.is_byte = np.array([lib.is_byte(i) for i in range(self.size)])
        self.spaced = np.array([ok and p.startswith(SPACE) for p, ok in zip(pieces, plain, strict=True)])
        # the sign that the model puts before a text is taken off again
        self.prefixed = bool(plain) and lib.normalize("x") == SPACE + "x"
        text = [str(i).encode() + b"," for i in range(self.size)]
        width = max(map(len, text), default=1)
        self.digits = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in text), np.uint8).reshape(self.size, width)

    def _spaces(self, pieces: list[str], plain: list[bool], scores: np.ndarray) -> None:
        """How runs of space signs are cut into pieces, if texts can be cut at spaces.

        They can if a sign stands only at the front of pieces or in pieces of
        signs alone, and if the latter merge after all others. Then what is
        left of a run of signs merges by itself: the longest piece as often
        as it fits, then a rest by its length. That this is so is tried out
        on runs up to three times the longest piece.
        """
        runs = {len(p): i for p, i in self.ids.items() if not p.strip(SPACE)}
        most = max(runs, default=0)
        others = [scores[i] for p, i in self.ids.items() if len(p) > 1 and p.strip(SPACE)]
        self.cuts = (
            1 in runs
            and all(SPACE not in p[1:] for p in self.ids if p.strip(SPACE))
            and all(scores[i] < min(others, default=0) for n, i in runs.items() if n > 1)
        )
        if not self.cuts:
            return
        sizes = np.arange(3 * most + 1)
        merged, at = merge_rounds(np.full(sizes.sum(), runs[1], np.int32), np.concatenate([[0], np.cumsum(sizes)]), self.pairs)
        tails = [merged[at[n] : at[n + 1]] for n in range(len(sizes))]
        self.cuts = all(tails[n].tolist() == [runs[most]] * (n // most) + tails[n % most].tolist() for n in range(len(sizes)))
        self.sign, self.longest, self.most = runs[1], runs[most], most
        self.tail_size = np.array([len(t) for t in tails[:most]])
        self.tail_start = np.cumsum(self.tail_size) - self.tail_size
        self.tails = np.concatenate(tails[:most])

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of parts of normalised texts, all merged in the same rounds."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        borders = np.concatenate([[0], np.cumsum(sizes)])
        symbols = self.symbol[points]
        cuts = borders
        if len(sizes) and sizes.max() > LONG:
            near = points[:-1].astype(np.int64) << 21 | points[1:]
            place = np.minimum(np.searchsorted(self.inside, near), max(0, len(self.inside) - 1))
            apart = self.inside[place] != near if len(self.inside) else np.ones(len(near), bool)
            apart &= np.repeat(sizes > LONG, sizes)[:-1]
            cuts = np.unique(np.concatenate([borders, np.flatnonzero(apart) + 1]))
        merged, at = merge_rounds(symbols, cuts, self.pairs)
        word_at = at[np.searchsorted(cuts, borders)]
        ids, id_at = self._with_bytes(merged)
        flat, ends = ids.astype(np.uint32).tobytes(), (4 * id_at[word_at]).tolist()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _with_bytes(self, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, symbols beyond the vocabulary as their bytes (or the unknown id); and where each symbol's ids begin."""
        odd = np.flatnonzero(merged >= self.size)
        counts = np.ones(len(merged), np.int64)
        if not len(odd):
            return merged.astype(np.int64), np.concatenate([[0], np.cumsum(counts)])
        points = merged[odd].astype(np.int64) - self.size
        if self.falls_back:
            counts[odd] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        starts = np.concatenate([[0], np.cumsum(counts)])
        ids = np.repeat(merged, counts).astype(np.int64)
        if self.falls_back:
            raw = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            ids[ragged_take(starts[odd], counts[odd])] = self.byte_id[raw]
        else:
            ids[starts[odd]] = self.library.unk_id()
        return ids, starts

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the borders of the texts in it; null and empty texts have none."""
        normal = pa.array([self.library.normalize(t) if t else "" for t in texts.to_pylist()], pa.string())
        if not self.cuts:
            packed = self.encode_words(normal.to_pylist())
            return np.frombuffer(b"".join(packed), np.uint32).astype(np.int64), np.cumsum([0, *(len(p) // 4 for p in packed)])
        parts, codes, borders = coded_parts(pc.split_pattern(normal, SPACE), keep_empty=True)
        first = np.zeros(len(codes), bool)
        first[borders[:-1]] = True  # what stands before the first sign: mostly nothing
        lengths, starts = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        behind = np.flatnonzero(~first)
        used, which = np.unique(codes[behind], return_inverse=True)
        fronts = np.flatnonzero(first & (codes != (parts.index("") if "" in parts else -1)))
        bare, which_bare = np.unique(codes[fronts], return_inverse=True)
        place = self.memo.places([SPACE + parts[c] for c in used.tolist()] + [parts[c] for c in bare.tolist()])
        lengths[behind], starts[behind] = self.memo.length[place][which], self.memo.start[place][which]
        at = place[len(used) + which_bare]
        lengths[fronts], starts[fronts] = self.memo.length[at], self.memo.start[at]
        ids = self.memo.pool[ragged_take(starts, lengths)].astype(np.int64)
        return self._joined_spaces(ids, np.concatenate([[0], np.cumsum(lengths)])[borders])

    def _joined_spaces(self, ids: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbouring signs of one text become the pieces that the run is cut into."""
        single = ids == self.sign
        near = single[1:] & single[:-1]
        near[borders[(borders > 0) & (borders < len(ids))] - 1] = False
        if not near.any():
            return ids, borders
        head = single & ~np.append(False, near)
        heads = np.flatnonzero(head)
        runs = np.bincount(np.cumsum(head)[single] - 1, minlength=len(heads))
        whole, rest = np.divmod(runs, self.most)
        counts = np.where(single, 0, 1)
        counts[heads] = whole + self.tail_size[rest]
        starts = np.concatenate([[0], np.cumsum(counts)])
        ids = np.repeat(ids, counts)
        ids[ragged_take(starts[heads], whole)] = self.longest
        ids[ragged_take(starts[heads] + whole, self.tail_size[rest])] = self.tails[ragged_take(self.tail_start[rest], self.tail_size[rest])]
        return ids, starts[borders]

    def decode_column(self, ids: np.ndarray, borders: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Decoded bytes of all texts, and their borders.

        Byte pieces that do not make up characters become U+FFFD each, as in the library.
        """
        sizes = self.shown_size[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.shown[ragged_take(self.shown_start[ids], sizes)]
        if self.prefixed and len(ids):
            # the first id of each text that shows anything
            shows = np.flatnonzero(sizes > 0)
            head = shows[np.minimum(np.searchsorted(shows, borders[:-1]), len(shows) - 1)] if len(shows) else np.zeros(0, np.int64)
            if len(head):
                head = head[(head >= borders[:-1]) & (head < borders[1:]) & self.spaced[ids[head]]]
                keep = np.ones(len(flat), bool)
                keep[ends[head]] = False
                flat = flat[keep]
                ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        raw, out_ends = flat.tobytes(), ends[borders]
        # an id beyond the byte pieces is whole characters, so only byte pieces can break the encoding
        if not len(ids) or not self.is_byte[ids].any() or _whole(raw):
            return raw, out_ends
        return self._mended(raw, ids, ends, borders)

    def _mended(self, raw: bytes, ids: np.ndarray, ends: np.ndarray, borders: np.ndarray) -> tuple[bytes, np.ndarray]:
        found, size = [], [0]
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            total = 0
            edge = np.flatnonzero(np.diff(self.is_byte[ids[a:b]])) + a + 1
            for c, d in zip([a, *edge.tolist()], [*edge.tolist(), b], strict=True):
                part = raw[ends[c] : ends[d]]
                if c < d and self.is_byte[ids[c]] and not _whole(part):
                    part = _byte_by_byte(part)
                found.append(part)
                total += len(part)
            size.append(total)
        return b"".join(found), np.cumsum(size)


def _whole(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _byte_by_byte(raw: bytes) -> bytes:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            if at + size <= len(raw) and _whole(raw[at : at + size]):
                out.append(raw[at : at + size])
                at += size
                break
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One per Python worker; what it has learnt about words serves the worker's later tasks."""
    return PieceModel(path)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, n_tokens, ids) per document; null and empty texts have no ids. No begin or end ids, no sampling.

    With ``digests`` the two SHA-256 digests (of the decimal ids joined by
    commas, and of the text that the ids decode to) take the place of the ids.
    One scan, no shuffle; a row depends on its text alone, so repeated rows
    give equal rows and lost tasks can run again. Null ids stay null, other
    columns are not read, an empty table gives no rows. A text is held whole,
    with about thirty bytes for each of its characters.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for part in text_slices(batches):
            ids, borders = model.encode_column(part.column("text"))
            cuts = list(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True))
            columns = [part.column("id"), pa.array(np.diff(borders))]
            if digests:
                columns += [pa.array(_digests(*_decimal(model, ids, borders), 1)), pa.array(_digests(*model.decode_column(ids, borders), 0))]
            else:
                columns.append(pa.array([ids[a:b].astype(np.int32) for a, b in cuts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids"])]
    fields = f"`{id_col}` {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")
    return arrow_map(docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), run, fields)


def _decimal(model: PieceModel, ids: np.ndarray, borders: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Decimal ids, each with a comma behind it, and the borders of the texts."""
    rows = model.digits[ids]
    filled = rows != 0
    ends = np.concatenate([[0], np.cumsum(filled.sum(axis=1))])
    return rows[filled].tobytes(), ends[borders]


def _digests(raw: bytes, ends: np.ndarray, cut: int) -> list[str]:
    view = memoryview(raw)
    return [hashlib.sha256(view[a : max(a, b - cut)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the inverse of ``encode_pieces``; null ids give an empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            rows = [np.asarray(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            borders = np.cumsum([0, *map(len, rows)])
            raw, ends = model.decode_column(np.concatenate(rows) if rows else np.zeros(0, np.int64), borders)
            texts = [raw[a:b].decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=[id_col, "text"])

    return arrow_map(encoded.selectExpr(f"`{id_col}` AS id", f"`{ids_col}` AS ids"), run, f"`{id_col}` {kind}, text string")
