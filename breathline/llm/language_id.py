"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from breathline.llm.shared import arrow_map, coded_words, text_slices
from breathline.session import cut_lineage

UNKNOWN = "und"
SPACE = r"[\x20\x09-\x0D]+"
#: longer words are run in pieces of so many bytes
LONGEST = 64


def _gate(x: np.ndarray) -> np.ndarray:
    """Piecewise linear sigmoid; far cheaper than the smooth one, trained as it is used."""
    return np.clip(0.25 * x + 0.5, 0, 1)


def _squash(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -1, 1)


class ByteGru:
    """Two GRU layers (left to right, right to left) over the bytes of a word, and a label at every position.

    Gate rows of a weight matrix: update, reset, candidate. The input weights
    are one row per byte, so an input step is a table look-up.
    """

    def __init__(self, labels: list[str], hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        h, n = hidden, len(labels)
        self.p: dict[str, np.ndarray] = {}
        for side in "fb":
            self.p[f"x{side}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.p[f"h{side}"] = rng.normal(0, h**-0.5, (h, 3 * h)).astype(np.float32)
            self.p[f"c{side}"] = np.zeros(3 * h, np.float32)
        self.p["out"] = rng.normal(0, (2 * h) ** -0.5, (2 * h, n)).astype(np.float32)
        self.p["bias"] = np.zeros(n, np.float32)

    def _run(self, x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States (T, B, H) of one direction over ``x`` (T, B)."""
        h, w, table = self.hidden, self.p[f"h{side}"], self.p[f"x{side}"] + self.p[f"c{side}"]
        state = np.zeros((x.shape[1], h), np.float32)
        states = np.empty((len(x), *state.shape), np.float32)
        for t in range(len(x)):
            given, back = table[x[t]], state @ w
            gates = _gate(given[:, : 2 * h] + back[:, : 2 * h])
            update, reset = gates[:, :h], gates[:, h:]
            fresh = _squash(given[:, 2 * h :] + reset * back[:, 2 * h :])
            if keep is not None:
                keep.append((state, update, reset, fresh, back[:, 2 * h :]))
            state = fresh + update * (state - fresh)
            states[t] = state
        return states

    def _probabilities(self, both: np.ndarray) -> np.ndarray:
        logits = both @ self.p["out"] + self.p["bias"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(axis=-1, keepdims=True)

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities (T, B, labels) at every byte of words of one length, ``x`` (T, B)."""
        both = np.concatenate([self._run(x, "f"), self._run(x[::-1], "b")[::-1]], axis=2)
        return self._probabilities(both)

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted cross entropy at every position, by backpropagation through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        states = {"f": self._run(x, "f", kept["f"]), "b": self._run(x[::-1], "b", kept["b"])}
        both = np.concatenate([states["f"], states["b"][::-1]], axis=2)
        error = self._probabilities(both)
        error[:, np.arange(x.shape[1]), y] -= 1
        error *= weight[None, :, None] / x.size
        h = self.hidden
        grads = {"out": np.einsum("tbh,tbn->hn", both, error), "bias": error.sum((0, 1))}
        back = error @ self.p["out"].T
        for side, into, steps in (("f", back[:, :, :h], x), ("b", back[::-1, :, h:], x[::-1])):
            w = self.p[f"h{side}"]
            gx, gh = np.zeros_like(self.p[f"x{side}"]), np.zeros_like(w)
            flow = np.zeros((x.shape[1], h), np.float32)
            inputs: list[np.ndarray] = []
            for t in range(len(steps) - 1, -1, -1):
                state, update, reset, fresh, candidate = kept[side][t]
                flow = flow + into[t]
                d_fresh = flow * (1 - update) * (np.abs(fresh) < 1)
                d_update = flow * (state - fresh) * (0.25 * ((update > 0) & (update < 1)))
                d_reset = d_fresh * candidate * (0.25 * ((reset > 0) & (reset < 1)))
                given = np.concatenate([d_update, d_reset, d_fresh], axis=1)
                through = np.concatenate([d_update, d_reset, d_fresh * reset], axis=1)
                inputs.append(given)
                gh += state.T @ through
                flow = flow * update + through @ w.T
            seen = steps[::-1].ravel()
            order = np.argsort(seen, kind="stable")
            edges = np.flatnonzero(np.diff(seen[order].astype(np.int64), prepend=-1))
            gx[seen[order][edges]] = np.add.reduceat(np.concatenate(inputs)[order], edges, axis=0)
            grads[f"x{side}"], grads[f"h{side}"], grads[f"c{side}"] = gx, gh, gx.sum(0)
        return grads

    def fit(self, words: list[bytes], y: np.ndarray, steps: int, batch: int = 256, rate: float = 0.01, seed: int = 11) -> None:
        """Adam over batches of words of one length; labels weigh equally whatever their share."""
        rng = np.random.default_rng(seed)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        share = np.bincount(y, minlength=len(self.labels)) / max(1, len(y))
        by_length = {n: np.flatnonzero(sizes == n) for n in np.unique(sizes).tolist()}
        lengths = np.array(list(by_length))
        chance = np.array([len(v) * n for n, v in by_length.items()], float)
        chance /= chance.sum()
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            n = int(rng.choice(lengths, p=chance))
            rows = rng.choice(by_length[n], batch)
            x = np.frombuffer(b"".join(words[r] for r in rows.tolist()), np.uint8).reshape(batch, n).T
            weight = (1 / (len(self.labels) * share[y[rows]])).astype(np.float32)
            now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, g in self.step(x, y[rows], weight).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                self.p[k] -= now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)

    def word_sums(self, words: list[bytes]) -> np.ndarray:
        """Sum of the label probabilities over the positions of each word."""
        sums = np.zeros((len(words), len(self.labels)), np.float32)
        owner, pieces = [], []
        for i, word in enumerate(words):
            if len(word) <= LONGEST:
                owner.append(i)
                pieces.append(word)
            else:
                cut = _pieces(word)
                owner += [i] * len(cut)
                pieces += cut
        owner = np.asarray(owner, np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(sizes, kind="stable")
        edges = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            n = int(sizes[order[a]])
            for c in range(a, b, 2048):
                rows = order[c : min(b, c + 2048)]
                x = np.frombuffer(b"".join(pieces[r] for r in rows.tolist()), np.uint8).reshape(len(rows), n).T
                found = self.positions(x).sum(axis=0)
                if n < LONGEST:
                    sums[owner[rows]] += found
                else:  # pieces of one word
                    np.add.at(sums, owner[rows], found)
        return sums


class WordLabels:
    """Probability sums by word: the network sees each distinct word once, until ``most`` words are held."""

    def __init__(self, model: ByteGru, most: int = 300_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.sums = np.zeros((0, len(self.model.labels)), np.float32)
        self.size = np.zeros(0, np.int64)

    def places(self, words: list[str]) -> np.ndarray:
        if len(self.at) + len(words) > self.most:
            self.clear()
        new = [w for w in words if w not in self.at]
        if new:
            first, held = len(self.at), len(self.at) + len(new)
            if held > len(self.size):
                grown = np.zeros((2 * held, self.sums.shape[1]), np.float32)
                grown[:first] = self.sums[:first]
                self.sums, self.size = grown, np.resize(self.size, 2 * held)
            coded = [w.encode() for w in new]
            # a word without a letter says nothing about the language
            lettered = np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in new), bool, len(new))
            self.sums[first:held] = self.model.word_sums(coded) * lettered[:, None]
            self.size[first:held] = np.fromiter(map(len, coded), np.int64, len(coded)) * lettered
            self.at.update(zip(new, range(first, held), strict=True))
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def label(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Label and score of whole texts: probabilities pooled over all positions."""
        best, score, named = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), bool)
        words, codes, borders = coded_words(texts)
        places = self.places(words)[codes]
        full = np.flatnonzero(np.diff(borders))
        if len(full):
            sums = np.add.reduceat(self.sums[places], borders[full], axis=0, dtype=np.float64)
            sizes = np.add.reduceat(self.size[places], borders[full])
            best[full] = sums.argmax(axis=1)
            score[full] = sums.max(axis=1) / np.maximum(sizes, 1)
            named[full] = sizes > 0
        labels = [self.model.labels[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), named.tolist(), strict=True)]
        return labels, np.clip(score, 0, 1)


def _labeller(model: ByteGru | None):
    if model:
        return WordLabels(model).label
    return lambda texts: ([UNKNOWN] * len(texts), np.zeros(len(texts)))


def _pieces(word: bytes) -> list[bytes]:
    return [word[k : k + LONGEST] for k in range(0, len(word), LONGEST)]


def sample_words(docs: DataFrame, text_col: str, lang_col: str, order_by: str, max_docs: int, max_words: int) -> DataFrame:
    """(lang, word, _place) of words with a letter, drawn from the whole texts of a bounded number of documents a language.

    Each language gets an equal part of ``max_docs`` documents (20 at least; the
    smallest hashes of ``order_by``) and of ``max_words`` words (by a hash of
    document and place), so a rare language is learnt however large the others are.
    Nulls in text or language are left out.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.xxhash64(order_by).alias("_hash"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )

    def thinned(rows: DataFrame, hashed: str, most: int) -> DataFrame:
        """About ``most`` rows a language or a little more, and all rows of small languages."""
        counts = rows.groupBy("lang").count().collect()  # one row per language
        if all(r["count"] <= most for r in counts):
            return rows
        share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, int(min(1.0, (1.25 * most + 100) / r["count"]) * 1_000_003))])
        return rows.where(F.pmod(hashed, F.lit(1_000_003)) < F.element_at(share, F.col("lang")))

    def first(rows: DataFrame, hashed: str, most: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(hashed, *[c for c in rows.columns if c not in ("lang", hashed)]))
        return thinned(rows, hashed, most).withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")

    languages = max(1, labelled.select("lang").distinct().count())
    sample = cut_lineage(first(labelled, "_hash", max(20, max_docs // languages)))
    words = sample.select("lang", "_hash", F.posexplode(F.split("text", SPACE)).alias("_at", "word")).where(F.col("word").rlike(r"\p{L}"))
    words = words.select("lang", "word", F.xxhash64("_hash", "_at").alias("_place"))
    return first(words, "_place", max(1, max_words // languages))


def train_language_model(
    docs: DataFrame, text_col: str, lang_col: str, order_by: str,
    max_docs: int = 2000, max_words: int = 200_000, hidden: int = 16, steps: int = 700,
) -> ByteGru | None:
    """A network fitted on the words of ``sample_words``, long ones in pieces as in prediction. None if no labelled text has a word."""
    # as Arrow: a Row object for each word takes the driver a hundred times the bytes of the word
    sample = sample_words(docs, text_col, lang_col, order_by, max_docs, max_words).select("_place", "lang", "word").toArrow()
    sample = sample.sort_by([(c, "ascending") for c in sample.column_names])
    langs = sample.column("lang").to_pylist()
    labels = sorted(set(langs))
    number = {lang: i for i, lang in enumerate(labels)}
    words, y = [], []
    for lang, word in zip(langs, sample.column("word").cast(pa.binary()).to_pylist(), strict=True):
        found = _pieces(word)
        words += found
        y += [number[lang]] * len(found)
    if not words:
        return None
    model = ByteGru(labels, hidden)
    model.fit(words, np.asarray(y), steps)
    return model


def identify_languages(docs: DataFrame, model: ByteGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per document, from its whole text alone.

    Every byte of every word gets label probabilities; a document pools them
    as their mean over all positions, the label is the largest, the score its
    value. States start anew at each word, so equal words are run once.
    Null texts, texts without a letter, and all texts when there is no model
    are ``und`` with score 0. One scan, no shuffle; repeated rows stay
    repeated; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = _labeller(model)
        for part in text_slices(batches):
            labels, score = label(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(labels, pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    return arrow_map(docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), run, f"`{id_col}` {kind}, lang_pred string, score double")


def least_score(labels: int) -> float:
    """The score under which a language is no better than a guess among ``labels`` ones: a fifth over an even share, 1 for a single label."""
    return (1 + 0.2 * (1 - 1 / labels)) / labels - 1e-6


def keep_identified(docs: DataFrame, model: ByteGru | None, text_col: str = "text", min_score: float | None = None) -> DataFrame:
    """The rows, with all columns, whose text has a language with at least ``min_score`` (``least_score`` if None).

    Null texts and those without a letter go. Without a model all rows stay; repeated rows stay repeated; an empty table stays empty.
    """
    bound = min_score if min_score is not None or model is None else least_score(len(model.labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = _labeller(model)
        for part in text_slices(batches, text_col):
            labels, score = label(part.column(text_col))
            named = np.fromiter((x != UNKNOWN for x in labels), bool, len(labels))
            yield part.filter(pa.array(named & (score >= bound)))

    return arrow_map(docs, run, docs.schema) if model else docs
