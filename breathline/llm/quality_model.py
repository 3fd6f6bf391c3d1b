"""Text quality by a generalised additive model with pairwise interactions: cyclic boosted shallow trees per feature."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathline.llm.shared import arrow_map, bounded_sample, coded_words, text_slices

FEATURES = [
    "log_words", "word_bytes", "upper", "digit", "symbol", "punctuation", "shout", "high_bytes",
    "distinct_words", "distinct_pairs", "dup_lines", "line_words", "stops",
]
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>", "punctuation": b",;:()[]\"'-/=", "shout": b"!", "stops": b".?"}


def _byte_weights() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES) + 2), np.int64)
    for column, chars in enumerate(_CLASSES.values()):
        table[list(chars), column] = 1
    table[128:, len(_CLASSES)] = 1
    table[[b for b in range(256) if b not in b" \t\n\x0b\x0c\r"], len(_CLASSES) + 1] = 1
    return table


def text_features(texts: pa.Array) -> np.ndarray:
    """(rows, features) of whole texts; null and empty texts have zeros."""
    texts = pc.fill_null(texts, "")
    rows = len(texts)
    table = _byte_weights()
    counts = np.zeros((rows, table.shape[1]))
    dup_lines, lines = np.zeros(rows), np.zeros(rows)
    for row, text in enumerate(texts.to_pylist()):
        if text:
            counts[row] = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256) @ table
            full = [line for line in text.split("\n") if line and not line.isspace()]
            lines[row], dup_lines[row] = len(full), len(full) - len(set(full))
    words, codes, borders = coded_words(texts)
    n = np.diff(borders).astype(float)
    owner = np.repeat(np.arange(rows), np.diff(borders))
    span = len(words) + 1
    distinct = np.bincount(np.unique(owner * span + codes) // span, minlength=rows)
    inside = owner[1:] == owner[:-1]
    _, first = np.unique((owner[1:] * span + codes[1:])[inside] * span + codes[:-1][inside], return_index=True)
    pairs = np.bincount(owner[1:][inside][first], minlength=rows)
    words_at_least = np.maximum(n, 1)
    chars = np.maximum(counts[:, -1], 1)
    by_name = dict(zip([*_CLASSES, "high_bytes"], counts.T, strict=False))
    return np.column_stack([
        np.log1p(n), counts[:, -1] / words_at_least, by_name["upper"] / chars, by_name["digit"] / chars,
        by_name["symbol"] / words_at_least, by_name["punctuation"] / words_at_least, by_name["shout"] / words_at_least,
        by_name["high_bytes"] / chars, distinct / words_at_least, pairs / np.maximum(n - 1, 1),
        dup_lines / np.maximum(lines, 1), n / np.maximum(lines, 1), by_name["stops"] / words_at_least,
    ]).astype(np.float32)


class AdditiveModel:
    """Log odds as a sum of look-up tables: one per feature, and one per chosen pair of features on coarser bins."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.single = [np.zeros(len(e) + 1) for e in edges]
        self.coarse = [np.unique(np.linspace(0, len(e) - 1, 7).astype(int)) if len(e) else np.zeros(0, int) for e in edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def bins(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fine = np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])
        rough = np.column_stack([np.searchsorted(self.edges[j][c], x[:, j], side="right") for j, c in enumerate(self.coarse)])
        return fine, rough

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        fine, rough = self.bins(x)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.single):
            total += table[fine[:, j]]
        for (i, j), table in self.pairs.items():
            total += table[rough[:, i], rough[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _tree_1d(g: np.ndarray, h: np.ndarray, ridge: float, depth: int) -> np.ndarray:
    """Newton leaf value per bin of a tree of ``depth`` on binned gradient and curvature sums."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = _gain(gl, hl, ridge) + _gain(g.sum() - gl, h.sum() - hl, ridge)
        cut = int(gains.argmax()) + 1
        if gains[cut - 1] > _gain(g.sum(), h.sum(), ridge) + 1e-9:
            return np.concatenate([_tree_1d(g[:cut], h[:cut], ridge, depth - 1), _tree_1d(g[cut:], h[cut:], ridge, depth - 1)])
    return np.full(len(g), -g.sum() / (h.sum() + ridge))


def _tree_2d(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Table of the best tree that cuts the first feature once and each side by the second; and its gain."""
    best, table = -np.inf, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            halves = [_tree_1d(a[s].sum(0), b[s].sum(0), ridge, 1) for s in (slice(None, cut), slice(cut, None))]
            now = np.vstack([np.broadcast_to(halves[0], (cut, a.shape[1])), np.broadcast_to(halves[1], (len(a) - cut, a.shape[1]))])
            gain = -float((a * now).sum() + 0.5 * (b * now * now).sum())
            if gain > best:
                best, table = gain, now.T if turned else now
    return table, best


def fit_additive_model(
    x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, rate: float = 0.1, bins: int = 32, ridge: float = 2.0
) -> AdditiveModel:
    """Boost one shallow tree per feature in turn, round after round; then choose pairs by what they add and boost those.

    Without rows, or with rows of one label, the tables stay empty and the score is the smoothed share of label 1.
    """
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    model = AdditiveModel(edges, base)
    if not len(y) or y.min() == y.max():
        return model
    fine, rough = model.bins(x)
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, table in enumerate(model.single):
            g, h = slopes()
            step = rate * _tree_1d(np.bincount(fine[:, j], g, len(table)), np.bincount(fine[:, j], h, len(table)), ridge, 2)
            table += step
            total += step[fine[:, j]]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        cell = rough[:, i] * shape[1] + rough[:, j]
        g, h = slopes()
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), cell

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda ij: -_tree_2d(*sums(*ij)[:2], ridge)[1])
    for i, j in ranked[:pairs]:
        model.pairs[i, j] = np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            g, h, cell = sums(i, j)
            step = rate * _tree_2d(g, h, ridge)[0]
            table += step
            total += step.ravel()[cell]
    return model


def measure_texts(docs: DataFrame, text_col: str, extra: list[str]) -> DataFrame:
    """``extra`` columns and the features of each row, from its whole text."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = text_features(part.column("text"))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in extra), *map(pa.array, found.T)], names=[*extra, *FEATURES])

    picked = docs.select(*extra, F.col(text_col).alias("text"))
    return arrow_map(picked, run, f"{kinds}, " + ", ".join(f"{f} float" for f in FEATURES))


def train_quality_model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int = 20_000) -> AdditiveModel:
    """Fit on at most ``max_rows`` labelled ids, those with the smallest hashes; only their texts are measured.

    Rows without a label are left out; of several labels of one id the smallest
    counts. Ids without a document add nothing.
    """
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("double").alias("_y"))
    sample = bounded_sample(one, ["_id"], max_rows)
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")  # max_rows rows
    rows = measure_texts(chosen, "_text", ["_id", "_y"]).toArrow().sort_by([(c, "ascending") for c in ["_id", *FEATURES]])
    x = np.column_stack([rows.column(f).to_numpy() for f in FEATURES]).astype(np.float32)
    return fit_additive_model(x, (rows.column("_y").to_numpy() > 0).astype(float))


def score_quality(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per document by adding up table cells for whole batches; score is the probability of label 1.

    From the whole text alone; null and empty texts are scored on zero
    features. One scan, no shuffle; repeated rows stay repeated; other columns
    are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.score(text_features(part.column("text"))))], names=[id_col, "score"])

    return arrow_map(docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), run, f"`{id_col}` {kind}, score double")


def keep_good(docs: DataFrame, model: AdditiveModel, text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """The rows, with all columns, that score ``cut`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text_col):
            yield part.filter(pa.array(model.score(text_features(part.column(text_col))) >= cut))

    return arrow_map(docs, run, docs.schema)
