"""A generalised additive model with pairwise interactions (GA2M) that scores texts for quality.

Training is cyclic boosting of shallow trees: round after round each feature in turn gets a tree of at most four leaves, fitted to
the gradient of the log loss over its bins and added to the feature's lookup table; then the pairs of features that explain most of what is
left get tables of their own in the same way, from trees that cut each of the two once. A score is the sum of one table
entry per feature and per pair, looked up for a whole batch at once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.shared import small_batches

#: At most so many labelled rows are learned from: those of the least hashes of their ids, a fixed sample.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3

FEATURES = [
    "log_words", "word_length", "symbols", "exclaim", "capitals", "digits", "bars", "distinct", "same_as_before",
    "repeat_lines", "short_words", "marked_words", "worst_line", "stops", "not_ascii", "top_word", "line_words", "repeat_windows",
]

_SYMBOL = re.compile(r"[#*$%&|<>~^=_{}\\]")
_MARKED = re.compile(r"\w[#*$%&|<>!?~^=]{2,}")
_DIGIT = re.compile(r"\d")
_LETTER = re.compile(r"[^\W\d_]")


def features(text: str | None) -> list[float]:
    """The values of FEATURES for a whole text; a null or empty text has zeros."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    symbols = _SYMBOL.findall(text)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    seen = Counter(lines)
    upper = sum(map(str.isupper, words))
    worst = 0.0
    for line, k in seen.items():
        size = len(line)
        if size >= 20:
            worst = max(worst, (line.count("|") + line.count("*") + line.count("#") + line.count("$") + line.count("%") + line.count("&") + line.count("!")) / size)
    before = sum(a == b for a, b in zip(words, words[1:]))
    fours = list(zip(words, words[1:], words[2:], words[3:]))
    return [
        math.log1p(n),
        chars / n,
        len(symbols) / chars,
        text.count("!") / n,
        upper / n,
        len(_DIGIT.findall(text)) / chars,
        words.count("|") / n,
        len(counts) / n,
        before / n,
        1 - len(seen) / max(1, len(lines)),
        sum(1 for w in words if len(w) <= 2) / n,
        len(_MARKED.findall(text)) / n,
        worst,
        (text.count(".") + text.count("?")) / n,
        0.0 if text.isascii() else sum(c > "\x7f" for c in text) / len(text),
        max(counts.values()) / n,
        math.log1p(n / max(1, len(lines))),
        1 - len(set(fours)) / max(1, len(fours)),
    ]


@dataclass
class Model:
    """intercept, and for each feature the upper edges of its bins and its table; pairs: (feature, feature, coarse edges, table)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) for each row of x, as additions of table entries."""
        z = np.full(len(x), self.intercept)
        for f, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, f])]
        for f, g, ef, eg, t in self.pairs:
            z += t[np.searchsorted(ef, x[:, f]), np.searchsorted(eg, x[:, g])]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf"))


def _tree(grad: np.ndarray, hess: np.ndarray, least: float, reg: float) -> np.ndarray:
    """A tree of up to four leaves over ordered bins: the value of each bin."""

    def cut(lo: int, hi: int) -> tuple[float, int]:
        g, h = np.cumsum(grad[lo:hi]), np.cumsum(hess[lo:hi])
        if hi - lo < 2:
            return 0.0, -1
        gl, hl, gr, hr = g[:-1], h[:-1], g[-1] - g[:-1], h[-1] - h[:-1]
        gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + reg) + gr**2 / (hr + reg) - g[-1] ** 2 / (h[-1] + reg), 0)
        k = int(gain.argmax())
        return float(gain[k]), lo + k + 1

    parts = [(0, len(grad))]
    for _ in range(2):
        parts = [q for lo, hi in parts for gain, at in [cut(lo, hi)] for q in ([(lo, at), (at, hi)] if gain > 0 else [(lo, hi)])]
    out = np.zeros(len(grad))
    for lo, hi in parts:
        out[lo:hi] = grad[lo:hi].sum() / (hess[lo:hi].sum() + reg)
    return out


def _tree2(grad: np.ndarray, hess: np.ndarray, reg: float) -> tuple[float, np.ndarray]:
    """The best cut of both axes: its gain and the table of the four quadrants' values."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    total_g, total_h = g[-1, -1], h[-1, -1]
    parts = []
    for c in (g, h):
        a, row, col = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        parts.append((a, row - a, col - a, c[-1, -1] - row - col + a))
    gain = sum(x**2 / (y + reg) for x, y in zip(*parts)) - total_g**2 / (total_h + reg)
    if not gain.size:
        return 0.0, np.zeros(grad.shape)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = [x[i, j] / (y[i, j] + reg) for x, y in zip(*parts)]
    out = np.empty(grad.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 120, pairs: int = 8, pair_bins: int = 8, pair_rounds: int = 40, rate: float = 0.15, reg: float = 2.0) -> Model:
    """Fit the model to rows x with labels y (0 or 1). Without both labels the score is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    z0 = math.log(share / (1 - share))
    n_features = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if len(set(y.tolist())) < 2:
        return Model(z0, [np.zeros(0)] * n_features, [np.zeros(1)] * n_features, [])
    edges = [_edges(x[:, f], bins) for f in range(n_features)]
    at = [np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(y), z0)
    least = max(1.0, 0.002 * len(y) / 4)

    def gradient():
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        return y - p, p * (1 - p) + 1e-6

    for _ in range(rounds):
        for f in range(n_features):
            g, h = gradient()
            k = len(tables[f])
            step = rate * _tree(np.bincount(at[f], g, k), np.bincount(at[f], h, k), least, reg)
            tables[f] += step
            z += step[at[f]]
    coarse = [_edges(x[:, f], pair_bins) for f in range(n_features)]
    low = [np.searchsorted(e, x[:, f]) for f, e in enumerate(coarse)]

    def cells(a, b):
        g, h = gradient()
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        where = low[a] * shape[1] + low[b]
        return np.bincount(where, g, shape[0] * shape[1]).reshape(shape), np.bincount(where, h, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_tree2(*cells(a, b), reg)[0], a, b) for a, b in combinations(range(n_features), 2)), reverse=True)[:pairs]
    chosen = {(a, b): np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for gain, a, b in gains if gain > 0}
    for _ in range(pair_rounds):
        for (a, b), t in chosen.items():
            step = rate * _tree2(*cells(a, b), reg)[1]
            t += step
            z += step[low[a], low[b]]
    return Model(z0, edges, tables, [(a, b, coarse[a], coarse[b], t) for (a, b), t in chosen.items()])


def held_out() -> F.Column:
    """Whether a doc_id is kept out of training."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def _featured(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep plus x, the features of the last column, a text."""
    small_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            rows = [features(t) for t in b.column(b.num_columns - 1).to_pylist()]
            flat = pa.array(np.array(rows, np.float64).reshape(-1))
            at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.ListArray.from_arrays(at, flat)], names=[*keep, "x"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", x array<double>"
    return df.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most sample_rows labelled rows outside the held-out fifth; only their texts are read into features.

    Rows without a doc_id or a label are left out. The sample is that of the least hashes of the ids, so it does not depend on partitions.
    """
    sample = labels.where(~held_out() & F.col("quality").isNotNull()).select("doc_id", "quality")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most sample_rows short rows
    got = _featured(rows.select("doc_id", "quality", "text"), ["doc_id", "quality"]).collect()
    got = sorted(got, key=lambda r: (r.doc_id, r.quality, r.x))
    x = np.array([r.x for r in got], np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.quality for r in got], np.float64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs; null and empty texts are scored too."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            s = model.score(np.array([features(t) for t in b.column(2).to_pylist()], np.float64).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_predicted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold, all columns unchanged; no shuffle."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            s = model.score(np.array([features(t) for t in b.column(at).to_pylist()], np.float64).reshape(-1, len(FEATURES)))
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
