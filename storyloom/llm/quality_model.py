"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn over the features, each adding to the lookup table of one
feature; then over the most useful pairs of features. A text's score is the logistic of a sum of
table entries, found by binning all rows at once.

Rows: null and empty texts have no words and are scored by their features like any other; each row
gives one row, repeated rows the same one; a null doc_id is in no fold and never learned from;
without labels of both kinds every score is the share of label 1, or 1; empty tables give empty tables.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import fold, slices
from storyloom.llm.toxicity import sample

FEATURES = (
    "log_words", "word_chars", "symbols", "bangs", "upper", "digits", "commas", "periods", "not_ascii", "distinct", "repeats", "dup_lines", "line_words", "common",
)
#: Classes of code points, by which a text's characters are counted.
KINDS = {"symbols": "#*$%&|<>{}[]\\^~=_@+/", "bangs": "!?", "commas": ",;:", "periods": "."}


def kinds() -> np.ndarray:
    """The class of each code point: those of KINDS, then upper case, digits, and what is not ASCII."""
    out = np.zeros(0x110000, np.uint8)
    out[128:] = 7
    for i, marks in enumerate(KINDS.values(), 1):
        out[[ord(c) for c in marks]] = i
    for c in range(0x250):
        if chr(c).isupper():
            out[c] = 5
    out[ord("0") : ord("9") + 1] = 6
    return out


def features(text: str | None, kind: np.ndarray) -> list[float]:
    """Whole-text features in the order of FEATURES."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    count = np.bincount(kind[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=8) / chars
    lines = [x for x in text.split("\n") if x.strip()]
    freq: dict[str, int] = {}
    for w in words:
        freq[w] = freq.get(w, 0) + 1
    again = sum(map(str.__eq__, words, words[1:]))
    return [
        np.log1p(len(words)), (chars - n) / n, count[1], count[2], count[5], count[6], count[3], count[4], count[7],
        len(freq) / np.sqrt(n), again / n, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), max(freq.values(), default=0) / n,
    ]


@dataclass(frozen=True)
class Model:
    base: float
    edges: list[np.ndarray]  # of each feature's bins
    tables: list[np.ndarray]  # of each feature
    coarse: list[np.ndarray]  # edges of the bins for pairs
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], "right")]
        for a, b, t in self.pairs:
            z += t[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def tree(grad: np.ndarray, hess: np.ndarray, depth: int, ridge: float, least: float) -> np.ndarray:
    """Leaf values by bin of a tree that cuts the ordered bins at most `depth` levels deep."""
    g, h = np.cumsum(grad), np.cumsum(hess)
    value = np.full(len(grad), g[-1] / (h[-1] + ridge))
    if depth and len(grad) > 1:
        left, right = (g[:-1], h[:-1]), (g[-1] - g[:-1], h[-1] - h[:-1])
        gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge)
        gain[(left[1] < least) | (right[1] < least)] = -1
        k = int(gain.argmax())
        if gain[k] > g[-1] ** 2 / (h[-1] + ridge) + 1e-9:
            return np.concatenate([tree(grad[: k + 1], hess[: k + 1], depth - 1, ridge, least), tree(grad[k + 1 :], hess[k + 1 :], depth - 1, ridge, least)])
    return value


def quadrants(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """The best tree with one cut of either feature of a pair: its gain, and its values by cell."""
    best, table = 0.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for i, j in itertools.product(range(g.shape[0] - 1), range(g.shape[1] - 1)):
        parts = []
        for c in (cg, ch):
            a, b, d, all_ = c[i, j], c[i, -1], c[-1, j], c[-1, -1]
            parts.append(np.array([[a, b - a], [d - a, all_ - b - d + a]]))
        pg, ph = parts
        gain = (pg**2 / (ph + ridge)).sum() - pg.sum() ** 2 / (ph.sum() + ridge)
        if ph.min() >= least and gain > best:
            best, value = gain, pg / (ph + ridge)
            table = value[np.ix_((np.arange(g.shape[0]) > i).astype(int), (np.arange(g.shape[1]) > j).astype(int))]
    return best, table


def boost(x: np.ndarray, y: np.ndarray, bins: int = 64, pair_bins: int = 8, rounds: int = 150, pair_rounds: int = 40, most_pairs: int = 6, rate: float = 0.1) -> Model:
    """Cyclic boosting of the log-loss, first over features, then over pairs picked by gain."""
    ridge, least = 1.0, 2.0
    cut = lambda c, n: np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1]))
    edges = [cut(c, bins) for c in x.T]
    coarse = [cut(c, pair_bins) for c in x.T]
    at = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)]
    base = float(np.log(y.mean() / (1 - y.mean())))
    z, tables = np.full(len(y), base), [np.zeros(len(e) + 1) for e in edges]
    slope = lambda: (y - (p := 1 / (1 + np.exp(-z))), np.maximum(p * (1 - p), 1e-6))
    for _ in range(rounds):
        for j, k in enumerate(at):
            g, h = slope()
            step = rate * tree(*(np.bincount(k, v, len(tables[j])) for v in (g, h)), 2, ridge, least)
            tables[j] += step
            z += step[k]
    cell = [np.searchsorted(e, c, "right") for e, c in zip(coarse, x.T, strict=True)]
    shape = [len(e) + 1 for e in coarse]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.bincount(cell[a] * shape[b] + cell[b], v, shape[a] * shape[b]).reshape(shape[a], shape[b]) for v in slope())

    gains = sorted(((quadrants(*grid(a, b), ridge, least)[0], a, b) for a, b in itertools.combinations(range(x.shape[1]), 2)), reverse=True)
    pairs = [(a, b, np.zeros((shape[a], shape[b]))) for gain, a, b in gains[:most_pairs] if gain > 0]
    for _ in range(pair_rounds):
        for a, b, t in pairs:
            step = rate * quadrants(*grid(a, b), ridge, least)[1]
            t += step
            z += step[cell[a], cell[b]]
    return Model(base, edges, tables, coarse, pairs)


def measured(df: DataFrame, keep: tuple[str, ...], score: Model | None, to: str) -> DataFrame:
    """keep, and as column `to` the features or, given a model, the score. Features of a slice of rows are binned at once."""
    src = df.select(*[F.col(c) for c in keep], F.col("text").alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast(score)
    schema = src.drop("__text").withColumn(to, F.lit(0.0) if score else F.array(F.lit(0.0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, model = kinds(), shared.value
        for b in slices(batches, "__text"):
            x = np.array([features(t, kind) for t in b.column("__text").to_pylist()], float).reshape(-1, len(FEATURES))
            out = pa.array(model.score(x), pa.float64()) if model else pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], out], names=[*keep, to])

    return src.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000) -> Model:
    """max_labelled bounds the rows that are learned from; only their features come to the driver."""
    rows = measured(sample(docs, labels, "quality", 5, 0, max_labelled), ("y",), None, "features").toPandas()
    y = rows["y"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        p = min(max(y.mean() if len(y) else 1.0, 1e-6), 1 - 1e-6)
        return Model(float(np.log(p / (1 - p))), [], [], [], [])
    x = np.stack(rows["features"].to_numpy())
    order = np.lexsort([*x.T, y])  # the fit doesn't depend on the order in which rows came
    return boost(x[order], y[order])


def scored(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = measured(docs, ("doc_id",), model or train(docs, labels), "score")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents that score `least` or more, in all their columns."""
    return measured(docs, tuple(docs.columns), train(docs, labels), "__score").where(F.col("__score") >= least).select(docs.columns)
