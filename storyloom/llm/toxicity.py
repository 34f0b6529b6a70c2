"""Toxicity by maximum-scoring segments of token log-odds.

Log-odds of a word and of its beginnings have Dirichlet priors: the prior of each is centred on
the next shorter beginning, that of the shortest on the whole sample. A linear scan finds every
maximal scoring segment of a text; under the extreme-value law of such segments a score S among n
tokens is expected K n exp(-lambda S) times by chance, and a logistic fit on these statistics
gives the document's score.

Rows: null and empty texts have no segments and get the score of a text without any; each row gives
one row, repeated rows the same one; a null doc_id is in no fold and never learned from; without
labels of both kinds every score is the share of toxic labels, or 0; empty tables give empty tables.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import fold, slices

WORD = re.compile(r"[^\W\d_]+")
#: Beginnings of words that are tokens too, in letters; a whole word ends in END.
LENGTHS, END = range(3, 9), "$"
#: Words kept with their scores in each worker; it bounds memory only.
CACHE = 500_000


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # of the tokens whose log-odds differ from those of their next shorter beginning
    drift: float  # of a token without a weight
    decay: float  # lambda
    scale: tuple[float, float]  # K of the best segments, and of those whose words are counted once
    fit: tuple[float, ...]  # intercept and coefficients of the logistic fit


class Scores(dict):
    """Word -> score of its longest known beginning."""

    def __init__(self, model: Model):
        self.weights, self.drift = model.weights, model.drift

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        get = self.weights.get
        found = get(word + END)
        for k in range(min(len(word), LENGTHS[-1]), LENGTHS[0] - 1, -1):
            if found is not None:
                break
            found = get(word[:k])
        out = (found or 0.0) + self.drift
        if len(word) <= 64:
            self[word] = out
        return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end, sum), by one scan with a list of candidates.

    A candidate knows the last one before it that began at a lower sum, so that none is passed over twice. When none began lower than
    the newest, no later one can join those before, and they are done: the scan takes linear time.
    """
    total = np.cumsum(scores)
    done: list[tuple[int, int, float, float, int]] = []
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before it, sum up to its end, place of the lower one
    at = np.flatnonzero(scores > 0)
    for i, left, right in zip(at.tolist(), (total[at] - scores[at]).tolist(), total[at].tolist(), strict=True):
        start, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                break
            start, left, lower = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = lower
        if j < 0:
            done += found
            found.clear()
        found.append((start, i + 1, left, right, j))
    return [(a, b, r - l) for a, b, l, r, _ in done + found]


def read(text: str | None, scores: Scores) -> tuple[np.ndarray, list[str]]:
    """Scores of a text's words, each time they come, and the words."""
    found = WORD.findall((text or "").lower())
    return np.fromiter(map(scores.__getitem__, found), float, len(found)), found


def measured(scores: np.ndarray, words: list[str], found: list[tuple[int, int, float]], drift: float) -> tuple[float, float, float]:
    """Best segment of all; best segment and sum of all segments where a word that came before in the text weighs nothing, as texts repeat harmless words too."""
    if not found:
        return 0.0, 0.0, 0.0
    n = len(words)
    fresh = np.full(n, drift)
    first = list(dict(zip(reversed(words), range(n - 1, -1, -1), strict=True)).values())
    fresh[first] = scores[first]
    new = [x[2] for x in (found if len(first) == n else segments(fresh))]
    return max(x[2] for x in found), max(new), sum(new)


def statistics(best: np.ndarray, fresh: np.ndarray, total: np.ndarray, n: np.ndarray, model: Model) -> list[np.ndarray]:
    """The best segments less their expected size among n tokens, and the logarithm of the fresh segments' sum, in units of 1 / lambda."""
    return [model.decay * fresh - np.log(1 + model.scale[1] * n), np.log1p(model.decay * total), model.decay * best - np.log(1 + model.scale[0] * n)]


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """text and y of at most `most` labelled rows outside the held-out fold, chosen by a hash of doc_id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y")  # `most` rows of two numbers


def weigh(counts: dict[str, tuple[int, int]], prior: float, doubt: float) -> dict[str, float]:
    """Log-odds of tokens against the sample as a whole; counts has toxic and other documents by token, "" those of all.

    A token departs from its next shorter beginning by what exceeds `doubt` standard errors; one that doesn't has no weight of its own.
    """
    toxic, clean = counts[""]
    share, weight = {"": toxic / (toxic + clean)}, {"": 0.0}
    odds = lambda p: math.log(p / (1 - p))
    out: dict[str, float] = {}
    for token in sorted(counts.keys() - {""}, key=lambda t: (t.endswith(END), len(t), t)):
        word = token.removesuffix(END)
        parent = next((word[:k] for k in range(min(len(word) - (token == word), LENGTHS[-1]), LENGTHS[0] - 1, -1) if word[:k] in share), "")
        a, b = (x + prior * p for x, p in zip(counts[token], (share[parent], 1 - share[parent]), strict=True))
        apart = odds(a / (a + b)) - odds(share[parent])
        sure = abs(apart) - doubt * math.sqrt(1 / a + 1 / b)
        share[token], weight[token] = share[parent], weight[parent]
        if sure > 0 and counts[token] != counts[parent]:  # equal counts: the same words, seen already
            share[token] = a / (a + b)
            out[token] = weight[token] = weight[parent] + math.copysign(sure, apart)
    return out


def karlin(values: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(x * values)) = 1; 1 where there is none."""
    if not len(values) or values.max() <= 0 or (values * share).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (share * np.exp(high * values)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(mid * values)).sum() < 1 else (low, mid)
    return max(high, 0.05)


def gumbel_scale(best: np.ndarray, n: np.ndarray, decay: float) -> float:
    """K of greatest likelihood where P(best <= s) = exp(-K n exp(-decay s)) for each text of n words."""
    expected = float((n * np.exp(-decay * best)).sum())
    return len(best) / expected if expected > 0 else 1.0


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 100) -> tuple[float, ...]:
    """Intercept and coefficients by Newton's method with a ridge penalty; a step is halved until the penalised loss falls."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    loss = lambda w: float(np.logaddexp(0, a @ w).sum() - y @ (a @ w) + ridge / 2 * w @ w)
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        while (new := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if new > now or np.abs(step).max() < 1e-9:
            break
        w, now = w + step, new
    return tuple(w.tolist())


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, min_count: int = 5, prior: float = 10.0, doubt: float = 1.5, drift: float = 0.25) -> Model:
    """max_labelled bounds the rows that are learned from, and so the tokens that come to the driver."""
    rows = sample(docs, labels, "toxic", 4, 2, max_labelled)
    terms = rows.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("w"))
    by_word = terms.groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    begins = F.array([F.when(F.length("w") >= k, F.substring("w", 1, k)) for k in LENGTHS] + [F.concat("w", F.lit(END))])
    tokens = by_word.select(F.explode(F.array_compact(begins)).alias("t"), "a", "b").groupBy("t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = {r.t: (r.a, r.b) for r in tokens.where(F.col("a") + F.col("b") >= min_count).toLocalIterator()}
    total = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    if not 0 < total[0] < total[1]:
        p = min(max(total[0] / max(1, total[1]), 1e-6), 1 - 1e-6) if total[1] else 1e-6
        return Model({}, -drift, 1.0, (1.0, 1.0), (math.log(p / (1 - p)), 0.0, 0.0, 0.0))
    model = Model(weigh(counts | {"": (total[0], total[1] - total[0])}, prior, doubt), -drift, 1.0, (1.0, 1.0), (0.0, 0.0, 0.0, 0.0))

    def null_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, count = Scores(model), Counter()
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                count.update(read(text, scores)[0].round(2).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.float64()), pa.array(count.values(), pa.int64())], names=["s", "n"])

    null = rows.where("y = 0").select("text").mapInArrow(null_scores, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).toPandas()
    n = null["n"].to_numpy(float)
    decay = karlin(null["s"].to_numpy(float), n / max(1.0, n.sum()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for b in slices(batches):
            x = [(*measured(v, w, segments(v), model.drift), float(len(w))) for v, w in (read(t, scores) for t in b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*x, strict=True)] + [b.column("y")], names=["best", "fresh", "total", "n", "y"])

    seen = rows.mapInArrow(measure, "best double, fresh double, total double, n double, y int").toPandas()  # numbers of at most max_labelled rows
    seen = seen.sort_values(["n", "best", "fresh", "total", "y"])  # the fit doesn't depend on the order in which rows came
    clean = seen[seen["y"] == 0]
    scale = tuple(gumbel_scale(clean[c].to_numpy(), clean["n"].to_numpy(), decay) for c in ("best", "fresh"))
    model = Model(model.weights, model.drift, decay, scale, model.fit)
    x = np.column_stack(statistics(*(seen[c].to_numpy() for c in ("best", "fresh", "total", "n")), model))
    return Model(model.weights, model.drift, decay, scale, logistic(x, seen["y"].to_numpy(float)))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score, passages: array of (first word, words, log-odds) of each segment expected less than once by chance."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text"))
    span = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("log_odds", pa.float64())]))
    schema = src.drop("__text").withColumns({"score": F.lit(0.0), "passages": F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("words"), F.lit(0.0).alias("log_odds")))}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scores = Scores(m)
        for b in slices(batches, "__text"):
            out, spans = [], []
            for text in b.column("__text").to_pylist():
                s, words = read(text, scores)
                found = segments(s)
                z = m.fit[0] + float(np.dot(m.fit[1:], statistics(*measured(s, words, found, m.drift), len(s), m)))
                out.append(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))))
                spans.append([(a, e - a, x) for a, e, x in found if m.decay * x > math.log(1 + m.scale[0] * len(s))])
            spans = [[{"first": a, "words": n, "log_odds": x} for a, n, x in p] for p in spans]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(out, pa.float64()), pa.array(spans, span)], names=[*keep, "score", "passages"])

    return src.mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
