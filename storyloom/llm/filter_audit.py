"""How filters of a corpus interact: what each removes in every order, beside what the others remove.

A document's measures come from one scan of its Arrow buffer: byte classes by table, prefix sums of them for capitals,
symbols and code points, word hashes by differences of a prefix sum of powers. Each document's sorted hashes give its
distinct words; neighbours of equal hash are held byte against byte, and a document in which two differ is counted by its
words themselves. From the measures a document gets a mask, a bit for each filter that it fails. Documents of one part
and mask are alike in every order, so masks are counted first; the orders are worked out from at most 2^k counts a part.

Rows: null text is empty, a null part the empty string. A document without a label counts as neither good nor
toxic; one with several labels counts once, by its highest. A null doc_id has no label, is no smaller id than any and
has none below it. Repeated rows count each; rows of one id and text aren't copies of each other. An empty
table gives an empty one. Further columns aren't looked at.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import slices, written

SYMBOLS = b"#$%&*|"
MEASURES = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_points")
#: Bytes of a text scanned together, which bounds a worker's memory; longer texts come alone.
SLICE = 1_000_000
#: Bytes hashed or compared at a time.
BLOCK = 1 << 16
#: Base of the hash's powers: any odd number has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
POWERS, BACK = (np.cumprod(np.array([1] + [b] * (BLOCK - 1), np.uint64), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
SPACES, CAPITALS, MARKS, LEADING = (
    np.array([f(c) for c in range(256)]) for f in (lambda c: c == 32 or 9 <= c <= 13, lambda c: 65 <= c <= 90, lambda c: c in SYMBOLS, lambda c: c & 0xC0 != 0x80)
)

#: The filters of the query, in SQL; a document that fails one is removed by it. E's column comes from copies().
FILTERS = {
    "A": "n_words < 100", "B": "100 * n_distinct < 80 * n_words", "C": "100 * n_capitals > 10 * n_points", "D": "n_symbols > 0", "E": "coalesce(first_id < doc_id, false)",
}


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all words and the bytes behind their last; a text's end ends a word."""
    edge = np.ones(len(data) + 1, bool)  # whether a word can't go on from the byte before
    edge[1:-1] = SPACES[data[:-1]]
    edge[offsets - offsets[0]] = True
    inside = ~SPACES[data]
    after = edge[1:].copy()
    after[:-1] |= ~inside[1:]
    return np.flatnonzero(inside & edge[:-1]), np.flatnonzero(inside & after) + 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, wherever it stands: the sum of byte times power of place, divided by the power of its start. Modulo 2^64, block by block."""
    at_start, at_end = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    carry, far, back, shift = np.uint64(0), np.uint64(1), np.uint64(1), np.zeros(len(start), np.uint64)
    step, step_back = np.uint64(pow(BASE, BLOCK, 1 << 64)), np.uint64(pow(BASE, -BLOCK, 1 << 64))
    with np.errstate(over="ignore"):
        for a in range(0, len(data), BLOCK):
            piece = data[a : a + BLOCK].astype(np.uint64) + np.uint64(1)
            piece *= POWERS[: len(piece)] * far
            sums = np.empty(len(piece) + 1, np.uint64)
            sums[0] = carry
            np.cumsum(piece, out=sums[1:])
            sums[1:] += carry
            i, j = np.searchsorted(start, (a, a + BLOCK))
            at_start[i:j], shift[i:j] = sums[start[i:j] - a], BACK[start[i:j] - a] * back
            i, j = np.searchsorted(end, (a, a + BLOCK), "right")
            at_end[i:j] = sums[end[i:j] - a]
            carry, far, back = sums[-1], far * step, back * step_back
        return (at_end - at_start) * shift


def unequal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Which pairs of byte runs differ."""
    out = size_a != size_b
    same = np.flatnonzero(~out)
    ends = np.cumsum(size_a[same])
    at = 0
    while at < len(same):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        rows = same[at:to]
        n = size_a[rows]
        place = np.arange(n.sum()) - np.repeat(ends[at:to] - n - base, n)
        wrong = np.flatnonzero(data[np.repeat(a[rows], n) + place] != data[np.repeat(b[rows], n) + place])
        out[rows[np.searchsorted(ends[at:to] - base, wrong, "right")]] = True
        at = to
    return out


def distinct_words(data: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray, n: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """Number of different words of each of n texts; text: the text that each word is of."""
    bits = max(1, n.bit_length())
    hashes = word_hashes(data, start, end) if hashes is None else hashes
    key = (text.astype(np.uint64) << np.uint64(64 - bits)) | (hashes >> np.uint64(bits))
    order = np.argsort(key)
    at = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    a, b = order[at], order[at + 1]
    out = np.bincount(text, minlength=n) - np.bincount(text[a], minlength=n)
    wrong = unequal(data, start[a], start[b], (end - start)[a], (end - start)[b])
    for t in np.unique(text[a[wrong]]):  # different words of equal hash
        i, j = np.searchsorted(text, (t, t + 1))
        out[t] = len({data[s:e].tobytes() for s, e in zip(start[i:j], end[i:j], strict=True)})
    return out


def measures(texts: pa.Array) -> list[np.ndarray]:
    """MEASURES of each text, from the array's own buffers."""
    _, where, what = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(what or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    start, end = word_places(data, offsets)
    text = np.searchsorted(offsets, start, "right") - 1

    def count(of: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(of[data], out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    return [np.bincount(text, minlength=len(texts)), distinct_words(data, text, start, end, len(texts)), count(CAPITALS), count(MARKS), count(LEADING)]


def measured(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """keep, text_hash and MEASURES of every row's whole text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    src = df.select(*[F.col(c) for c in keep], F.unhex(F.sha2(whole, 256)).alias("text_hash"), whole.alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text", SLICE):
            found = [pa.array(x, pa.int64()) for x in measures(b.column("__text"))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *found], names=[*b.schema.names[:-1], *MEASURES])

    return src.mapInArrow(run, src.drop("__text").withColumns({m: F.lit(0).cast("long") for m in MEASURES}).schema)


def copies(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with first_id, the least id with the same text; null where no other row has the text."""
    first = docs.groupBy("text_hash").agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return docs.join(written(first), "text_hash", "left")  # a table: Spark broadcasts it if it's small and else splits a hot text's rows


def masked(docs: DataFrame, labels: DataFrame, filters: dict[str, str], part: str = "lang", key: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: the documents that fail exactly the filters of a mask, bit by bit in the filters' order."""
    known = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("quality").alias("__good"), F.max("toxic").alias("__toxic"))
    bits = sum((F.when(F.expr(c), 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    each = docs.select(key, F.coalesce(part, F.lit("")).alias("part"), bits.alias("mask")).join(written(known), key, "left")
    return each.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__good") == 1).alias("good"), F.count_if(F.col("__toxic") == 1).alias("toxic"))


def interactions(masks: DataFrame, letters: str) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. All orders: for up to seven filters."""
    if len(letters) > 7:
        raise ValueError("all orders of more than seven filters are too many")
    places = [(o, i, o[i]) for o in map("".join, itertools.permutations(letters)) for i in range(len(letters))]
    step = [F.struct(F.lit(o).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(1 << letters.index(c)).alias("own"), F.lit(sum(1 << letters.index(x) for x in o[:i])).alias("before")) for o, i, c in places]
    each = masks.select("*", F.explode(F.array(*step)).alias("s")).select("*", "s.*").drop("s")
    has = lambda bits: F.col("mask").bitwiseAND(F.col(bits)) != 0
    here, total = has("own") & ~has("before"), math.factorial(len(letters))
    of = lambda test, x="n": F.sum(F.when(test, F.col(x)).otherwise(0))
    share = F.sum(F.when(has("own"), F.col("n") * (F.lit(total) / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long")).otherwise(0))  # each of a mask's filters comes first in as many orders
    return each.groupBy("part", "filter_order", "step").agg(
        of(~has("own") & ~has("before")).alias("kept"), of(here).alias("removed"), of(has("own") & has("before")).alias("redundant"), of(F.col("mask") == F.col("own")).alias("unique_fails"),
        of(here, "good").alias("good_lost"), of(here, "toxic").alias("toxic_lost"), share.alias("shapley"),
    )


def audit(df: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, part: str = "lang") -> DataFrame:
    """interactions() of the filters over all documents of each part. A filter is a SQL condition on doc_id, first_id and MEASURES, true where a document fails; its name is one letter."""
    docs = written(measured(df, keep=("doc_id", part)))
    return interactions(masked(copies(docs), labels, filters, part), "".join(filters))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(first_id < doc_id, FALSE) THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
orders(o) AS (SELECT '' UNION ALL SELECT o || c FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(c) WHERE NOT contains(o, c)),
places AS (SELECT o AS filter_order, step, o[step] AS own, left(o, step::INT - 1) AS before FROM orders, range(1, 6) t(step) WHERE len(o) = 5),
x AS (SELECT *, contains(fails, own) AS has, len(fails) <> len(translate(fails, before, '')) AS gone FROM m, places),
r AS (SELECT part, filter_order, step::INTEGER AS step, any_value(own) AS own, coalesce(sum(n) FILTER (NOT has AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (has AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (has AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (has AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (has AND NOT gone), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""
