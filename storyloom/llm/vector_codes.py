"""Codes of vectors: each of their parts becomes the number of its nearest codebook entry (product quantisation).

A vector's components become whole numbers, floor(scale * x), so that all that follows is exact. Equal parts at one
position are deduplicated into distinct rows with their weights; Lloyd's rounds run over those alone, and codes and
errors are joined back to the vectors. A round gathers the sums of each entry: as many numbers as the codebooks hold,
whatever the number of vectors. The codebooks are in every task; they have `entries` rows a part.

Rows: a null vector, or one with a null or non-finite component, is dropped; the others give one row each, repeated
ids and repeated rows too. Null ids come last among the first vectors, equal ids go by their components; null labels are
one label. With fewer vectors than entries, codebooks are that short; an empty table gives an empty one. A vector
without components has the code of entry 0 and no error. Further columns aren't looked at. Vectors of different
lengths, or of one that the number of parts doesn't divide, and components beyond +-8192 at a scale of 4096 (whose squared
distances could leave 64 bits) are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest whole number of a component: 2,048 squared differences of such numbers have 63 bits.
MOST = 1 << 25


def integer_parts(df: DataFrame, vector: str, keep: list[str], parts: int, scale: int) -> DataFrame:
    """row, keep, parts: an array of the vector's consecutive parts in whole numbers; unusable vectors go."""
    v = F.col(vector)
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.when(F.abs(x.cast("double")) * scale <= MOST, F.floor(x.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component is too large to be coded")).cast("long")).cast("int"))
    size = F.when(F.size("__v") % parts != 0, F.raise_error(F.lit(f"a vector's length is no multiple of {parts}")).cast("int")).otherwise((F.size("__v") / parts).cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("__v", p * F.col("__n") + 1, F.col("__n")))
    out = df.where(usable).select(F.monotonically_increasing_id().alias("row"), *keep, whole.alias("__v")).withColumn("__n", size)
    return out.select("row", *keep, each.alias("parts"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of 64-bit integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry; the lower index at a tie."""
    code, error = np.zeros(len(values), np.int64), ((values - book[0]) ** 2).sum(1)
    for j in range(1, len(book)):
        far = ((values - book[j]) ** 2).sum(1)
        closer = far < error
        code[closer], error[closer] = j, far[closer]
    return code, error


def assigned(b: pa.RecordBatch, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part position in the batch: it, its rows' places, values, codes, errors."""
    at = b.column("part").to_numpy()
    for part in np.unique(at):
        rows = np.flatnonzero(at == part)
        values = matrix(b.column("value").take(pa.array(rows)))
        yield int(part), rows, values, *nearest(values, books[part])


def entry_sums(weighted: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """part, entry, place, n, total: weight of the parts that an entry is nearest to, and their components' sums, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [np.zeros(len(x), np.int64) for x in books], [np.zeros_like(x) for x in books]
        for b in batches:
            weight = b.column("weight").to_numpy()
            for part, rows, values, code, _ in assigned(b, books):
                for j in np.unique(code):
                    mine = code == j
                    w = weight[rows[mine]]
                    n[part][j] += w.sum()
                    total[part][j] += (values[mine] * w[:, None]).sum(0)
        for part, (k, t) in enumerate(zip(n, total, strict=True)):
            for j in np.flatnonzero(k):
                size = t.shape[1]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(size, x, np.int64)) for x in (part, j)), pa.array(np.arange(size)), pa.array(np.full(size, k[j], np.int64)), pa.array(t[j])], names=["part", "entry", "place", "n", "total"])

    each = weighted.mapInArrow(run, "part long, entry long, place long, n long, total long")
    return each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def train(weighted: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """Codebooks after the rounds; weighted: (part, value, weight), each value once. Entries without parts stay."""
    for _ in range(rounds):
        books = [x.copy() for x in books]
        for r in entry_sums(weighted, books).collect():  # as many rows as the codebooks have numbers
            books[r.part][r.entry, r.place] = r.total // r.n
    return books


def coded_values(weighted: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """part, value, code, error of each distinct part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64)
            for _, rows, _, c, e in assigned(b, books):
                code[rows], error[rows] = c, e
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("value"), pa.array(code), pa.array(error)], names=["part", "value", "code", "error"])

    return weighted.mapInArrow(run, "part int, value array<int>, code int, error long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def compress(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(key, label, code, error) of each usable vector, and the codebooks, one array of entries for each part. At most 256 entries: a code has two hex digits."""
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows = written(integer_parts(df, vector, [key, label], parts, scale))
    size = F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p))
    least, most = rows.agg(F.min(size), F.max(size)).first()
    if least != most:
        raise ValueError(f"vectors of {least} and of {most} components")
    first = rows.orderBy(F.col(key).asc_nulls_last(), "parts").limit(entries).select("parts").collect()
    out = rows.select(key, label, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    if not first:
        return out, [np.zeros((0, 0), np.int64)] * parts
    books = [np.array([r.parts[p] for r in first], np.int64).reshape(len(first), -1) for p in range(parts)]
    each = rows.select("row", key, label, F.posexplode("parts").alias("part", "value"))
    weighted = written(each.groupBy("part", "value").agg(F.count(F.lit(1)).alias("weight")))
    books = train(weighted, books, rounds)
    hexed = F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda x: F.lpad(F.lower(F.hex(x["code"])), 2, "0"))  # a vector's few parts
    back = each.join(coded_values(weighted, books), ["part", "value"]).groupBy("row", key, label)
    return written(back.agg(F.array_join(hexed, "").alias("code"), F.sum("error").alias("error")).select(out.columns)), books


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """Adds label_error, the errors' sum over equal labels, nulls together. The sums are a table, which Spark broadcasts if it's small and else joins in pieces."""
    sums = written(coded.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error")))
    return coded.join(sums, F.col(label).eqNullSafe(F.col("__label"))).drop("__label")


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in SQL, over all parts in every round."""
    distance = "list_sum(list_transform(list_zip(e.value, b.value), lambda z: (z[1] - z[2])::HUGEINT * (z[1] - z[2])))"
    nearest_ = "SELECT r, part, value, arg_min(entry, {x: far, y: entry}) AS entry, min(far) AS error FROM (SELECT e.r, e.part, e.value, b.entry, coalesce(" + distance + ", 0) AS far FROM each e JOIN b%d b USING (part)) GROUP BY ALL"
    steps = "".join(
        f"""
a{k} AS MATERIALIZED ({nearest_ % k}),
s{k} AS (SELECT part, entry, place, sum(x) AS s, count(*) AS n FROM (SELECT part, entry, unnest(value) AS x, generate_subscripts(value, 1) AS place FROM a{k}) GROUP BY ALL),
m{k} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS value FROM s{k} GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.value, b.value) AS value FROM b{k} b LEFT JOIN m{k} m USING (part, entry)),"""
        for k in range(rounds)
    )
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), FALSE)),
each AS MATERIALIZED (SELECT r, p AS part, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS value FROM kept, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT part, entry, value FROM each JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM kept) USING (r) WHERE entry < {entries}),{steps}
z AS ({nearest_ % rounds}),
codes AS (SELECT r, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM z GROUP BY r),
book AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS h FROM (SELECT part, entry, unnest(value) AS x, generate_subscripts(value, 1) AS place FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN codes USING (r), book"""


ORACLE = oracle()
