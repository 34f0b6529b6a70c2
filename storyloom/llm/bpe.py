"""Byte-level BPE: texts to token ids by a published rank table, and back.

Each pattern match is merged by a segment tree over its byte positions. A leaf holds the rank of
the pair that starts at its position, joined with the position, so the root is the leftmost pair
of least rank; a merge writes two or three leaves, each in logarithmic time.

Rows: null text is an empty text and has no ids; every row gives one row, repeated rows the same
one; an empty table gives an empty table; further columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import slices

#: Chunks in each of the two generations that a worker keeps with their ids. It bounds memory only.
CACHE = 400_000
#: The pattern for which CHUNK's cuts hold; a fixed value. Texts are cut at matches themselves for any other.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word before white space or an end mark, such marks before white space, else all up to white space, each with the one
#: space before it; or white space. No match of the pattern crosses from one into the next.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(rf" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[{BLANK}.,:;!?]|\Z)|[.,:;!?]+(?=[{BLANK}]|\Z)| ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
#: Above every rank.
NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank table of a .tiktoken file; some 50,000 entries."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pattern match."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    width = n - 1
    get, none = ranks.get, NONE
    # leaf i is tree[width + i]; node k is the lesser of 2k and 2k + 1, whatever the width
    tree = [none] * width + [none if (r := get(piece[i : i + 2])) is None else r * n + i for i in range(width)]
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = [*range(1, n + 1), n], [*range(-1, n)]
    while (least := tree[1]) != none:
        i = least % n
        gone = after[i]
        end = after[i] = after[gone]
        before[end] = i
        prev = before[i]
        changed = [(i, none if end == n or (r := get(piece[i : after[end]])) is None else r * n + i)]
        if gone < width and tree[width + gone] != none:
            changed.append((gone, none))
        if prev >= 0:
            changed.append((prev, none if (r := get(piece[prev:end])) is None else r * n + prev))
        for leaf, value in changed:
            k = width + leaf
            if tree[k] == value:
                continue
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder(dict):
    """Chunk of text -> its ids as little-endian unsigned 32-bit integers; filled as chunks are met. A chunk is a match of the pattern, or some of them together.

    Chunks are kept in two generations: when the young one is full it becomes the old one, whose used chunks come back.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.old, self.cut = ranks, regex.compile(pattern), {}, pattern == CUT_PATTERN

    def __missing__(self, chunk: str) -> bytes:
        if (out := self.old.get(chunk)) is None:
            matches = (chunk,) if not self.cut or chunk[chunk[0] == " " :].isalpha() else self.pattern.findall(chunk)
            ids = [i for m in matches for i in merge(m.encode(), self.ranks)]
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= 48:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        if self.cut:
            return b"".join([self[c] for c in CHUNK.findall(text)])
        return b"".join([self[m[0]] for m in self.pattern.finditer(text) if m[0]])


#: The encoders of this worker, so that its later tasks find the chunks of earlier ones.
ENCODERS: dict[tuple[str, str], Encoder] = {}


class Decoder:
    """Ids back to bytes, by one gather from the joined vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = dict(zip(ranks.values(), ranks, strict=True))
        size = max(by_id, default=-1) + 1
        self.length = np.array([len(by_id.get(i, b"")) for i in range(size)], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)

    def decode(self, ids: bytes) -> bytes:
        k = np.frombuffer(ids, "<u4")
        n = self.length[k]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[k] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def encoded(batches: Iterator[pa.RecordBatch], coder: Encoder, text: str) -> Iterator[pa.RecordBatch]:
    """The rows with n_tokens and ids instead of their text, in batches of bounded size."""
    for b in slices(batches, text):
        ids = [coder.encode(t) for t in b.column(text).to_pylist()]
        cols, names = zip(*((b.column(n), n) for n in b.schema.names if n != text), strict=True) if b.num_columns > 1 else ((), ())
        yield pa.RecordBatch.from_arrays([*cols, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[*names, "n_tokens", "ids"])


def decoded(batches: Iterator[pa.RecordBatch], decoder: Decoder, ids: str) -> Iterator[pa.RecordBatch]:
    """The rows with `decoded`, the bytes that the ids stand for."""
    for b in slices(batches, ids):
        out = pa.array([decoder.decode(x or b"") for x in b.column(ids).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, "decoded"])


def encode(df: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", and_decode: bool = False) -> DataFrame:
    """keep, n_tokens, ids: binary of little-endian unsigned 32-bit integers; with and_decode, also what they decode to."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # a vocabulary of fixed size
    src = df.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    out = src.drop("__text").withColumns({"n_tokens": F.lit(0).cast("long"), "ids": F.lit(b"")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (key := (ranks_path, pattern)) not in ENCODERS:
            ENCODERS[key] = Encoder(ranks.value, pattern)
        found = encoded(batches, ENCODERS[key], "__text")
        yield from decoded(found, Decoder(ranks.value), "ids") if and_decode else found

    return src.mapInArrow(run, (out.withColumn("decoded", F.lit(b"")) if and_decode else out).schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """df with `decoded`, the bytes that the ids stand for."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    src = df.drop("decoded")
    return src.mapInArrow(lambda batches: decoded(batches, Decoder(ranks.value), ids), src.withColumn("decoded", F.lit(b"")).schema)


def digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the decoded bytes."""
    both = encode(df, ranks_path, pattern, and_decode=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
