"""Token counts of a published byte-level BPE tokenizer, without the ids.

Most pre-tokens of a text are whole vocabulary strings. Which of these encode alone as one token is proved beforehand, by
merging each one's bytes under the tokenizer's own merges; such a pre-token counts 1 by look-up, and only the others are
merged. A vocabulary string that its merges don't lead to has no such proof and is merged like any other.

Rows: null text is an empty text and has no tokens; every row gives one row, repeated rows the same one; an empty table
gives an empty one; further columns aren't looked at. A special token's string inside a text is one token, as by the
library's default, and the texts on its two sides are apart.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.bpe import BLANK, CACHE, CHUNK
from storyloom.llm.common import slices

LIMIT = 512
#: The library's pattern of byte-level pre-tokens, a fixed value; white space is named, as libraries disagree on it.
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


def byte_letters() -> dict[str, int]:
    """The characters in which such files write bytes: those that print stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass(frozen=True)
class Vocabulary:
    strings: tuple[bytes, ...]  # by id
    single: tuple[int, ...]  # ids of the 256 bytes
    merges: dict[tuple[int, int], tuple[int, int]]  # two ids -> rank and the id that they become
    special: tuple[str, ...]


def read_vocabulary(path: str) -> Vocabulary:
    """A tokenizer file of byte-level BPE; one with anything that this module doesn't do is refused."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    cut = before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)
    whole = not any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not (plain and cut and whole and file.get("normalizer") is None and not file.get("truncation")):
        raise ValueError(f"{path} isn't a plain byte-level BPE tokenizer")
    letters, ids = byte_letters(), model["vocab"]
    strings = [b""] * (max(ids.values()) + 1)
    for s, i in ids.items():
        if all(c in letters for c in s):
            strings[i] = bytes(letters[c] for c in s)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
    single = {b: ids[c] for c, b in letters.items()}
    return Vocabulary(tuple(strings), tuple(single[b] for b in range(256)), merges, tuple(t["content"] for t in file["added_tokens"]))


def merged(piece: bytes, v: Vocabulary) -> list[int]:
    """Ids of one pre-token: of all neighbours that can merge, those of least rank, leftmost first, by a heap whose outdated entries are passed over."""
    ids, n, merges = [v.single[b] for b in piece], len(piece), v.merges
    after, before = [*range(1, n + 1), n], [*range(-1, n)]
    heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        rank, i, new = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j >= n or (m := merges.get((ids[i], ids[j]))) is None or m != (rank, new):
            continue
        ids[i], ids[j] = new, -1
        after[i] = k = after[j]
        before[k] = i
        if k < n and (m := merges.get((new, ids[k]))):
            heapq.heappush(heap, (m[0], i, m[1]))
        if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
            heapq.heappush(heap, (m[0], h, m[1]))
    return [i for i in ids if i >= 0]


def proven(v: Vocabulary) -> frozenset[str]:
    """The vocabulary's texts that encode alone as one token: their own bytes' merges end in their own id. Bytes that are no text can't be a pre-token."""
    out = set()
    for i, s in enumerate(v.strings):
        try:
            text = s.decode()
        except UnicodeDecodeError:
            continue
        if text and merged(s, v) == [i]:
            out.add(text)
    return frozenset(out)


class Counter(dict):
    """Chunk of text -> its number of tokens. Proven texts are there from the start; other chunks are kept in two generations of bounded size."""

    def __init__(self, v: Vocabulary, alone: frozenset[str]):
        super().__init__(dict.fromkeys(alone, 1))
        self.v, self.alone, self.young, self.old = v, alone, 0, {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None

    def __missing__(self, chunk: str) -> int:
        if (n := self.old.get(chunk)) is None:
            pieces = PRETOKEN.findall(chunk)
            n = len(merged(chunk.encode(), self.v)) if pieces == [chunk] else sum(map(self.__getitem__, pieces))
        if len(chunk) <= 48:
            if self.young >= CACHE:
                self.old = {c: k for c, k in self.items() if c not in self.alone}
                self.clear()
                self.update(dict.fromkeys(self.alone, 1))
                self.young = 0
            self[chunk] = n
            self.young += 1
        return n

    def count(self, text: str) -> int:
        """Tokens of a text. No pre-token crosses from one CHUNK into the next."""
        if self.special and self.special.search(text):
            pieces = self.special.split(text)
            return len(pieces) - 1 + sum(map(self.count, pieces))
        return sum(map(self.__getitem__, CHUNK.findall(text)))


#: The counter of this worker, so that its later tasks find the chunks of earlier ones.
COUNTERS: dict[str, Counter] = {}


def counted(df: DataFrame, path: str, limit: int = LIMIT, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, n_bytes, n_tokens and over_limit of every row's whole text."""
    v = read_vocabulary(path)
    shared = df.sparkSession.sparkContext.broadcast((v, proven(v)))  # a vocabulary of fixed size
    whole = F.coalesce(F.col(text), F.lit(""))
    src = df.select(*[F.col(c) for c in keep], F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in COUNTERS:
            COUNTERS[path] = Counter(*shared.value)
        count = COUNTERS[path].count
        for b in slices(batches, "__text"):
            n = pa.array([count(t) for t in b.column("__text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], "n_tokens"])

    out = src.mapInArrow(run, src.drop("__text").withColumn("n_tokens", F.lit(0).cast("long")).schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
