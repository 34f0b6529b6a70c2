"""Removal of long passages that a reference, or an earlier document, has.

Suffix automata of reference shards decide what goes: documents are streamed through them for matching statistics, and
the words of maximal spans of `length` or more that match are removed. Two forms:

without_reference(): a reference of bounded size is broadcast in shards, of which each worker makes automata.

deduplicated(): documents are their own reference, which has no such bound, and all documents past all shards would be
quadratic. So shards are picked by anchors. A window is `length` consecutive words; of the grams in it the one of least
hash is its anchor, and equal windows have equal anchors at equal places. An anchor's shard is the set of its different
surroundings in all documents, each once, with the least document that has it; Spark brings a shard together by its
anchor, its automaton is made there, and the surroundings run through it: each window gets the least document in which
it starts. A surrounding without rival needs no automaton, as it matches itself in full. An anchor of more than `most`
surroundings (a phrase that a large part of all documents has) is no shard of bounded size: its windows are shards
of their own, one passage each, and their least documents are found by aggregation.
So nothing grows with the square of a group of copies, and no task holds more than `most` surroundings at once.

Rows: null and empty texts have no words; a null doc_id is neither earlier nor later than any;
rows of one doc_id don't remove each other's words; each row gives one row; an empty table gives an
empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import by_key, give_back, slices, written
from storyloom.llm.numeric import Runs, Words

#: Words of a gram: the anchor of a window is one of its grams.
GRAM = 8
#: Bytes of text that are worked on at once.
AT_ONCE = 600_000


class Anchors:
    """Anchors of all windows of some documents; places are counted through all documents."""

    def __init__(self, texts: list[bytes], length: int):
        self.words, self.length = Words.of(texts), length
        first, n = self.words.first, len(self.words.hash)
        runs = Runs(self.words.hash)
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        end = first[1:][doc] if n else first[:0]
        self.window = np.flatnonzero(np.arange(n) + length <= end)  # where windows start
        if not len(self.window):
            self.at = self.doc = self.window_anchor = np.zeros(0, np.int64)
            self.gram = self.context = self.window_hash = np.zeros(0, np.uint64)
            return
        place = np.arange(n - GRAM + 1)
        grams = runs.hash(place, place + GRAM, 2)
        span = length - GRAM + 1
        spans = sliding_window_view(grams, span)
        least = np.concatenate([k + spans[k].argmin(1) for k in np.split(self.window, range(20_000, len(self.window), 20_000))])
        self.at, self.window_anchor = np.unique(least, return_inverse=True)
        self.doc = doc[self.at]
        self.gram = grams[self.at]
        self.low = np.maximum(first[:-1][self.doc], self.at - (span - 1))
        self.high = np.minimum(first[1:][self.doc], self.at + length)
        self.context = runs.hash(self.low, self.high, 3) ^ ((self.at - self.low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.runs = runs

    def hashes(self, windows: np.ndarray) -> np.ndarray:
        """Hashes of the windows of the given numbers."""
        start = self.window[windows]
        return self.runs.hash(start, start + self.length, 4)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def members(values: np.ndarray, docs: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Whether each value is in the set of its document; docs are in order."""
    out = np.zeros(len(values), bool)
    ends = np.searchsorted(docs, np.arange(len(sets) + 1))
    for start, end, known in zip(ends, ends[1:], sets, strict=False):
        if end > start and len(known):
            out[start:end] = np.isin(values[start:end], known)
    return out


def sets_of(column: pa.Array) -> list[np.ndarray]:
    return [np.array(x or [], np.int64).view(np.uint64) for x in column.to_pylist()]


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """anchor, context, doc_id, text_hash of each document, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=AT_ONCE):
            a = Anchors([t.encode() for t in b.column("text").to_pylist()], length)
            _, one = np.unique(np.stack([a.doc.astype(np.uint64), a.context]), axis=1, return_index=True)
            if len(one):
                row = pa.array(a.doc[one])
                yield pa.RecordBatch.from_arrays([signed(a.gram[one]), signed(a.context[one]), b.column("doc_id").take(row), b.column("text_hash").take(row)], names=["anchor", "context", "doc_id", "text_hash"])

    return docs.mapInArrow(run, docs.select(F.lit(0).cast("long").alias("anchor"), F.lit(0).cast("long").alias("context"), "doc_id", "text_hash").schema)


def looked_up(docs: DataFrame, length: int) -> DataFrame:
    """Two kinds of rows from one reading of the documents.

    anchor, context, words (hashes), doc_id of the surroundings in column `wanted`, which the document is the least to have; and
    window, doc_id, text_hash of the windows that the anchors in column `open` have and no surrounding in column `whole` covers.
    """
    names = ["anchor", "context", "words", "window", "doc_id", "text_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=AT_ONCE):
            a = Anchors([t.encode() for t in b.column("text").to_pylist()], length)
            of = lambda doc: [b.column(c).take(pa.array(doc.astype(np.int64))) for c in ("doc_id", "text_hash")]
            k = np.flatnonzero(members(a.context, a.doc, sets_of(b.column("wanted"))))
            if len(k):
                _, one = np.unique(np.stack([a.doc[k].astype(np.uint64), a.context[k]]), axis=1, return_index=True)
                k = k[one]
                size = a.high[k] - a.low[k]
                ends = np.cumsum(size)
                flat = a.words.hash[np.repeat(a.low[k] - ends + size, size) + np.arange(ends[-1])]
                words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), signed(flat))
                yield pa.RecordBatch.from_arrays([signed(a.gram[k]), signed(a.context[k]), words, pa.nulls(len(k), pa.int64()), *of(a.doc[k])], names=names)
            left = members(a.gram, a.doc, sets_of(b.column("open"))) & ~members(a.context, a.doc, sets_of(b.column("whole")))
            k = np.flatnonzero(left[a.window_anchor]) if len(a.at) else a.at
            if len(k):
                doc, window = np.unique(np.stack([a.doc[a.window_anchor[k]].astype(np.uint64), a.hashes(k)]), axis=1)
                none = pa.nulls(len(doc), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(doc), pa.list_(pa.int64())), signed(window), *of(doc)], names=names)

    zero = F.lit(None).cast("long")
    return docs.mapInArrow(run, docs.select(zero.alias("anchor"), zero.alias("context"), F.lit(None).cast("array<long>").alias("words"), zero.alias("window"), "doc_id", "text_hash").schema)


def shard_runs(contexts: list[int], least: list[int], words: list[list[int]], length: int) -> list[tuple[int, int, int, int]]:
    """(context, first window, last window, least document in which those windows start) of the surroundings of one shard."""
    automaton = Automaton([])
    ends = [automaton.add(w, i) for w, i in zip(words, least, strict=True)]
    owner, top = automaton.owners(length)
    out = []
    for context, at in zip(contexts, ends, strict=True):
        each = [owner[top[state]] for state in at[length - 1 :]]  # of the window that ends at each place
        cuts = [k for k in range(1, len(each)) if each[k] != each[k - 1]]
        out += [(context, i, j - 1, each[i]) for i, j in zip([0, *cuts], [*cuts, len(each)], strict=True)]
    return out


def matched(rows: DataFrame, length: int) -> DataFrame:
    """context, first, last, least for rows of (anchor, context, least, words): a shard for each anchor."""
    id_type = rows.schema["least"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: tuple[list, list, list] = ([], [], [])
        now, out = None, []

        def batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), kind), strict=True)], names=["context", "first", "last", "least"])

        kind = pa.int64()
        for b in batches:
            kind = b.schema.field("least").type
            for anchor, *row in zip(*(b.column(c).to_pylist() for c in ("anchor", "context", "least", "words")), strict=True):
                if anchor != now and shard[0]:
                    out += shard_runs(*shard, length)
                    shard = ([], [], [])
                now = anchor
                for column, value in zip(shard, row, strict=True):
                    column.append(value)
            if len(out) > 20_000:
                yield batch(out, kind)
                out = []
        if shard[0]:
            out += shard_runs(*shard, length)
        if out:
            yield batch(out, kind)
        give_back()

    by_anchor = rows.repartition("anchor").sortWithinPartitions("anchor", "context")
    return by_anchor.mapInArrow(run, rows.select("context", F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0).cast(id_type).alias("least")).schema)


def spans_of(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """context, first, last of the runs of each document, sorted by context; a negative last stands for the last window."""
    out = []
    for runs in column.to_pylist():
        r = np.array([(x["context"], x["first"], x["last"]) for x in runs or []], np.int64).reshape(-1, 3)
        key = np.ascontiguousarray(r[:, 0]).view(np.uint64)
        order = np.argsort(key, kind="stable")
        out.append((key[order], r[order, 1], r[order, 2]))
    return out


def without(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words left, joined by one space; columns `known` (runs of windows in surroundings) and `windows` tell what goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=AT_ONCE):
            texts = [t.encode() for t in b.column("text").to_pylist()]
            known, gone = spans_of(b.column("known")), sets_of(b.column("windows"))
            some = [i for i in range(len(texts)) if len(known[i][0]) or len(gone[i])]
            a = Anchors([texts[i] for i in some], length)
            depth = np.zeros(len(a.words.hash) + 1, np.int64)
            if len(a.at):
                ends = np.searchsorted(a.doc, np.arange(len(some) + 1))
                for i, start, end in zip(some, ends, ends[1:], strict=False):
                    key, first, last = known[i]
                    left, right = (np.searchsorted(key, a.context[start:end], side) for side in ("left", "right"))
                    n = right - left
                    row = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
                    low, high = np.repeat(a.low[start:end], n), np.repeat(a.high[start:end], n)
                    np.add.at(depth, low + first[row], 1)
                    np.add.at(depth, np.where(last[row] < 0, high, low + last[row] + length), -1)
                w = members(a.hashes(np.arange(len(a.window))), a.doc[a.window_anchor], [gone[i] for i in some])
                np.add.at(depth, a.window[w], 1)
                np.add.at(depth, a.window[w] + length, -1)
            stay = np.cumsum(depth)[:-1] == 0
            place = {i: k for k, i in enumerate(some)}
            n_words, n_removed, kept = [], [], []
            for i, t in enumerate(texts):
                words = t.split()
                n_words.append(len(words))
                if i in place:
                    words = list(compress(words, stay[a.words.first[place[i]] : a.words.first[place[i] + 1]].tolist()))
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    zero = F.lit(0).cast("long")
    return docs.mapInArrow(run, docs.select("doc_id", zero.alias("n_words"), zero.alias("n_removed"), F.lit("").alias("kept")).schema)


def deduplicated(docs: DataFrame, length: int = 50, most: int = 256) -> DataFrame:
    """doc_id, n_words, n_removed, kept. `most` bounds a shard: the surroundings of an anchor that one automaton holds."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
    key = ["doc_id", "text_hash"]
    found = anchors(docs.where("doc_id IS NOT NULL"), length)
    span = by_key(found, "anchor", F.min("doc_id").alias("min_doc_id"), F.max("doc_id").alias("max_doc_id")).where("min_doc_id < max_doc_id")
    shared = written(found.join(span.select("anchor"), "anchor"))  # rows of anchors that two documents have
    context = by_key(shared, "context", F.min(F.struct(*key)).alias("holder"), F.first("anchor").alias("anchor"))
    context = written(context.select("context", "anchor", F.col("holder.doc_id").alias("least"), F.col("holder.text_hash").alias("text_hash")))
    size = by_key(context, "anchor", F.count(F.lit(1)).alias("n"))
    context = written(context.join(size, "anchor"))
    few = context.where(F.col("n").between(2, most)).groupBy(F.col("least").alias("doc_id"), "text_hash").agg(F.collect_list("context").alias("wanted"))  # at most as many as the document's words
    earlier = F.col("least") < F.col("doc_id")
    hot = shared.join(context.where(F.col("n") > most).select("context", "least"), "context").groupBy(key).agg(
        F.collect_set(F.when(earlier, F.col("context"))).alias("whole"), F.collect_set(F.when(~earlier, F.col("anchor"))).alias("open")
    )
    seen = written(looked_up(docs.join(few.join(hot, key, "full"), key), length))
    runs = matched(seen.where("words IS NOT NULL").select("anchor", "context", F.col("doc_id").alias("least"), "words"), length)
    whole = context.where((F.col("n") == 1) | (F.col("n") > most)).select("context", F.lit(0).alias("first"), F.lit(-1).alias("last"), "least")
    runs = written(runs.unionByName(whole))
    known = shared.join(runs, "context").where(earlier).groupBy(key).agg(F.collect_set(F.struct("context", "first", "last")).alias("known"))
    windows = seen.where("window IS NOT NULL").select("window", *key)
    least = by_key(windows, "window", F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last")
    repeated = windows.join(least, "window").where(earlier).groupBy(key).agg(F.collect_set("window").alias("windows"))
    marks = known.join(repeated, key, "full")
    return without(docs.join(marks, key, "left"), length)


class Automaton:
    """Suffix automaton of sequences of word hashes; no match runs over the end of one."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.owner: dict[int, int] = {}  # state of a prefix -> least owner of the sequences that have it
        for sequence in sequences:
            self.add(sequence)

    def add(self, sequence: list[int], owner: int = 0) -> list[int]:
        """The states of the sequence's prefixes."""
        last, at = 0, []
        for c in sequence:
            last = self.extend(last, c)
            at.append(last)
            self.owner[last] = min(owner, self.owner.get(last, owner))
        return at

    def owners(self, length: int) -> tuple[list[int], list[int]]:
        """For each state the least owner of what it stands for, and the state of its string's last `length` numbers."""
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        least: list[int | None] = [self.owner.get(s) for s in range(len(self.link))]
        for s in reversed(order):
            up = self.link[s]
            if up > 0 and least[s] is not None and (least[up] is None or least[s] < least[up]):
                least[up] = least[s]
        top = list(range(len(self.link)))
        for s in order:
            if self.length[self.link[s]] >= length:
                top[s] = top[self.link[s]]
        return least, top

    def extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # sequences after the first may lead along known states
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self.split(last, c, q)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self.split(p, c, q)
        return new

    def split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the shorter strings that lead to it from p on."""
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def statistics(self, words: list[int]) -> list[int]:
        """For each place the length of the longest match that ends there."""
        state = size = 0
        out = []
        for c in words:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                size += 1
            out.append(size)
        return out


def without_reference(docs: DataFrame, reference: DataFrame, length: int = 50, shard_words: int = 20_000, max_words: int = 100_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept: without the words in runs of `length` or more that a text of the reference has.

    max_words bounds what is broadcast, 8 bytes a word; a larger reference is an error, not cut.
    """
    texts = reference.where("text IS NOT NULL").select("text").distinct()
    size = texts.select(F.size(F.split("text", r"[\x20\x09-\x0D]+")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if size > max_words:
        raise ValueError(f"the reference has {size} words, and at most {max_words} are broadcast")
    words = Words.of(sorted(r.text.encode() for r in texts.collect()) or [b""])
    sequences = [words.hash[a:b].tolist() for a, b in zip(words.first, words.first[1:], strict=False) if b - a >= length]
    ends = np.cumsum([len(x) for x in sequences]) // shard_words
    shards = docs.sparkSession.sparkContext.broadcast([[x for x, k in zip(sequences, ends, strict=True) if k == shard] for shard in np.unique(ends)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Automaton(x) for x in shards.value]
        for b in slices(batches, most=AT_ONCE):
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            found = Words.of(texts)
            n_words, n_removed, kept = [], [], []
            for t, a, e in zip(texts, found.first, found.first[1:], strict=False):
                depth = np.zeros(e - a + 1, np.int64)
                for automaton in automata:
                    match = np.array(automaton.statistics(found.hash[a:e].tolist()), np.int64)
                    at = np.flatnonzero(match >= length)
                    np.add.at(depth, at + 1 - match[at], 1)
                    np.add.at(depth, at + 1, -1)
                stay = np.cumsum(depth)[:-1] == 0
                n_words.append(len(stay))
                n_removed.append(int((~stay).sum()))
                kept.append(b" ".join(compress(t.split(), stay.tolist())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    zero = F.lit(0).cast("long")
    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id", zero.alias("n_words"), zero.alias("n_removed"), F.lit("").alias("kept")).schema)
