"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, cut further where the last eight characters hash to zero, so that an edit
changes the paragraphs near it only; the mean is 64 characters, in a finer second sketch of short
texts 16. A repeated paragraph counts as often as it comes. Each digest is added to one cell in
each of three parts of a sketch. A sketch is doubled until its own digests can be peeled off it.
Two fingerprints are folded to one size and subtracted; peeling recovers the digests that differ,
and where that fails both are peeled at their own sizes.

Rows: null text is an empty text, whose sketches are empty; likeness is shared / all paragraphs, 1
for two empty texts; each row gives one row; documents of equal or null id are in the order of
their texts' hashes, null ids last; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import slices
from storyloom.llm.numeric import R_INVERSE, R, U, mixed, powers

#: Bits of the boundary hash: 2**COARSE characters to a paragraph in the mean; texts under SHORT characters have the FINE sketch too.
COARSE, FINE, SHORT = 6, 4, 1024
PARTS = 3
#: Characters that are worked on at once.
AT_ONCE = 600_000
SEEDS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U)


def paragraphs(texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(text number, digest) of the coarse and of the fine paragraphs of all texts."""
    size = np.array([len(t) for t in texts], np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    start = np.cumsum(size) - size
    if not n:
        empty = np.zeros(0, np.int64), np.zeros(0, U)
        return empty, empty
    h = cp * np.uint32(0x9E3779B1)
    for back, factor in ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (4, 0x27D4EB2F)):
        nxt = h * np.uint32(factor)
        nxt[back:] += h[:-back]
        h = nxt
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    # the hash of a text's first seven characters may look into the text before it: no cut there
    early = start[size > 0][:, None] + np.arange(7)
    h[np.minimum(early, n - 1)] = np.uint32(0xFFFFFFFF)
    forced = cp == 10
    forced[(start + size - 1)[size > 0]] = True
    total = np.concatenate([np.zeros(1, U), np.cumsum(mixed(cp.astype(U)) * powers(R, n), dtype=U)])
    inverse = powers(R_INVERSE, n)
    out = []
    for bits in (COARSE, FINE):
        end = np.flatnonzero(forced | (h >> np.uint32(32 - bits) == 0)) + 1
        begin = np.concatenate([[0], end[:-1]])
        doc = np.searchsorted(start, begin, "right") - 1
        digest = mixed((total[end] - total[begin]) * inverse[begin], 1) + (end - begin).astype(U) * SEEDS[0]
        order = np.lexsort((digest, doc))
        doc, digest = doc[order], digest[order]
        fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])])
        place = np.arange(len(doc))
        nth = place - np.maximum.accumulate(np.where(fresh, place, 0))
        digest = mixed(digest + nth.astype(U) * SEEDS[1], 2)
        if bits == FINE:
            some = size[doc] < SHORT
            doc, digest = doc[some], digest[some]
        out.append((doc, digest))
    return out[0], out[1]


@dataclass
class Sketches:
    """Many sketches side by side: of sketch i the cells start at `start[i]`, PARTS << `bits[i]` of them."""

    bits: np.ndarray
    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    check: np.ndarray

    @classmethod
    def empty(cls, bits: np.ndarray) -> Sketches:
        cells = PARTS << bits
        n = int(cells.sum())
        return cls(bits, np.cumsum(cells) - cells, np.zeros(n, np.int64), np.zeros(n, U), np.zeros(n, np.uint32))

    def cells(self, which: np.ndarray, digest: np.ndarray) -> np.ndarray:
        """The PARTS cells of each digest in its sketch."""
        bits = self.bits[which]
        mask = (np.int64(1) << bits) - 1
        return np.stack([self.start[which] + (np.int64(j) << bits) + (mixed(digest, SEEDS[j + 1]).astype(np.int64) & mask) for j in range(PARTS)])

    def add(self, which: np.ndarray, digest: np.ndarray, sign: np.ndarray) -> None:
        check = (mixed(digest, SEEDS[0]).astype(np.uint32) * sign.astype(np.uint32)).astype(np.uint32)
        key = digest * sign.astype(U)
        for at in self.cells(which, digest):
            np.add.at(self.count, at, sign)
            np.add.at(self.key, at, key)
            np.add.at(self.check, at, check)

    def folded(self, bits: np.ndarray) -> Sketches:
        """The same sketches with fewer cells: cells whose places agree in the lower bits are added up."""
        out = Sketches.empty(bits)
        which = np.repeat(np.arange(len(bits)), PARTS << self.bits)
        inside = np.arange(len(self.count)) - self.start[which]
        part, cell = inside >> self.bits[which], inside & ((np.int64(1) << bits[which]) - 1)
        at = out.start[which] + (part << bits[which]) + cell
        np.add.at(out.count, at, self.count)
        np.add.at(out.key, at, self.key)
        np.add.at(out.check, at, self.check)
        return out

    def peeled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sketch, digest and sign of what can be peeled off, and for each sketch whether nothing is left."""
        rest = Sketches(self.bits, self.start, self.count.copy(), self.key.copy(), self.check.copy())
        which_cell = np.repeat(np.arange(len(self.bits)), PARTS << self.bits)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.flatnonzero(np.abs(rest.count) == 1)
        while len(look):
            sign = rest.count[look]
            one = np.abs(sign) == 1
            look, sign = look[one], sign[one]
            digest = rest.key[look] * sign.astype(U)
            pure = rest.check[look] == (mixed(digest, SEEDS[0]).astype(np.uint32) * sign.astype(np.uint32)).astype(np.uint32)
            which, digest, sign = which_cell[look[pure]], digest[pure], sign[pure]
            order = np.lexsort((digest, which))
            which, digest, sign = which[order], digest[order], sign[order]
            if not len(which):
                break
            new = np.concatenate([[True], (which[1:] != which[:-1]) | (digest[1:] != digest[:-1])])
            which, digest, sign = which[new], digest[new], sign[new]
            rest.add(which, digest, -sign)
            found.append((which, digest, sign))
            look = np.unique(rest.cells(which, digest))
        left = (rest.count != 0) | (rest.key != 0)
        done = np.bincount(which_cell[left], minlength=len(self.bits)) == 0
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)]
        return parts[0], parts[1], parts[2], done


def sketched(which: np.ndarray, digest: np.ndarray, n: int) -> Sketches:
    """A sketch for each of n texts, just large enough to be peeled."""
    counts = np.bincount(which, minlength=n)
    bits = np.maximum(2, np.ceil(np.log2(np.maximum(1, 0.45 * counts)))).astype(np.int64)
    while True:
        out = Sketches.empty(bits)
        out.add(which, digest, np.ones(len(which), np.int64))
        done = out.peeled()[3]
        if done.all():
            return out
        bits = bits + ~done


def packed(sketches: Iterable[Sketches], n: int) -> list[bytes]:
    """For each text its sketches one after the other: a byte with the size's logarithm, then counts, keys and checks of the cells."""
    out = [b""] * n
    for s in sketches:
        for i, (a, b) in enumerate(zip(s.start, s.start + (PARTS << s.bits), strict=True)):
            out[i] += bytes([s.bits[i]]) + s.count[a:b].astype("<i2").tobytes() + s.key[a:b].astype("<u8").tobytes() + s.check[a:b].astype("<u4").tobytes()
    return out


def unpacked(prints: list[bytes]) -> tuple[Sketches, Sketches, np.ndarray]:
    """Coarse and fine sketches, and whether a fine one was there (otherwise it's an empty one)."""
    levels: list[list[tuple[int, bytes, bytes, bytes]]] = [[], []]
    has_fine = np.zeros(len(prints), bool)
    for k, p in enumerate(prints):
        at = 0
        for level in levels:
            if at >= len(p):
                level.append((2, bytes(24), bytes(96), bytes(48)))
                continue
            has_fine[k] = level is levels[1]
            n = PARTS << p[at]
            level.append((p[at], p[at + 1 : at + 1 + 2 * n], p[at + 1 + 2 * n : at + 1 + 10 * n], p[at + 1 + 10 * n : at + 1 + 14 * n]))
            at += 1 + 14 * n
    out = []
    for level in levels:
        s = Sketches.empty(np.array([x[0] for x in level], np.int64))
        s.count = np.frombuffer(b"".join(x[1] for x in level), "<i2").astype(np.int64)
        s.key = np.frombuffer(b"".join(x[2] for x in level), "<u8").astype(U)
        s.check = np.frombuffer(b"".join(x[3] for x in level), "<u4").astype(np.uint32)
        out.append(s)
    return out[0], out[1], has_fine


def sizes(s: Sketches) -> np.ndarray:
    """Paragraphs of each sketch: its counts add up to PARTS times as many."""
    return np.add.reduceat(s.count, s.start) // PARTS if len(s.start) else np.zeros(0, np.int64)


def likeness(a: Sketches, b: Sketches) -> np.ndarray:
    """Shared paragraphs as a share of all, pair by pair."""
    n = len(a.bits)
    bits = np.minimum(a.bits, b.bits)
    x, y = a.folded(bits), b.folded(bits)
    which, _, sign, done = Sketches(x.bits, x.start, x.count - y.count, x.key - y.key, x.check - y.check).peeled()
    only_a, only_b = (np.bincount(which[sign == s], minlength=n) for s in (1, -1))
    if not done.all():  # too many differ for that size: peel each at its own
        mine, theirs = a.peeled(), b.peeled()
        bad = np.flatnonzero(~done)
        sets = [set(zip(p[0][k := np.isin(p[0], bad)].tolist(), p[1][k].tolist(), strict=True)) for p in (mine, theirs)]
        for i, one, other in ((0, sets[0], sets[1]), (1, sets[1], sets[0])):
            n_only = np.bincount(np.array([d for d, x in one if (d, x) not in other], np.int64), minlength=n)
            (only_a, only_b)[i][bad] = n_only[bad]
    size_a, size_b = sizes(a), sizes(b)
    every = size_a + only_b
    return np.where(every == 0, 1.0, (size_a - only_a) / np.maximum(1, every)) * ((every > 0) | (size_b == 0))


def fingerprints(texts: list[str]) -> list[bytes]:
    coarse, fine = paragraphs(texts)
    n = len(texts)
    short = np.array([len(t) < SHORT for t in texts])
    out = packed([sketched(*coarse, n)], n)
    number = np.cumsum(short) - 1
    extra = packed([sketched(number[fine[0]], fine[1], int(short.sum()))], int(short.sum()))
    return [p + (extra[number[i]] if short[i] else b"") for i, p in enumerate(out)]


def compared(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Likeness of fingerprints, pair by pair: by the fine sketches where both have them."""
    (ca, fa, ha), (cb, fb, hb) = unpacked(a), unpacked(b)
    return np.where(ha & hb, likeness(fa, fb), likeness(ca, cb))


def edited(text: str, following: str) -> str:
    """text with the last third of its characters replaced by the first as many of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def in_order(docs: DataFrame, per_part: int) -> DataFrame:
    """doc_id, text, n (equal rows) in ranges of descending doc_id, each a partition of about `per_part` rows; the first row of each also ends the range before it (`ahead`).

    An id that many rows have, or null, is split by the hashes of its texts, after equal rows are made one. What comes to the
    driver is two numbers for each range.
    """
    docs = docs.select("doc_id", F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    slim = docs.select("id", F.xxhash64("text").alias("hash"))
    total, nulls = slim.agg(F.count(F.lit(1)), F.count_if(F.col("id").isNull())).first()
    parts = max(4, -(-total // per_part))
    points = np.array(slim.approxQuantile("id", [i / parts for i in range(1, parts)], max(1e-6, 0.1 / parts)), float).astype(np.int64)
    bounds, n = np.unique(points, return_counts=True)
    often = bounds[n > 1]  # ids of about a range's rows or more
    edges = np.unique(np.concatenate([bounds, often + 1]))  # such an id has a region of its own
    cuts = np.ones(len(edges) + 2, np.int64)  # ranges of each region; the last one is that of null ids
    cuts[np.searchsorted(edges, often, "right")] = n[n > 1] + 1
    cuts[-1] = max(1, -(-nulls // per_part))
    begin = np.cumsum(cuts[[*range(len(edges), -1, -1), len(edges) + 1]])
    offset = np.concatenate([[0], begin[:-1]])

    def place(none: pd.Series, x: pd.Series, h: pd.Series) -> np.ndarray:
        """The range of rows, in descending order of ids and ascending order of hashes."""
        region = np.where(none.to_numpy(bool), len(edges) + 1, np.searchsorted(edges, x.to_numpy(np.int64), "right"))
        inside = (h.to_numpy(np.int64) / 2.0**64 + 0.5) * cuts[region]
        at = np.where(region > len(edges), len(edges) + 1, len(edges) - region)
        return offset[at] + np.minimum(inside.astype(np.int64), cuts[region] - 1)

    keys = (F.col("id").isNull(), F.coalesce("id", F.lit(0).cast("long")), F.col("hash"))
    range_of = F.pandas_udf(lambda none, x, h: pd.Series(place(none, x, h)), "long")
    first = slim.groupBy(range_of(*keys).alias("range")).agg(F.min(F.struct((-F.col("id")).alias("i"), "hash")).alias("top")).collect()  # a row for each range
    order = {r: i for i, r in enumerate(sorted(x["range"] for x in first))}
    ahead = {(x["top"]["i"] is None, -(x["top"]["i"] or 0), x["top"]["hash"]): (order[x["range"]] - 1) % len(order) for x in first}

    def places(none: pd.Series, x: pd.Series, h: pd.Series) -> pd.Series:
        out = [[order[r]] for r in place(none, x, h).tolist()]
        for i, key in enumerate(zip(none.tolist(), x.tolist(), h.tolist(), strict=True)):
            if key in ahead:
                out[i].append(-1 - ahead[key])
        return pd.Series(out)

    rows = docs.withColumn("hash", F.xxhash64("text"))
    hot = F.pandas_udf(lambda none, x: none | x.isin(often), "boolean")(*keys[:2])
    many = rows.where(hot).groupBy("id", "hash").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    rows = rows.where(~hot).withColumn("n", F.lit(1).cast("long")).unionByName(many)
    rows = rows.withColumn("r", F.explode(F.pandas_udf(places, "array<long>")(*keys)))
    rows = rows.select("doc_id", "text", "n", "hash", (F.col("r") < 0).alias("ahead"), F.when(F.col("r") < 0, -1 - F.col("r")).otherwise(F.col("r")).cast("int").alias("range"))
    return rows.repartitionById(max(1, len(order)), "range").sortWithinPartitions("ahead", F.col("doc_id").desc_nulls_last(), "hash", "text").drop("hash")


def versions(docs: DataFrame, per_part: int = 4_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = in_order(docs, per_part)
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = rows.select("doc_id", *[F.lit(x).alias(n) for n, x in zip(names, (0, "", "", "", 0.0, 0.0), strict=True)], F.lit(0).cast("long").alias("times")).withColumn("n_chars", F.lit(0).cast("long")).schema

    def finish(ids: list, texts: list[str], n: list[int], id_type: pa.DataType) -> pa.RecordBatch:
        """Rows of all texts but the last, which only follows; of equal rows all but one are followed by their like."""
        own = [*range(len(texts) - 1), *(i for i in range(len(texts) - 1) if n[i] > 1)]
        after = [i + 1 if k < len(texts) - 1 else i for k, i in enumerate(own)]
        new = [edited(texts[i], texts[j]) for i, j in zip(own, after, strict=True)]
        prints, changed = fingerprints(texts), fingerprints(new)
        mine = [prints[i] for i in own]
        text = lambda x: pa.array([base64.b64encode(p).decode() for p in x], pa.string())
        cols = [
            pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
            text(mine),
            text(changed),
            pa.array(compared(mine, changed), pa.float64()),
            pa.array(compared(mine, [prints[j] for j in after]), pa.float64()),
            pa.array([1 if k < len(texts) - 1 else n[i] - 1 for k, i in enumerate(own)], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in own], id_type), *cols], names=["doc_id", *names, "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, n, chars, ended = [], [], [], 0, False
        for b in slices(batches):
            for doc_id, text, many, ahead in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "n", "ahead")), strict=True):
                if ended:  # by the first of the rows that the next range begins with
                    break
                ids.append(doc_id)
                texts.append(text)
                n.append(many)
                chars += len(text)
                ended = ahead
                if (ended or chars > AT_ONCE) and len(texts) > 1:
                    yield finish(ids, texts, n, b.schema.field("doc_id").type)
                    ids, texts, n, chars = ids[-1:], texts[-1:], n[-1:], len(texts[-1])

    tens = F.sequence(F.lit(0), F.floor((F.col("times") - 1) / 10_000))  # by ten thousands, so that no array is long
    out = rows.mapInArrow(run, schema).withColumn("t", F.explode(tens))
    return out.withColumn("t", F.explode(F.sequence(F.lit(1), F.least(F.lit(10_000), F.col("times") - 10_000 * F.col("t"))))).drop("times", "t")
