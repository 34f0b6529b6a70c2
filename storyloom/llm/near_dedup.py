"""Near-duplicate documents by a multi-index Hamming join over MinHash signatures.

Documents with equal sets of shingles are one node. Signatures are cut into chunks; two signatures
that differ in few enough symbols agree, by the pigeonhole principle, in some chunk but for one
symbol, so each chunk is looked up with each symbol left out. What shares such a key is first paired
with a few leaders of the key only: the least and the greatest node, which pairs all in keys of up to
three nodes, then, across what isn't connected yet, leaders by other orders. Pairs are confirmed on
full sets, and links closed to components by least labels. Last, the nodes whose keys still lead to
several components are joined by a prefix filter on their full sets: shingles in rising order of how
many nodes have them, those of one component first; two sets that link share one of the first
n - ceil(percent of n) + 1. Nodes that share such a shingle with few others are paired; those that
share one with many, and have enough in common with any, meet in blocks, full set against full set,
and a block gives one link for each two components, not its pairs. So each pair within MAX_DISTANCE
is compared or connected.

Rows: null and empty texts have empty sets and link with nothing; rows of equal sets are linked,
repeated rows too; a null doc_id is never a component's id unless all of its ids are null; an empty
table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import by_key, give_back, slices, written
from storyloom.llm.numeric import Runs, Words, mixed

#: A signature has CHUNKS * WIDTH symbols of 16 bits; pairs are looked for that differ in at most MAX_DISTANCE of them, so
#: that some chunk has at most MAX_DISTANCE // CHUNKS = 1 error. At a similarity of 0.8, 6.4 differ in the mean, and more
#: than 15 in about one pair of 10,000.
CHUNKS, WIDTH = 8, 4
MAX_DISTANCE = 15
AT_ONCE = 600_000
#: Nodes that share a shingle of their prefixes are paired up to this many; more meet in blocks.
PAIRED = 32
#: Nodes and shingles of a block in the mean, and how many of those that come to it a task holds against it at once.
BLOCK, BLOCK_SHINGLES, AT_ONCE_NODES = 512, 400_000, 128
FACTORS = mixed(np.arange(CHUNKS * WIDTH, dtype=np.uint64), 11) | np.uint64(1)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; of all words where they're fewer than a shingle's."""
    words = Words.of(texts, lower=True)
    runs = Runs(words.hash)
    out = []
    for a, b in zip(words.first, words.first[1:], strict=False):
        start = np.arange(a, max(a + 1, b - size + 1)) if b > a else np.zeros(0, np.int64)
        out.append(np.unique(runs.hash(start, np.minimum(start + size, b), 5)))
    return out


def node_of(s: np.ndarray) -> int:
    """A hash of a set."""
    return int(mixed(mixed(s, 6).sum(keepdims=True, dtype=np.uint64), 8).view(np.int64)[0])


def signature(s: np.ndarray) -> np.ndarray:
    """16 bits of the least value of each of the hash functions."""
    least = np.full(len(FACTORS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(s), 4096):
        least = np.minimum(least, (s[None, at : at + 4096] * FACTORS[:, None]).min(1))
    return (mixed(least) >> np.uint64(48)).astype(np.int32)


def described(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (a hash of the set), sig of every row."""
    src = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=AT_ONCE):
            sets = shingle_sets([(t or "").encode() for t in b.column("text").to_pylist()], size)
            node = [node_of(s) for s in sets]
            sig = pa.array([signature(s) if len(s) else [] for s in sets], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), sig], names=["doc_id", "text_hash", "n_shingles", "node", "sig"])

    zero = F.lit(0).cast("long")
    return src.mapInArrow(run, src.select("doc_id", "text_hash", zero.alias("n_shingles"), zero.alias("node"), F.array(F.lit(0)).alias("sig")).schema)


def keys(sig: str) -> Column:
    """The chunks of a signature, each with one symbol left out in turn, as hashes."""
    out = []
    for c in range(CHUNKS):
        for gone in range(WIDTH):
            out.append(F.xxhash64(F.lit(c * WIDTH + gone), *[F.get(sig, F.lit(c * WIDTH + i)) for i in range(WIDTH) if i != gone]))
    return F.array(*out)


def may_link(percent: int) -> Column:
    """Whether sizes n_a, n_b and signatures sig_a, sig_b allow a link."""
    near = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x != y), lambda z: z)) <= MAX_DISTANCE
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & near


def pairs(led: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes whose sizes and signatures allow a link, from rows of a node and an array of its keys' leaders."""
    both = led.select("node", F.explode("leaders").alias("other")).where("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    for x in ("a", "b"):
        both = both.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")), x)
    return both.where(may_link(percent)).select("a", "b")


def candidates(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs with the first two leaders of each key; and node, leaders: two by other orders, for the nodes of keys of more than three."""
    keyed = nodes.select("node", F.explode(keys("sig")).alias("key"))
    other = [F.min(F.struct(F.xxhash64("node", F.lit(salt)).alias("o"), "node")).getField("node") for salt in range(2)]
    leaders = written(keyed.groupBy("key").agg(F.array(F.min("node"), F.max("node")).alias("first"), F.array(*other).alias("more"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    led = keyed.join(leaders, "key")
    first = written(pairs(led.select("node", F.col("first").alias("leaders")), nodes, percent))
    return first, led.where("size > 3").select("node", F.col("more").alias("leaders"))


def unconnected(led: DataFrame, label: DataFrame) -> DataFrame:
    """led with the leaders only that aren't in their node's component yet."""
    each = led.select("node", F.explode(F.array_distinct("leaders")).alias("leader")).where("node <> leader")
    for x in ("node", "leader"):
        each = each.join(label.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")), x, "left")
    apart = each.where(F.coalesce("label_node", "node") != F.coalesce("label_leader", "leader"))
    return apart.select("node", F.array("leader").alias("leaders"))


def torn(nodes: DataFrame, label: DataFrame) -> DataFrame:
    """node, n, label, group of the nodes that share keys across components; groups are closed over such keys."""
    named = written(nodes.join(label, "node", "left").select("node", "n", "sig", F.coalesce("label", "node").alias("label")))
    keyed = named.select("node", "label", F.explode(keys("sig")).alias("key"))
    apart = keyed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("node").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 3 AND low <> high")
    led = keyed.join(written(apart.select("key", "lead")), "key").where("node <> lead")
    group = labels(led.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()).withColumnRenamed("label", "group")
    return written(named.drop("sig").join(group, "node"))


def prefixes(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """shingle, node, label, n, place of the shingles of each set's prefix that more than one component has; place: how many of the set come before."""
    each = rows.select("node", "label", "n").join(sets, "node").select("node", "label", "n", F.explode("shingles").alias("shingle"))
    known = by_key(each, "shingle", F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("many")).where("low <> high")
    shared = each.join(known.select("shingle", "many"), "shingle").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("many", "shingle"))).alias("shared"))
    shared = shared.withColumn("alone", F.col("n") - F.size("shared")).withColumn("last", F.expr(f"n - (n * {percent} + 99) div 100 + 1 - alone"))
    posted = shared.where("last > 0").select("node", "label", "n", "alone", F.posexplode(F.slice("shared", F.lit(1), F.col("last").cast("int"))).alias("i", "of"))
    return written(posted.select(F.col("of.shingle").alias("shingle"), "node", "label", "n", (F.col("alone") + F.col("i")).alias("place")))


def across(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between components, at least one for each two that a pair of a group links; rows: (node, n, label, group)."""
    posted = prefixes(rows, sets, percent)
    known = by_key(posted, "shingle", F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("many")).where("low <> high")
    posted = posted.join(known.select("shingle", "many"), "shingle")
    one, other = (posted.where(F.col("many") <= PAIRED).select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "n", "place")]) for x in ("a", "b"))
    most = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))  # in common, from the first common shingle on
    enough = (100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))
    few = one.join(other, "shingle").where("node_a < node_b AND label_a <> label_b").where(enough).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    many = posted.where(F.col("many") > PAIRED).groupBy("node").agg(F.min("place").alias("place"))
    return confirmed(written(few), sets, percent).union(written(in_blocks(rows.join(many, "node"), sets, percent)))


def in_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: for each two components of a block one pair of nodes whose full sets are similar enough, where there is one.

    Two nodes have at most n - place in common each, so one link needs gains that add up to 0 or more: what can't reach that with
    any node of its group goes. The rest is dealt out to blocks. To each block of its group come the nodes outside the group's largest
    component, or those with a gain of 0 or more: each link has one of either kind, and the fewer are taken.
    """
    rows = rows.withColumn("gain", (100 + percent) * (F.col("n") - F.col("place")) - 2 * percent * F.col("n"))
    top = rows.groupBy("group").agg(F.max("gain").alias("top"))
    rows = written(rows.join(top, "group").where("gain + top >= 0").select("group", "node", "label", "n", "gain"))
    part = rows.groupBy("group", "label").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.count_if(F.col("gain") >= 0).alias("able"))
    whole = part.groupBy("group").agg(F.max(F.struct("size", "label")).alias("main"), *[F.sum(c).alias(c) for c in ("size", "shingles", "able")]).where("main.size < size")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    whole = whole.select("group", F.col("main.label").alias("main"), blocks, (F.col("able") < F.col("size") - F.col("main.size")).alias("by_gain"))
    comes = F.when(F.col("by_gain"), F.col("gain") >= 0).otherwise(F.col("label") != F.col("main"))
    rows = rows.join(whole, "group").join(sets, "node").select("group", "node", "label", "shingles", "blocks", comes.alias("comes"))
    all_ = rows.withColumns({"block": F.pmod(F.xxhash64("node"), "blocks").cast("int"), "side": F.lit(0)})
    few = rows.where("comes").withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "side": F.lit(1)})
    both = all_.unionByName(few).select("group", "block", "side", "node", "label", "shingles")

    def links(held: list[tuple], asked: list[tuple]) -> list[tuple[int, int]]:
        """held and asked: (node, label, set)."""
        flat = np.concatenate([x[2] for x in held])
        order = np.argsort(flat, kind="stable")
        flat, holder = flat[order], np.repeat(np.arange(len(held)), [len(x[2]) for x in held])[order]
        shared = np.zeros((len(asked), len(held)), np.int64)
        for i, (_, _, s) in enumerate(asked):
            for part in np.split(s, range(2_000, len(s), 2_000)):
                left, right = np.searchsorted(flat, part, "left"), np.searchsorted(flat, part, "right")
                size = right - left
                shared[i] += np.bincount(holder[np.repeat(left - np.cumsum(size) + size, size) + np.arange(size.sum())], minlength=len(held))
        n, m = (np.array([len(x[2]) for x in side], np.int64) for side in (asked, held))
        of, to = (np.array([x[1] for x in side], np.int64) for side in (asked, held))
        i, j = np.nonzero((100 * shared >= percent * (n[:, None] + m[None, :] - shared)) & (of[:, None] != to[None, :]))
        found = {}
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            found.setdefault((min(of[a], to[b]), max(of[a], to[b])), (asked[a][0], held[b][0]))
        return [(min(p), max(p)) for p in found.values()]

    def linked(held: list[tuple], asked: list[tuple]) -> pa.RecordBatch:
        out = links(held, asked) if asked else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, asked, size = None, [], [], 0
        for b in batches:
            for group, block, side, node, label, shingles in zip(*(b.column(c) for c in ("group", "block", "side", "node", "label", "shingles")), strict=True):
                key = (group.as_py(), block.as_py())
                if asked and (key != now or len(asked) >= AT_ONCE_NODES or size >= BLOCK_SHINGLES):
                    yield linked(held, asked)
                    asked, size = [], 0
                if key != now:
                    now, held = key, []
                (asked if side.as_py() else held).append((node.as_py(), label.as_py(), shingles.values.to_numpy()))
                size += len(shingles) * side.as_py()
        yield linked(held, asked)
        give_back()

    return both.repartition("group", "block").sortWithinPartitions("group", "block", "side").mapInArrow(run, "a long, b long").distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node, shingles of the wanted (node, id, text_hash): a document for each node, whose id may be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=AT_ONCE):
            sets = shingle_sets([(t or "").encode() for t in b.column("text").to_pylist()], size)
            nodes = b.column("node").to_pylist()
            same = [node_of(s) == n for s, n in zip(sets, nodes, strict=True)]
            found = [np.sort(s.view(np.int64)) for s, ok in zip(sets, same, strict=True) if ok]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, ok in zip(nodes, same, strict=True) if ok], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    wanted = wanted.select("node", "id", F.col("text_hash").alias("h"))
    held = docs.select("doc_id", "text").join(wanted, (F.xxhash64("text") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("text", "node")
    return held.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def confirmed(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    for x in ("a", "b"):
        found = found.join(sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}")), x)
    shared = F.size(F.array_intersect("s_a", "s_b"))
    found = found.select("a", "b", (F.size("s_a") + F.size("s_b")).alias("both"), shared.alias("shared"))
    return written(found.where(100 * F.col("shared") >= percent * (F.col("both") - F.col("shared"))).select("a", "b"))


def labels(links: DataFrame) -> DataFrame:
    """node, label of every linked node: the least node that it reaches.

    Each round hangs every node on its least neighbour, follows that to its end, and goes on with the links between ends only.
    Two rounds leave half the nodes at most, so all rounds together join little more than the links, whatever a component's shape.
    """
    edges, label = written(links.select("a", "b")), None
    while True:
        ends = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        up = written(ends.select("node", F.least("node", "near").alias("up")))
        while True:  # each time twice as far
            step = written(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("far")), "up").select("node", "up", "far"))
            up = step.select("node", F.col("far").alias("up"))
            if step.where("up <> far").isEmpty():
                break
        top = up.select(F.col("node").alias("label"), "up")
        label = up.select("node", F.col("up").alias("label")) if label is None else written(label.join(top, "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        for x in ("a", "b"):
            edges = edges.join(up.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}")), x)
        edges = written(edges.where("up_a <> up_b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct())
        if edges.isEmpty():
            return label


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """label with the components made one that the links lead between, and the nodes that had no link before."""
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(label, "node", "left_anti").select("node", F.col("node").alias("label"))
    label = written(label.unionByName(new))
    ends = links
    for x in ("a", "b"):
        ends = ends.join(label.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")), x)
    between = ends.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).where("a <> b").distinct()
    top = labels(between).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return written(label.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")))


def classes(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept; documents link from `percent` of shared among all shingles of `size` words."""
    rows = written(described(docs, size))
    nodes = written(rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("holder"), F.max("n_shingles").alias("n"), F.first("sig").alias("sig")))
    first, led = candidates(nodes, percent)

    def sets(found: DataFrame) -> DataFrame:
        ends = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return written(sets_of(docs, nodes.join(ends, "node").select("node", F.col("holder.doc_id").alias("id"), F.col("holder.text_hash").alias("text_hash")), size))

    label = labels(confirmed(first, sets(first), percent))
    more = written(pairs(unconnected(led, label), nodes, percent).join(first, ["a", "b"], "left_anti"))
    found = confirmed(more, sets(more), percent)
    if not found.isEmpty():
        label = joined(label, found)
    rest = torn(nodes, label)
    if not rest.isEmpty():
        holders = nodes.join(rest.select("node"), "node").select("node", F.col("holder.doc_id").alias("id"), F.col("holder.text_hash").alias("text_hash"))
        found = across(rest, written(sets_of(docs, holders, size)), percent)
        if not found.isEmpty():
            label = joined(label, found)
    label = nodes.join(label, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    least = label.groupBy("label").agg(F.min("least").alias("component_id"))
    component = label.join(least, "label").select(F.col("node").alias("of"), "component_id")
    out = rows.join(component, (F.col("node") == F.col("of")) & (F.col("n_shingles") > 0), "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def distinct_documents(docs: DataFrame, **how) -> DataFrame:
    """One document of each class, in all columns of docs: the one of least id and, among rows of that id, of least text hash."""
    kept = classes(docs, **how).where("kept")
    kept = kept.groupBy("component_id", F.when(F.col("n_shingles") == 0, F.col("text_hash")).alias("e")).agg(F.min("text_hash").alias("__hash"))
    kept = kept.select(F.col("component_id").alias("__id"), "__hash").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    return docs.join(kept, same).dropDuplicates(["__id", "__hash"]).select(docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(w[i:least(i + 3, len(w))]) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id, c = doc_id AS kept
FROM (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) LEFT JOIN n USING (doc_id)
"""
