"""Fingerprints, substring and near-duplicate removal against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from helpers import prose

from storyloom.llm import fingerprint, near_dedup, substring_dedup



def plain_likeness(a, b):
    coarse, fine = fingerprint.paragraphs([a, b])
    doc, digest = fine if max(len(a), len(b)) < fingerprint.SHORT else coarse
    x, y = (set(digest[doc == k].tolist()) for k in (0, 1))
    return len(x & y) / len(x | y) if x | y else 1.0


def check_versions(df, per_part):
    """Every column against plain code; documents of equal id are in the order of their texts' hashes."""
    out = fingerprint.versions(df, per_part=per_part).collect()
    rows = df.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()
    rows = sorted(((r.doc_id, r.text, r.h) for r in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[2]))
    expected = []
    for (i, text, _), (_, after, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        new = fingerprint.edited(text, after)
        expected.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), round(plain_likeness(text, new), 9), round(plain_likeness(text, after), 9)))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in out), key=str) == sorted(expected, key=str)
    prints = {}
    for r in out:
        assert prints.setdefault((r.doc_id, r.n_chars), r.fingerprint) == r.fingerprint or sum(x[0] == r.doc_id for x in rows) > 1


def test_versions_against_plain_code(odd, none):
    check_versions(odd, 5)
    assert fingerprint.versions(none).count() == 0


def test_versions_of_hot_ids(make):
    """A third of the rows has one id, a third none, and many rows of these are equal."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 20), "s") for i in range(60)] + [(30, prose(rng, rng.randrange(9)), "s") for _ in range(60)] + [(None, "same text", "s")] * 40 + [(None, None, "s")] * 10 + [(None, prose(rng, 9), "s") for _ in range(20)]
    rows += [(2**60 + i, f"far {i}", "s") for i in range(5)] + [(-(2**60), "low", "s")]
    check_versions(make(rows), 10)
    parts = fingerprint.in_order(make(rows), 10).withColumn("p", fingerprint.F.spark_partition_id()).groupBy("p").count().collect()
    assert max(r["count"] for r in parts) <= 30


def test_one_document_follows_itself(make):
    (r,) = fingerprint.versions(make([(3, "abcdefghi", "s")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefabc").hexdigest()


def test_likeness_is_that_of_the_paragraphs():
    rng = random.Random(4)
    texts = ["", "a", "a\na\na\nb", "\n" * 50] + [prose(rng, n) for n in (3, 30, 100, 400, 3000)]
    texts += [t[: len(t) // 2] + prose(rng, 20) + t[len(t) // 2 :] for t in texts]
    a, b = zip(*((x, y) for x in texts for y in texts), strict=True)
    got = fingerprint.compared(fingerprint.fingerprints(list(a)), fingerprint.fingerprints(list(b)))
    assert np.allclose(got, [plain_likeness(x, y) for x, y in zip(a, b, strict=True)])


def test_peeling_lists_a_sketch():
    rng = np.random.default_rng(0)
    digest = rng.integers(0, 2**63, 500).astype(np.uint64)
    which = np.sort(rng.integers(0, 5, 500))
    d, x, sign, done = fingerprint.sketched(which, digest, 5).peeled()
    assert done.all() and (sign == 1).all()
    assert sorted(zip(d, x, strict=True)) == sorted(zip(which, digest, strict=True))


def plain_substrings(rows, length=50):
    first = {}
    for i, text in rows:
        w = (text or "").encode().split()
        for k in range(len(w) - length + 1):
            if i is not None:
                key = b" ".join(w[k : k + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if i is not None and first[b" ".join(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


def check_substrings(df, **how):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.deduplicated(df, **how).collect()), key=str)
    assert got == plain_substrings([(r.doc_id, r.text) for r in df.collect()])


def test_substrings_of_odd_rows(odd, none):
    check_substrings(odd)
    assert substring_dedup.deduplicated(none).count() == 0


def test_substrings_against_plain_code(make):
    rng = random.Random(11)
    passages = [prose(rng, n) for n in (49, 50, 51, 70, 120)] + ["du " * 130, "la li " * 60]
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randrange(60)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages).split()
            a = rng.randrange(10)
            parts.insert(rng.randrange(3), " ".join(p[a if rng.random() < 0.5 else 0 :]))
        rows.append((i * 7 % 120, "\t".join(parts), "s"))
    for most in (0, 3, 256):  # all, some and none of the shared anchors split by window
        check_substrings(make(rows), most=most)


def test_query_of_substrings_against_plain_code(spark, sf):
    from storyloom.llm.catalog import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain_substrings([(r.doc_id, r.text) for r in docs])]
    assert sorted(map(tuple, QUERIES["op7_substring_dedup"](spark, sf).collect()), key=str) == expected and sum(x[2] for x in expected) > 1000


def test_automata_decide_between_surroundings():
    """Least owner of each window by brute force, on sequences with many common parts."""
    rng = random.Random(5)
    for _ in range(100):
        common = [rng.randrange(4) for _ in range(12)]
        words = [[rng.randrange(4) for _ in range(rng.randrange(6))] + common[rng.randrange(4) :] + [rng.randrange(4) for _ in range(rng.randrange(6))] for _ in range(rng.randrange(1, 7))]
        words = [w for w in words if len(w) >= 5]
        owner = [rng.randrange(50) for _ in words]
        runs = substring_dedup.shard_runs(list(range(len(words))), owner, words, 5)
        got = {(c, k): least for c, i, j, least in runs for k in range(i, j + 1)}
        windows = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        assert got == {(c, k): min(o for o, v in zip(owner, words, strict=True) if x in windows(v)) for c, w in enumerate(words) for k, x in enumerate(windows(w))}


def plain_classes(rows, size, percent):
    sets = []
    for _, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def check_classes(df, size=4, percent=80):
    out = near_dedup.classes(df, size, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == plain_classes([(r.doc_id, r.text) for r in df.collect()], size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_classes_of_odd_rows(odd, none, make):
    check_classes(odd)
    assert near_dedup.classes(none).count() == 0
    check_classes(make([(i, prose(random.Random(i), 50), "s") for i in range(5)]))  # no links at all


def test_near_copies_of_null_id(make):
    rng = random.Random(3)
    base = prose(rng, 120).split()
    near = lambda k: " ".join(w if i != 10 * k else "other" for i, w in enumerate(base))
    check_classes(make([(5, near(1), "s"), (None, near(2), "s"), (None, near(3), "s"), (None, near(3), "s"), (9, prose(rng, 90), "s"), (None, prose(rng, 90), "s")]))
    check_classes(make([(None, near(1), "s"), (None, near(2), "s")]))


def test_classes_against_plain_code(make):
    rng = random.Random(2)
    rows = []
    for g in range(25):
        base = prose(rng, rng.choice([3, 5, 40, 150])).split()
        for _ in range(rng.choice([1, 2, 5, 14])):
            w = [x if rng.random() > 0.02 else x.upper() + "x" for x in base]
            rows.append((len(rows) * 31 % 997, " ".join(w).upper() if rng.random() < 0.2 else " ".join(w), "s"))
    chain = prose(rng, 120).split()
    for k in range(20):  # each is near the one before, the ends are not
        chain = chain[: 6 * k] + prose(rng, 3).split() + chain[6 * k + 3 :]
        rows.append((2000 + k, " ".join(chain), "s"))
    check_classes(make(rows))
    check_classes(make(rows), size=5)


def test_one_document_of_each_class(make, odd):
    kept = near_dedup.distinct_documents(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()]
    assert sorted(ids) == sorted(set(ids)) and 6 not in ids and 5 in ids and {1, 2, 3, 4} <= set(ids)


def test_reference_passages_against_plain_code(make, odd, none):
    rng = random.Random(9)
    reference = [prose(rng, n) for n in (30, 50, 64, 200)] + ["la li " * 40]
    texts = [prose(rng, 20) + " " + " ".join(rng.choice(reference).split()[rng.randrange(5) :]) + "\n" + prose(rng, rng.randrange(30)) for _ in range(60)]
    windows = {tuple(r.split()[k : k + 50]) for r in reference for k in range(len(r.split()) - 49)}
    docs = make([(i, t, "s") for i, t in enumerate(texts)] + [(99, None, "s")])
    ref = make([(i, t, "s") for i, t in enumerate(reference)] + [(8, None, "s")])
    for shard_words in (100, 20_000):
        out = {r.doc_id: r for r in substring_dedup.without_reference(docs, ref, shard_words=shard_words).collect()}
        assert out[99].n_words == 0 and len(out) == 61
        for i, t in enumerate(texts):
            w = t.split()
            gone = {k + j for k in range(len(w) - 49) if tuple(w[k : k + 50]) in windows for j in range(50)}
            assert (out[i].n_words, out[i].n_removed, out[i].kept) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert substring_dedup.without_reference(none, ref).count() == 0 and substring_dedup.without_reference(odd, none).where("n_removed > 0").count() == 0
    with pytest.raises(ValueError, match="at most"):
        substring_dedup.without_reference(docs, ref, max_words=100)


def test_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        seqs = [[rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(rng.randrange(1, 4))]
        known = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        doc = [rng.randrange(4) for _ in range(15)]
        best = [max([n for n in range(1, i + 2) if tuple(doc[i + 1 - n : i + 1]) in known], default=0) for i in range(len(doc))]
        assert substring_dedup.Automaton(seqs).statistics(doc) == best


def copies(rng, n, share):
    """n copies of one text, each with that share of its words or a little more or less changed."""
    base = prose(rng, 150).split()
    rate = [share * rng.uniform(0.8, 1.3) for _ in range(n)]
    return [" ".join(x if rng.random() > r else f"{x}x{rng.random()}" for x in base) for r in rate]


@pytest.mark.parametrize("share", [0.02, 0.036])
def test_copies_just_under_the_threshold_against_plain_code(make, share):
    """Hundreds of copies, most pairs of which aren't near: their leaders alone miss links."""
    check_classes(make([(i, t, "s") for i, t in enumerate(copies(random.Random(0), 300, share))]))


def test_query_of_classes_against_sql(spark):
    """Recall by pairs over 10,000 documents: every link of the SQL's components is found, and no other."""
    import duckdb

    from storyloom.llm.catalog import QUERIES

    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    expected = sorted(map(tuple, con.execute(near_dedup.ORACLE).fetchall()))
    assert sorted(map(tuple, QUERIES["op9_near_dedup"](spark, sf).select("doc_id", "n_shingles", "component_id", "kept").collect())) == expected
    assert sum(i != c for i, _, c, _ in expected) > 500


def joined_components(spark, rng, groups, paired, monkeypatch):
    """What across() joins and what all pairs would: nodes are sets that share a template of their group, each a component or of one of a few."""
    monkeypatch.setattr(near_dedup, "PAIRED", paired)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    nodes = []
    for g, (n, changed) in enumerate(groups):
        base = rng.sample(range(10**6), 60)
        for _ in range(n):
            s = {x if rng.random() > changed * rng.uniform(0, 1.5) else rng.randrange(10**9) for x in base}
            nodes.append((len(nodes), g, len(nodes) if rng.random() < 0.6 else -1 - rng.randrange(3) - 3 * g, sorted(s)))
    rows = spark.createDataFrame([(i, len(s), c, g) for i, g, c, s in nodes], "node long, n long, label long, group long")
    sets = spark.createDataFrame([(i, s) for i, _, _, s in nodes], "node long, shingles array<long>")
    found = {(r.a, r.b) for r in near_dedup.across(rows, sets, 80).collect()}
    held = [set(s) for *_, s in nodes]
    near = {(a, b) for b in range(len(nodes)) for a in range(b) if nodes[a][2] != nodes[b][2] and 100 * len(held[a] & held[b]) >= 80 * len(held[a] | held[b])}

    def components(links):
        label = {c: c for _, _, c, _ in nodes}
        root = lambda c: c if label[c] == c else root(label[c])
        for a, b in links:
            label[root(nodes[a][2])] = root(nodes[b][2])
        parts = {}
        for c in label:
            parts.setdefault(root(c), set()).add(c)
        return sorted(map(sorted, parts.values()))

    assert found <= near
    return components(found), components(near), len(near)


@pytest.mark.parametrize("paired", [1, 8, 32])
def test_last_step_against_all_pairs(spark, monkeypatch, paired):
    """Sets that share rare and frequent shingles, paired one by one and in blocks."""
    got, expected, n = joined_components(spark, random.Random(paired), [(6, 0.1), (40, 0.06), (40, 0.12), (90, 0.09), (30, 0.3)], paired, monkeypatch)
    assert got == expected and n > 100


def test_a_shared_template_needs_no_pairs(spark):
    """Where a template is not enough for a link, its many documents neither post it nor meet."""
    rng = random.Random(7)
    for own, most in ((60, 0), (25, 40 * 14)):
        sets = [(i, [*range(97), *rng.sample(range(1000, 10**9), own)]) for i in range(40)]
        rows = spark.createDataFrame([(i, len(s), i, 0) for i, s in sets], "node long, n long, label long, group long")
        held = spark.createDataFrame(sets, "node long, shingles array<long>")
        assert near_dedup.prefixes(rows, held, 80).count() <= most
        hot = rows.withColumn("place", near_dedup.F.lit(own))
        assert near_dedup.in_blocks(hot, held, 80).count() == 0


def joined_rows(spark, run):
    """Rows that the joins of run() made, by Spark's own count, and its result."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    done, total = store.executionsList(), 0
    for i in range(before, done.size()):
        at = done.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if "Join" in node.name():
                metrics = (node.metrics().apply(k) for k in range(node.metrics().size()))
                total += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
    return total, out


def test_closing_labels_joins_each_link_about_twice(spark):
    """Links within large groups aren't joined anew in each round; a path and a star around a late node take few rounds too."""
    rng = random.Random(12)
    links = {(a, b) for a in range(300) for b in rng.sample(range(300), 12) if a < b and a % 3 == b % 3}
    links |= {(1000 + k, 1001 + k) for k in range(90)} | {(2000 + k, 2999) for k in range(60)}
    label = {x: x for link in links for x in link}
    root = lambda x: x if label[x] == x else root(label[x])
    for a, b in sorted(links):
        x, y = sorted((root(a), root(b)))
        label[y] = x
    df = spark.createDataFrame(sorted(links), "a long, b long")
    rows, got = joined_rows(spark, lambda: near_dedup.labels(df).collect())
    assert {r.node: r.label for r in got} == {x: root(x) for x in label} and len(got) == len(label)
    assert rows <= 2 * len(links) + 12 * len(label)
    links = [(a, b) for a in range(200) for b in range(a + 1, 200) if rng.random() < 0.5]
    rows, got = joined_rows(spark, lambda: near_dedup.labels(spark.createDataFrame(links, "a long, b long")).collect())
    assert {r.label for r in got} == {0} and rows <= 2.2 * len(links)
    assert near_dedup.labels(df.limit(0)).count() == 0
