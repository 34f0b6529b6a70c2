"""Look-ups in a written graph: the rows of a scan, of which only some are read."""

import random

import pytest
from pyspark.sql import functions as F

from storyloom.operators import graph, store


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """A graph of one large and one small novel, with row groups of a few hundred rows."""
    rng, path = random.Random(1), str(tmp_path_factory.mktemp("graph") / "g")
    name = lambda: "".join(rng.choice("abcdefghij日月é") for _ in range(rng.randrange(1, 9)))
    people, edges = [], []
    for novel, n in (("n", 3000), ("m", 20)):
        names = sorted({name() for _ in range(n)})
        people += [(novel, x, rng.randrange(50), [1], [1], [name() for _ in range(rng.randrange(3))]) for x in names]
        pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(3 * n)})
        edges += [(novel, a, b, "love", [1], 1, 0.5, [(1, 1, "x" * 50)]) for a, b in pairs if a != b]
    p = spark.createDataFrame(people, "novel_id string, name string, mention_count long, chapters array<int>, chunk_ids array<int>, aliases array<string>")
    e = spark.createDataFrame(edges, "novel_id string, source string, target string, type string, chunk_ids array<int>, weight long, confidence double, evidence array<struct<chunk_id:int,chapter_id:int,text:string>>")
    titles = spark.createDataFrame([("n", "N"), ("m", "M")], "novel_id string, title string")
    before, store.ROW_GROUP = store.ROW_GROUP, 16_384
    store.write_novels(titles, p, e, path)
    store.ROW_GROUP = before
    return path, people, edges


def rows_read(df, table):
    """Rows that the scans of a table gave when df ran."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "Adaptive" in node.nodeName():
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if node.nodeName().startswith("Scan parquet") and f"/{table}" in node.toString():
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("q", ["a", "日", "ab", "日月", "abc", "bcde", "éé", "abab", "aaaa", "zz", "a日", " ab ", "", "jihgfe"])
@pytest.mark.parametrize("novel", ["n", "m", "none"])
def test_search_equals_the_scan(spark, written, q, novel):
    path, _, _ = written
    people = store.read(spark, path, "persons")
    for limit in (1, 10):
        assert store.search_written(spark, path, novel, q, limit).collect() == store.search(people, novel, q, limit).select(people.columns).collect()


def test_search_looks_at_every_name_and_alias(spark, written):
    path, people, _ = written
    for q in ("日月", "abc", "j"):
        expected = sorted(((-n, x) for v, x, n, *_, aliases in people if v == "n" and any(q in t for t in (x, *aliases))))[:10]
        assert [(-r.mention_count, r.name) for r in store.search_written(spark, path, "n", q).collect()] == expected


def test_one_hop_equals_the_scan_and_reads_few_rows(spark, written):
    path, _, edges = written
    for novel, name in (("n", edges[100][1]), ("n", edges[2000][2]), ("m", edges[-1][1]), ("n", "nobody")):
        near = store.one_hop_written(spark, path, novel, name)
        expected = sorted((a, b) for v, a, b, *_ in edges if v == novel and name in (a, b))
        assert sorted((r.source, r.target) for r in near.collect()) == expected
        assert sorted(map(str, near.collect())) == sorted(map(str, store.one_hop_edges(store.read(spark, path, "relates_to"), novel, name).select(near.columns).collect()))
        total = 2 * sum(v == novel for v, *_ in edges)
        assert novel == "m" or rows_read(store.one_hop_written(spark, path, novel, name), "adjacent") < 0.2 * total


def test_a_rare_gram_reads_few_postings(spark, written):
    path, people, _ = written
    hits = store.read(spark, path, "postings").where("novel_id = 'n' AND gram IN ('日月é')")
    total = store.read(spark, path, "postings").where("novel_id = 'n'").count()
    assert 0 < hits.count() and rows_read(hits, "postings") < 0.1 * total


def test_postings_and_ends_of_odd_rows(spark):
    people = spark.createDataFrame([("n", "a\nb", 1, None), ("n", "\U0001f600x", 2, ["\U0001f600x", ""])], "novel_id string, name string, mention_count long, aliases array<string>")
    got = {(r.gram, r.name) for r in store.postings(people).collect()}
    assert got == {("a", "a\nb"), ("\n", "a\nb"), ("b", "a\nb"), ("a\n", "a\nb"), ("\nb", "a\nb"), ("a\nb", "a\nb")} | {(g, "\U0001f600x") for g in ("\U0001f600", "x", "\U0001f600x")}
    empty = graph.stored_relations(spark.createDataFrame([], "novel_id string, source string, target string"), people)
    assert store.adjacent(empty).count() == 0 and store.adjacent(spark.createDataFrame([("n", "a", "a"), ("n", "a", "b")], "novel_id string, source string, target string")).where(F.col("end") == "a").count() == 2


def test_a_write_works_out_people_and_edges_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    people = spark.createDataFrame([("n", f"P{i}", i, [1], [i], []) for i in range(10)], "novel_id string, name string, mention_count long, chapters array<int>, chunk_ids array<int>, aliases array<string>")
    edges = spark.createDataFrame([("n", f"P{i}", f"P{i + 1}", "other", [i], 1, 0.5, []) for i in range(10)], "novel_id string, " + store.SCHEMAS["relates_to"].removesuffix(", novel_id string"))
    people, edges = (df.repartition(2).mapInArrow(noted, df.schema) for df in (people, edges))
    titles = spark.createDataFrame([("n", "N")], "novel_id string, title string")
    assert store.write_novels(titles, people, edges, f"file://{tmp_path}/g") == {"edges_without_persons": 1}  # P10 is no person
    assert seen.value == 20
    now = store.snapshot(spark, f"file://{tmp_path}/g")
    assert now["persons"].count() == 10 and now["relates_to"].count() == 9 and now["adjacent"].count() == 18
