"""Chunk sets of persons and relations as rows: the counts of the lists, without any list."""

from pyspark.sql import functions as F

from storyloom.operators import graph
from storyloom.plans import catalog


def merges_of(spark, sf):
    return graph.valid_merges(catalog.people(spark, sf), catalog.merges(spark, sf))


def test_counts_without_lists(spark, sf):
    """The rows that the lists give, for persons and relations, before and after merges."""
    f, merges = catalog.facts(spark, sf), merges_of(spark, sf)
    people = f.withColumnRenamed("source", "name")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect())) and a.count() > 0
    assert same(graph.persons(people, lists=False), graph.persons(people))
    alias = catalog.alias_rows(spark, sf)
    slim = graph.merge_persons(graph.apply_aliases(graph.persons(people, lists=False), alias), merges, graph.merge_person_chunks(graph.person_chunks(people), merges))
    assert "chunk_ids" not in slim.columns and same(slim, graph.merge_persons(graph.apply_aliases(graph.persons(people), alias), merges))
    assert same(graph.relations(f, lists=False), graph.relations(f))
    slim = graph.merge_relations(graph.relations(f, lists=False), merges, graph.merge_relation_chunks(graph.relation_chunks(f), merges))
    rounded = lambda df: df.withColumn("confidence", F.round("confidence", 9))
    assert "chunk_ids" not in slim.columns and same(rounded(slim), rounded(graph.merge_relations(graph.relations(f), merges)))
    sets = graph.merge_relation_chunks(graph.relation_chunks(f), merges).groupBy(*graph.KEY).agg(F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"))
    assert same(sets, graph.merge_relations(graph.relations(f), merges).select(*graph.KEY, "chunk_ids"))


def test_a_person_in_a_million_chunks(spark):
    """Two names of one person, in a million chunks each that overlap by half; each chunk twice."""
    ids = spark.range(2_000_000)
    names = ids.select(F.lit("n").alias("novel_id"), (F.col("id") % 1_000_000).cast("int").alias("chunk_id"), F.lit(1).alias("chapter_id"), F.lit("A").alias("name"))
    names = names.union(ids.select(F.lit("n"), (F.col("id") % 1_000_000 + 500_000).cast("int"), F.lit(2), F.lit("B")))
    merges = spark.createDataFrame([("n", "B", "A")], "novel_id string, drop string, keep string")
    people = graph.persons(names, lists=False)
    assert {r.name: r.mention_count for r in people.collect()} == {"A": 1_000_000, "B": 1_000_000}
    merged = graph.merge_persons(people.withColumn("aliases", F.array().cast("array<string>")), merges, graph.merge_person_chunks(graph.person_chunks(names), merges))
    (one,) = merged.collect()
    assert (one.name, one.mention_count, one.chapters, one.aliases) == ("A", 1_500_000, [1, 2], ["B"])


def test_no_list_of_chunks_in_the_plans(spark, sf):
    for query in (catalog.agg1_persons, catalog.agg8_merged_persons, catalog.agg9_merged_relations):
        plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_set(chunk_id" not in plan and "collect_list(chunk_id" not in plan and "flatten(collect_list(chunk_ids" not in plan


def test_a_build_without_lists(spark, tmp_path):
    from test_pipeline import chapters

    from storyloom.config import Settings
    from storyloom.operators import store
    from storyloom.plans import ingest

    judge = lambda pairs: [{"a": p["a"], "b": p["b"], "merge": True, "confidence": 1.0} for p in pairs]
    ch, titles = chapters(spark, ["Anna met Bert in town", "Anna and Bertram and Annabel", "Carla saw Bertrand", "Bert and Anna and Dora"]), spark.createDataFrame([("n", "Book")], "novel_id string, title string")
    got = []
    for lists in (True, False):
        out = ingest.build(spark, ch, str(tmp_path / f"w{lists}"), Settings(chunk_lists=lists), merge_judge=judge)
        ingest.save(out, titles, str(tmp_path / f"g{lists}"))
        assert ("chunk_ids" in out.persons.columns) is lists and out.merges.count() > 0
        now = store.snapshot(spark, str(tmp_path / f"g{lists}"))
        plain = lambda df: sorted(map(str, df.select(sorted(set(df.columns) - {"chunk_ids"})).collect()))
        got.append((plain(now["persons"]), plain(now["relates_to"])))
    assert got[0] == got[1] and got[0][0] and got[0][1]


def test_equal_ordinals_are_decided_by_the_rows_alone(spark):
    rows = [("n", 1, 1, 3, "A", "B", "t", c / 10, i) for i, c in enumerate((7, 2, 9, 4))]
    names = "novel_id string, chunk_id int, chapter_id int, ordinal int, source string, target string, type string, confidence double, row long"
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        for n in (1, 3):
            df = spark.createDataFrame(order, names).repartition(n)
            assert graph.relations(df).first().confidence == 0.7  # the first of the table
            assert graph.relations(df.drop("row")).first().confidence == 0.2


def test_a_person_in_a_chunk_of_two_chapters(spark):
    rows = spark.createDataFrame([("n", 1, 1, "A"), ("n", 1, 2, "A"), ("n", 1, 1, "A"), ("n", None, 3, "A"), ("n", 4, None, "A")], "novel_id string, chunk_id int, chapter_id int, name string")
    assert tuple(graph.persons(rows).first()) == ("n", "A", 2, [1, 2, 3], [1, 4])
