"""What a query uses several times is worked out once: its plan reads what was written, not the sources again."""

from storyloom.operators import recall
from storyloom.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_merged_relations_read_lines_once(spark):
    df = QUERIES["agg9_merged_relations"](spark, "/root/testdata/sf0.001")
    assert "l_partkey" not in plan(df) and df.count() > 0


def test_chapters_read_archives_once(spark):
    df = QUERIES["src1_epub_chapters"](spark, "/root/testdata/sf0.001")
    assert "html" not in plan(df) and df.count() > 0


def test_candidates_of_a_chunk_are_ordered_once(spark):
    """A chunk's strong candidates come to its mentions as one list: rows of mentions and candidates aren't held against each other."""
    mentions = spark.createDataFrame([("n", 1, m) for m in ("Ann", "Bob", "Cleo")], "novel_id string, chunk_id int, mention string")
    index = spark.createDataFrame([("n", c, c) for c in ("Ann", "Anna", "Bobby", "Zed")], "novel_id string, canonical string, name string")
    seen = spark.createDataFrame([("n", 1, "Zed"), ("n", 1, "Ann")], "novel_id string, chunk_id int, canonical string")
    out = recall.candidates(mentions, index, seen.limit(1), seen, 2)
    assert "LeftAnti" not in plan(out)
    got = sorted((r.mention, r["rank"], r.canonical, r.source) for r in out.collect())
    assert got == [
        ("Ann", 1, "Zed", "strong_extraction"), ("Ann", 2, "Anna", "weak"), ("Bob", 1, "Zed", "strong_extraction"), ("Bob", 2, "Ann", "strong_text"),
        ("Cleo", 1, "Zed", "strong_extraction"), ("Cleo", 2, "Ann", "strong_text"),
    ]
