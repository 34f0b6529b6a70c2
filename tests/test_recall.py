"""Recall: names in texts and the names most alike, against plain code and SQL, in any number of blocks and shards."""

import random

import duckdb
import pytest

from storyloom.operators import alike, recall
from storyloom.operators.alike import NameIndex


def plain(index, mention, k, skip=()):
    letters = set(mention)
    score = lambda c: (any(mention in n or n in mention for n in index[c]), max(len(letters & set(n)) for n in index[c]))
    ranked = sorted((c for c in index if c != mention and c not in skip), key=lambda c: (not score(c)[0], -score(c)[1], c))
    return [(c, *score(c)) for c in ranked[:k]]


@pytest.mark.parametrize(("seed", "block"), [(i, b) for i in range(4) for b in (0, 5, 128)])
def test_index_against_all_names(seed, block, monkeypatch):
    monkeypatch.setattr(alike, "BLOCK", max(block, 1))
    rng = random.Random(seed)
    for _ in range(100):
        letters = "abcdéf日"[: rng.randrange(2, 8)]
        word = lambda least=1: "".join(rng.choice(letters) for _ in range(rng.randrange(least, 6)))  # noqa: E731, B023
        index, names = NameIndex(), {}
        for _ in range(rng.randrange(30)):  # asked again and again while it grows
            c = word()
            for n in (c, *(word() for _ in range(rng.randrange(3)))):
                names.setdefault(c, set()).add(n)
                index.add(c, n)
            m, k, skip = word(0), rng.randrange(12), set(rng.sample(sorted(names), min(len(names), rng.randrange(3))))
            assert index.most_alike(m, k, skip) == plain(names, m, k, skip)


def test_twice_the_names_are_not_twice_the_work():
    rng, seen = random.Random(2), []
    word = lambda: "".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", range(26, 0, -1), k=rng.randrange(4, 10)))
    asked = [word() for _ in range(300)]
    for n in (1000, 2000, 4000, 8000):
        index = NameIndex()
        for _ in range(n):
            c = word()
            index.add(c, c)
        for m in asked:
            index.most_alike(m, 5)
        seen.append(index.looked_at)
    assert all(b < 1.85 * a for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] < 300 * 8000 / 4


def named(spark, rows):
    return spark.createDataFrame(rows, "novel_id string, canonical string, name string")


@pytest.mark.parametrize(("mentions", "names"), [(20_000, 50_000), (7, 9), (1, 1)])
def test_weak_candidates_in_blocks_and_shards(spark, mentions, names):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6)))
    index, asked = {}, set()
    for novel, n in (("hot", 60), ("small", 3), ("none", 0)):
        for _ in range(n):
            c = word()
            index.setdefault(novel, {}).setdefault(c, set()).update({c, word()})
        asked |= {(novel, word()) for _ in range(n + 5)}
    rows = [(novel, c, n) for novel, of in index.items() for c, own in of.items() for n in own]
    out = recall.weak_candidates(spark.createDataFrame(sorted(asked), "novel_id string, mention string"), named(spark, rows), 6, mentions, names)
    expected = [(novel, m, c, sorted(index[novel][c]), i + 1) for novel, m in asked if novel in index for i, (c, _, _) in enumerate(plain(index[novel], m, 6))]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize(("chars", "names"), [(4_000_000, 100_000), (50, 3), (1, 1)])
def test_names_in_texts_in_blocks_and_shards(spark, chars, names):
    rng = random.Random(4)
    texts = [(novel, i, "".join(rng.choice("ab c日\U0001f600") for _ in range(rng.randrange(40)))) for novel, n in (("hot", 40), ("m", 3), ("no names", 2)) for i in range(n)] + [("hot", 99, ""), ("hot", 98, None)]
    index = [("hot", "abc", "abc"), ("hot", "abc", "a"), ("hot", "日b", "日b"), ("hot", "x", "b c"), ("hot", "y", "b c"), ("hot", "z", ""), ("hot", "w", None), ("m", "\U0001f600", "\U0001f600"), ("no texts", "a", "a")]
    got = recall.text_mentions(spark.createDataFrame(texts, "novel_id string, chunk_id int, text string"), named(spark, index + index[:2]), chars, names)
    expected = {(v, i, c) for v, i, t in texts for w, c, n in index if v == w and t and n and n in t}
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert recall.text_mentions(spark.createDataFrame([], "novel_id string, chunk_id int, text string"), named(spark, index)).count() == 0


def test_a_million_names(spark):
    """Far more names than one automaton takes, against SQL."""
    names = spark.range(1_000_000).selectExpr("'n' AS novel_id", "concat('Name', conv(id, 10, 36)) AS canonical", "concat('Name', conv(id, 10, 36)) AS name")
    rng = random.Random(5)
    texts = [("n", i, " ".join("Name" + rng.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") + str(rng.randrange(5000)) for _ in range(20))) for i in range(12)]
    got = recall.text_mentions(spark.createDataFrame(texts, "novel_id string, chunk_id int, text string"), names, most_chars=500).toArrow()
    con = duckdb.connect()
    con.register("got", got)
    con.register("names", names.toArrow())
    con.execute("CREATE TABLE texts (novel_id VARCHAR, chunk_id INT, text VARCHAR)")
    con.executemany("INSERT INTO texts VALUES (?, ?, ?)", texts)
    con.execute("CREATE TABLE expected AS SELECT t.novel_id, chunk_id, canonical FROM texts t JOIN names n ON contains(text, name)")
    assert con.execute("SELECT (SELECT count(*) FROM expected) = (SELECT count(*) FROM got), (SELECT count(*) FROM (SELECT * FROM expected EXCEPT SELECT * FROM got)), (SELECT count(*) FROM expected) > 200").fetchone() == (True, 0, True)


def test_no_join_of_all_pairs(spark):
    """What meets on the novel alone are its sizes, one row each."""
    index = named(spark, [("n", "a", "a")])
    plan = recall.weak_candidates(spark.createDataFrame([("n", "b")], "novel_id string, mention string"), index, 3)._jdf.queryExecution().toString()
    groups = [x for x in plan.splitlines() if "FlatMapCoGroupsInArrow" in x]
    assert groups and all("__block" in x and "__shard" in x for x in groups if "[" in x)
