"""The resolver and the tables made of its decisions against a plain version of the rules, on all conversations and on random novels."""

import random

import pytest

from storyloom.operators import resolution
from storyloom.plans import catalog
from plain_resolver import resolve

NAMES = ["翠翠", "天保", "大老", "傩送", "二老", "顺顺", "祖父", "父亲", "爷爷", "母亲的船", "翠翠的祖父", "翠翠的父亲", "天保大老", "翠翠祖父", "弟弟", "两个儿子", "12", "老船夫", "大个子", "船", "他的父亲", "翠", "保", "爸爸", "妈"]


def story(rng):
    chunks = []
    for i in range(1, rng.randrange(2, 14)):
        own = [rng.choice(NAMES) for _ in range(rng.randrange(5))]
        people = [{"name": n, "category": rng.choice([None, "person", "descriptive", "descriptive", "composite", "generic"])} for n in own]
        links = [{"source": rng.choice(NAMES), "target": rng.choice(NAMES), "type": "other", "confidence": 0.5} for _ in range(rng.randrange(3))]
        text = " ".join(rng.sample(NAMES, rng.randrange(7)))
        chunks.append({"chunk_id": i, "chapter_id": 1 + i // 3, "text": text, "section_type": rng.choice(["body", "body", "body", "epigraph"]), "characters": people, "relationships": links})
    return chunks


def answering(seed):
    """A judge that often picks a candidate, at times another's, nobody or nothing at all."""

    def judge(text, asked):
        rng, out = random.Random(f"{seed}/{text}"), []
        for a in asked:
            pick = rng.random()
            to = rng.choice([c["canonical"] for c in a["candidates"]]) if pick < 0.75 else rng.choice(NAMES) if pick < 0.85 else None
            if rng.random() < 0.95:
                out.append({"mention": a["mention"], "resolves_to": to})
        return out

    return judge


@pytest.mark.parametrize("part", range(6))
def test_random_novels(part):
    """What the ordered step decides, in some hundred novels full of roles, generic names and provisional ones."""
    for seed in range(part * 120, part * 120 + 120):
        chunks = story(random.Random(seed))
        expected = resolve(chunks, answering(seed))
        for hits in (False, True):  # texts read by the step, or names found beforehand
            novel = resolution.Novel("n")
            for c in chunks:
                novel.take(c | ({"hits": [n for n in NAMES if n in c["text"]]} if hits else {}), answering(seed))
            novel.close()
            rows = novel.taken()
            assert [(r["name"], r["target"]) for r in rows if r["kind"] == "alias"] == expected["aliases"], seed
            assert {k: v for k, v in novel.count.items() if v} == expected["counters"], seed
            assert sorted((r["name"], r["chunk_id"], r["flag"]) for r in rows if r["kind"] == "register") == sorted(expected["registered"]), seed
            assert sorted((r["name"], r["chunk_id"]) for r in rows if r["kind"] == "gone") == sorted(expected["gone"]), seed


def test_tables_of_random_novels(spark):
    """All tables that are made of the decisions, for sixty novels at once."""
    stories = {f"n{seed}": story(random.Random(seed)) for seed in range(60)}
    flat = [(v, c["chunk_id"], c["chapter_id"], c["text"], c["section_type"], c["characters"], c["relationships"]) for v, own in stories.items() for c in own]
    inputs = spark.createDataFrame(flat, "novel_id string, chunk_id int, chapter_id int, text string, section_type string, characters array<struct<name:string,category:string>>, relationships array<struct<source:string,target:string,type:string,confidence:double>>")
    rows = resolution.resolve(inputs, answering("all")).persist()
    expected = {v: resolve(own, answering("all")) for v, own in stories.items()}
    check_tables(rows, inputs, expected)


def check_tables(rows, inputs, expected):
    by = lambda df, *c: sorted((r["novel_id"], *(r[x] for x in c)) for r in df.collect())
    flat = lambda k, pick=lambda x: x: sorted((v, *pick(x)) for v, t in expected.items() for x in t[k])
    assert by(resolution.characters(rows), "chunk_id", "chapter_id", "ordinal", "name") == flat("characters", lambda x: x[:4])
    assert by(resolution.relations(rows, inputs), "chunk_id", "ordinal", "source", "target") == flat("relations")
    assert by(resolution.dropped(rows), "name") == flat("dropped", lambda x: (x,))
    assert by(resolution.bridges(rows), "mention", "chunk_id", "a", "b") == flat("bridges")
    assert by(resolution.canonicals(rows), "name", "first_seen", "mention_count", "chapters", "aliases") == flat("canonicals")
    assert {(r.novel_id, r.name): r.n for r in resolution.counters(rows).collect() if r.n} == {(v, k): n for v, t in expected.items() for k, n in t["counters"].items()}


def test_all_conversations(spark, sf):
    inputs, rows = catalog.resolved(spark, sf)
    rows, stories = rows.persist(), {}
    for r in inputs.orderBy("novel_id", "chunk_id").collect():
        stories.setdefault(r.novel_id, []).append(r.asDict(recursive=True))
    expected = {v: resolve(own, catalog.alike) for v, own in stories.items()}
    assert sum(len(t["aliases"]) for t in expected.values()) > 20
    check_tables(rows, inputs, expected)
