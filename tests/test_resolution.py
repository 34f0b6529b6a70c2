"""The resolver's decisions, case by case, in batch and in a stream."""

import pyarrow as pa
import pytest

from storyloom.operators import lineage, resolution
from storyloom.operators.resolution import Novel
from storyloom.plans import catalog
from storyloom.streaming.resolution import INPUT, PROVIDER, resolve_stream


def chunk(i, text, names=(), links=(), section="body"):
    """names: 'name' or ('name', category); links: (source, target)."""
    people = [{"name": n, "category": None} if isinstance(n, str) else {"name": n[0], "category": n[1]} for n in names]
    return {"chunk_id": i, "chapter_id": i, "text": text, "section_type": section, "characters": people, "relationships": [{"source": a, "target": b, "type": "other", "confidence": 0.5} for a, b in links]}


def run(chunks, answers=None, judge=None, **how):
    novel = Novel("n", **how)
    for c in chunks:
        novel.take(c, judge or resolution.judge_from(answers or {}))
    novel.close()
    return novel, novel.taken()


def people(rows, i=None):
    seen = dict.fromkeys((r["chunk_id"], r["target"]) for r in rows if r["kind"] == "decision" and r["type"] == "character" and i in (None, r["chunk_id"]))
    return [name for _, name in seen]


def bonds(rows):
    ends = {(r["chunk_id"], r["ordinal"], r["type"]): r["target"] for r in rows if r["kind"] == "decision"}
    return [(a, ends[c, i, "target"]) for (c, i, part), a in ends.items() if part == "source" and a != ends[c, i, "target"]]


def first_seen(rows):
    out = {}
    for r in rows:
        if r["kind"] == "promote" or r["kind"] == "register" and r["flag"]:
            out.setdefault(r["name"], r["chunk_id"])
    return out


def kept_bridges(rows):
    gone = {r["name"]: r["chunk_id"] for r in rows if r["kind"] == "gone"}
    return [(r["name"], r["target"], r["type"]) for r in rows if r["kind"] == "bridge" and r["chunk_id"] > gone.get(r["type"], 0)]


def aliases(rows):
    return {r["target"]: r["name"] for r in rows if r["kind"] == "alias"}


def test_first_name_seen_is_canonical():
    novel, rows = run([chunk(1, "翠翠", ["翠翠"]), chunk(2, "翠翠 二翠", ["二翠"])], {"二翠": "翠翠"})
    assert aliases(rows) == {"二翠": "翠翠"} and people(rows, 2) == ["翠翠"] and first_seen(rows) == {"翠翠": 1}


def test_null_answer_registers_a_person_and_drops_others():
    for category, kept in ((None, True), ("person", True), ("generic", False), ("descriptive", False), ("composite", False)):
        novel, rows = run([chunk(1, "甲", ["甲"]), chunk(2, "甲乙", [("乙某", category)], [("乙某", "甲")])], {"乙某": None})
        assert ("乙某" in people(rows, 2)) is kept
        assert bool(bonds(rows)) is kept


def test_hard_filtered_and_lexicon_names_are_never_persons():
    novel, rows = run([chunk(1, "x", ["甲", "两个儿子", "12", ("弟弟", "person")], [("两个儿子", "甲"), ("弟弟", "甲")])], {"弟弟": None})
    assert people(rows) == ["甲"] and not bonds(rows)
    assert (novel.count["collective_filtered"], novel.count["invalid_filtered"]) == (1, 1)


def test_a_generic_name_may_be_an_alias():
    _, rows = run([chunk(1, "甲", ["甲"]), chunk(2, "甲 弟弟", ["弟弟"])], {"弟弟": "甲"})
    assert aliases(rows) == {"弟弟": "甲"}


def test_outside_the_body_names_are_provisional():
    novel, rows = run([chunk(1, "序", ["甲", "乙", ("丙某", "descriptive")], section="epigraph"), chunk(2, "甲", ["甲"])])
    assert {r["name"] for r in rows if r["kind"] == "register" and not r["flag"]} - {r["name"] for r in rows if r["kind"] == "promote"} == {"乙"}
    assert first_seen(rows) == {"甲": 2} and novel.count["nonbody_person_provisional"] == 2 and novel.count["nonbody_descriptive_dropped"] == 1
    assert "丙某" not in people(rows)


def test_deferred_names_see_what_the_rest_of_the_chunk_shows():
    _, rows = run([chunk(1, "老船夫 甲", [("老船夫", "descriptive"), "甲"])], {"老船夫": "甲"})
    assert aliases(rows) == {"老船夫": "甲"} and people(rows) == ["甲"]
    novel, rows = run([chunk(1, "老船夫", [("老船夫", "descriptive")])])
    assert people(rows) == [] and novel.count["descriptive_unresolved"] == 1


ROLE = ("父亲", "descriptive")
CASES = {
    "one sighting is not enough": ([chunk(1, "甲", ["甲"]), chunk(2, "甲父亲", [ROLE])], {"父亲": "甲"}, {}),
    "two chunks confirm": ([chunk(1, "甲", ["甲"]), chunk(2, "甲父亲", [ROLE]), chunk(3, "甲父亲", [ROLE])], {"父亲": "甲"}, {"父亲": "甲"}),
    "one chunk counts once": ([chunk(1, "甲", ["甲"]), chunk(2, "甲父亲", [ROLE, ROLE])], {"父亲": "甲"}, {}),
    "not descriptive": ([chunk(1, "甲", ["甲"]), chunk(2, "甲父亲", ["父亲"])], {"父亲": "甲"}, {"父亲": "甲"}),
    "not a senior": ([chunk(1, "甲", ["甲"]), chunk(2, "甲长子", [("长子", "descriptive")])], {"长子": "甲"}, {"长子": "甲"}),
    "of: wrong head": ([chunk(1, "翠翠", ["翠翠", "顺顺"]), chunk(2, "翠翠 顺顺", ["翠翠的父亲"])], {"翠翠的父亲": "顺顺"}, {}),
    "of: head, anchor here": ([chunk(1, "翠翠", ["翠翠", "祖父"]), chunk(2, "翠翠 祖父", ["翠翠的祖父"])], {"翠翠的祖父": "祖父"}, {"翠翠的祖父": "祖父"}),
    "of: head, anchor absent": ([chunk(1, "翠翠", ["翠翠", "祖父"]), chunk(2, "祖父", ["翠翠的祖父"])], {"翠翠的祖父": "祖父"}, {}),
    "of: anchor unknown": ([chunk(1, "祖父", ["祖父"]), chunk(2, "祖父", ["她的祖父"])], {"她的祖父": "祖父"}, {"她的祖父": "祖父"}),
    "prefix: the anchor itself": ([chunk(1, "天保", ["天保"]), chunk(2, "x", ["天保大老"])], {"天保大老": "天保"}, {"天保大老": "天保"}),
    "prefix: neither": ([chunk(1, "天保", ["天保", "顺顺"]), chunk(2, "x", ["天保大老"])], {"天保大老": "顺顺"}, {}),
}


@pytest.mark.parametrize("case", CASES)
def test_role_gate(case):
    chunks, answers, expected = CASES[case]
    _, rows = run(chunks, answers)
    assert aliases(rows) == expected


def test_a_role_of_two_persons_is_barred():
    def judge(text, pending):
        return [{"mention": p["mention"], "resolves_to": None if p["mention"] != "父亲" else "甲" if "甲" in text else "乙"} for p in pending]

    chunks = [chunk(1, "甲乙", ["甲", "乙"])] + [chunk(i, t, [ROLE]) for i, t in ((2, "甲"), (3, "乙"), (4, "甲"), (5, "甲"))]
    novel, rows = run(chunks, judge=judge)
    assert "父亲" in novel.barred and "父亲" not in aliases(rows)


def test_wrong_targets_count_as_no_answer():
    first = chunk(1, "甲", ["甲"])
    for answer in ("Nobody", "两个儿子"):
        _, rows = run([first, chunk(2, "甲", ["乙某"])], {"乙某": answer})
        assert people(rows, 2) == ["乙某"] and not aliases(rows)
        _, rows = run([first, chunk(2, "甲", [("乙某", "descriptive")])], {"乙某": answer})
        assert people(rows, 2) == []


def test_a_failing_judge_marks_its_chunk():
    def judge(text, pending):
        raise TimeoutError("busy")

    _, rows = run([chunk(1, "甲", ["甲"]), chunk(2, "甲", ["乙某", ("弟弟", None), ("大个子", "descriptive")])], judge=judge)
    assert people(rows, 2) == ["乙某"] and [r["flag"] for r in rows if r["kind"] == "chunk"] == [False, True]


def test_bridges_need_two_candidates_and_go_with_dropped_mentions():
    start = chunk(1, "甲乙", ["甲", "乙"])
    novel, rows = run([start, chunk(2, "甲乙", ["丙"])], {"丙": "甲"})
    assert kept_bridges(rows) == [("乙", "甲", "丙")]
    _, rows = run([start, chunk(2, "甲乙", [("丙", "descriptive")])], {"丙": None})
    assert not kept_bridges(rows)


def test_strong_candidates_are_not_limited():
    names = [f"人{c}" for c in "甲乙丙丁戊己庚"]
    asked = []

    def judge(text, pending):
        asked.extend(pending)
        return []

    run([chunk(1, "", names), chunk(2, "".join(names), ["客"]), chunk(3, "无", ["主"])], judge=judge)
    by = {p["mention"]: [c["canonical"] for c in p["candidates"]] for p in asked}
    assert sorted(by["客"]) == sorted(names) and len(by["主"]) == 5


def test_lineage_changes_nothing(spark, sf):
    from storyloom.plans.catalog import conversation_input

    inputs = conversation_input(spark, sf)
    off, on = resolution.resolve(inputs, resolution.nobody), resolution.resolve(inputs, resolution.nobody, lineage=True)
    keep = lambda df: sorted(map(str, df.where("kind <> 'event'").collect()))
    assert keep(off) == keep(on)
    events = lineage.flat_events(resolution.events(on))
    assert events.count() > 0 and lineage.chains(events).count() > 0


def test_tables_of_the_decisions(spark):
    """The set-based outputs against plain code over the same rows."""
    novels = {
        "n": [chunk(1, "序 丁", ["丁", "戊"], section="epigraph"), chunk(2, "甲 乙 丁", ["甲", "乙", "丁"], [("甲", "乙"), ("甲", "丙")]), chunk(3, "甲 乙", ["甲一", "甲", "甲一"], [("甲一", "乙"), ("甲一", "甲"), ("弟弟", "乙")]), chunk(4, "甲 乙", [("大个子", "descriptive"), "乙"], [("大个子", "乙")])],
        "m": [chunk(1, "甲", ["甲"]), chunk(2, "乙", ["乙"], [("乙", "甲")])],
    }
    answers = {"甲一": "甲", "丙": "乙", "大个子": None}
    data = [(n, *[c[k] for k in ("chunk_id", "chapter_id", "text", "section_type")], [(p["name"], p["category"]) for p in c["characters"]], [(r["source"], r["target"], r["type"], r["confidence"]) for r in c["relationships"]]) for n, cs in novels.items() for c in cs]
    from storyloom.schema import CHARACTER, RELATIONSHIP

    inputs = spark.createDataFrame(data, f"novel_id string, chunk_id int, chapter_id int, text string, section_type string, characters array<{CHARACTER}>, relationships array<{RELATIONSHIP}>")
    rows = resolution.resolve(inputs, resolution.judge_from(answers)).persist()
    plain = {n: run(cs, answers)[1] for n, cs in novels.items()}
    got = sorted((r.novel_id, r.chunk_id, r.ordinal, r.name) for r in resolution.characters(rows).collect())
    expected = [(n, i, k, x) for n, rs in plain.items() for i in (1, 2, 3, 4) for k, x in enumerate(people(rs, i))]
    assert got == sorted(expected)
    assert sorted((r.novel_id, r.source, r.target) for r in resolution.relations(rows, inputs).collect()) == sorted((n, *b) for n, rs in plain.items() for b in bonds(rs))
    assert {(r.novel_id, r.name): r.first_seen for r in resolution.canonicals(rows).collect()} == {(n, x): i for n, rs in plain.items() for x, i in first_seen(rs).items()}
    assert sorted((r.novel_id, r.a, r.b, r.mention) for r in resolution.bridges(rows).collect()) == sorted((n, *b) for n, rs in plain.items() for b in kept_bridges(rs))
    assert [(r.novel_id, r.name) for r in resolution.dropped(rows).collect()] == [("n", "戊")]
    assert {(r.canonical, r.alias, r.ordinal) for r in resolution.aliases(rows).collect()} == {("甲", "甲一", 0)}  # 乙 isn't a candidate of 丙 yet
    (one,) = resolution.canonicals(rows).where("novel_id = 'n' AND name = '甲'").collect()
    assert (one.mention_count, one.chapters, one.aliases) == (2, [2, 3], ["甲一"])  # 2 and 3: the body's chunks that show it


def test_names_found_beforehand_or_in_the_text(spark, sf):
    from storyloom.plans.catalog import alike, conversation_input

    inputs = conversation_input(spark, sf).where("novel_id < '2'")
    rows = sorted(map(str, resolution.resolve(inputs, alike, lineage=True).collect()))
    plain = []
    for n in {r.novel_id for r in inputs.select("novel_id").distinct().collect()}:
        novel = Novel(n, lineage=True)
        for r in inputs.where(inputs.novel_id == n).orderBy("chunk_id").collect():
            novel.take(r.asDict(recursive=True), alike)
        novel.close()
        plain += novel.taken()
    assert rows == sorted(map(str, spark.createDataFrame([tuple(r.get(c) for c in resolution.columns(resolution.RESOLUTION)) for r in plain], resolution.RESOLUTION).collect())) and "kind='alias'" in " ".join(rows)


def test_the_union_of_candidates_may_be_allowed():
    start = [chunk(1, "x", list("甲乙子丑寅卯"))]
    again = chunk(2, "甲乙子丑寅", ["丙", "卯客"])  # five are strong, so 卯 is a candidate of nobody; 卯客 has it where the text shows it
    for own, text, expected in ((True, "甲乙子丑寅", None), (False, "甲乙子丑寅", None), (True, "卯", "卯")):
        _, rows = run([*start, again | {"text": text}], {"丙": "卯", "卯客": None}, own_candidates_only=own)
        assert aliases(rows).get("丙") == expected
    found = {"丙": ["甲"], "丁": ["乙"]}
    for own, expected in ((True, None), (False, "乙")):
        novel, _ = run(start, own_candidates_only=own)
        c = resolution.Chunk(3, 3, "甲乙", True, "body", {})
        c.pending = {m: list(x) for m, x in found.items()}
        novel.canonical |= {"甲": "甲", "乙": "乙"}
        novel.index |= {"甲": {"甲"}, "乙": {"乙"}}
        novel.judged(c, resolution.judge_from({"丙": "乙", "丁": "乙"}))
        assert aliases(novel.taken()).get("丙") == expected


@pytest.fixture
def states(spark):
    """A session whose state store has map states."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    yield spark
    spark.conf.set(key, before)


def stream_input(inputs):
    from pyspark.sql import functions as F

    last = inputs.groupBy("novel_id").agg(F.max("chunk_id").alias("end"))
    return inputs.join(last, "novel_id").select("novel_id", "chunk_id", "chapter_id", "text", "section_type", "characters", "relationships", F.lit(False).alias("tombstone"), (F.col("chunk_id") == F.col("end")).alias("last"))


def drain(spark, path, judge=resolution.nobody, **how):
    """Runs the stream over what is in path/in and not taken yet: each call is a restart."""
    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = resolve_stream(stream, judge, **how).writeStream.format("parquet").option("checkpointLocation", f"{path}/ckpt").option("path", f"{path}/out").trigger(availableNow=True).start()
    q.awaitTermination(240)
    if q.exception():
        raise q.exception()
    return q


def test_stream_gives_the_rows_of_the_batch(states, sf, tmp_path):
    from storyloom.plans.catalog import conversation_input

    spark, inputs = states, conversation_input(states, sf)
    rows = stream_input(inputs)
    rows.where("chunk_id % 2 = 0").coalesce(1).write.parquet(str(tmp_path / "in"))  # even chunks come first
    drain(spark, tmp_path)
    rows.where("chunk_id % 2 = 1").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    drain(spark, tmp_path)  # a restart in the middle of every novel
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = resolution.resolve(inputs, resolution.nobody)
    assert sorted(map(str, out.collect())) == sorted(map(str, batch.select(out.columns).collect()))
    rows.limit(5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # come again: all novels are closed
    drain(spark, tmp_path)
    assert spark.read.parquet(str(tmp_path / "out")).count() == out.count()


def test_a_stream_restarts_in_mid_novel_with_all_that_it_knew(states, tmp_path):
    """Aliases, provisional names, sightings of a role, barred roles and bridges of earlier runs count in later ones; one file a run."""
    spark = states

    def judge(text, pending):
        same = {"二老": "傩送", "大老": "天保", "父亲": "天保" if "天保" in text else "傩送", "爷爷": "天保"}
        return [{"mention": p["mention"], "resolves_to": same.get(p["mention"])} for p in pending]

    father, grand = ("父亲", "descriptive"), ("爷爷", "descriptive")
    story = [
        chunk(1, "序 天保", ["天保", "顺顺"], section="epigraph"), chunk(2, "天保 傩送", ["天保", "傩送"], [("天保", "傩送")]), chunk(3, "天保 大老", ["大老", grand]), chunk(4, "傩送 父亲", [father]), chunk(5, "天保 父亲", [father]),
        chunk(6, "天保 父亲", [father]), chunk(7, "天保 爷爷 二老", [grand, "二老"]), chunk(8, "大老 二老", ["大老", "二老"], [("大老", "二老")]), chunk(9, "爷爷", [grand, ("弟弟", None)]),
    ]
    schema = INPUT.replace(", tombstone boolean, last boolean", "")
    inputs = spark.createDataFrame([tuple({"novel_id": "n", **c}[k] for k in ("novel_id", "chunk_id", "chapter_id", "text", "section_type", "characters", "relationships")) for c in story], schema)
    rows = stream_input(inputs)
    for part in ("chunk_id IN (2, 3)", "chunk_id IN (1, 5)", "chunk_id = 4", "chunk_id IN (8, 7)", "chunk_id = 6", "chunk_id = 9"):
        rows.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drain(spark, tmp_path, judge)
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = resolution.resolve(inputs, judge).select(out.columns)
    assert sorted(map(str, out.collect())) == sorted(map(str, batch.collect()))
    assert {(r.name, r.target) for r in out.where("kind = 'alias'").collect()} >= {("天保", "大老"), ("傩送", "二老"), ("天保", "爷爷")}


def test_what_a_stream_writes_follows_what_changed(states, tmp_path):
    """A novel that knows many names: a chunk that brings one name changes a few entries, whatever the novel's size."""
    spark, entries = states, []
    names = [f"Name{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{i}" for i in range(400)]
    story = [chunk(1, "x", names)] + [chunk(i, "x", [names[i], f"New{i}"]) for i in range(2, 6)]
    schema = INPUT.replace(", tombstone boolean, last boolean", "")
    inputs = spark.createDataFrame([tuple({"novel_id": "n", **c}[k] for k in ("novel_id", "chunk_id", "chapter_id", "text", "section_type", "characters", "relationships")) for c in story], schema)
    rows = stream_input(inputs)
    for i in range(1, 5):
        rows.where(f"chunk_id = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        state = drain(spark, tmp_path).recentProgress[-1].stateOperators[0]
        entries.append(state.customMetrics["rocksdbPutCount"] if "rocksdbPutCount" in state.customMetrics else state.numRowsUpdated)
    assert max(entries[1:]) < 0.1 * entries[0], entries


def test_a_stream_waits_for_no_more_than_it_may(states, tmp_path):
    rows = stream_input(states.createDataFrame([("n", i, i, "x", "body", [], []) for i in range(2, 9)], INPUT.replace(", tombstone boolean, last boolean", "")))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="chunk 1 is missing"):
        drain(states, tmp_path, most_early=3)
    states.conf.unset("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError, match="providerClass"):
        drain(states, tmp_path)


def test_what_a_task_holds_does_not_grow_with_its_chunks(monkeypatch):
    monkeypatch.setattr(resolution, "GATHERED", 50)
    read = []

    def batches():
        for b in range(4):
            read.append(b)
            yield pa.RecordBatch.from_pylist([
                {"novel_id": f"n{b // 2}", "chunk_id": b * 100 + i, "chapter_id": 1, "section_type": "body", "characters": [{"name": f"Name{i}", "category": None}], "relationships": [], "hits": []} for i in range(100)
            ])

    sizes, kinds = [], set()
    for i, out in enumerate(resolution.resolved_in_order(batches(), resolution.Novel, resolution.nobody)):
        assert i or read == [0]  # the first rows are given on before more is read
        sizes.append(out.num_rows)
        kinds |= set(out.column("kind").to_pylist())
    assert max(sizes) < 120 and len(sizes) > 10 and {"register", "decision", "chunk", "counter"} <= kinds


def test_events_of_a_novel_keep_their_order_over_batches(spark, sf):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        _, out = catalog.resolved(spark, sf, lineage=True)
        split = sorted(map(str, resolution.events(out).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = resolution.events(catalog.resolved(spark, sf, lineage=True)[1])
    assert split == sorted(map(str, whole.collect()))
    assert whole.groupBy("novel_id", "ordinal").count().where("count > 1").isEmpty()
