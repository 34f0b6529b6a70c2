"""Lineage of a whole job and its diagnosis, recall beyond the broadcast bound, baselines, reports and refusals."""

import json

import pytest
from pyspark.sql import functions as F

from storyloom.config import Settings
from storyloom.operators import chunks, evaluation, lineage, merging, recall, resolution
from storyloom.plans import ingest


def chapters(spark, texts, novel="n"):
    return chunks.number_chapters(spark.createDataFrame([(novel, i, "", t) for i, t in enumerate(texts)], "novel_id string, place int, title string, text string"))


TEXTS = ["Anna met Bert in town", "Anna and Bertram walk", "Carla saw Bertrand and Anna"]


def test_a_job_writes_all_its_events(spark, tmp_path):
    judge = resolution.judge_from({"Bertram": "Bert", "Bertrand": "Bert", "Bert": None, "Anna": None, "Carla": None})
    titles = spark.createDataFrame([("n", "Book")], "novel_id string, title string")
    how = {"settings": Settings(lineage=True), "judge": judge, "merge_judge": lambda pairs: [{"a": p["a"], "b": p["b"], "merge": {p["a"], p["b"]} == {"Anna", "Carla"}, "confidence": 1.0} for p in pairs]}
    ingest.job(spark, chapters(spark, TEXTS), titles, str(tmp_path / "w"), str(tmp_path / "g"), str(tmp_path / "events"), True, **how)
    ev = lineage.read_events(spark, str(tmp_path / "events/novel_id=n"), lineage.EVENTS.replace("novel_id string, ", "")).drop("_corrupt").withColumn("novel_id", F.lit("n")).persist()
    kinds = {r.event for r in ev.select("event").distinct().collect()}
    assert set(lineage.MENTION_EVENTS) | {"chunk_start", "judge_batch", "extraction_raw", "merge_stats", "canonical_snapshot", "job_end"} <= kinds <= set(lineage.MENTION_EVENTS + lineage.JOB_EVENTS)
    end = json.loads(ev.where("event = 'job_end'").first().body)
    assert end["status"] == "completed" and end["chunk_failures"] == 0
    asked = spark.createDataFrame([("Bertram", "Bert"), ("Anna", "Anna"), ("Nobody", "Anna"), ("Carla", "Bert")], "mention string, expect string")
    verdicts = {r.mention: r.verdict for r in lineage.diagnose_events(ev, asked).collect()}
    assert verdicts["Bertram"] == verdicts["Anna"] == "SUCCESS" and verdicts["Nobody"] == "EXTRACTION_LAYER" and verdicts["Carla"] != "SUCCESS"


def test_events_of_a_job_that_fails(spark, tmp_path):
    titles = spark.createDataFrame([("n", "Book")], "novel_id string, title string")

    with pytest.raises(Exception, match="chunk"):
        ingest.job(spark, chapters(spark, TEXTS).drop("text").withColumn("chunk", F.lit(1)), titles, str(tmp_path / "w"), str(tmp_path / "g"), str(tmp_path / "events"))
    (line,) = spark.read.json(str(tmp_path / "events")).collect()
    assert line.event == "job_end" and json.loads(line.body)["status"] == "failed"
    (tmp_path / "file").write_text("x")
    assert lineage.flush(lineage.failed_job(titles, "e"), str(tmp_path / "file/below")) is False


def test_a_failed_chunk_breaks_the_chain(spark):
    rows = [("n", "job_end", 0, None, None, None, '{"chunk_failures":2}'), ("n", "extraction_raw", 0, 1, 1, None, '{"characters":[{"name":"Eve"}],"relationships":[]}')]
    asked = spark.createDataFrame([("Eve", "Eve"), ("Zed", "Zed")], "mention string, expect string")
    for keep, expected in ((rows, {"Eve": "CHAIN_BREAK", "Zed": "CHAIN_BREAK"}), (rows[1:], {"Eve": "CHAIN_BREAK", "Zed": "EXTRACTION_LAYER"})):
        assert {r.mention: r.verdict for r in lineage.diagnose_events(spark.createDataFrame(keep, lineage.EVENTS), asked).collect()} == expected


def test_novels_are_told_by_their_own_rows(spark):
    """The same names in two novels: one novel's failed chunks, raw names, merges and snapshots say nothing about the other's."""
    known = '{"registered":"True","final_canonical":"%s"}'
    rows = [("n", "job_end", 0, None, None, None, '{"chunk_failures":2}'), ("m", "job_end", 0, None, None, None, '{"chunk_failures":0}'), ("m", "extraction_raw", 0, 1, 1, None, '{"characters":[{"name":"Raw"}],"relationships":[]}')]
    rows += [(v, "registration", 1, 1, 1, "Eve", known % "Eve") for v in "nm"] + [("m", "merge_drop", 0, None, None, "Eve", '{"merge_keep":"Ann"}'), ("n", "canonical_snapshot", 0, None, None, "Eve", '{"aliases":["Ann"]}')]
    asked = [(v, m, "Ann") for v in "nm" for m in ("Eve", "Zed", "Raw")]
    out = lineage.diagnose_events(spark.createDataFrame(rows, lineage.EVENTS), spark.createDataFrame(asked, "novel_id string, mention string, expect string"))
    assert {(r.novel_id, r.mention): r.verdict for r in out.collect()} == {
        ("n", "Eve"): "SUCCESS", ("m", "Eve"): "MERGE_LAYER", ("n", "Zed"): "CHAIN_BREAK", ("m", "Zed"): "EXTRACTION_LAYER", ("n", "Raw"): "CHAIN_BREAK", ("m", "Raw"): "CHAIN_BREAK",
    }


def test_roles_are_those_of_the_resolver(spark):
    known = {"天保": "天保", "大老": "天保", "翠翠": "翠翠", "翠": "翠翠", "岳云": "岳云"}
    mentions = ["翠翠的父亲", "天保大老", "翠翠祖父", "老船夫", "岳云", "大老爷", "他的船", "船的主"]
    novel = resolution.Novel("n", canonical=dict(known))
    out = recall.role_mentions(spark.createDataFrame([(m,) for m in mentions], "mention string"), spark.createDataFrame(list(known.items()), "name string, canonical string"))
    for r in out.collect():
        role = novel.role(r.mention)
        assert (r.kind, r.by_of, r.anchor, r["head"]) == (role.kind, role.by_of, role.anchor, role.head)


def test_a_pair_of_one_canonical_is_an_error(spark):
    who = spark.createDataFrame([("n", "A", 1, 1, [1], [])], "novel_id string, name string, first_seen int, mention_count long, chapters array<int>, aliases array<string>")
    pairs = spark.createDataFrame([("n", "A", "A")], "novel_id string, a string, b string")
    with pytest.raises(Exception, match="both sides"):
        merging.pair_metadata(pairs, who).collect()


def outcomes(spark):
    rows = [(f"r{r}", c, o) for c, found in {"A1": "PPP", "A2": "PFP", "A3": "FFF", "A4": "SFS", "A5": "SSS"}.items() for r, o in enumerate(found)]
    return spark.createDataFrame([(r, c, {"P": "PASS", "F": "FAIL", "S": "SKIP"}[o]) for r, c, o in rows], "run_id string, check_id string, outcome string")


def test_a_baseline_and_its_reports(spark):
    out = outcomes(spark)
    runs = spark.createDataFrame([(f"r{i}", "hash", 4000) for i in range(3)], "run_id string, corpus string, chunk_size int")
    base = evaluation.aggregate(out, runs, ["corpus", "chunk_size"])
    rows = {r.check_id: r for r in base.collect()}
    assert {c: r.classification for c, r in rows.items()} == {"A1": "stable", "A2": "variance", "A3": "stable", "A4": "unclassified", "A5": "unclassified"}
    assert {r.baseline_status for r in rows.values()} == {"INVALID_NOT_REGRESSION_SAFE"} and rows["A2"].distribution == {"PASS": 2, "FAIL": 1}
    assert [c for c, r in rows.items() if r.note] == ["A4"]
    assert evaluation.quality(base).first().asDict() == {"stable": 2, "stable_failures": 1, "variance": 1, "unclassified": 2}
    with pytest.raises(ValueError, match="agree"):
        evaluation.aggregate(out, runs.withColumn("corpus", F.col("run_id")), ["corpus"])
    last = out.withColumn("ordinal", F.lit(0)).union(spark.createDataFrame([("r0", "A1", "FAIL", 1)], "run_id string, check_id string, outcome string, ordinal int"))
    assert {r.check_id: r.fails for r in evaluation.aggregate(last, runs, ["corpus"]).collect()}["A1"] == 1
    one = out.where("run_id = 'r1'").drop("run_id")
    text = evaluation.run_report(one, evaluation.checkset(spark), {"model": "rule"})
    assert "| model | rule |" in text and "| A2 | A | single_canonical_with_aliases | FAIL |" in text
    assert "INVALID_NOT_REGRESSION_SAFE" in evaluation.baseline_report(base, {"corpus": "hash"})
    text = evaluation.compare_report(evaluation.compare(one, evaluation.stability(out)))
    assert text.startswith("# Comparison: REGRESSION") and text.index("| A3 |") < text.index("| A1 |")
    assert evaluation.compare_report(evaluation.compare(one, base, same=False)).startswith("# Comparison: REFUSE_COMPARE")


def test_refusals_before_a_run(spark):
    good = evaluation.checkset(spark)
    assert evaluation.refusals(good, "a" * 64, "a" * 64, False) == []
    bad = good.limit(2).withColumns({"outcome_class": F.lit("odd"), "attribution": F.lit(""), "layer": F.lit(None).cast("string"), "preconditions": F.array(F.lit("person_exists:x"), F.lit("other"))})
    found = evaluation.refusals(bad, None, "a" * 64, True, ["model"])
    assert len(found) == 3 + 2 * 4 and any("corpus is missing" in x for x in found)
    assert "changed" in evaluation.refusals(good, "b" * 64, "a" * 64, False)[0]


def test_upper_medians_against_plain_code(spark):
    import random

    rng = random.Random(1)
    rows = [(f"s{i % 7}", rng.choice([rng.random() ** 9 * 1e6, 3.0, -1.5])) for i in range(2000)] + [("one", 4.0), ("same", 2.0), ("same", 2.0)]
    plain = {}
    for s, v in rows:
        plain.setdefault(s, []).append(v)
    out = {r.stage: r.median for r in evaluation.stage_profile(spark.createDataFrame(rows, "stage string, seconds double")).collect()}
    assert out == {s: sorted(v)[len(v) // 2] for s, v in plain.items()}
