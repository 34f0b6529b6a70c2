"""Evaluations by one call: modes, refusals, provenance, and which runs are comparable."""

import hashlib
import subprocess

import pytest
from test_pipeline import book

from storyloom.config import Settings
from storyloom.operators import evaluation, extraction
from storyloom.plans import evaluate
from storyloom.plans.evaluate import DRY, REAL, SMOKE, Models, Refused

X = "application/xhtml+xml"


@pytest.fixture
def corpus(tmp_path):
    content = book([(X, f"<p>第{n}章</p><p>{t}</p>") for n, t in (("一", "翠翠和祖父"), ("二", "天保"), ("三", "天保和大老"))])
    (tmp_path / "biancheng.epub").write_bytes(content)
    return str(tmp_path / "biancheng.epub"), hashlib.sha256(content).hexdigest()


@pytest.fixture
def repository(tmp_path):
    at = tmp_path / "code"
    at.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(at), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init"), (at / "x").write_text("1"), git("add", "x"), git("commit", "-m", "one")
    return at, git


def no_call(*a):
    raise AssertionError("called")


def test_a_dry_run_calls_and_writes_nothing(spark, tmp_path, corpus, repository):
    out = evaluate.run(spark, corpus[0], str(tmp_path / "out"), corpus[1], DRY, models=Models(no_call, no_call, no_call), repository=str(repository[0]))
    assert out.run_id is None and corpus[1] in out.report and "git_commit" in out.report and not (tmp_path / "out").exists()


def test_runs_that_must_not_start(spark, tmp_path, corpus, repository):
    where = {"repository": str(repository[0]), "models": Models(no_call, no_call, no_call)}
    for book_, pinned, why in ((str(tmp_path / "none.epub"), corpus[1], "corpus is missing"), (corpus[0], "f" * 64, "corpus has changed")):
        with pytest.raises(Refused, match=why):
            evaluate.run(spark, book_, str(tmp_path / "out"), pinned, REAL, **where)
    twice = evaluation.checkset(spark).limit(1)
    with pytest.raises(Refused, match="duplicate id"):
        evaluate.run(spark, corpus[0], str(tmp_path / "out"), corpus[1], checks=twice.union(twice), **where)
    with pytest.raises(Refused, match="can't be told"):
        evaluate.run(spark, corpus[0], str(tmp_path / "out"), corpus[1], models=where["models"], repository="/nowhere")
    with pytest.raises(ValueError, match="no such mode"):
        evaluate.run(spark, corpus[0], str(tmp_path / "out"), corpus[1], "odd")
    assert not (tmp_path / "out").exists()


def test_from_a_file_to_reports(spark, tmp_path, corpus, repository):
    at, git = repository
    out_dir = str(tmp_path / "out")

    def extractor(text):
        return {"characters": [{"name": n} for n in ("翠翠", "祖父", "天保", "大老") if n in text], "relationships": []}

    def judge(text, pending):
        return [{"mention": p["mention"], "resolves_to": "天保" if p["mention"] == "大老" else None} for p in pending]

    real = lambda **how: evaluate.run(spark, corpus[0], out_dir, corpus[1], models=Models(extractor, judge, prompts=how.pop("prompts", {})), repository=str(at), **how)
    one = real(tag="first")
    outcomes = {r.check_id: r.outcome for r in one.outcomes.collect()}
    assert len(outcomes) == 24 and outcomes["A2"] == "PASS" and outcomes["G1"] == outcomes["G3"] == outcomes["G5"] == "PASS" and outcomes["A1"] == "SKIP" and outcomes["A6"] == "FAIL" and outcomes["B1"] == "PASS"
    row = one.row.first()
    assert row.corpus_hash == corpus[1] and row.mode == REAL and row.status == "completed" and row.tag == "first" and row.stats["persons"] == 3 and row.stats["failed_blocks"] == 0 and row.stats["merge_candidate_pairs"] >= 0
    assert len(row.provenance["git_commit"]) == 40 and row.provenance["git_dirty"] == "false" and row.provenance["spark"] == spark.version and not row.warnings
    assert (tmp_path / f"out/reports/{one.run_id}.md").read_text() == one.report and "| A2 | A | " in one.report
    (at / "x").write_text("2")
    two = real()
    assert "uncommitted" in two.row.first().warnings[0]
    git("commit", "-am", "two")
    three = real()
    ids = [one.run_id, two.run_id, three.run_id]
    base, text = evaluate.baseline(spark, out_dir, ids)  # another commit is provenance only
    assert base.count() == 24 and "stable" in text
    with pytest.raises(Refused, match="git_commit"):
        evaluate.baseline(spark, out_dir, ids, same_commit=True)
    evaluate.baseline(spark, out_dir, ids[:2], same_commit=True)
    same = evaluate.identity(Settings(), "c", "2", {}, REAL)
    assert set(same) == set(evaluate.IDENTITY)
    for how, field in (((Settings(chunk_size=50), "c", "2", {}, REAL), "chunk_size"), ((Settings(model="m"), "c", "2", {}, REAL), "model"), ((Settings(), "c", "3", {}, REAL), "checkset_version"), ((Settings(), "c", "2", {}, SMOKE), "mode")):
        assert {k for k, v in evaluate.identity(*how).items() if v != same[k]} == {field}
    for how, field in (({"prompts": {"judge": ("other",)}}, "judge_prompt"),):
        other = real(**how)
        with pytest.raises(Refused, match=field):
            evaluate.baseline(spark, out_dir, [one.run_id, other.run_id])
    refused, text = evaluate.against(spark, out_dir, other.run_id, ids)
    assert {r.verdict for r in refused.collect()} == {"REFUSE_COMPARE"} and "REFUSE_COMPARE" in text
    content = book([(X, "<p>第一章</p><p>天保和大老</p>")])
    (tmp_path / "b.epub").write_bytes(content)
    another = evaluate.run(spark, str(tmp_path / "b.epub"), out_dir, None, models=Models(extractor, judge), repository=str(at))
    with pytest.raises(Refused, match="corpus_hash"):
        evaluate.baseline(spark, out_dir, [one.run_id, another.run_id])


def test_a_smoke_run_calls_no_model_and_leaves_no_graph(spark, tmp_path, corpus, repository):
    out = evaluate.run(spark, corpus[0], str(tmp_path / "out"), corpus[1], SMOKE, models=Models(no_call, no_call, no_call), repository=str(repository[0]))
    row = out.row.first()
    assert row.mode == SMOKE and row.stats["persons"] == len(extraction.smoke_extractor("")["characters"]) and out.outcomes.count() == 24
    assert not list((tmp_path / "out/graphs").iterdir())


def test_a_failed_chunk_shows_in_the_run(spark, tmp_path, corpus, repository):
    def extractor(text):
        raise extraction.Rejected("no")

    row = evaluate.run(spark, corpus[0], str(tmp_path / "out"), corpus[1], models=Models(extractor), repository=str(repository[0])).row.first()
    assert row.status == "completed_with_errors" and row.failed_chunks == [1, 2, 3] and row.warnings and row.stats["failed_blocks"] == 3
