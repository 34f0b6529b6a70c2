"""An evaluation by one call: from a book's file to a graph, its checks' outcomes, a row that says what was run, and a report."""

from __future__ import annotations

import platform
import subprocess
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.config import Settings
from storyloom.operators import chunks as C
from storyloom.operators import evaluation, extraction, merging, resolution, resume, store
from storyloom.plans import ingest
from storyloom.schema import columns
from storyloom.sources import epub

#: real calls the given models; smoke calls none and gives the same three people for any text; dry only looks whether a run may start.
REAL, SMOKE, DRY = "real", "smoke", "dry"
#: What must be equal for two runs to be comparable; where and from which commit they ran is provenance only.
IDENTITY = ["corpus_hash", "checkset_version", "model", "chunk_size", "chunk_overlap", "chunker_version", "extractor_version", "extraction_prompt", "judge_prompt", "merge_prompt", "mode"]
RUNS = f"run_id string, tag string, status string, started_at timestamp, {', '.join(f'{c} string' for c in IDENTITY)}, provenance map<string,string>, stats map<string,bigint>, failed_chunks array<int>, warnings array<string>"
OUTCOMES = "run_id string, check_id string, outcome string"


class Refused(Exception):
    """A run that must not start, or runs that can't be compared."""


@dataclass(frozen=True)
class Models:
    """What a real run calls, and the prompts that it asks them with."""

    extractor: extraction.Extractor = extraction.rule_extractor
    judge: resolution.AliasJudge = resolution.nobody
    merge_judge: merging.MergeJudge = ingest.keep_none
    prompts: dict[str, tuple[str, ...]] = field(default_factory=dict)


SMOKE_MODELS = Models(extraction.smoke_extractor, resolution.nobody, ingest.keep_none)


def git_state(folder: str | None = None) -> dict[str, str]:
    """git_commit and git_dirty of the folder, by default this library's. An evaluation that can't say what code ran isn't one: without git it's refused."""
    at = folder or str(Path(__file__).resolve().parent)
    ask = lambda *a: subprocess.run(["git", "-C", at, *a], capture_output=True, text=True, check=True).stdout.strip()
    try:
        return {"git_commit": ask("rev-parse", "HEAD"), "git_dirty": str(bool(ask("status", "--porcelain"))).lower()}
    except (OSError, subprocess.CalledProcessError) as e:
        raise Refused(f"the commit of {at} can't be told: {e}") from e


def provenance(spark: SparkSession, settings: Settings, folder: str | None = None) -> dict[str, str]:
    """Where and with what a run ran; none of it decides whether runs are comparable."""
    return git_state(folder) | {"spark": spark.version, "pyspark": pyspark.__version__, "python": platform.python_version(), "master": spark.sparkContext.master} | {k: str(v) for k, v in asdict(settings).items()}


def identity(settings: Settings, corpus_hash: str, checkset_version: str, prompts: dict[str, tuple[str, ...]], mode: str) -> dict[str, str]:
    hashes = {f"{k}_prompt": resume.prompt_hash(*prompts.get(k, ())) for k in ingest.CALLS}
    own = {"corpus_hash": corpus_hash, "checkset_version": checkset_version, "model": settings.model, "chunk_size": settings.chunk_size, "chunk_overlap": settings.chunk_overlap}
    return {k: str(v) for k, v in (own | {"chunker_version": ingest.CHUNKER_VERSION, "extractor_version": ingest.EXTRACTOR_VERSION, "mode": mode} | hashes).items()}


def graph_snapshot(spark: SparkSession, result: ingest.Result, chapters: DataFrame, graph: str, searched: list[str], checkpoint_dir: bool) -> DataFrame:
    """evaluation.SNAPSHOT of each novel of the run, as the stored graph has it. A novel's persons are one row of it: checks look at them together."""
    now = store.snapshot(spark, graph)
    people = now["persons"].groupBy("novel_id").agg(F.sort_array(F.collect_list(F.struct("name", "aliases"))).alias("persons"))
    found_by = lambda q: F.contains("name", F.lit(q)) | F.exists("aliases", lambda a: F.contains(a, F.lit(q)))
    hits = [F.struct(F.lit(q).alias("q"), F.sort_array(F.collect_set(F.when(found_by(q), F.col("name")))).alias("names")) for q in searched]
    found = now["persons"].groupBy("novel_id").agg(F.map_from_entries(F.array(*hits)).alias("hits"))
    nonbody = evaluation.nonbody_canonicals(now["persons"], chapters).groupBy("novel_id").agg(F.count(F.lit(1)).alias("nonbody"))
    failed = result.extractions.where("status = 'failed'").groupBy("novel_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("failed_chunks"))
    out = result.chunks.select("novel_id").distinct()
    for df in (people, found, nonbody, failed, stats(result, now)):
        out = out.join(df, "novel_id", "left")
    empty = lambda ddl: F.array().cast(ddl)
    out = out.select(
        "novel_id", F.coalesce("persons", empty("array<struct<name:string,aliases:array<string>>>")).alias("persons"), F.array(F.lit("Novel"), F.lit("Person")).alias("labels"), F.array("novel_id").alias("novels_seen"),
        F.coalesce("hits", F.map_from_entries(F.array(*[F.struct(F.lit(q), empty("array<string>")) for q in searched]))).alias("hits"), F.create_map(F.lit("nonbody_canonical_count"), F.coalesce("nonbody", F.lit(0)).cast("long")).alias("counts"),
        F.coalesce("stats", F.create_map().cast("map<string,bigint>")).alias("stats"), F.lit(checkpoint_dir).alias("checkpoint_dir"), F.coalesce("failed_chunks", empty("array<int>")).alias("failed_chunks"),
    )
    return out.select(columns(evaluation.SNAPSHOT))


def stats(result: ingest.Result, now: dict[str, DataFrame]) -> DataFrame:
    """novel_id, stats: the resolver's counters, the merges' outcomes, and the sizes of the graph."""
    merges = merging.merge_stats(result.decisions)
    merged = merges.select("novel_id", F.explode(F.map_from_arrays(F.array(*[F.lit("merge_candidate_pairs" if c == "candidate_pairs" else c) for c in merges.columns[1:]]), F.array(*merges.columns[1:]))).alias("name", "n"))
    sizes = store.counts(now["persons"], now["relates_to"]).select("novel_id", F.explode(F.create_map(F.lit("persons"), "persons", F.lit("relationships"), "relationships")).alias("name", "n"))
    failed = result.extractions.groupBy("novel_id").agg(F.count_if(F.col("status") == "failed").alias("n")).select("novel_id", F.lit("failed_blocks").alias("name"), "n")
    every = resolution.counters(result.resolution).unionByName(merged).unionByName(sizes).unionByName(failed)
    return every.groupBy("novel_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("stats"))  # some two dozen a novel


@dataclass
class Run:
    run_id: str | None  # None after a dry run
    report: str
    outcomes: DataFrame | None
    row: DataFrame | None


def run(
    spark: SparkSession, book: str, out_dir: str, pinned_hash: str | None, mode: str = REAL, settings: Settings = Settings(), models: Models = Models(), checks: DataFrame | None = None,
    checkset_version: str = "2", tag: str = "", repository: str | None = None, save_text: Callable[[str, str], None] | None = None,
) -> Run:
    """Reads the book, builds and stores its graph afresh, evaluates the checks and writes the run: its row, its outcomes, its graph and its report under out_dir.

    Refused is raised before anything is called if the corpus is missing, isn't the pinned one (pinned_hash None: any), the checkset isn't
    sound or the code's commit can't be told. A smoke run's graph is removed again. out_dir is a folder that driver and executors share.
    """
    if mode not in (REAL, SMOKE, DRY):
        raise ValueError(f"no such mode: {mode}")
    checks = evaluation.checkset(spark) if checks is None else checks
    models = SMOKE_MODELS if mode == SMOKE else models
    fs, at = store.files(spark, book)
    files = epub.uploads(spark, book).where("code = 0").persist() if fs.exists(at(book)) else None
    hashes = sorted(r.novel_id for r in files.select("novel_id").distinct().collect()) if files is not None else []  # a few books
    corpus = None if not hashes else hashes[0] if len(hashes) == 1 else resume.prompt_hash(*hashes)
    if why := evaluation.refusals(checks, corpus, pinned_hash or corpus or "", False):
        raise Refused("; ".join(why))
    where, same = provenance(spark, settings, repository), identity(settings, corpus, checkset_version, models.prompts, mode)
    if mode == DRY:
        return Run(None, evaluation.report([{"setting": k, "value": v} for k, v in (same | where).items()], "A run may start"), None, None)
    run_id = uuid.uuid4().hex
    at_run, started = f"{out_dir}/work/{run_id}", spark.sql("SELECT current_timestamp() AS t").first().t
    chapters = epub.read_epub(files).persist()
    result = ingest.build(spark, chapters, at_run, settings, models.extractor, models.judge, models.merge_judge, prompts=models.prompts)
    graph = f"{out_dir}/graphs/{run_id}"
    store.write_novels(files.select("novel_id", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("title")).dropDuplicates(["novel_id"]), result.persons, result.relations, graph)
    searched = [r.a for r in checks.where("kind = 'alias_search_unique'").select("a").distinct().collect()]
    snapshots = graph_snapshot(spark, result, chapters, graph, searched or [""], False)
    outcomes = evaluation.evaluate(checks, snapshots).select(F.lit(run_id).alias("run_id"), "check_id", "outcome")
    outcomes.write.parquet(f"{out_dir}/outcomes/run_id={run_id}/rows")
    status = result.admission.agg(F.max("status")).first()[0] or "completed"
    seen = snapshots.select("stats", "failed_chunks").first()  # of the one novel, or the first
    values = (run_id, tag, status, started, *[same[c] for c in IDENTITY], where, seen.stats if seen else {}, seen.failed_chunks if seen else [], [f"the job ended as {status}"] * (status != "completed") + ["the code has uncommitted changes"] * (where["git_dirty"] == "true"))
    row = spark.createDataFrame([values], RUNS)
    row.write.parquet(f"{out_dir}/runs/run_id={run_id}/rows")  # last: a run without its row isn't one
    text = evaluation.run_report(outcomes, checks, same | where)
    (save_text or (lambda path, t: store.put_small(spark, path, t)))(f"{out_dir}/reports/{run_id}.md", text)
    if mode == SMOKE:
        fs.delete(at(graph), True)
    chapters.unpersist(), files.unpersist()
    return Run(run_id, text, spark.read.schema(OUTCOMES).parquet(f"{out_dir}/outcomes/run_id={run_id}/rows"), row)


def runs(spark: SparkSession, out_dir: str, run_ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, outcomes) of the given runs."""
    at = lambda kind: [f"{out_dir}/{kind}/run_id={i}/rows" for i in run_ids]
    return spark.read.schema(RUNS).parquet(*at("runs")), spark.read.schema(OUTCOMES).parquet(*at("outcomes"))


def comparable(rows: DataFrame, same_commit: bool = False) -> None:
    """Raises Refused if the runs differ in IDENTITY, or with same_commit in their commit; says in what."""
    fields = [F.col(c) for c in IDENTITY] + [F.col("provenance")["git_commit"].alias("git_commit")] * same_commit
    counts = rows.select(*fields).agg(*[F.count_distinct(F.col(c)).alias(c) for c in rows.select(*fields).columns]).first().asDict()
    if differ := sorted(c for c, n in counts.items() if n > 1):
        raise Refused(f"the runs differ in {', '.join(differ)}")


def baseline(spark: SparkSession, out_dir: str, run_ids: list[str], same_commit: bool = False) -> tuple[DataFrame, str]:
    """evaluation.aggregate() of runs, and its report. Runs that can't be compared are refused."""
    rows, outcomes = runs(spark, out_dir, run_ids)
    comparable(rows, same_commit)
    out = evaluation.aggregate(outcomes, rows, IDENTITY)
    return out, evaluation.baseline_report(out, rows.select(*IDENTITY).first().asDict())


def against(spark: SparkSession, out_dir: str, run_id: str, baseline_ids: list[str], same_commit: bool = False) -> tuple[DataFrame, str]:
    """One run against a baseline of others, and the report. A run of another corpus, model, setting, checkset or prompt gets REFUSE_COMPARE for each check, and so does any against a baseline with stable failures."""
    rows, _ = runs(spark, out_dir, [run_id, *baseline_ids])
    try:
        comparable(rows, same_commit)
        same = True
    except Refused:
        same = False
    base, _ = baseline(spark, out_dir, baseline_ids, same_commit)
    first = base.select("baseline_status").first()
    out = evaluation.compare(runs(spark, out_dir, [run_id])[1], base, same, first is None or first[0] == "VALID")
    return out, evaluation.compare_report(out)
