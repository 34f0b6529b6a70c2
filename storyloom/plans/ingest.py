"""A novel's way from chapters to a stored graph, with resume."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.config import Settings
from storyloom.operators import chunks as C
from storyloom.operators import extraction, graph, lineage, merging, resolution, resume, store
from storyloom.operators.extraction import Extractor
from storyloom.schema import EXTRACTIONS

CHECKPOINT = f"{EXTRACTIONS}, config_fingerprint string"

JUDGEMENTS = "novel_id string, chunk_id int, fingerprint string, answers string"


def keep_none(pairs: list[dict]) -> list[dict]:
    """A merge judge that merges nothing."""
    return [{"a": p["a"], "b": p["b"], "merge": False, "confidence": 1.0} for p in pairs]


#: Of the chunker's and the extractor's own rules: raised when their results change.
CHUNKER_VERSION = EXTRACTOR_VERSION = 1
CALLS = ("extraction", "judge", "merge")


def versions_of(settings: Settings, prompts: dict[str, tuple[str, ...]]) -> tuple[str, dict[str, str]]:
    """The fingerprint of extraction, and the versions under which the answers of each judge may be used again."""
    if unknown := prompts.keys() - set(CALLS):
        raise ValueError(f"no such calls: {sorted(unknown)}")
    hashes = {k: resume.prompt_hash(*prompts.get(k, ())) for k in CALLS}
    own = {k: v for k, v in asdict(settings).items() if k in ("chunk_size", "chunk_overlap", "model")}
    print_ = resume.config_fingerprint(chunker=CHUNKER_VERSION, extractor=EXTRACTOR_VERSION, prompt=hashes["extraction"], **own)
    return print_, {k: resume.config_fingerprint(config=print_, model=settings.model, prompt=hashes[k]) for k in ("judge", "merge")}


@dataclass
class Result:
    chunks: DataFrame
    extractions: DataFrame
    resolution: DataFrame
    decisions: DataFrame
    persons: DataFrame
    relations: DataFrame
    admission: DataFrame
    ready: DataFrame  # what was resolved: chunks with their extractions
    merges: DataFrame
    manifests: resume.Manifests | None = None
    begun: DataFrame | None = None  # manifests of the novels that this run worked on


def build(
    spark: SparkSession, chapters: DataFrame, work_dir: str, settings: Settings = Settings(), extractor: Extractor = extraction.rule_extractor,
    judge: resolution.AliasJudge = resolution.nobody, merge_judge: merging.MergeJudge = keep_none, checkpoint: str | None = None,
    contents: DataFrame | None = None, prompts: dict[str, tuple[str, ...]] | None = None,
) -> Result:
    """Chunks, extracts what no checkpoint has, resolves, aggregates, merges and drops the unconfirmed.

    work_dir is a folder that driver and executors share. What calls judges or extractors is written there, so that
    no later action repeats a call; a checkpoint key makes a later run with the same settings start from what is done.
    contents: (novel_id, content_hash, title) of the uploads. With a checkpoint, novels that an earlier run completed with the
    same bytes, settings and chunks aren't worked on again and have no rows in the result; the others are noted as begun.
    prompts: what `extraction`, `judge` and `merge` ask a model with; an answer to another prompt, model or setting counts as none.
    A checkpoint that can't be written is logged and left out.
    """
    numbers, run = iter(range(10_000)), f"{work_dir}/runs/{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        path = f"{run}/{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    chunks = written(C.chunk(chapters, settings.chunk_size, settings.chunk_overlap), "chunks")
    print_, versions = versions_of(settings, prompts or {})
    store_ = resume.Checkpoints(spark, f"{work_dir}/checkpoints")
    manifests = begun = None
    if checkpoint and contents is not None:
        manifests = resume.Manifests(store_)
        uploads = C.structure_hash(chunks).join(contents, "novel_id")
        known = manifests.reusable(uploads, print_).where("known_status = 'COMPLETED'").select(F.col("known_novel_id").alias("novel_id"))
        chunks = written(chunks.join(known, "novel_id", "left_anti"), "chunks_to_do")
        counts = chunks.groupBy("novel_id").agg(F.count(F.lit(1)).alias("chunk_count"))
        begun = uploads.join(counts, "novel_id").withColumns({"config_fingerprint": F.lit(print_), "status": F.lit(resume.IN_PROGRESS)})
        begun = written(begun, "manifests")
        manifests.save(begun)
    old = store_.get("extractions", checkpoint, CHECKPOINT) if checkpoint else spark.createDataFrame([], CHECKPOINT)
    done = resume.completed(old, print_)
    how = extraction.Attempts(retries=settings.retries)
    new = extraction.extract_all(resume.todo(chunks, done), extractor, how, settings.concurrency).withColumn("config_fingerprint", F.lit(print_))
    new = resume.with_attempts(new, old)
    extractions = written(resume.combine(done.join(chunks.select("novel_id", "chunk_id"), ["novel_id", "chunk_id"], "left_semi"), new), "extractions")
    if checkpoint:
        store_.put_novels("extractions", checkpoint, extractions, chunks, CHECKPOINT)
    ready = written(resume.assembled(chunks, extractions.where("status = 'completed'")).select("*", "result.*").drop("result"), "ready")
    past = store_.get("judgements", checkpoint, JUDGEMENTS) if checkpoint else None
    resolved = written(resolution.resolve(ready, judge, settings.lineage, past, versions["judge"], settings.own_candidates_only), "resolution")
    if checkpoint:
        store_.put_novels("judgements", checkpoint, resolution.judgements(resolved), chunks, JUDGEMENTS)
    texts = chunks.select("novel_id", "chunk_id", "text")
    named, linked = resolution.characters(resolved), resolution.relations(resolved, ready).join(texts, ["novel_id", "chunk_id"])
    people = graph.apply_aliases(graph.persons(named, settings.chunk_lists), resolution.aliases(resolved))
    edges = graph.relations(linked, settings.chunk_lists)
    evidence = merging.pair_evidence(resolution.bridges(resolved))
    pairs = merging.pair_metadata(evidence, resolution.canonicals(resolved))
    past = store_.get("merge_answers", checkpoint, merging.ANSWERS) if checkpoint else None
    answers = written(merging.judged(pairs, merge_judge, past, versions["merge"]), "merge_answers")
    if checkpoint:
        store_.put_novels("merge_answers", checkpoint, answers.where("error IS NULL"), chunks, merging.ANSWERS)
    answers = answers.withColumn("ordinal", F.lit(0))
    decisions = written(merging.decide(pairs, answers, settings.merge_threshold), "decisions")
    merges = merging.roots(merging.merge_map(decisions), lambda df: written(df, f"roots_{next(numbers)}"))
    merges = written(graph.valid_merges(people, merges), "merges")
    if settings.chunk_lists:
        people, edges = graph.merge_persons(people, merges), graph.merge_relations(edges, merges)
    else:
        people = graph.merge_persons(people, merges, graph.merge_person_chunks(graph.person_chunks(named), merges))
        edges = graph.merge_relations(edges, merges, graph.merge_relation_chunks(graph.relation_chunks(linked), merges))
    people, edges = graph.drop_unconfirmed(people, edges, resolution.dropped(resolved))
    people, edges = written(people, "persons"), written(edges, "relations")
    failures = resume.failed(extractions)
    admission = resume.admission(chunks, failures, resolution.judge_failures(resolved), decisions.where("outcome = 'failed'"))
    return Result(chunks, extractions, resolved, decisions, people, edges, admission, ready, merges, manifests, begun)


def events(result: Result, raw_extraction: bool = False) -> DataFrame:
    """All lineage events of a run (lineage.EVENTS); those of mentions only with settings.lineage."""
    stats = merging.merge_stats(result.decisions)
    return lineage.job_events(result.ready, resolution.events(result.resolution), stats, result.merges, result.persons, result.admission, raw_extraction)


def job(spark: SparkSession, chapters: DataFrame, titles: DataFrame, work_dir: str, graph_path: str, lineage_path: str | None = None, raw_extraction: bool = False, **how) -> Result:
    """build() and save(), with the events written at the end, whether that is a success or an exception, which is raised again."""
    try:
        result = build(spark, chapters, work_dir, **how)
        save(result, titles, graph_path)
    except Exception as e:
        if lineage_path:
            lineage.flush(lineage.failed_job(titles, f"{type(e).__name__}: {e}"), lineage_path)
        raise
    if lineage_path:
        lineage.flush(events(result, raw_extraction), lineage_path)
    return result


def save(result: Result, titles: DataFrame, path: str) -> dict[str, int]:
    """Writes the graph's tables, then notes the novels without any gap as complete; titles: (novel_id, title)."""
    worked_on = result.chunks.select("novel_id").distinct()
    out = store.write_novels(titles.join(worked_on, "novel_id", "left_semi"), result.persons, result.relations, path)
    if result.manifests is not None:
        done = result.admission.where("complete").select("novel_id")
        result.manifests.save(result.begun.join(done, "novel_id", "left_semi").withColumn("status", F.lit(resume.COMPLETED)))
    return out
