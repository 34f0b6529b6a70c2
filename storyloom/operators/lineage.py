"""Events of a job, and why a mention ended where it did: the layer of its first decisive fact."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: The events of a mention and those of a chunk or a job; fixed values.
MENTION_EVENTS = ("mention_enter", "recall", "judge", "admission", "registration")
JOB_EVENTS = ("chunk_start", "judge_batch", "extraction_raw", "merge_stats", "merge_drop", "canonical_snapshot", "job_end")
#: Every event's columns; `body` is JSON of what the event's kind has besides.
EVENTS = "novel_id string, event string, ordinal long, chunk_id int, chapter_id int, mention string, body string"

#: Admissions that end a mention; fixed values.
NEGATIVE = ("blocked", "observation", "target_mismatch", "anchor_mismatch", "anchor_absent")
HYGIENE = ("skipped_hardfilter",)
LAYERS = ("SUCCESS", "SUCCESS_ALIAS", "SUCCESS_CANONICAL", "CATEGORY_LAYER_D5", "RECALL_LAYER", "JUDGE_LAYER", "ADMISSION_LAYER", "MERGE_LAYER", "REGISTRATION_LAYER", "HYGIENE_LAYER", "CHAIN_BREAK", "EXTRACTION_LAYER", "UNKNOWN")


def parsed(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """lines with the fields of their JSON in place of `column`; of a line that can't be read `_corrupt` is the text and all else null."""
    others = [c for c in lines.columns if c != column]
    whole = F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(*others, whole.alias("r")).select(*others, "r.*")


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines but for blank ones."""
    return parsed(spark.read.text(path).where(F.trim("value") != ""), schema)


def all_or_nothing(lines: DataFrame) -> DataFrame:
    """The rows, or none if any line is corrupt."""
    bad = lines.agg(F.coalesce(F.bool_or(F.col("_corrupt").isNotNull()), F.lit(False)).alias("__bad"))
    return lines.join(F.broadcast(bad), ~F.col("__bad")).drop("_corrupt", "__bad")  # one row


def job_events(ready: DataFrame, mention_events: DataFrame, decided: DataFrame, merges: DataFrame, people: DataFrame, admission: DataFrame, raw_extraction: bool = False) -> DataFrame:
    """EVENTS of all kinds of a job that ended, out of its tables; they have no part in any decision.

    ready: chunks with their extractions; mention_events: resolution.events(); decided: merge decisions with merge_stats() by
    novel; merges: (novel_id, drop, keep); people: the final persons; admission: resume.admission().
    """

    def rows(df: DataFrame, event: str, *body: str, mention: str | None = None, chunk: bool = False) -> DataFrame:
        at = [F.col(c).cast("int") if chunk else F.lit(None).cast("int").alias(c) for c in ("chunk_id", "chapter_id")]
        text = F.to_json(F.struct(*[F.expr(x) for x in body])) if body else F.lit("{}")
        return df.select("novel_id", F.lit(event).alias("event"), F.lit(0).cast("long").alias("ordinal"), *at, (F.col(mention) if mention else F.lit(None).cast("string")).alias("mention"), text.alias("body"))

    each = mention_events.select("novel_id", "event", F.col("ordinal").cast("long").alias("ordinal"), "chunk_id", "chapter_id", "mention", F.to_json("facts").alias("body"))
    asked = mention_events.where("event = 'judge'").groupBy("novel_id", "chunk_id", "chapter_id").agg(F.sort_array(F.collect_set("mention")).alias("mentions"))  # of one chunk
    out = each.unionByName(rows(ready, "chunk_start", "section_type", "length(text) AS text_len", "size(characters) AS characters_count", "size(relationships) AS relationships_count", chunk=True))
    out = out.unionByName(rows(asked, "judge_batch", "mentions", chunk=True))
    if raw_extraction:
        out = out.unionByName(rows(ready, "extraction_raw", "characters", "relationships", chunk=True))
    out = out.unionByName(rows(decided, "merge_stats", *[c for c in decided.columns if c != "novel_id"]))
    out = out.unionByName(rows(merges, "merge_drop", "keep AS merge_keep", mention="drop"))
    out = out.unionByName(rows(people, "canonical_snapshot", "aliases", "mention_count", mention="name"))
    return out.unionByName(rows(admission, "job_end", "status", "chunk_failures", "judge_failures", "merge_failures"))


def failed_job(novels: DataFrame, error: str) -> DataFrame:
    """The last event of the jobs of novels (novel_id) that ended by an exception."""
    body = F.to_json(F.struct(F.lit("failed").alias("status"), F.lit(error).alias("error")))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return novels.select("novel_id").distinct().select("novel_id", F.lit("job_end").alias("event"), F.lit(0).cast("long").alias("ordinal"), none("int", "chunk_id"), none("int", "chapter_id"), none("string", "mention"), body.alias("body"))


def flush(events: DataFrame, path: str) -> bool:
    """Writes events as JSON lines, a folder for each novel, in place of those of an earlier job; whether that worked. A failure is logged, as it mustn't hide how the job ended."""
    try:
        events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("novel_id").json(path)
    except Exception as e:  # noqa: BLE001
        log.warning("events can't be written to %s: %s", path, str(e)[:300])
        return False
    return True


def diagnose_events(events: DataFrame, expected: DataFrame) -> DataFrame:
    """diagnose() with all that it needs taken from EVENTS; expected: (novel_id, mention, expect), or without novel_id where the events are of one novel."""
    by = ["novel_id"] if "novel_id" in expected.columns else []
    kind = lambda k, schema: parsed(events.where(F.col("event") == k).select("novel_id", "mention", "ordinal", F.col("body").alias("value")), schema)
    facts = events.where(F.col("event").isin(*MENTION_EVENTS)).withColumn("facts", F.from_json("body", "map<string,string>"))
    drops = kind("merge_drop", "merge_keep string").select(*by, F.col("mention").alias("canonical"), F.col("merge_keep").alias("keep"))
    shown = kind("canonical_snapshot", "aliases array<string>").select(*by, F.col("mention").alias("canonical"), "aliases")
    raw = kind("extraction_raw", "characters array<struct<name:string>>, relationships array<struct<source:string,target:string>>")
    names = raw.select(*by, F.explode(F.concat(F.col("characters.name"), F.col("relationships.source"), F.col("relationships.target"))).alias("name"))
    failed = kind("job_end", "chunk_failures long").where("chunk_failures > 0")
    return diagnose(flat_events(facts), expected, drops, shown, names, failed.select("novel_id").distinct() if by else not failed.isEmpty())


def effective_category(hygiene, extraction):  # noqa: ANN001, ANN201
    return F.when(hygiene.isin("generic", "collective", "invalid"), hygiene).otherwise(extraction)


def facts(events: DataFrame, *by: str) -> DataFrame:
    """One row for each mention (of each novel, with by="novel_id") with what its events say, the last by ordinal where one counts.

    events: (mention, ordinal, event, hygiene_category, extraction_category, candidates int, judge_called, resolves_to,
    admission, registered, alias_to, final_canonical).
    """
    is_ = lambda e: F.col("event") == e
    last = lambda c, test: F.max_by(F.when(test, F.col(c)), F.when(test, F.col("ordinal")))
    category = effective_category(F.col("hygiene_category"), F.col("extraction_category"))
    some = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    return events.groupBy(*by, "mention").agg(
        some(is_("mention_enter") & (category.isNull() | (category == "person"))).alias("plain_category"),
        some(is_("recall")).alias("recalled"),
        some(is_("recall") & (F.col("candidates") > 0)).alias("found"),
        some(is_("judge") & F.col("judge_called") & F.col("resolves_to").isNull()).alias("judged_null"),
        some(is_("admission") & F.col("admission").isin(*NEGATIVE)).alias("refused"),
        last("admission", is_("admission")).alias("last_admission"),
        F.coalesce(last("registered", is_("registration")), F.lit(False)).alias("registered"),
        last("alias_to", is_("registration")).alias("alias_to"),
        last("final_canonical", is_("registration")).alias("final_canonical"),
    )


def diagnose(events: DataFrame, expected: DataFrame, merge_drops: DataFrame, snapshot: DataFrame, raw_names: DataFrame, failed: bool | DataFrame) -> DataFrame:
    """mention, verdict for each (mention, expect) of `expected`; expect may be null.

    merge_drops: (canonical, keep), snapshot: (canonical, aliases), raw_names: (name) that the extraction had. failed: whether any
    chunk failed. If `expected` has novel_id, so has each of these, a novel's mentions are told by its own rows only, and `failed` is a table of the novels.
    """
    by = ["novel_id"] if "novel_id" in expected.columns else []
    f = expected.join(facts(events, *by), [*by, "mention"], "left").withColumn("seen", F.col("registered").isNotNull())
    alias = F.when(F.col("registered"), F.col("alias_to"))
    f = f.withColumn("alias", alias).withColumn("own", F.when(F.col("registered") & F.col("alias").isNull(), F.col("final_canonical")))
    f = f.withColumn("holder", F.coalesce("alias", "own"))
    f = f.join(merge_drops.select(*by, F.col("canonical").alias("holder"), F.lit(True).alias("absorbed")), [*by, "holder"], "left")
    f = f.join(snapshot.select(*by, F.col("canonical").alias("holder"), F.col("aliases").alias("holder_aliases")), [*by, "holder"], "left")
    f = f.join(raw_names.select(*by, F.col("name").alias("mention"), F.lit(True).alias("raw")).distinct(), [*by, "mention"], "left")
    f = f.withColumn("__broken", F.lit(failed)) if isinstance(failed, bool) else f.join(failed.select(*by, F.lit(True).alias("__broken")), by, "left")
    is_null_safe = lambda c: F.coalesce(c, F.lit(False))
    met = is_null_safe((F.col("alias") == F.col("expect")) | (F.col("own") == F.col("expect"))) | is_null_safe(F.array_contains("holder_aliases", F.col("expect")))
    unseen = F.when(F.col("raw").isNotNull() | F.coalesce("__broken", F.lit(False)), "CHAIN_BREAK").otherwise("EXTRACTION_LAYER")
    fixed = (
        F.when(F.col("plain_category"), "CATEGORY_LAYER_D5").when(F.col("recalled") & ~F.col("found"), "RECALL_LAYER").when(F.col("judged_null"), "JUDGE_LAYER")
        .when(F.col("refused"), "ADMISSION_LAYER").when(F.col("absorbed").isNotNull(), "MERGE_LAYER")
    )
    with_expectation = F.when(met, "SUCCESS").otherwise(F.coalesce(fixed, F.when(F.col("own") != F.col("expect"), "REGISTRATION_LAYER"), F.lit("UNKNOWN")))
    ended = F.when(F.col("last_admission").isin(*HYGIENE), "HYGIENE_LAYER").when(F.col("last_admission").isNotNull(), "ADMISSION_LAYER").otherwise("UNKNOWN")
    without = F.when(F.col("alias").isNotNull(), "SUCCESS_ALIAS").when(F.col("own").isNotNull(), "SUCCESS_CANONICAL").otherwise(F.coalesce(fixed, ended))
    return f.select(*by, "mention", "expect", F.when(~F.col("seen"), unseen).when(F.col("expect").isNotNull(), with_expectation).otherwise(without).alias("verdict"))


def flat_events(events: DataFrame) -> DataFrame:
    """Events of the resolver in the columns that facts() takes."""
    x = F.col("facts")
    yes = lambda k: x[k] == "True"
    return events.select(
        "novel_id", "chunk_id", "mention", "ordinal", "event", x["hygiene_category"].alias("hygiene_category"), x["extraction_category"].alias("extraction_category"),
        F.when(F.col("event") == "recall", F.when(x["recall_candidates"].isNull(), 0).otherwise(F.size(F.split(x["recall_candidates"], r"\|")))).alias("candidates"),
        yes("judge_called").alias("judge_called"), x["judge_resolves_to"].alias("resolves_to"), x["admission"].alias("admission"), yes("registered").alias("registered"),
        x["alias_to"].alias("alias_to"), x["final_canonical"].alias("final_canonical"), x["lineage_id"].alias("lineage_id"),
    )


def all_mentions(events: DataFrame, *by: str) -> DataFrame:
    return events.where("mention <> ''").select(*by, "mention").distinct()


def chains(events: DataFrame) -> DataFrame:
    """lineage_id, chunk_id, chain: a mention's events in a chunk, in order, as text."""
    line = F.concat_ws(" ", F.col("event"), F.to_json(F.struct("candidates", "resolves_to", "admission", "registered", "alias_to", "final_canonical")))
    return events.groupBy("lineage_id", "chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda s: s["line"]), "\n").alias("chain"))
