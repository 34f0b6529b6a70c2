"""Checkpoint tables of long runs: what is done, what is to do, and when a run counts as complete."""

from __future__ import annotations

import hashlib
import json
import logging
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.operators.store import files, put_small
from storyloom.schema import columns

log = logging.getLogger(__name__)

SCHEMA_VERSION = 1
KEY = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,199}")


def prompt_hash(*prompts: str) -> str:
    return hashlib.sha256("\n".join(prompts).encode()).hexdigest()


def config_fingerprint(**settings: object) -> str:
    """Of everything that makes two runs' results comparable: versions, prompt hashes, model, chunk size and overlap."""
    return hashlib.sha256(json.dumps({"schema_version": SCHEMA_VERSION} | settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def find_manifest(manifests: DataFrame, content: str, fingerprint: str) -> DataFrame:
    """The manifest of the same bytes and settings; of several the one updated last."""
    hits = manifests.where((F.col("content_hash") == content) & (F.col("config_fingerprint") == fingerprint))
    return hits.orderBy(F.desc("updated_at"), "novel_id").limit(1)


def latest_manifests(manifests: DataFrame) -> DataFrame:
    w = Window.partitionBy("content_hash", "config_fingerprint").orderBy(F.desc("updated_at"), "novel_id")
    return manifests.withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i")


def completed(extractions: DataFrame, fingerprint: str) -> DataFrame:
    return extractions.where((F.col("status") == "completed") & (F.col("config_fingerprint") == fingerprint))


def failed(extractions: DataFrame) -> DataFrame:
    return extractions.where("status = 'failed'").select("novel_id", "chunk_id", "error")


def todo(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """The chunks that aren't done: the anti-join that comes before any costly call."""
    return chunks.join(done.select("novel_id", "chunk_id"), ["novel_id", "chunk_id"], "left_anti")


def combine(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows, one for each chunk, old ones first."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy("novel_id", "chunk_id").orderBy("__new")
    return both.withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i", "__new")


def with_attempts(new: DataFrame, old: DataFrame) -> DataFrame:
    """New rows with `attempts` counted on from the latest old row of their chunk."""
    before = old.groupBy("novel_id", "chunk_id").agg(F.max("attempts").alias("__before"))
    return new.join(before, ["novel_id", "chunk_id"], "left").withColumn("attempts", F.col("attempts") + F.coalesce("__before", F.lit(0))).drop("__before")


def assembled(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Completed extractions with their chunks."""
    return chunks.join(done.select("novel_id", "chunk_id", "result"), ["novel_id", "chunk_id"])


def admission(chunks: DataFrame, failures: DataFrame, judge_failures: DataFrame, merge_failures: DataFrame, written: bool = True) -> DataFrame:
    """novel_id, complete: no chunk, judge or merge call failed and the graph is written; terminal status of the job: chunks that failed in extraction or judging are errors."""
    novels = chunks.select("novel_id").distinct()
    for name, df in (("chunk", failures), ("judge", judge_failures), ("merge", merge_failures)):
        novels = novels.join(df.groupBy("novel_id").agg(F.count(F.lit(1)).alias(f"{name}_failures")), "novel_id", "left").na.fill(0, [f"{name}_failures"])
    gaps = F.col("chunk_failures") + F.col("judge_failures") + F.col("merge_failures")
    status = F.when(F.col("chunk_failures") + F.col("judge_failures") > 0, "completed_with_errors").otherwise("completed")
    return novels.withColumns({"complete": (gaps == 0) & F.lit(written), "status": status if written else F.lit("failed")})


def call_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """chunk_id, added: calls after less calls before, for every chunk of either."""
    b, a = before.select("chunk_id", F.col("calls").alias("b")), after.select("chunk_id", F.col("calls").alias("a"))
    return a.join(b, "chunk_id", "full").select("chunk_id", (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("added"))


def graph_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """name, kind: only_left, only_right, aliases or mention_count of persons that differ between two snapshots."""
    pick = lambda df, s: df.select("name", F.sort_array("aliases").alias(f"al_{s}"), F.col("mention_count").alias(f"mc_{s}"))
    both = pick(left, "l").join(pick(right, "r"), "name", "full")
    kinds = F.when(F.col("mc_r").isNull(), F.array(F.lit("only_left"))).when(F.col("mc_l").isNull(), F.array(F.lit("only_right")))
    differ = F.array_compact(F.array(F.when(F.col("al_l") != F.col("al_r"), "aliases"), F.when(F.col("mc_l") != F.col("mc_r"), "mention_count")))
    return both.select("name", F.explode(kinds.otherwise(differ)).alias("kind"))


class Checkpoints:
    """Tables of one folder by kind and key. A table that is missing or unreadable counts as empty.

    Each put() writes a new version and then marks it as whole; readers take the newest marked version that can be read, so
    a crash in between, or a run that still reads the version before, loses nothing. The version before the newest stays.
    """

    MARK = "WHOLE"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def folder(self, kind: str, key: str) -> str:
        if not KEY.fullmatch(kind) or not KEY.fullmatch(key):
            raise ValueError(f"not a key: {kind!r}, {key!r}")
        return f"{self.path}/{kind}/key={key}"

    def versions(self, kind: str, key: str) -> list[int]:
        """The marked versions, the newest first."""
        folder = self.folder(kind, key)
        fs, at = files(self.spark, folder)
        found = fs.listStatus(at(folder)) if fs.exists(at(folder)) else []
        numbers = [int(s.getPath().getName().removeprefix("v")) for s in found if re.fullmatch(r"v\d+", s.getPath().getName())]
        return sorted((n for n in numbers if fs.exists(at(f"{folder}/v{n}/{self.MARK}"))), reverse=True)

    def put(self, kind: str, key: str, rows: DataFrame) -> bool:
        """Replaces the rows; they show whole or not at all. A write that fails is logged and gives False: a job goes on without it, and the rows before stay."""
        folder = self.folder(kind, key)
        try:
            old, (fs, at) = self.versions(kind, key), files(self.spark, folder)
            new = max(old, default=0) + 1
            rows.write.mode("overwrite").parquet(f"{folder}/v{new}/rows")  # what a crash left there was never marked
            fs.create(at(f"{folder}/v{new}/{self.MARK}")).close()
            for n in old[1:]:
                fs.delete(at(f"{folder}/v{n}"), True)
        except Exception as e:  # noqa: BLE001  a checkpoint saves work, it isn't the work
            log.warning("checkpoint %s of %s can't be written: %s", kind, key, str(e)[:300])
            return False
        return True

    def put_novels(self, kind: str, key: str, rows: DataFrame, novels: DataFrame, schema: str) -> bool:
        """put() in place of the given novels' rows only; those of other novels under the key stay."""
        others = self.get(kind, key, schema).join(novels.select("novel_id").distinct(), "novel_id", "left_anti")
        return self.put(kind, key, others.select(rows.columns).unionByName(rows))

    def get(self, kind: str, key: str, schema: str) -> DataFrame:
        for n in self.versions(kind, key):
            df = self.spark.read.schema(schema).parquet(f"{self.folder(kind, key)}/v{n}/rows")
            try:
                df.count()  # reads the footer of every file
            except Exception as e:  # noqa: BLE001  whatever is wrong with the files, the version before is tried
                log.warning("checkpoint %s of %s, version %d, can't be read: %s", kind, key, n, str(e)[:300])
                continue
            return df
        return self.spark.createDataFrame([], schema)

    def delete(self, kind: str, key: str) -> None:
        fs, at = files(self.spark, self.folder(kind, key))
        fs.delete(at(self.folder(kind, key)), True)

    def keys(self, kind: str) -> list[str]:
        fs, at = files(self.spark, f"{self.path}/{kind}")
        found = fs.listStatus(at(f"{self.path}/{kind}")) if fs.exists(at(f"{self.path}/{kind}")) else []
        return sorted(k for k in (s.getPath().getName().removeprefix("key=") for s in found) if self.versions(kind, k))


#: The states of a manifest; fixed values.
IN_PROGRESS, COMPLETED = "IN_PROGRESS", "COMPLETED"
MANIFEST = "novel_id string, content_hash string, config_fingerprint string, structure_hash string, title string, chunk_count long, status string, created_at timestamp, updated_at timestamp"


class Manifests:
    """One row for each novel that a run has begun: what it was made of and whether it's complete. Each novel's is a small file of its own, so runs side by side don't touch each other's."""

    def __init__(self, checkpoints: Checkpoints):
        self.spark, self.path = checkpoints.spark, f"{checkpoints.path}/manifests"

    def all(self) -> DataFrame:
        fs, at = files(self.spark, self.path)
        return self.spark.read.schema(MANIFEST).json(self.path) if fs.exists(at(self.path)) else self.spark.createDataFrame([], MANIFEST)

    def save(self, rows: DataFrame) -> None:
        """rows: (novel_id, content_hash, config_fingerprint, structure_hash, title, chunk_count, status), the novels of one run. Other novels' rows stay, and so does the time at which a novel was begun."""
        bad = rows.where(~F.coalesce(F.col("status").isin(IN_PROGRESS, COMPLETED) & F.col("content_hash").rlike("^[0-9a-f]{64}$") & F.col("config_fingerprint").rlike("^[0-9a-f]{64}$"), F.lit(False)))
        if not bad.isEmpty():
            raise ValueError("a manifest has two hashes of 64 hexadecimal digits and is IN_PROGRESS or COMPLETED")
        begun = self.all().select("novel_id", F.col("created_at").alias("__begun"))
        new = rows.join(begun, "novel_id", "left").withColumns({"created_at": F.coalesce("__begun", F.current_timestamp()), "updated_at": F.current_timestamp()})
        for r in new.select("novel_id", F.to_json(F.struct(*columns(MANIFEST))).alias("line")).collect():  # a line a novel
            put_small(self.spark, f"{self.path}/{hashlib.sha256(r.novel_id.encode()).hexdigest()}.json", r.line)

    def reusable(self, uploads: DataFrame, fingerprint: str) -> DataFrame:
        """content_hash, known_novel_id, known_status of the uploads (content_hash, structure_hash) that an earlier run with the same settings has begun; chunks that differ are another analysis."""
        known = latest_manifests(self.all().where(F.col("config_fingerprint") == fingerprint))
        known = known.select("content_hash", "structure_hash", F.col("novel_id").alias("known_novel_id"), F.col("status").alias("known_status"))
        return uploads.select("content_hash", "structure_hash").join(known, ["content_hash", "structure_hash"]).drop("structure_hash")
