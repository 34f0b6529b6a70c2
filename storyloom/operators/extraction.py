"""Extraction of people and relations from chunks: a rule in the JVM, a replay table, or any function, with validation and retries."""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.schema import CATEGORIES, EXTRACTION, EXTRACTIONS, MAX_NAME, RELATION_TYPES, columns

NAME = r"\p{Lu}\p{Ll}{2,49}"


class Retryable(Exception):
    """A failure that another attempt may mend: a busy or unreachable service."""


class Rejected(Exception):
    """A failure that is final: a refused request, or an answer that isn't valid."""


def service_failure(status: int, message: str) -> Exception:
    """What an extractor or judge raises for an HTTP status that is no success: only too many requests and the service's own failures may be mended by trying again."""
    return (Retryable if status == 429 or status >= 500 else Rejected)(f"{status}: {message[:300]}")


#: text -> {"characters": [{"name", "category"}], "relationships": [{"source", "target", "type", "confidence"}]}
Extractor = Callable[[str], dict]


def smoke_extractor(text: str) -> dict:
    """The same three people for any text."""
    return {"characters": [{"name": n, "category": "person"} for n in ("Ada", "Bruno", "Clara")], "relationships": [{"source": "Ada", "target": "Bruno", "type": "friendship", "confidence": 0.9}]}


def problems(answer: object) -> str | None:
    """Why an answer isn't valid; one bad record rejects the whole chunk."""
    if not isinstance(answer, dict) or not all(isinstance(answer.get(k, []), list) for k in ("characters", "relationships")):
        return "shape"
    named = lambda x: isinstance(x, str) and 1 <= len(x) <= MAX_NAME
    for c in answer.get("characters", []):
        if not isinstance(c, dict) or not named(c.get("name")) or c.get("category") not in (None, *CATEGORIES):
            return f"character {c!r}"[:200]
    for r in answer.get("relationships", []):
        if not isinstance(r, dict) or not named(r.get("source")) or not named(r.get("target")) or r.get("type") not in RELATION_TYPES:
            return f"relationship {r!r}"[:200]
        if not isinstance(r.get("confidence"), (int, float)) or not 0 <= r["confidence"] <= 1:
            return f"confidence {r!r}"[:200]
    return None


def drop_self_loops(relationships: Column) -> Column:
    return F.filter(relationships, lambda r: r["source"] != r["target"])


def valid_extraction(x: Column) -> Column:
    """The same rules for a struct column, in the JVM; null fields aren't valid but for a category."""
    name = lambda s: F.coalesce(F.length(s).between(1, MAX_NAME), F.lit(False))
    people = F.forall(x["characters"], lambda c: name(c["name"]) & (c["category"].isNull() | c["category"].isin(*CATEGORIES)))
    known = lambda r: F.coalesce(r["type"].isin(*RELATION_TYPES) & r["confidence"].between(0, 1), F.lit(False))
    return F.coalesce(people & F.forall(x["relationships"], lambda r: name(r["source"]) & name(r["target"]) & known(r)), F.lit(False))


def parse(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Answers in JSON as `result` (self-loops gone) and `valid`; what can't be read isn't valid."""
    out = answers.withColumn("result", F.from_json(column, EXTRACTION, {"mode": "PERMISSIVE"}))
    out = out.withColumn("valid", valid_extraction(F.col("result")))
    clean = F.struct(F.col("result.characters").alias("characters"), drop_self_loops(F.col("result.relationships")).alias("relationships"))
    return out.withColumn("result", F.when(F.col("valid"), clean))


@dataclass(frozen=True)
class Attempts:
    """Retries after the first attempt; pauses grow by `pause` seconds each."""

    retries: int = 1
    pause: float = 0.5


def in_order(run: Callable, rows: Iterable, at_once: int) -> Iterator:
    """run(row) of each row, in the rows' order, `at_once` of them at a time.

    At most twice as many rows are taken ahead of the first that isn't done, so neither rows nor answers pile up behind a
    slow call. If the reader stops early, what hasn't begun is not begun.
    """
    pool = ThreadPoolExecutor(at_once)
    waiting: deque = deque()
    try:
        for row in rows:
            waiting.append(pool.submit(run, row))
            if len(waiting) >= 2 * at_once:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()
    finally:
        pool.shutdown(wait=True, cancel_futures=True)


def attempt(extractor: Extractor, text: str, how: Attempts) -> tuple[str, int, str | None, dict | None]:
    """Status, attempts, error and answer of one text. What the extractor says is final, and an answer that isn't valid, is not tried again; anything else is."""
    for n in range(1, how.retries + 2):
        try:
            answer = extractor(text)
            if bad := problems(answer):
                raise Rejected(f"validation: {bad}")
            loops = [r for r in answer.get("relationships", []) if r["source"] != r["target"]]
            return "completed", n, None, {"characters": answer.get("characters", []), "relationships": loops}
        except Rejected as e:
            return "failed", n, str(e), None
        except Exception as e:  # noqa: BLE001  a service may fail in any way; the row tells which
            if n > how.retries:
                return "failed", n, f"{type(e).__name__}: {e}", None
            time.sleep(how.pause * n)
    raise AssertionError


def extract_all(chunks: DataFrame, extractor: Extractor, how: Attempts = Attempts(), concurrency: int = 4, tasks: int | None = None) -> DataFrame:
    """EXTRACTIONS of every chunk: a completed or a failed row for each.

    A task keeps up to `concurrency` calls going, in threads, and gives its rows in their order; a pause before another
    attempt holds one of them only. There are `tasks` tasks, as many as the session's shuffle partitions or cores if none are
    given, so up to tasks at work x concurrency calls are made at once. Rows are given on as soon as they and those before
    them are done: what a task holds doesn't grow with its chunks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(row: tuple) -> tuple:
            novel, chunk_id, text = row
            began = time.monotonic()
            status, attempts, error, result = attempt(extractor, text, how)
            return novel, chunk_id, status, attempts, error, time.monotonic() - began, json.dumps(result) if result else None

        rows, names = [], ["novel_id", "chunk_id", "status", "attempts", "error", "seconds", "answer"]
        for row in in_order(one, (r for b in batches for r in zip(b["novel_id"], b["chunk_id"], b["text"], strict=True)), concurrency):
            rows.append(row)
            if len(rows) >= 64:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)

    spark = chunks.sparkSession
    n = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    raw = chunks.select("novel_id", "chunk_id", "text").repartition(n, "novel_id", "chunk_id")
    out = raw.mapInPandas(run, "novel_id string, chunk_id int, status string, attempts int, error string, seconds double, answer string")
    return out.withColumn("result", F.from_json("answer", EXTRACTION)).select(columns(EXTRACTIONS))


def replayed(chunks: DataFrame, table: DataFrame) -> DataFrame:
    """EXTRACTIONS from a table of earlier results; a chunk that it lacks fails."""
    out = chunks.select("novel_id", "chunk_id").join(table.select("novel_id", "chunk_id", "result"), ["novel_id", "chunk_id"], "left")
    done = F.col("result").isNotNull()
    return out.select("novel_id", "chunk_id", F.when(done, "completed").otherwise("failed").alias("status"), F.lit(1).alias("attempts"), F.when(~done, "no replay").alias("error"), F.lit(0.0).alias("seconds"), "result")


def mentioned(chunks: DataFrame) -> DataFrame:
    """novel_id, chunk_id, chapter_id, ordinal, name: capitalised words of each chunk, each once, by first occurrence."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), F.lit(0)))
    return chunks.select("novel_id", "chunk_id", "chapter_id", F.posexplode(names).alias("ordinal", "name"))


def related(chunks: DataFrame) -> DataFrame:
    """Relations of names that follow each other in a chunk; type and confidence by the names' lengths."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), F.lit(0)))
    pairs = F.zip_with(F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0))), F.slice(names, 2, 100_000), lambda a, b: F.struct(a.alias("source"), b.alias("target")))
    out = chunks.select("novel_id", "chunk_id", "chapter_id", F.posexplode(pairs).alias("ordinal", "r")).select("*", "r.*").drop("r")
    size = F.length("source") + F.length("target")
    return out.withColumn("type", F.get(F.array(*[F.lit(t) for t in RELATION_TYPES]), (size % 7).cast("int"))).withColumn("confidence", (size % 10 + 1) / 10)


def rule_extractor(text: str) -> dict:
    """The rule of mentioned() and related() as a function of one text, for use with extract_all()."""
    import regex

    names = list(dict.fromkeys(regex.findall(NAME, text)))
    size = [len(a) + len(b) for a, b in zip(names, names[1:], strict=False)]
    return {
        "characters": [{"name": n, "category": "person"} for n in names],
        "relationships": [{"source": a, "target": b, "type": RELATION_TYPES[k % 7], "confidence": (k % 10 + 1) / 10} for a, b, k in zip(names, names[1:], size, strict=False)],
    }


def first_answers(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__i", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__i = 1").drop("__i")
