"""Which canonicals are one person: bridge evidence, decisions, and the roots they lead to."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVIDENCE_CAP = 5
ANSWERS = "novel_id string, a string, b string, merge boolean, confidence double, error string, fingerprint string"

#: pairs -> decisions; rows of (a, b, ...) to rows of (a, b, merge, confidence). One call for a novel.
MergeJudge = Callable[[list[dict]], list[dict]]


def bridge_pairs(candidates: DataFrame) -> DataFrame:
    """novel_id, mention, chunk_id, a, b for each two established candidates of a mention in a chunk; candidates: (novel_id, chunk_id, mention, canonical)."""
    rows = candidates.groupBy("novel_id", "chunk_id", "mention").agg(F.sort_array(F.collect_set("canonical")).alias("c"))  # a chunk's few candidates
    pairs = F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return rows.select("novel_id", "mention", "chunk_id", F.explode(pairs).alias("p")).select("novel_id", "mention", "chunk_id", "p.a", "p.b")


def pair_evidence(bridges: DataFrame) -> DataFrame:
    """novel_id, a, b, evidence: the first five of each unordered pair, one for each mention and chunk."""
    rows = bridges.select("novel_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "mention", "chunk_id").distinct()
    w = Window.partitionBy("novel_id", "a", "b").orderBy("chunk_id", "mention")
    few = rows.withColumn("i", F.row_number().over(w)).where(F.col("i") <= EVIDENCE_CAP)
    return few.groupBy("novel_id", "a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "chunk_id", "mention"))), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["mention"].alias("mention"))).alias("evidence"))


def pair_metadata(pairs: DataFrame, canonicals: DataFrame) -> DataFrame:
    """Adds each side's aliases, first chunk, mention count and chapters; canonicals: (novel_id, name, first_seen, mention_count, chapters, aliases).

    A pair of one canonical with itself is an error.
    """
    pairs = pairs.withColumn("a", F.when(F.col("a") == F.col("b"), F.raise_error(F.concat(F.lit("a merge pair has one canonical on both sides: "), "a")).cast("string")).otherwise(F.col("a")))
    for side in ("a", "b"):
        more = canonicals.select("novel_id", F.col("name").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("first_seen", "mention_count", "chapters", "aliases")])
        pairs = pairs.join(more, ["novel_id", side])
    return pairs


def judged(pairs: DataFrame, judge: MergeJudge, replays: DataFrame | None = None, version: str = "") -> DataFrame:
    """novel_id, a, b, merge, confidence, error, fingerprint: the judge's answers, one call for each novel; if it fails, each pair has the error.

    replays: rows of an earlier result; a novel whose pairs and version are the same isn't asked again, unless that call failed.
    """
    names = ["novel_id", "a", "b", "merge", "confidence", "error", "fingerprint"]

    def run(key: tuple, batch: pd.DataFrame, old: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(batch):
            return pd.DataFrame([], columns=names)
        ordered = batch.sort_values(["a", "b"])
        rows, asked = ordered.to_dict("records"), hashlib.sha256((version + ordered.to_json(orient="records", force_ascii=False)).encode()).hexdigest()
        if old is not None and len(known := old[(old["fingerprint"] == asked) & old["error"].isna()]):
            return known[names]
        try:
            got = [(key[0], d["a"], d["b"], bool(d["merge"]), float(d["confidence"]), None, asked) for d in judge(rows)]
        except Exception as e:  # noqa: BLE001  no merges then, and the run goes on
            got = [(key[0], r["a"], r["b"], None, None, f"{type(e).__name__}: {e}", asked) for r in rows]
        return pd.DataFrame(got, columns=names)

    groups = pairs.groupBy("novel_id")
    if replays is None:
        return groups.applyInPandas(lambda key, batch: run(key, batch), ANSWERS)
    return groups.cogroup(replays.select(names).groupBy("novel_id")).applyInPandas(run, ANSWERS)


def decide(pairs: DataFrame, decisions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """novel_id, a, b, outcome: merged, rejected, low_confidence or failed; keep, drop of the merged.

    Only pairs that were asked count, the first answer of each; the canonical seen first, then of least name, is kept.
    pairs: (novel_id, a, b, a_first_seen, b_first_seen), decisions: (novel_id, a, b, merge, confidence, ordinal[, error]).
    """
    answers = decisions.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    answers = answers.withColumn("__i", F.row_number().over(Window.partitionBy("novel_id", "a", "b").orderBy("ordinal"))).where("__i = 1").drop("__i")
    out = pairs.join(answers, ["novel_id", "a", "b"])
    failed = F.col("error").isNotNull() if "error" in decisions.columns else F.lit(False)
    outcome = F.when(failed, "failed").when(~F.col("merge"), "rejected").when(F.col("confidence") < threshold, "low_confidence").otherwise("merged")
    side = lambda f: f(F.struct(F.col("a_first_seen").alias("s"), F.col("a").alias("n")), F.struct(F.col("b_first_seen").alias("s"), F.col("b").alias("n")))["n"]
    out = out.withColumn("outcome", outcome)
    return out.select("novel_id", "a", "b", "ordinal", "outcome", *[F.when(F.col("outcome") == "merged", side(f)).alias(n) for n, f in (("keep", F.least), ("drop", F.greatest))])


def merge_map(decided: DataFrame) -> DataFrame:
    """novel_id, drop, keep; of several decisions on one dropped name the last counts."""
    return decided.where("outcome = 'merged'").groupBy("novel_id", "drop").agg(F.max_by("keep", "ordinal").alias("keep"))


def merge_stats(decided: DataFrame) -> DataFrame:
    count = lambda o: F.count_if(F.col("outcome") == o)
    return decided.groupBy("novel_id").agg(F.count(F.lit(1)).alias("candidate_pairs"), count("merged").alias("merged_pairs"), count("rejected").alias("rejected_pairs"), count("low_confidence").alias("low_confidence_pairs"), count("failed").alias("failed_pairs"))


def roots(merges: DataFrame, materialise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """novel_id, drop, keep with `keep` followed to its end, in a logarithmic number of joins.

    A cycle, which decide() can't make, ends at its least name. `materialise` cuts the lineage between rounds.
    """
    now = materialise(merges.select("novel_id", "drop", "keep", F.least("drop", "keep").alias("least")))
    while True:
        step = now.select("novel_id", F.col("drop").alias("keep"), F.col("keep").alias("far"), F.col("least").alias("least_far"))
        new = now.join(step, ["novel_id", "keep"], "left")
        new = materialise(new.select("novel_id", "drop", "keep", F.coalesce("far", "keep").alias("to"), F.least("least", F.coalesce("least_far", "least")).alias("now_least"), "least"))
        if new.where("keep <> to AND (to <> drop OR now_least <> least)").isEmpty():
            return new.select("novel_id", "drop", F.when(F.col("to") == F.col("drop"), F.col("now_least")).otherwise(F.col("to")).alias("keep")).where("drop <> keep")
        now = new.select("novel_id", "drop", F.col("to").alias("keep"), F.col("now_least").alias("least"))
