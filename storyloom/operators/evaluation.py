"""Declarative checks over a graph snapshot, their stability over runs, and comparison with a baseline.

A checkset is a table of (check_id, kind, a, b, names, others, n, full_corpus, record, all_of, any_of); what a kind
means by a, b, names and others stands at its expression in outcome().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.operators.recall import text_mentions

PASS, FAIL, SKIP, INCONCLUSIVE, OBSERVATION = "PASS", "FAIL", "SKIP", "INCONCLUSIVE", "OBSERVATION"
CHECKS = "check_id string, kind string, a string, b string, names array<string>, others array<string>, n long, full_corpus boolean, record boolean, all_of array<string>, any_of array<string>"
#: persons, labels and the rest of one run, as one row; a null field is one that the run didn't give.
SNAPSHOT = (
    "novel_id string, persons array<struct<name:string,aliases:array<string>>>, labels array<string>, novels_seen array<string>, hits map<string,array<string>>,"
    " counts map<string,bigint>, stats map<string,bigint>, checkpoint_dir boolean, failed_chunks array<int>"
)
CLASSES = ("stable", "variance", "observation")
KINDS = (
    "single_canonical_with_aliases", "aliased_into", "distinct_persons", "alias_search_unique", "count_eq", "person_absent_and_not_alias", "aliases_not_contain", "alias_in_aliases",
    "family_fragments", "fragments_not_independent", "record_stats", "merge_observation", "observation_if_person", "labels_subset", "novel_isolation", "no_checkpoint_dir",
)


def checkset(spark: SparkSession) -> DataFrame:
    """The checks on one novel, second edition; the names and limits are fixed values."""
    fragments, family = ["大儿子", "长子", "次子", "第二个儿子"], ["天保", "傩送", "大老", "二老"]
    rows = [
        ("A1", "single_canonical_with_aliases", None, None, ["傩送", "二老"], ["二老"]), ("A2", "single_canonical_with_aliases", None, None, ["天保", "大老"], ["大老"]),
        ("A3", "aliased_into", "老船夫", "祖父"), ("A4", "aliased_into", "爷爷", "祖父"), ("A5", "distinct_persons", "傩送", "杨马兵"), ("A6", "alias_search_unique", "二老", "傩送"),
        ("A7", "observation_if_person", "老二"), ("B1", "count_eq", "nonbody_canonical_count"), ("B2", "record_stats", None, None, ["nonbody_person_provisional", "nonbody_provisional_dropped", "nonbody_descriptive_dropped"]),
        ("C1", "person_absent_and_not_alias", "父亲"), ("C2", "person_absent_and_not_alias", "翠翠的父亲"), ("C3", "alias_in_aliases", "顺顺", "爹爹"), ("C4", "aliases_not_contain", "顺顺", None, ["父亲", "爸爸"]),
        ("C5", "observation_if_person", "爸爸"), ("D1", "family_fragments", None, None, fragments, family), ("D2", "record_stats", None, None, ["descriptive_resolved", "descriptive_unresolved", "composite_resolved", "composite_unresolved"]),
        ("D3", "fragments_not_independent", None, None, fragments), ("E1", "record_stats", None, None, ["collective_filtered", "generic_filtered", "invalid_filtered"]), ("F1", "merge_observation"),
        ("G1", "labels_subset", None, None, ["Novel", "Person"]), ("G2", "record_stats", None, None, ["persons", "relationships"]), ("G3", "novel_isolation"), ("G4", "record_stats", None, None, ["failed_blocks"]), ("G5", "no_checkpoint_dir"),
    ]
    partial = {"A5", "B1", "C1", "C2", "G1", "G3", "G5"}
    need_all, need_any = {"C1": ["顺顺"], "C3": ["顺顺"], "C4": ["顺顺"]}, {"C2": ["翠翠", "翠翠的父亲"]}
    record = {"record_stats", "merge_observation", "observation_if_person"}
    full = [(*r, *[None] * (6 - len(r)), 0, r[0] not in partial, r[1] in record, need_all.get(r[0]), need_any.get(r[0])) for r in rows]
    return spark.createDataFrame(full, CHECKS)


def problems(checks: DataFrame) -> DataFrame:
    """check_id, problem of a checkset: duplicate ids, unknown kinds, and of columns that it may have too: classes, attributions, layers and preconditions that aren't valid."""
    twice = checks.groupBy("check_id").count().where("count > 1").select("check_id", F.lit("duplicate id").alias("problem"))
    bad = [(F.col("kind").isin(*KINDS), "unknown kind")]
    for column, valid, problem in (
        ("outcome_class", lambda c: c.isin(*CLASSES), "unknown class"), ("attribution", lambda c: c != "", "no attribution"), ("layer", lambda c: c != "", "no layer"),
        ("preconditions", lambda c: F.forall(c, lambda x: x.startswith("person_exists:")), "unknown precondition"),
    ):
        if column in checks.columns:
            bad.append((valid(F.col(column)), problem))
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), problem) for ok, problem in bad]))
    return twice.union(checks.select("check_id", F.explode(found).alias("problem")))


def refusals(checks: DataFrame, content_hash: str | None, pinned_hash: str, checkpoint_on: bool, missing_settings: list[str] = []) -> list[str]:  # noqa: B006
    """Why an evaluation must not start; empty if it may. content_hash: of the corpus, None if there is none."""
    out = [f"setting {x} is missing" for x in missing_settings]
    if checkpoint_on:
        out.append("checkpoints are on: a run that is evaluated starts afresh")
    out += [f"checkset: {r.check_id}: {r.problem}" for r in problems(checks).orderBy("check_id", "problem").collect()]  # a few dozen at most
    if content_hash is None:
        out.append("the corpus is missing")
    elif content_hash != pinned_hash:
        out.append(f"the corpus has changed: {content_hash[:12]} isn't {pinned_hash[:12]}")
    return out


def outcome() -> Column:
    """The outcome of a check on a snapshot, both in one row."""
    people, a, b, names, others = (F.col(c) for c in ("persons", "a", "b", "names", "others"))
    by_name = lambda n: F.filter(people, lambda p: p["name"] == n)
    holds = lambda p, n: (p["name"] == n) | F.array_contains(p["aliases"], n)
    by_mention = lambda n: F.filter(people, lambda p: holds(p, n))
    who = lambda n: F.get(by_mention(n), F.lit(0))
    absorbed = lambda n: F.exists(people, lambda p: F.array_contains(p["aliases"], n))
    verdict = lambda ok: F.when(ok, PASS).otherwise(FAIL)
    unless = lambda missing, then: F.when(missing, SKIP).otherwise(then)
    none = lambda x: F.size(x) == 0

    group = F.filter(people, lambda p: F.exists(names, lambda n: holds(p, n)))
    one = F.get(group, F.lit(0))
    has_all = F.forall(others, lambda n: (n == one["name"]) | F.array_contains(one["aliases"], n))
    hits = F.element_at("hits", a)
    stray = lambda f: (who(f)["name"] == f) | ~F.array_contains(others, who(f)["name"])
    fragments_ok = F.forall(names, lambda f: none(by_mention(f)) | ~stray(f))
    stats = F.col("stats")
    stat = lambda k: F.coalesce(F.element_at(stats, F.lit(k)), F.lit(0))
    kinds = {
        "single_canonical_with_aliases": unless(none(group), verdict((F.size(F.array_distinct(F.transform(group, lambda p: p["name"]))) == 1) & has_all)),  # names: one person; others: its aliases
        "aliased_into": unless(none(by_mention(b)), verdict(none(by_name(a)) & F.array_contains(who(b)["aliases"], a))),  # a: alias, b: target
        "distinct_persons": unless(none(by_mention(a)) | none(by_mention(b)), verdict(who(a)["name"] != who(b)["name"])),
        "alias_search_unique": unless(hits.isNull(), verdict(F.coalesce(hits == F.array(b), F.lit(False)))),  # a: query, b: the one hit
        "count_eq": unless(F.element_at("counts", a).isNull(), verdict(F.element_at("counts", a) == F.col("n"))),  # a: key
        "person_absent_and_not_alias": verdict(none(by_name(a)) & ~absorbed(a)),
        "aliases_not_contain": unless(none(by_mention(a)), verdict(~F.arrays_overlap(who(a)["aliases"], names))),
        "alias_in_aliases": unless(none(by_mention(a)), verdict(F.array_contains(who(a)["aliases"], b))),
        "family_fragments": unless(~F.exists(others, lambda m: F.size(by_mention(m)) > 0), verdict(fragments_ok)),  # names: fragments, others: family
        "fragments_not_independent": verdict(F.forall(names, lambda f: none(by_name(f)))),
        "record_stats": unless(F.forall(names, lambda k: F.element_at(stats, k).isNull()), F.lit(OBSERVATION)),
        "merge_observation": unless(F.element_at(stats, F.lit("merge_candidate_pairs")).isNull(), F.when((stat("merge_candidate_pairs") > 0) & (stat("failed_pairs") >= stat("merge_candidate_pairs")), INCONCLUSIVE).otherwise(OBSERVATION)),
        "observation_if_person": F.lit(OBSERVATION),
        "labels_subset": unless(F.col("labels").isNull(), verdict(none(F.array_except("labels", names)))),
        "novel_isolation": unless(F.col("novels_seen").isNull(), verdict(F.forall("novels_seen", lambda x: x == F.col("novel_id")))),
        "no_checkpoint_dir": unless(F.col("checkpoint_dir").isNull(), verdict(~F.col("checkpoint_dir"))),
    }
    out = F.lit(INCONCLUSIVE)
    for kind, x in kinds.items():
        out = F.when(F.col("kind") == kind, x).otherwise(out)
    met = F.coalesce(F.forall("all_of", lambda n: F.size(by_mention(n)) > 0), F.lit(True)) & F.coalesce(F.exists("any_of", lambda n: F.size(by_mention(n)) > 0), F.lit(True))
    blind = F.col("full_corpus") & ~F.col("record") & (F.coalesce(F.size("failed_chunks"), F.lit(0)) > 0)
    return F.when(blind, INCONCLUSIVE).when(~met, SKIP).otherwise(out)


def evaluate(checks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """novel_id, check_id, outcome of every check on every snapshot. Checks are a few dozen rows: at most 10,000 are broadcast."""
    if checks.limit(10_001).count() > 10_000:
        raise ValueError("a checkset has at most 10,000 checks")
    return snapshots.join(F.broadcast(checks), F.lit(True)).select("novel_id", "check_id", outcome().alias("outcome"))


def stability(outcomes: DataFrame) -> DataFrame:
    """check_id, decisive, passes, fails, runs, classification, satisfies_expected. outcomes: (run_id, check_id, outcome)."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    out = outcomes.groupBy("check_id").agg(n(PASS).alias("passes"), n(FAIL).alias("fails"), F.count(F.lit(1)).alias("runs"))
    out = out.withColumn("decisive", F.col("passes") + F.col("fails"))
    stable = (F.col("passes") == 0) | (F.col("fails") == 0)
    out = out.withColumn("classification", F.when(F.col("decisive") < 2, "unclassified").when(stable, "stable").otherwise("variance"))
    return out.withColumn("satisfies_expected", F.when(F.col("classification") == "stable", F.col("fails") == 0))


def distribution(outcomes: DataFrame) -> DataFrame:
    """check_id, distribution: outcomes and how often each came, as a map."""
    each = outcomes.groupBy("check_id", "outcome").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("check_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("distribution"))


def baseline_status(stable: DataFrame) -> DataFrame:
    failing = F.coalesce(F.bool_or((F.col("classification") == "stable") & ~F.col("satisfies_expected")), F.lit(False))
    return stable.agg(F.when(failing, "INVALID_NOT_REGRESSION_SAFE").otherwise("VALID").alias("status"))


def same_identity(runs: DataFrame, fields: list[str]) -> bool:
    """Whether all runs agree in the fields that make them comparable."""
    return runs.select(*fields).distinct().limit(2).count() <= 1


def aggregate(outcomes: DataFrame, runs: DataFrame, fields: list[str]) -> DataFrame:
    """A baseline: a row for each check with its stability, its outcomes, what is doubtful, and the status of the whole.

    outcomes: (run_id, check_id, outcome), of which a run's last by check counts if there is an `ordinal`; runs: (run_id, *fields).
    Runs that differ in `fields` can't be one baseline.
    """
    if runs.isEmpty() or not same_identity(runs, fields):
        raise ValueError("a baseline needs runs that agree in what makes them comparable")
    if "ordinal" in outcomes.columns:
        outcomes = outcomes.groupBy("run_id", "check_id").agg(F.max_by("outcome", "ordinal").alias("outcome"))
    stable = stability(outcomes)
    lone = (F.col("classification") == "unclassified") & (F.col("decisive") == 1) & (F.col("fails") == 1)
    out = stable.join(distribution(outcomes), "check_id").withColumn("note", F.when(lone, "one decisive outcome, which failed: too few runs to call it stable"))
    return out.join(baseline_status(stable).withColumnRenamed("status", "baseline_status"), F.lit(True))  # one row


def quality(baseline: DataFrame) -> DataFrame:
    """checks by classification, and stable failures, of aggregate()."""
    n = lambda c: F.count_if(F.col("classification") == c)
    return baseline.agg(n("stable").alias("stable"), F.count_if((F.col("classification") == "stable") & ~F.col("satisfies_expected")).alias("stable_failures"), n("variance").alias("variance"), n("unclassified").alias("unclassified"))


def compare(run: DataFrame, baseline: DataFrame, same: bool = True, valid: bool = True) -> DataFrame:
    """check_id, outcome, verdict, drift of one run against a baseline (stability())."""
    if not same or not valid:
        return run.select("check_id", "outcome", F.lit("REFUSE_COMPARE").alias("verdict"), F.lit(False).alias("drift"))
    out = run.join(baseline, "check_id", "left")
    undecided = ~F.col("outcome").isin(PASS, FAIL)
    quiet = F.col("outcome").isin(SKIP, INCONCLUSIVE)
    verdict = F.when(quiet, F.col("outcome")).when(F.col("classification") == "stable", F.when(F.col("outcome") == PASS, PASS).otherwise("REGRESSION")).otherwise(OBSERVATION)
    majority = F.when(F.col("passes") + F.col("fails") > 0, F.when(F.col("passes") >= F.col("fails"), PASS).otherwise(FAIL))
    drift = ~undecided & (F.coalesce(F.col("classification"), F.lit("")) != "stable") & (F.col("outcome") != majority)
    return out.select("check_id", "outcome", verdict.alias("verdict"), F.coalesce(drift, F.lit(False)).alias("drift"))


def snapshot(people: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Persons and relations without ids, lists sorted, confidence to six places."""
    p = people.select("novel_id", "name", F.sort_array("aliases").alias("aliases"), "mention_count", F.sort_array("chapters").alias("chapters"))
    return p, edges.select("novel_id", "source", "target", "type", "weight", F.round("confidence", 6).alias("confidence"))


def nonbody_canonicals(people: DataFrame, chapters: DataFrame) -> DataFrame:
    """novel_id, name of persons with chapters, none of which is body."""
    each = people.select("novel_id", "name", F.explode("chapters").alias("chapter_id")).join(chapters.select("novel_id", "chapter_id", "section_type"), ["novel_id", "chapter_id"], "left")
    return each.groupBy("novel_id", "name").agg(F.coalesce(F.bool_or(F.col("section_type") == "body"), F.lit(False)).alias("body")).where("NOT body").select("novel_id", "name")


def alias_contexts(chunks: DataFrame, names: DataFrame, width: int = 40, most: int = 5) -> DataFrame:
    """novel_id, name, alias, chunk_id, start, context: occurrences left to right without overlap, the first `most` of each alias.

    names: (novel_id, name, alias). Only chunks that have the alias, as text recall finds them, are split at it.
    """
    names = names.where("alias <> ''")
    found = text_mentions(chunks, names.select("novel_id", F.col("alias").alias("canonical"), F.col("alias").alias("name")))
    hits = found.withColumnRenamed("canonical", "alias").join(names, ["novel_id", "alias"]).join(chunks.select("novel_id", "chunk_id", "text"), ["novel_id", "chunk_id"])
    parts = F.split("text", F.concat(F.lit(r"\Q"), F.col("alias"), F.lit(r"\E")), -1)
    starts = F.slice(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.aggregate(F.slice("parts", F.lit(1), k), F.lit(0), lambda s, p: s + F.length(p)) + (k - 1) * F.length("alias")), F.lit(1), F.size("parts") - 1)
    hits = hits.withColumn("parts", F.slice(parts, 1, most + 1))  # later ones can't be among the first
    hits = hits.select("novel_id", "name", "alias", "chunk_id", "text", F.explode(starts).alias("start"))
    w = Window.partitionBy("novel_id", "name", "alias").orderBy("chunk_id", "start")
    few = hits.withColumn("i", F.row_number().over(w)).where(F.col("i") <= most)
    begin = F.greatest(F.col("start") - width, F.lit(0))
    context = F.substring("text", begin + 1, F.col("start") + F.length("alias") + width - begin)
    return few.select("novel_id", "name", "alias", "chunk_id", "start", context.alias("context"))


def histogram(outcomes: DataFrame) -> DataFrame:
    """A column for each outcome, zero where none came."""
    return outcomes.groupBy().pivot("outcome", [PASS, FAIL, SKIP, INCONCLUSIVE, OBSERVATION]).count().na.fill(0)


def upper_median(calls: DataFrame, bounds: DataFrame, levels: int = 3, parts: int = 1000) -> DataFrame:
    """stage, median: the value of rank floor(n / 2) + 1. bounds: (stage, n, least, most).

    Counts by parts of the range from the least to the greatest value find the part that has it, which is cut into parts again;
    after `levels` of these one part's different values are ordered. So no task gets all values of a stage.
    """
    rows = calls.join(bounds.select("stage", F.col("least").alias("low"), F.col("most").alias("high"), (F.floor(F.col("n") / 2) + 1).alias("rank")), "stage")
    for _ in range(levels):
        wide = F.col("high") > F.col("low")
        part = F.when(wide, F.least(F.lit(parts - 1), F.floor((F.col("seconds") - F.col("low")) / (F.col("high") - F.col("low")) * parts))).otherwise(0)
        rows = rows.withColumn("part", part.cast("int"))
        each = rows.groupBy("stage", "part").agg(F.count(F.lit(1)).alias("c"), F.min("seconds").alias("part_low"), F.max("seconds").alias("part_high"), F.first("rank").alias("r"))
        upto = F.sum("c").over(Window.partitionBy("stage").orderBy("part"))  # at most `parts` rows
        here = each.withColumn("upto", upto).where("upto >= r AND upto - c < r").select("stage", "part", "part_low", "part_high", (F.col("r") - F.col("upto") + F.col("c")).alias("inner"))
        rows = rows.join(here, ["stage", "part"]).select("stage", "seconds", F.col("part_low").alias("low"), F.col("part_high").alias("high"), F.col("inner").alias("rank"))
    each = rows.groupBy("stage", "seconds").agg(F.count(F.lit(1)).alias("c"), F.first("rank").alias("rank"))
    upto = F.sum("c").over(Window.partitionBy("stage").orderBy("seconds"))
    return each.withColumn("upto", upto).where("upto >= rank AND upto - c < rank").select("stage", F.col("seconds").alias("median"))


def stage_profile(calls: DataFrame) -> DataFrame:
    """stage, n, total, least, median (the upper one), most, share of the whole. calls: (stage, seconds)."""
    total = calls.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("total"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))
    whole = total.agg(F.sum("total").alias("whole"))
    out = total.join(upper_median(calls, total), "stage").join(F.broadcast(whole), F.lit(True))  # one row
    return out.select("stage", "n", F.round("total", 6).alias("total"), "least", "median", "most", F.round(F.col("total") / F.col("whole"), 6).alias("share"))


def report(rows: list[dict], title: str) -> str:
    """A Markdown table of collected check rows."""
    if not rows:
        return f"# {title}\n\nno checks\n"
    head = list(rows[0])
    body = "\n".join("| " + " | ".join("" if r[h] is None else str(r[h]) for h in head) + " |" for r in rows)
    return f"# {title}\n\n| {' | '.join(head)} |\n|{'-|' * len(head)}\n{body}\n"


def rows_of(df: DataFrame, *order: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]  # a checkset's few dozen rows


def run_report(outcomes: DataFrame, checks: DataFrame, environment: dict[str, object]) -> str:
    """One run: where it ran, how many checks ended how, and each check with its group."""
    counts = histogram(outcomes).first().asDict()
    each = outcomes.join(checks.select("check_id", "kind", F.substring("check_id", 1, 1).alias("group")), "check_id", "left").select("check_id", "group", "kind", "outcome")
    env = report([{"setting": k, "value": v} for k, v in environment.items()], "Environment")
    return f"{report([counts], 'Run')}\n{env}\n{report(rows_of(each, 'check_id'), 'Checks')}"


def baseline_report(baseline: DataFrame, identity: dict[str, object]) -> str:
    """A baseline: its status, what its runs have in common, and each check."""
    status = baseline.select("baseline_status").first()
    head = report([{"status": status[0] if status else None} | identity | quality(baseline).first().asDict()], "Baseline")
    return f"{head}\n{report(rows_of(baseline.select('check_id', 'classification', 'satisfies_expected', 'distribution', 'note'), 'check_id'), 'Checks')}"


def compare_report(compared: DataFrame) -> str:
    """A comparison: regressions first, then the rest."""
    rows = rows_of(compared, "check_id")
    worse = [r for r in rows if r["verdict"] == "REGRESSION"]
    refused = bool(rows) and all(r["verdict"] == "REFUSE_COMPARE" for r in rows)
    verdict = "REFUSE_COMPARE" if refused else "REGRESSION" if worse else "OK"
    return f"# Comparison: {verdict}\n\n{report(worse, 'Regressions')}\n{report([r for r in rows if r not in worse], 'Other checks')}"
