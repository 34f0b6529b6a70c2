"""Resolved mentions and relations to a graph of persons and weighted, directed, typed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVIDENCE_CAP = 5
KEY = ["novel_id", "source", "target", "type"]


def person_chunks(mentions: DataFrame) -> DataFrame:
    """novel_id, name, chunk_id, each once: the chunk sets of persons, as rows."""
    return mentions.select("novel_id", "name", "chunk_id").distinct()


def persons(mentions: DataFrame, lists: bool = True) -> DataFrame:
    """From characters only; mention_count is the number of distinct chunks. mentions: (novel_id, chunk_id, chapter_id, name).

    lists: with chunk_ids, an array as long as the person has chunks. Without, chunk sets stay rows (person_chunks()), and
    merge_persons() counts them as such.
    """
    chapters = [F.sort_array(F.collect_set("chapter_id")).alias("chapters")]
    if lists:  # counted by the set itself: a distinct count beside sets would send a set for each row
        once = mentions.select("novel_id", "name", "chapter_id", "chunk_id").distinct()
        out = once.groupBy("novel_id", "name").agg(*chapters, F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"))
        return out.select("novel_id", "name", F.size("chunk_ids").cast("long").alias("mention_count"), "chapters", "chunk_ids")
    slim = mentions.groupBy("novel_id", "name", "chunk_id").agg(F.min("chapter_id").alias("chapter_id"))  # a chunk has one chapter
    return slim.groupBy("novel_id", "name").agg(F.count("chunk_id").alias("mention_count"), *chapters)


def first_in_chunk(relations: DataFrame) -> DataFrame:
    """One row for each key and chunk, the first by ordinal, of equal ones by what else they have, so that it doesn't hang on how rows are dealt out; self-loops go.

    A column `row`, where there is one, is the rows' order in their table, and decides first among equal ordinals.
    """
    w = Window.partitionBy(*KEY, "chunk_id").orderBy("ordinal", *[c for c in ("row", "chapter_id", "confidence", "text") if c in relations.columns])
    return relations.where("source <> target").withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i")


def first_evidence(order: list[str], fields: list[str]) -> Column:
    """The first EVIDENCE_CAP of a group in the order, as structs."""
    kept = F.slice(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))), 1, EVIDENCE_CAP)
    return F.transform(kept, lambda x: F.struct(*[x[f].alias(f) for f in fields]))


def ranked_evidence(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """At most EVIDENCE_CAP rows of each key, before anything is gathered: a common relation has many."""
    return rows.withColumn("__i", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__i") <= EVIDENCE_CAP).drop("__i")


def relation_chunks(rows: DataFrame) -> DataFrame:
    """novel_id, source, target, type, chunk_id, each once: the chunk sets of relations, as rows."""
    return rows.where("source <> target").select(*KEY, "chunk_id").distinct()


def relations(rows: DataFrame, lists: bool = True, firsts: bool = False) -> DataFrame:
    """weight (distinct chunks), confidence (mean over chunks of each chunk's first), chunk_ids, evidence (first five chunks).

    rows: (novel_id, chunk_id, chapter_id, ordinal, source, target, type, confidence[, text]). lists as in persons(): without
    chunk_ids, relation_chunks() has them. firsts: rows are those of first_in_chunk() already, written once as they're read twice.
    """
    once = rows if firsts else first_in_chunk(rows)
    total = once.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("weight"), F.avg("confidence").alias("confidence"), *[F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids")] * lists,
        F.min(F.struct("chunk_id", "ordinal")).alias("first_seen"),
    )
    fields = ["chunk_id", "chapter_id"] + ["text"] * ("text" in rows.columns)
    few = ranked_evidence(once, KEY, ["chunk_id"]).groupBy(*KEY).agg(first_evidence(["chunk_id"], fields).alias("evidence"))
    return total.join(few, KEY)


def apply_aliases(people: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds aliases in their order of first confirmation, without the canonical; aliases: (novel_id, canonical, alias, ordinal)."""
    once = aliases.where("alias <> canonical").groupBy("novel_id", "canonical", "alias").agg(F.min("ordinal").alias("ordinal"))
    lists = once.groupBy("novel_id", F.col("canonical").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "alias"))), lambda x: x["alias"]).alias("aliases"))
    return people.join(lists, ["novel_id", "name"], "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def valid_merges(people: DataFrame, merges: DataFrame) -> DataFrame:
    """novel_id, drop, keep of the merges whose two ends exist."""
    ends = people.select("novel_id", "name")
    return merges.where("drop <> keep").join(ends.withColumnRenamed("name", "drop"), ["novel_id", "drop"]).join(ends.withColumnRenamed("name", "keep"), ["novel_id", "keep"]).select("novel_id", "drop", "keep")


def redirected(rows: DataFrame, merges: DataFrame, *ends: str) -> DataFrame:
    """rows with the kept name in place of each dropped one in the given columns. merges are to roots."""
    for end in ends:
        to = merges.select("novel_id", F.col("drop").alias(end), F.col("keep").alias("__keep"))
        rows = rows.join(to, ["novel_id", end], "left").withColumn(end, F.coalesce("__keep", end)).drop("__keep")
    return rows


def merge_person_chunks(chunks: DataFrame, merges: DataFrame) -> DataFrame:
    """person_chunks() after the merges."""
    return redirected(chunks, merges, "name").select("novel_id", "name", "chunk_id").distinct()


def merge_relation_chunks(chunks: DataFrame, merges: DataFrame) -> DataFrame:
    """relation_chunks() after the merges; self-loops go."""
    return redirected(chunks, merges, "source", "target").where("source <> target").select(*KEY, "chunk_id").distinct()


def counted_chunks(out: DataFrame, chunks: DataFrame, key: list[str], count: str) -> DataFrame:
    return out.join(chunks.groupBy(*key).agg(F.count(F.lit(1)).alias(count)), key, "left").na.fill(0, [count])


def merge_persons(people: DataFrame, merges: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Chunks and chapters are united; aliases: the kept person's, then those of each dropped one and its name. merges are to roots.

    chunks: merge_person_chunks() of people without chunk_ids, whose rows are counted.
    """
    merges = valid_merges(people, merges)
    rows = people.join(merges.withColumnRenamed("drop", "name"), ["novel_id", "name"], "left")
    rows = rows.withColumns({"to": F.coalesce("keep", "name"), "moved": F.col("keep").isNotNull()})
    names = F.when(F.col("moved"), F.concat("aliases", F.array("name"))).otherwise(F.col("aliases"))
    merged = rows.groupBy("novel_id", F.col("to").alias("name")).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("chapters")))).alias("chapters"), *[F.sort_array(F.array_distinct(F.flatten(F.collect_list("chunk_ids")))).alias("chunk_ids")] * (chunks is None),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("moved", "name", names.alias("n")))), lambda x: x["n"])).alias("names"),
    )
    names = F.array_remove(F.array_distinct("names"), F.col("name")).alias("aliases")
    if chunks is not None:
        return counted_chunks(merged.select("novel_id", "name", "chapters", names), chunks, ["novel_id", "name"], "mention_count")
    return merged.select("novel_id", "name", F.size("chunk_ids").cast("long").alias("mention_count"), "chapters", "chunk_ids", names)


def merge_relations(edges: DataFrame, merges: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Ends are redirected, self-loops go, equal keys are joined: chunks united, confidences pooled, evidence in order of first discovery, five at most.

    chunks: merge_relation_chunks() of edges without chunk_ids, whose rows are counted.
    """
    edges = redirected(edges, merges, "source", "target").where("source <> target")
    total = edges.groupBy(*KEY).agg(
        *[F.sort_array(F.array_distinct(F.flatten(F.collect_list("chunk_ids")))).alias("chunk_ids")] * (chunks is None), (F.sum(F.col("confidence") * F.col("weight")) / F.sum("weight")).alias("confidence"),
        F.min("first_seen").alias("first_seen"),
    )
    proof = edges.select(*KEY, "first_seen", F.posexplode("evidence").alias("pos", "e"))
    few = ranked_evidence(proof, KEY, ["first_seen", "pos"]).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("first_seen", "pos", "e"))), lambda x: x["e"]).alias("evidence"))
    out = total.join(few, KEY)
    return out.withColumn("weight", F.size("chunk_ids").cast("long")) if chunks is None else counted_chunks(out, chunks, KEY, "weight")


def drop_unconfirmed(people: DataFrame, edges: DataFrame, dropped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the dropped names (novel_id, name) and the edges at them."""
    gone = lambda c: dropped.select("novel_id", F.col("name").alias(c))
    return people.join(gone("name"), ["novel_id", "name"], "left_anti"), edges.join(gone("source"), ["novel_id", "source"], "left_anti").join(gone("target"), ["novel_id", "target"], "left_anti")


def stored_relations(edges: DataFrame, people: DataFrame) -> DataFrame:
    """The edges whose two ends are persons."""
    for end in ("source", "target"):
        edges = edges.join(people.select("novel_id", F.col("name").alias(end)), ["novel_id", end], "left_semi")
    return edges
