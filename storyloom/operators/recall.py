"""Candidates for a mention: canonicals that its chunk shows, then the most alike of the others."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from storyloom.functions.text import OF, hard_filtered
from storyloom.operators.alike import NameIndex

TOP_K = 5


def known_in_extraction(names: DataFrame, known: DataFrame, provisional: DataFrame) -> DataFrame:
    """novel_id, chunk_id, canonical of the chunk's names that are known; names: (novel_id, chunk_id, name), known: (novel_id, name, canonical)."""
    found = names.where(~hard_filtered(F.col("name"))).join(known, ["novel_id", "name"]).select("novel_id", "chunk_id", "canonical")
    found = found.where(~hard_filtered(F.col("canonical"))).distinct()
    return found.join(provisional.select("novel_id", F.col("name").alias("canonical")), ["novel_id", "canonical"], "left_anti").select("novel_id", "chunk_id", "canonical")


def brought_together(rows: DataFrame, size: Column, index: DataFrame, most_rows: int, most_names: int) -> tuple[GroupedData, GroupedData]:
    """Both in groups of (novel, block, shard): blocks of a novel's rows of about `most_rows` in the sum of `size`, shards of its index of about `most_names` names.

    A canonical's names are in one shard. Each block meets each shard of its novel in a group of its own, so neither a large
    novel nor a large index ends up in one task; rows of novels without an index, and the other way round, are left out.
    """
    sizes = rows.groupBy("novel_id").agg(F.ceil(F.sum(size) / most_rows).cast("int").alias("__blocks"))
    sizes = sizes.join(index.groupBy("novel_id").agg(F.ceil(F.count(F.lit(1)) / most_names).cast("int").alias("__shards")), "novel_id")
    sizes = sizes.select("novel_id", F.greatest("__blocks", F.lit(1)).alias("__blocks"), F.greatest("__shards", F.lit(1)).alias("__shards"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    piece = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    by_row = [c for c in rows.columns if c not in ("novel_id", "text")]
    left = rows.join(sizes, "novel_id").withColumn("__block", piece("__blocks", *by_row)).withColumn("__shard", every("__shards"))
    right = index.join(sizes, "novel_id").withColumn("__shard", piece("__shards", "canonical")).withColumn("__block", every("__blocks"))
    own = lambda x: x.select(*[F.col(c).alias(c) for c in x.columns if c not in ("__blocks", "__shards")])  # noqa: E731  both may come from one table
    return tuple(own(x).groupBy("novel_id", "__block", "__shard") for x in (left, right))


def names_of(index: pa.Table) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for canonical, name in zip(index["canonical"].to_pylist(), index["name"].to_pylist(), strict=True):
        out.setdefault(canonical, []).append(name)
    return out


def text_mentions(chunks: DataFrame, index: DataFrame, most_chars: int = 4_000_000, most_names: int = 100_000) -> DataFrame:
    """novel_id, chunk_id, canonical of the canonicals with a name in the text; index: (novel_id, canonical, name).

    Each group of a novel's texts is read once by an automaton of the names that it meets, whatever the size of texts and index.
    """
    index = index.where("name <> ''").select("novel_id", "canonical", "name").distinct()
    src = chunks.where("text <> ''").select("novel_id", "chunk_id", "text")

    def run(texts: pa.Table, names: pa.Table) -> pa.Table:
        of: dict[str, list[str]] = {}
        for canonical, own in names_of(names).items():
            for name in own:
                of.setdefault(name, []).append(canonical)
        automaton = ahocorasick.Automaton()
        for name, canonicals in of.items():
            automaton.add_word(name, canonicals)
        automaton.make_automaton()
        rows, found = [], []
        for i, text in enumerate(texts["text"].to_pylist() if of else ()):
            here = {c for _, canonicals in automaton.iter(text) for c in canonicals}
            rows += [i] * len(here)
            found += here
        at = pa.array(rows, pa.int64())
        return pa.table({"novel_id": texts["novel_id"].take(at), "chunk_id": texts["chunk_id"].take(at), "canonical": pa.array(found, pa.string())})

    left, right = brought_together(src, F.length("text"), index, most_chars, most_names)
    return left.cogroup(right).applyInArrow(run, src.select("novel_id", "chunk_id", F.lit("").alias("canonical")).schema)


def weak_candidates(mentions: DataFrame, index: DataFrame, k: int, most_mentions: int = 4_000, most_names: int = 50_000) -> DataFrame:
    """novel_id, mention, canonical, matched_names, o: for each mention the first k of its novel's canonicals by likeness (see NameIndex), numbered from 1.

    mentions: (novel_id, mention), each once; index: (novel_id, canonical, name). Each shard of an index gives its own first k, of which the first k count.
    """

    def run(asked: pa.Table, names: pa.Table) -> pa.Table:
        of, alike = names_of(names), NameIndex()
        for canonical, own in of.items():
            own.sort()
            for name in own:
                alike.add(canonical, name)
        novel, rows = (asked if len(asked) else names)["novel_id"][0].as_py(), []
        for m in asked["mention"].to_pylist() if of else ():
            rows += [(novel, m, c, of[c], part, n) for c, part, n in alike.most_alike(m, k)]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=fields)

    fields, types = ["novel_id", "mention", "canonical", "matched_names", "part", "shared"], [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.int32()]
    left, right = brought_together(mentions, F.lit(1), index.select("novel_id", "canonical", "name"), most_mentions, most_names)
    out = left.cogroup(right).applyInArrow(run, "novel_id string, mention string, canonical string, matched_names array<string>, part boolean, shared int")
    o = F.row_number().over(Window.partitionBy("novel_id", "mention").orderBy(F.desc("part"), F.desc("shared"), "canonical"))
    return out.withColumn("o", o).where(F.col("o") <= k).drop("part", "shared")


def candidates(mentions: DataFrame, index: DataFrame, extraction: DataFrame, text: DataFrame, k: int = TOP_K) -> DataFrame:
    """novel_id, chunk_id, mention, canonical, rank, source, matched_names.

    All strong candidates, those of the extraction before those of the text, by name within each; weak ones fill up to
    `k` by substring, shared characters, name. mentions: (novel_id, chunk_id, mention).
    """
    key = ["novel_id", "chunk_id", "mention"]
    names = index.groupBy("novel_id", "canonical").agg(F.sort_array(F.collect_set("name")).alias("matched_names")).where(~hard_filtered(F.col("canonical")))
    tiers = extraction.withColumn("tier", F.lit(0)).union(text.withColumn("tier", F.lit(1))).groupBy("novel_id", "chunk_id", "canonical").agg(F.min("tier").alias("tier"))
    # a chunk's candidates in their order, once for all its mentions: rows of mentions and candidates aren't dealt out again
    own = tiers.join(names, ["novel_id", "canonical"]).groupBy("novel_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("tier", "canonical", "matched_names"))).alias("own"))
    held = mentions.select(*key).join(own, ["novel_id", "chunk_id"], "left").withColumn("own", F.filter(F.coalesce("own", F.array()), lambda x: x["canonical"] != F.col("mention")))
    strong = held.select(*key, F.posexplode("own").alias("i", "x")).select(*key, "x.*", (F.col("i") + 1).alias("rank"))
    # only mentions that lack candidates are held against the canonicals of their novel, each different one once
    open_ = held.where(F.size("own") < k).select(*key, F.transform("own", lambda x: x["canonical"]).alias("had"))
    # fewer than k are strong, so those that fill up are among the first 2 k
    usable = index.where(F.col("name").isNotNull() & ~hard_filtered(F.col("canonical"))).select("novel_id", "canonical", "name").distinct()
    weak = weak_candidates(open_.select("novel_id", "mention").distinct(), usable, 2 * k)
    lists = weak.groupBy("novel_id", "mention").agg(F.array_sort(F.collect_list(F.struct("o", "canonical", "matched_names"))).alias("all"))
    fill = F.slice(F.filter("all", lambda x: ~F.array_contains("had", x["canonical"])), F.lit(1), k - F.size("had"))
    weak = open_.join(lists, ["novel_id", "mention"]).select(*key, F.size("had").alias("n"), F.posexplode(fill).alias("i", "x"))
    weak = weak.select(*key, "x.canonical", "x.matched_names", F.lit(2).alias("tier"), (F.col("n") + F.col("i") + 1).alias("rank"))
    source = F.when(F.col("tier") == 0, "strong_extraction").when(F.col("tier") == 1, "strong_text").otherwise("weak")
    columns = [*key, "canonical", "rank", source.alias("source"), "matched_names"]
    return strong.select(columns).union(weak.select(columns))


def role_mentions(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """mention, kind, by_of, anchor, head against a stated set of known names: each beginning of a mention meets it by an equi-join."""
    m = mentions.select("mention", F.regexp_extract("mention", OF, 1).alias("x"), F.regexp_extract("mention", OF, 2).alias("y"), (F.col("mention").rlike(OF)).alias("by_of"))
    begins = m.where(F.length("mention") > 2).select("mention", F.explode(F.sequence(F.lit(2), F.length("mention") - 1)).alias("n"))
    begins = begins.withColumn("name", F.substring("mention", F.lit(1), F.col("n"))).join(known, "name").groupBy("mention").agg(F.max_by("canonical", "n").alias("who"), F.max("n").alias("n"))
    out = m.join(begins, "mention", "left").join(known.select(F.col("name").alias("x"), F.col("canonical").alias("of_who")), "x", "left")
    kind = F.when(F.col("by_of") | F.col("who").isNotNull(), "qualified").otherwise("bare")
    head = F.when(F.col("by_of"), F.col("y")).when(F.col("who").isNotNull(), F.substring("mention", F.col("n") + 1, F.lit(100)))
    return out.select("mention", kind.alias("kind"), "by_of", F.when(F.col("by_of"), F.col("of_who")).otherwise(F.col("who")).alias("anchor"), head.alias("head"))
