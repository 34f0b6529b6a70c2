"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

Each document has an exponential key scaled by its quality weight. In key order the documents of a
source fill what its target leaves after complete epochs. Sums over buckets of keys find where a
source's budget ends: first over buckets of the key's logarithm, which weights of any size only move
along, then over parts of the bucket in which the budget ends, about as many as the square root of the
rows; only one such part is sorted. The document in which the budget ends is taken in part.

Rows: null and empty texts have no words, are of size 0 and never taken; a null source is a source,
the last one; repeated rows have equal keys and are taken alike, sharing what is left at the
budget's end; an empty table gives an empty table; other columns of the input are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import words, written
from storyloom.llm.host_rules import n_symbols


#: Buckets for a doubling of the key: the fullest has less than a hundredth of a source's rows of one weight.
OCTAVE = 64


def quality_weight(text: Column) -> Column:
    """1 for plain prose, less with its share of symbols, 0.05 at least: what DataFrame functions alone can say; mix() takes any other weight."""
    text = F.coalesce(text, F.lit(""))
    return F.greatest(F.lit(0.05), 1 - 4 * n_symbols(text) / F.greatest(F.length(text), F.lit(1)))


def sampling_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, with u from a keyed hash of doc_id in (0, 1)."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 1) / (2.0**52 + 1)
    return -F.log(u) / weight


def ranked(df: DataFrame, order: Column) -> DataFrame:
    """df with `rank` from 0 in the order; by ranges, so that no task gets all rows."""
    parts = df.repartitionByRange(order).sortWithinPartitions(order)
    parts = written(parts.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__i")))
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return parts.join(before, "__p").withColumn("rank", F.col("__b") + F.col("__i")).drop("__p", "__i", "__b", "__n")


def targets(sizes: DataFrame, share: float, weights: tuple[int, ...], most: float) -> DataFrame:
    """source, source_size, target: shares by weight, none above `most` times the source's size, the excess shared anew."""
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    table = written(ranked(sizes, F.col("source").asc_nulls_last()).withColumn("weight", weight.cast("double")).drop("rank"))
    cap = most * F.col("source_size")
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # the level only rises, and each round but the last caps a source
        full = cap <= level * F.col("weight")
        capped, free = table.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if not free or (total - capped) / free <= level * (1 + 1e-15):
            break
        level = (total - capped) / free
    return table.withColumn("target", F.round(F.least(cap, level * F.col("weight")), 6)).drop("weight")


def sources_end(rows: DataFrame, plan: DataFrame, bucket: Column) -> DataFrame:
    """e_source, e_bucket, before, budget: the bucket in which each source's budget ends and what those before it hold. plan: (source, budget)."""
    sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
    running = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s, p = sums.withColumn("before", running).alias("s"), plan.alias("p")
    ends = s.join(p, F.col("s.source").eqNullSafe(F.col("p.source"))).where("before <= budget AND budget < before + size AND budget > 0")
    return written(ends.select(F.col("s.source").alias("e_source"), F.col("bucket").alias("e_bucket"), "before", "budget"))  # a row for each source


def rows_at(rows: DataFrame, ends: DataFrame, bucket: Column) -> DataFrame:
    """The rows of the buckets in which budgets end, with `before` and `budget`."""
    found = rows.withColumn("bucket", bucket).join(ends, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("bucket") == F.col("e_bucket")))
    return found.drop("e_source", "e_bucket")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: float = 2.0, seed: str = "mix", weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (complete), part (words of one more copy), taken, text_hash.

    weight: a positive column of docs, such as a joined score of the quality classifier; null counts as 0.05, as does less.
    """
    size = F.size(words(F.col("text"))).cast("long")
    weight = quality_weight(F.col("text")) if weight is None else F.greatest(F.lit(0.05), F.coalesce(weight.cast("double"), F.lit(0.05)))
    rows = docs.select("doc_id", "source", size.alias("size"), weight.alias("weight"), F.xxhash64("text").alias("h"))
    rows = rows.select("doc_id", "source", "size", F.struct(sampling_key(F.col("doc_id"), F.col("weight"), seed).alias("key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "h").alias("place"))
    rows = written(rows)  # no texts
    per_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = written(per_source.withColumn("copies", epochs).withColumn("budget", F.round(F.col("target") - F.col("copies") * F.col("source_size")).cast("long")))
    scale, n = F.log2("place.key") * OCTAVE, max(1, math.isqrt(rows.count()))
    octave = F.floor(scale).cast("int")
    ends = sources_end(rows, plan.select("source", "budget"), octave)
    near = rows_at(rows, ends, octave).withColumnRenamed("bucket", "octave").drop("before", "budget")
    part = F.least(F.floor((scale - F.col("octave")) * n), F.lit(n - 1)).cast("int")
    rest = ends.select(F.col("e_source").alias("source"), (F.col("budget") - F.col("before")).alias("budget"))
    last = rows_at(near, sources_end(near, rest, part), part)
    peers = last.groupBy("source", "budget", "before", "place").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    upto = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    cut = peers.withColumn("upto", upto).where("upto <= budget AND budget < upto + size").select(F.col("source").alias("c_source"), F.col("place").alias("cut"), F.floor((F.col("budget") - F.col("upto")) / F.col("n")).alias("rest"))
    plan = plan.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").select(F.col("source").alias("p_source"), "source_size", "target", "copies", "budget", "cut", "rest")
    plan = written(plan)  # a row for each source: of known size, so that Spark broadcasts it if it's small and else splits the hot source
    place = F.col("place")
    # a budget of a whole source's size or more ends in no bucket: then every document is within it
    part = F.when(F.col("budget") <= 0, 0).when(F.col("cut").isNull() | (place < F.col("cut")), F.col("size")).when(place == F.col("cut"), F.col("rest")).otherwise(0)
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("part", part.cast("long"))
    out = out.withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "part", "taken", F.col("place.h").alias("text_hash"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mix takes, in the columns of docs, a row for each copy.

    The copy in which a source's budget ends keeps its taken words, joined by one space; n_chars follows.
    """
    plan = mix(docs, **how).where("taken > 0").select(F.col("doc_id").alias("__id"), "text_hash", "copies", "part", "size").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("text_hash"))
    copies = F.concat(F.array_repeat(F.col("size"), F.col("copies").cast("int")), F.filter(F.array("part"), lambda x: x > 0))
    out = docs.join(plan, same).withColumn("__taken", F.explode(copies))
    cut = F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("__taken").cast("int")), " ")
    out = out.withColumn("text", F.when(F.col("__taken") < F.col("size"), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
k AS (SELECT doc_id, source, size, -ln((('0x' || md5('mix' || doc_id)[1:13])::BIGINT + 1.0::DOUBLE) / (4503599627370496.0::DOUBLE + 1.0::DOUBLE))
             / greatest(0.05::DOUBLE, 1 - 4 * length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) / greatest(length(text), 1)::DOUBLE) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM k GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source) AS i, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER a) AS level FROM r
      WINDOW b AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (SELECT source, source_size, round(least(cap, w * (SELECT coalesce(arg_min(level, i) FILTER (cap >= level * w), max(level)) FROM l)), 6) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
p AS (SELECT *, round(target - copies * source_size)::BIGINT AS budget FROM e),
o AS (SELECT k.doc_id, size, source_size, target, copies, budget, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
      FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size + least(size, greatest(0, budget - upto)))::BIGINT AS taken FROM o
"""
