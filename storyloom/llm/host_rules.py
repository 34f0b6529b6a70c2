"""Quality rules of documents and of the hosts they come from; DataFrame functions only.

Rule failures are counted by host (the source of a document), each host's rate is shrunk by a beta
prior fitted to all hosts by moments, and the host's verdict is joined back to its documents.

Rows: null and empty texts have no words and fail; a null source is a host of its own; repeated
rows count each time and each gives a row; an empty table gives an empty table; other columns of
the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import SPACE, words, written

SYMBOLS = "#*$%&|<>"


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long")


def repeated_words(df: DataFrame, w: str, out: str) -> DataFrame:
    """Adds the number of words of array column w in 3-word windows that the row has twice or more.

    Windows are told apart by 64-bit hashes within their row, sorted with their places.
    """
    window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    df = df.withColumn("__s", F.when(F.size(w) >= 4, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window))))
    places = F.transform("__s", lambda x, k: F.when(same(x, F.get("__s", k - 1)) | same(x, F.get("__s", k + 1)), x["i"]))
    df = df.withColumn("__p", F.sort_array(F.array_compact(places)))
    steps = F.zip_with("__p", F.slice("__p", 2, F.greatest(F.size("__p"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn(out, F.coalesce(total, F.lit(0).cast("long"))).drop("__s", "__p")


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the rules' counts and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(SPACE.replace("[", "[^")))
    df = docs.select("doc_id", F.col(host).alias("host"), text.alias("text"), words(text).alias("w"), lines.alias("lines"))
    df = repeated_words(df, "w", "n_repeat_words")
    df = df.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        n_symbols(F.col("text")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_verdicts(measured: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """host, documents, failures, rate (shrunk), host_failed: whether that rate is over max_rate."""
    hosts = written(measured.groupBy("host").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("base_failed").cast("long")).alias("failures")))
    mean = hosts.agg(F.coalesce(F.sum("failures") / F.sum("documents"), F.lit(0.0))).first()[0]
    rate = F.col("failures") / F.col("documents")
    # between-host variance: what the spread of the rates exceeds the spread that counting alone gives
    apart = hosts.agg(F.coalesce(F.avg((rate - mean) ** 2 - mean * (1 - mean) / F.col("documents")), F.lit(0.0))).first()[0]
    strength = mean * (1 - mean) / apart - 1 if apart > 1e-9 and 0 < mean < 1 else 1e6
    strength = min(max(strength, 1.0), 1e6)
    shrunk = (F.col("failures") + mean * strength) / (F.col("documents") + strength)
    return hosts.withColumn("rate", shrunk).withColumn("host_failed", F.col("rate") > max_rate)


def judge(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, host_rate, kept."""
    measured = written(measures(docs, host))  # numbers only; read twice
    verdicts = host_verdicts(measured, max_rate).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"), "host_failed")
    out = measured.join(verdicts, F.col("host").eqNullSafe(F.col("h")))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("host", "h", "host_failed")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM windows),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT d.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN repeats r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS k FROM f GROUP BY source),
p AS (SELECT sum(k) / sum(n) AS mean FROM h),
v AS (SELECT any_value(mean) AS mean, avg((k / n - mean) ** 2 - mean * (1 - mean) / n) AS apart FROM h, p),
s AS (SELECT mean, CASE WHEN apart > 1e-9 AND mean > 0 AND mean < 1 THEN least(greatest(mean * (1 - mean) / apart - 1, 1.0), 1e6) ELSE 1e6 END AS strength FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (k + mean * strength) / (n + strength) <= 0.5 AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, s
"""
