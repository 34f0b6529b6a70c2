"""Chapters to overlapping chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.text import chapter_title, first_line, section_type
from storyloom.schema import CHUNKS, columns


def number_chapters(sections: DataFrame) -> DataFrame:
    """(novel_id, place, title, text) to chapters: empty ones go first, then ids are 1 to n in the order of place."""
    w = Window.partitionBy("novel_id").orderBy("place")
    slim = sections.where("text <> ''").select("novel_id", "place").withColumn("chapter_id", F.row_number().over(w))
    slim = slim.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("novel_id")))  # without texts
    out = sections.where("text <> ''").join(slim, ["novel_id", "place"]).withColumn("first", first_line(F.col("text")))  # worked out once, not by each rule
    section = section_type(F.col("title"), F.col("text"), F.col("chapter_id") - 1, F.col("total"), F.col("first"))
    return out.select("novel_id", "chapter_id", chapter_title(F.col("title"), F.col("chapter_id")).alias("chapter_title"), "text", section.alias("section_type"))


def chunk(chapters: DataFrame, size: int = 4000, overlap: int = 400) -> DataFrame:
    """Windows of `size` characters, each `size - overlap` on; the first that reaches a chapter's end is its last. Ids go through a novel's chapters."""
    step = max(1, size - overlap)
    n = F.when(F.length("text") <= size, 1).otherwise(F.ceil((F.length("text") - size) / step).cast("int") + 1)
    chapters = chapters.where("text <> ''")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("novel_id").orderBy("chapter_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = chapters.select("novel_id", "chapter_id", n.alias("n")).withColumn("before", before.cast("int")).drop("n")  # numbers only, not texts
    out = chapters.join(first, ["novel_id", "chapter_id"]).withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("i") * step
    out = out.withColumns({"chunk_id": F.col("before") + F.col("i") + 1, "start_offset": start, "end_offset": F.least(start + size, F.length("text"))})
    return out.withColumn("text", F.substring("text", F.col("start_offset") + 1, F.lit(size))).select(columns(CHUNKS))


def structure_hash(chunks: DataFrame) -> DataFrame:
    """novel_id, structure_hash: of all chunks in order, by the digest of each, so that no text is gathered."""
    each = chunks.select("novel_id", "chunk_id", F.sha2(F.concat_ws("\x1f", *columns(CHUNKS)), 256).alias("d"))
    return each.groupBy("novel_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "d"))), lambda x: x["d"]), ""), 256).alias("structure_hash"))
