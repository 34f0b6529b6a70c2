"""EPUB files to chapters."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.text import html_text
from storyloom.operators.chunks import number_chapters

MAX_BYTES = 50 * 1024 * 1024
DOCUMENTS = {"application/xhtml+xml", "text/html"}


def sections(content: bytes) -> list[tuple[int, str, str]]:
    """(place, title, markup) of the documents of a book's spine, in its order; items that lack or aren't documents are passed over."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        opf = next(e.attrib["full-path"] for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if e.tag.endswith("}rootfile"))
        book = ElementTree.fromstring(z.read(opf))
        items = {e.attrib["id"]: e.attrib for e in book.iter() if e.tag.endswith("}item")}
        out = []
        for place, ref in enumerate(e.attrib["idref"] for e in book.iter() if e.tag.endswith("}itemref")):
            item = items.get(ref)
            if not item or item.get("media-type") not in DOCUMENTS:
                continue
            path = posixpath.normpath(posixpath.join(posixpath.dirname(opf), unquote(item["href"])))
            if path in names:
                markup = z.read(path).decode("utf-8", "ignore")
                head = re.search(r"<title[^>]*>(.*?)</title>", markup, re.S | re.I)
                out.append((place, head[1] if head else "", re.sub(r"<head(?:\s[^>]*)?>.*?</head>", "", markup, flags=re.S | re.I)))
    return out


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """novel_id (hash of the bytes), path, content, code: 0, or 400 or 413 for what isn't taken."""
    files = spark.read.format("binaryFile").load(path)
    code = F.when(~F.lower("path").endswith(".epub") | (F.col("length") == 0), 400).when(F.col("length") > MAX_BYTES, 413).otherwise(0)
    return files.select(F.sha2("content", 256).alias("novel_id"), "path", "content", "length", code.alias("code"))


def upload_code(path, length):  # noqa: ANN001, ANN201
    """The code as a column of a file's name and size."""
    return F.when(~F.lower(path).endswith(".epub") | (length == 0), 400).when(length > MAX_BYTES, 413).otherwise(0)


def read_epub(files: DataFrame) -> DataFrame:
    """Chapters of the files taken: (novel_id, chapter_id, chapter_title, text, section_type). A broken file has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for novel, content in zip(b["novel_id"], b["content"], strict=True):
                try:
                    rows = sections(content)
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
                    rows = []
                yield pd.DataFrame([(novel, *r) for r in rows], columns=["novel_id", "place", "title", "html"])

    raw = files.where("code = 0").dropDuplicates(["novel_id"]).select("novel_id", "content").mapInPandas(run, "novel_id string, place int, title string, html string")
    return number_chapters(raw.select("novel_id", "place", html_text(F.col("title")).alias("title"), html_text(F.col("html")).alias("text")))
