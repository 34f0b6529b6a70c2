"""EPUB archives as a data source of Spark: spark.read.format("epub").load(folder), once EpubSource is registered."""

from __future__ import annotations

import hashlib
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from storyloom.functions.text import html_text
from storyloom.operators.chunks import number_chapters
from storyloom.sources.epub import MAX_BYTES, sections

#: A row for each document of an archive's spine; one row with code or error for an archive that isn't taken or can't be read.
SECTIONS = "path string, novel_id string, code int, place int, title string, html string, error string"


@dataclass
class Archives(InputPartition):
    paths: tuple[str, ...]


class EpubSource(DataSource):
    """Options: path, a file or a folder of any file system that pyarrow opens; archives_per_task, 1 if not given."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return SECTIONS

    def reader(self, schema) -> EpubReader:  # noqa: ANN001
        return EpubReader(self.options["path"], int(self.options.get("archives_per_task", "1")))


class EpubReader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = [system.get_file_info(root)]
        if found[0].type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        return [Archives(tuple(paths[i : i + self.per_task])) for i in range(0, len(paths), self.per_task)]

    def read(self, partition: Archives) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            size = system.get_file_info(path).size
            code = 400 if not path.lower().endswith(".epub") or not size else 413 if size > MAX_BYTES else 0
            if code:
                yield path, None, code, None, None, None, None
                continue
            with system.open_input_stream(path) as f:
                content = f.read()
            novel = hashlib.sha256(content).hexdigest()
            try:
                for place, title, html in sections(content):
                    yield path, novel, 0, place, title, html, None
            except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as e:
                yield path, novel, 0, None, None, None, f"{type(e).__name__}: {e}"[:300]


def read(spark: SparkSession, path: str, archives_per_task: int = 1) -> DataFrame:
    """SECTIONS of the archives of a folder."""
    spark.dataSource.register(EpubSource)
    return spark.read.format("epub").option("archives_per_task", archives_per_task).load(path)


def chapters(rows: DataFrame, novel_id: str = "novel_id", materialise: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Chapters of what was read: (novel_id, chapter_id, chapter_title, text, section_type). The same bytes under two paths count once.

    The texts are used several times: `materialise` writes them, so that archives are read and markup is turned to text once.
    """
    good = rows.where("place IS NOT NULL").groupBy(F.col(novel_id).alias("novel_id"), "place").agg(F.min_by(F.struct("title", "html"), "path").alias("s"))
    return number_chapters(materialise(good.select("novel_id", "place", html_text(F.col("s.title")).alias("title"), html_text(F.col("s.html")).alias("text"))))
