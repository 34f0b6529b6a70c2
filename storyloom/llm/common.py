"""What the operators share: tables that cut lineage, word patterns, stable hash folds."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a class of a regular expression.
SPACE = r"[\x20\x09-\x0D]"
#: Texts are handled in slices of about so many characters, which bounds a Python worker's memory.
SLICE_CHARS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, of spark.checkpoint.dir; a temporary one only where that is unset and all run on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = sc.getConf().get("spark.checkpoint.dir")
        if found is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="storyloom-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, sizes are known, executors may be lost. clear() removes them."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes the tables that operators wrote in this session: to be called when their results are written, which still read them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; -1 for null, which is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(-1))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have at most `most` bytes together; a longer text comes alone."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(np.nan_to_num(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False)))
        at = 0
        while at < b.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + most, "right")))
            yield b.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: Spark keeps Python workers for later tasks, beside those that run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)



def by_key(df: DataFrame, key: str, *sums: Column) -> DataFrame:
    """df.groupBy(key).agg(*sums) for a join of df's rows with it on the same whole number.

    Groups are dealt out by another expression than the key, so the join deals out both of its sides itself; only
    then can Spark split a hot key's rows over several tasks.
    """
    other = F.bitwise_not(F.col(key))
    return df.groupBy(other.alias("__other")).agg(*sums).withColumn(key, F.bitwise_not(F.col("__other"))).drop("__other")
