"""Graph tables, a partition for each novel and write, and the queries over them."""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from storyloom.functions.text import node_id
from storyloom.operators.graph import stored_relations

TABLES = ("novels", "persons", "relates_to")
#: Made of these for look-ups: see postings() and adjacent().
LOOKUPS = ("postings", "adjacent")
#: Bytes of a row group of the look-ups: what a search reads at least.
ROW_GROUP = 4 << 20
SCHEMAS = {
    "novels": "title string, novel_id string",
    "persons": "name string, mention_count bigint, chapters array<int>, chunk_ids array<int>, aliases array<string>, id string, novel_id string",
    "postings": "gram string, text string, name string, mention_count bigint, novel_id string",
    "adjacent": "end string, source string, target string, type string, chunk_ids array<int>, weight bigint, confidence double, evidence array<struct<chunk_id:int,chapter_id:int,text:string>>, novel_id string",
    "relates_to": "source string, target string, type string, chunk_ids array<int>, weight bigint, confidence double, evidence array<struct<chunk_id:int,chapter_id:int,text:string>>, novel_id string",
}


def with_ids(people: DataFrame) -> DataFrame:
    """Ids are hashes of novel and name, so that they stay over re-writes."""
    return people.withColumn("id", node_id(F.col("novel_id"), F.col("name")))


def files(spark: SparkSession, path: str):  # noqa: ANN201
    """Hadoop's file system of a path, and the function that makes its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def put_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file with the text in place of the one before: readers have the old one or the new one, whole."""
    fs, at = files(spark, path)
    hidden = at(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(hidden)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    how[0] = jvm.Options.Rename.OVERWRITE
    jvm.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(hidden), fs.makeQualified(at(path)), how)


def pointer(path: str, novel_id: str) -> str:
    return f"{path}/current/{hashlib.sha256(novel_id.encode()).hexdigest()}.json"


def current(spark: SparkSession, path: str) -> DataFrame:
    """novel_id, version, before: the folder that each novel's rows are in now, and that of the write before."""
    fs, at = files(spark, path)
    schema = "novel_id string, version string, before string"
    return spark.read.schema(schema).json(f"{path}/current") if fs.exists(at(f"{path}/current")) else spark.createDataFrame([], schema)


def table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """All versions of a table, with novel_id and version as text; None if there's none."""
    fs, at = files(spark, path)
    if not fs.globStatus(at(f"{path}/{name}/version=*/novel_id=*")):  # none was written, or none had rows
        return None
    fields = [f for f in spark.read.parquet(f"{path}/{name}").schema if f.name not in ("novel_id", "version")]
    return spark.read.schema(StructType([*fields, StructField("version", StringType()), StructField("novel_id", StringType())])).parquet(f"{path}/{name}")


def write_novels(novels: DataFrame, people: DataFrame, edges: DataFrame, path: str) -> dict[str, int]:
    """Replaces the given novels' rows in all three tables; edges without both persons aren't stored but counted.

    A novel's rows are replaced whole, so what a former run had and this one hasn't is gone, edges too if it has none now.
    Each write has a folder of its own in each table. When all are written, each novel's pointer is switched to it, one small
    file for all three tables: a crash before leaves the novel as it was. Readers move nothing, and the rows before stay
    for those who still read them, until the novel's next write.
    """
    spark, version = novels.sparkSession, uuid.uuid4().hex

    def put(name: str, df: DataFrame) -> DataFrame:
        """df written, and as it's written: what comes of it isn't worked out anew."""
        to = f"{path}/{name}/version={version}"
        df.repartition("novel_id").write.partitionBy("novel_id").parquet(to)
        return spark.read.schema(StructType([*[f for f in df.schema if f.name != "novel_id"], StructField("novel_id", StringType())])).parquet(to)

    edges = edges.persist(StorageLevel.DISK_ONLY)  # written and counted
    people = put("persons", with_ids(people)).drop("id")
    keep = put("relates_to", stored_relations(edges, people))
    put("novels", novels)
    for name, df, key in zip(LOOKUPS, (postings(people), adjacent(keep)), ("gram", "end"), strict=True):
        by = [c for c in ("novel_id", key, "text", "name") if c in df.columns]  # a large novel, or a common gram of it, goes into several files
        df.repartitionByRange(*by).sortWithinPartitions(*by).write.option("parquet.block.size", ROW_GROUP).partitionBy("novel_id").parquet(f"{path}/{name}/version={version}")
    ids = reduce(DataFrame.union, [t.where(F.col("version") == version).select("novel_id") for n in TABLES if (t := table(spark, path, n)) is not None])
    old = {r.novel_id: r for r in current(spark, path).join(ids.distinct(), "novel_id", "left_semi").collect()}
    for (novel,) in ids.distinct().collect():  # a pointer for each novel of this write
        was = old.get(novel)
        put_small(spark, pointer(path, novel), json.dumps({"novel_id": novel, "version": version, "before": was.version if was else None}))
        if was and was.before:
            drop_version(spark, path, novel, was.before)
    lost = edges.count() - keep.count()
    edges.unpersist()
    return {"edges_without_persons": lost}


def drop_version(spark: SparkSession, path: str, novel_id: str, version: str) -> None:
    fs, at = files(spark, path)
    folder = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("novel_id", novel_id)
    for name in TABLES + LOOKUPS:
        fs.delete(at(f"{path}/{name}/version={version}/{folder}"), True)


def snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The graph's tables as they are now, of one look at the pointers: they belong together whatever is written meanwhile."""
    now = spark.createDataFrame(current(spark, path).select("novel_id", "version").collect(), "novel_id string, version string")  # a row a novel
    return {n: spark.createDataFrame([], SCHEMAS[n]) if (t := table(spark, path, n)) is None else t.join(now, ["novel_id", "version"], "left_semi").drop("version") for n in TABLES + LOOKUPS}


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table; without rows if no novel has any."""
    t = table(spark, path, name)
    return spark.createDataFrame([], SCHEMAS[name]) if t is None else t.join(current(spark, path), ["novel_id", "version"], "left_semi").drop("version")


def delete_novel(spark: SparkSession, path: str, novel_id: str) -> None:
    """Drops the novel's rows of each table."""
    fs, at = files(spark, path)
    for r in current(spark, path).where(F.col("novel_id") == novel_id).collect():
        fs.delete(at(pointer(path, novel_id)), False)
        for version in filter(None, (r.version, r.before)):
            drop_version(spark, path, novel_id, version)


def duplicates(people: DataFrame) -> DataFrame:
    """(novel_id, name) and ids that come more than once; none in a sound store."""
    names = people.groupBy("novel_id", "name").count().where("count > 1").select("novel_id", "name", F.lit("name").alias("key"), "count")
    ids = people.groupBy("id").agg(F.min("novel_id").alias("novel_id"), F.min("name").alias("name"), F.count(F.lit(1)).alias("count")).where("count > 1")
    return names.unionByName(ids.select("novel_id", "name", F.lit("id").alias("key"), "count"))


def list_novels(novels: DataFrame) -> DataFrame:
    return novels.select("novel_id", "title").orderBy("title", "novel_id")


def counts(people: DataFrame, edges: DataFrame) -> DataFrame:
    """novel_id, persons, relationships."""
    a = people.groupBy("novel_id").agg(F.count(F.lit(1)).alias("persons"))
    b = edges.groupBy("novel_id").agg(F.count(F.lit(1)).alias("relationships"))
    return a.join(b, "novel_id", "full").na.fill(0, ["persons", "relationships"])


def get_novel(novels: DataFrame, people: DataFrame, edges: DataFrame, novel_id: str) -> DataFrame:
    """The novel with its counts; no row if there's none."""
    here = lambda df: df.where(F.col("novel_id") == novel_id)
    return here(novels).join(counts(here(people), here(edges)), "novel_id", "left").na.fill(0, ["persons", "relationships"])


def search(people: DataFrame, novel_id: str, q: str, limit: int = 10) -> DataFrame:
    """Persons whose name or an alias has q without the space around it, case-sensitive; most mentioned first, then by name. An empty q finds all."""
    q = q.strip()
    hit = F.contains("name", F.lit(q)) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(a, F.lit(q)))
    return people.where((F.col("novel_id") == novel_id) & hit).orderBy(F.desc("mention_count"), "name").limit(limit)


def grams(s: Column, n: int) -> Column:
    """All runs of n characters of a text, each once; none if it's shorter."""
    places = F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1)))
    return F.array_distinct(F.filter(F.transform(places, lambda i: F.substring(s, i, F.lit(n))), lambda g: F.length(g) == n))


def postings(people: DataFrame) -> DataFrame:
    """novel_id, gram, text, name, mention_count: each run of one to three characters of each name and alias of a person."""
    names = F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    each = people.select("novel_id", "name", "mention_count", F.explode(names).alias("text"))
    return each.select("novel_id", F.explode(F.concat(*[grams(F.col("text"), n) for n in (1, 2, 3)])).alias("gram"), "text", "name", "mention_count")


def search_written(spark: SparkSession, path: str, novel_id: str, q: str, limit: int = 10) -> DataFrame:
    """search() in a written graph. The postings of q's grams of three characters (of its own length if it's shorter) are read
    and met, and the texts that have all of them looked at; then those of the persons found, `limit` at most, by name. An empty q reads all persons."""
    q, people = q.strip(), read(spark, path, "persons")
    if not q:
        return search(people, novel_id, q, limit)
    n = min(3, len(q))
    wanted = sorted({q[i : i + n] for i in range(len(q) - n + 1)})
    hits = read(spark, path, "postings").where((F.col("novel_id") == novel_id) & F.col("gram").isin(wanted))
    if len(wanted) > 1:
        hits = hits.groupBy("text", "name", "mention_count").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted))
    best = hits.where(F.contains("text", F.lit(q))).select("name", "mention_count").distinct().orderBy(F.desc("mention_count"), "name").limit(limit)
    names = [r.name for r in best.collect()]  # `limit` at most
    return people.where((F.col("novel_id") == novel_id) & F.col("name").isin(names)).orderBy(F.desc("mention_count"), "name").limit(limit)


def adjacent(edges: DataFrame) -> DataFrame:
    """The edges at each of their ends: end, and the edge's own columns."""
    return edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("end"), *edges.columns)


def one_hop_written(spark: SparkSession, path: str, novel_id: str, name: str) -> DataFrame:
    """one_hop_edges() in a written graph: rows are clustered by end, so other persons' row groups aren't read."""
    return read(spark, path, "adjacent").where((F.col("novel_id") == novel_id) & (F.col("end") == name)).drop("end")


def get_character(people: DataFrame, person_id: str, novel_id: str | None = None) -> DataFrame:
    out = people.where(F.col("id") == person_id)
    return out.where(F.col("novel_id") == novel_id) if novel_id else out


def one_hop_edges(edges: DataFrame, novel_id: str, name: str) -> DataFrame:
    """Edges at a person, in their stored direction."""
    return edges.where((F.col("novel_id") == novel_id) & ((F.col("source") == name) | (F.col("target") == name)))


def one_hop_nodes(edges: DataFrame, people: DataFrame, novel_id: str, name: str) -> DataFrame:
    """The person and its neighbours, each once, with whether it's the centre."""
    near = one_hop_edges(edges, novel_id, name).select("novel_id", F.explode(F.array("source", "target")).alias("name"))
    ends = near.union(people.where((F.col("novel_id") == novel_id) & (F.col("name") == name)).select("novel_id", "name")).distinct()
    return people.join(ends, ["novel_id", "name"], "left_semi").withColumn("is_center", F.col("name") == name)


def with_titles(edges: DataFrame, chapters: DataFrame) -> DataFrame:
    """Evidence with the titles of its chapters; an unknown chapter's is empty."""
    key = ["novel_id", "source", "target", "type"]
    each = edges.select(*key, F.posexplode("evidence").alias("pos", "e"))
    each = each.withColumn("chapter_id", F.col("e.chapter_id")).join(chapters.select("novel_id", "chapter_id", "chapter_title"), ["novel_id", "chapter_id"], "left")
    each = each.withColumn("e", F.col("e").withField("chapter_title", F.coalesce("chapter_title", F.lit(""))))
    lists = each.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda x: x["e"]).alias("evidence"))  # five at most
    return edges.drop("evidence").join(lists, key, "left")


def health(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"))
