"""Queries of the character-graph operators, and the SQL that gives the same rows.

Novels are the sources of `documents`, chapters their documents by doc_id. Operators on lists of pairs run over
`lineitem`, with orders as chunks, parts and suppliers as ends. Rules on Chinese names run over literal rows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from functools import reduce

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import chunks as C
from storyloom.operators import evaluation, extraction, graph, layout, lineage, merging, recall, resolution, resume, store
from storyloom.schema import CATEGORIES, RELATION_TYPES
from storyloom.shared import new_folder
from storyloom.sources import epub, epub_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """df in the shared folder, where the session names one; else it's worked out wherever it's read."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: for rows that are many or long and read several times."""
    path = new_folder(df.sparkSession, "tables")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple], names: str, alias: str = "v") -> str:
    """Literal rows as a table expression of SQL."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) {alias}({names}))"


# sources, chapters and chunks

BLANK, BREAK = T.BLANK, T.BREAK


def lines_sql(x: str) -> str:
    """Stripped non-blank lines of an SQL expression."""
    return f"list_filter(list_transform(string_split_regex({x}, '{BREAK}'), lambda s: regexp_replace(s, '^{BLANK}+|{BLANK}+$', '', 'g')), lambda s: s <> '')"



@query(f"""SELECT page_id, url, array_to_string({lines_sql("replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + '"' + "'), '&amp;', '&')")}, chr(10)) AS text FROM pages""")
def src2_html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", T.html_text(F.col("html")).alias("text"))


def sections(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.coalesce("source", F.lit("")).alias("novel_id"), F.col("doc_id").alias("place"), F.lit(" ").alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def chapters(spark: SparkSession, sf: str) -> DataFrame:
    return C.number_chapters(sections(spark, sf))


def section_sql(title: str, text: str, place: str, total: str) -> str:
    """The section rules as a CASE, from the same fixed values."""
    first = f"coalesce(({lines_sql(text)})[1], '')"
    strip = f"regexp_replace(coalesce({title}, ''), '^{BLANK}+|{BLANK}+$', '', 'g')"
    rules = [f"WHEN contains({strip}, {literal(w)}) THEN {literal(s)}" for w, s in T.TITLE_WORDS.items()]
    rules += [f"WHEN contains({first}, {literal(w)}) THEN {literal(s)}" for w, s in T.FIRST_LINE_WORDS.items()]
    rules += [f"WHEN regexp_matches({first}, '{T.CHAPTER_NUMBER}') THEN 'body'"]
    rules += [f"WHEN {place} = 0 AND length({text}) <= 200 AND regexp_matches({text}, '版权|作者') THEN 'metadata'"]
    rules += [f"WHEN {place} = {total} - 1 AND length({text}) <= 500 AND regexp_matches({text}, '公众号|微信|mp[.]weixin') THEN 'trailer'"]
    return f"CASE {' '.join(rules)} ELSE 'body' END"


CHAPTERS = """chapters AS (SELECT coalesce(source, '') AS novel_id, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id)::INT AS chapter_id, text FROM documents WHERE text <> '')"""
CHUNKS = f"""{CHAPTERS}, cut AS (SELECT *, unnest(range(0, CASE WHEN length(text) <= 4000 THEN 1 ELSE ceil((length(text) - 4000) / 3600.0)::INT + 1 END)) AS i FROM chapters),
chunks AS (SELECT novel_id, row_number() OVER (PARTITION BY novel_id ORDER BY chapter_id, i)::INT AS chunk_id, chapter_id, substring(text, (i * 3600 + 1)::BIGINT, 4000) AS text, (i * 3600)::INT AS start_offset,
           least(i * 3600 + 4000, length(text))::INT AS end_offset FROM cut)"""
NAMES = f"""{CHUNKS}, found AS (SELECT novel_id, chunk_id, chapter_id, regexp_extract_all(text, '{extraction.NAME}') AS n FROM chunks),
each AS (SELECT novel_id, chunk_id, chapter_id, unnest(n) AS name, unnest(range(len(n))) AS pos FROM found),
firsts AS (SELECT novel_id, chunk_id, chapter_id, name, min(pos) AS pos FROM each GROUP BY ALL),
mentioned AS (SELECT novel_id, chunk_id, chapter_id, (row_number() OVER (PARTITION BY novel_id, chunk_id ORDER BY pos) - 1)::INT AS ordinal, name FROM firsts)"""
RELATED = f"""{NAMES}, related AS (SELECT a.novel_id, a.chunk_id, a.chapter_id, a.ordinal, a.name AS source, b.name AS target, {literal(list(RELATION_TYPES))}[(length(a.name) + length(b.name)) % 7 + 1] AS type,
((length(a.name) + length(b.name)) % 10 + 1) / 10 AS confidence FROM mentioned a JOIN mentioned b ON a.novel_id = b.novel_id AND a.chunk_id = b.chunk_id AND b.ordinal = a.ordinal + 1)"""


@query(f"WITH {CHAPTERS}, t AS (SELECT *, count(*) OVER (PARTITION BY novel_id) AS total FROM chapters) SELECT novel_id, chapter_id, format('第{{}}章', chapter_id) AS chapter_title, length(text) AS n, {section_sql("''", 'text', 'chapter_id - 1', 'total')} AS section_type FROM t")
def src3_src4_chapters(spark, sf):
    return chapters(spark, sf).select("novel_id", "chapter_id", "chapter_title", F.length("text").cast("long").alias("n"), "section_type")


UPLOADS = [("a.epub", 10), ("B.EPUB", 52428800), ("c.epub", 52428801), ("d.pdf", 10), ("e.epub", 0), ("f.txt", 99999999)]


@query(f"SELECT path, CASE WHEN lower(path) NOT LIKE '%.epub' OR n = 0 THEN 400 WHEN n > 52428800 THEN 413 ELSE 0 END AS code FROM {values(UPLOADS, 'path, n')}")
def src5_upload_codes(spark, sf):
    return spark.createDataFrame(UPLOADS, "path string, n long").select("path", epub.upload_code(F.col("path"), F.col("n")).alias("code"))


@query("SELECT event_type, count(*) AS n, count(json_extract(props, '$.k')) AS with_k, count(*) FILTER (NOT json_valid(props)) AS corrupt FROM events GROUP BY event_type")
def src6_json_events(spark, sf):
    lines = lineage.parsed(table(spark, sf, "events").select("event_type", "props"), "k long", "props")
    return lines.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("with_k"), F.count("_corrupt").alias("corrupt"))


@query("SELECT event_id, event_type FROM events WHERE (SELECT count(*) FROM events WHERE NOT json_valid(props)) = 0")
def src6_all_or_nothing(spark, sf):
    lines = lineage.parsed(table(spark, sf, "events").select("event_id", "event_type", "props"), "k long", "props")
    return lineage.all_or_nothing(lines).select("event_id", "event_type")


def write_books(spark: SparkSession, sf: str, folder: str, pages: int = 50) -> None:
    """Archives of `pages` pages each, in the order of page_id: what an export would have made of the table."""
    system, root = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(root)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            put = lambda name, text: z.writestr(zipfile.ZipInfo(name), text)  # noqa: E731  of no date: the same bytes each time
            put("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
            ids = [str(i) for i in sorted(rows["page_id"])]
            items = "".join(f'<item id="p{i}" href="p%20{i}.xhtml" media-type="application/xhtml+xml"/>' for i in ids)
            put("OPS/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine>{"".join(f'<itemref idref="p{i}"/>' for i in ids)}</spine></package>')
            for i, html in zip(rows["page_id"], rows["html"], strict=True):
                put(f"OPS/p {i}.xhtml", html or "")
        own, path = pyarrow.fs.FileSystem.from_uri(f"{folder}/book{key[0]}.epub")
        with own.open_output_stream(path) as f:
            f.write(out.getvalue())
        return pd.DataFrame({"path": [path]})

    books = table(spark, sf, "pages").groupBy(F.floor(F.col("page_id") / pages).alias("book"))
    books.applyInPandas(run, "path string").write.format("noop").mode("overwrite").save()


def html_sql(x: str) -> str:
    """html_text() of an SQL expression."""
    plain = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for ref, char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&amp;", "'&'")):
        plain = f"replace({plain}, '{ref}', {char})"
    return f"array_to_string({lines_sql(plain)}, chr(10))"


@query(
    f"""WITH p AS (SELECT 'book' || (page_id // 50) AS novel_id, page_id, {html_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, {html_sql(r"regexp_replace(html, '(?is)<head(?:\s[^>]*)?>.*?</head>', '', 'g')")} AS text FROM pages),
    n AS (SELECT *, row_number() OVER (PARTITION BY novel_id ORDER BY page_id)::INT AS chapter_id, count(*) OVER (PARTITION BY novel_id) AS total FROM p WHERE text <> '')
    SELECT novel_id, chapter_id, coalesce(nullif(trim(title), ''), format('第{{}}章', chapter_id)) AS chapter_title, sha256(text) AS digest, {section_sql("coalesce(title, '')", "text", "chapter_id - 1", "total")} AS section_type FROM n"""
)
def src1_epub_chapters(spark, sf):
    folder = new_folder(spark, "books")
    write_books(spark, sf, folder)
    rows = epub_source.read(spark, folder).withColumn("book", F.regexp_extract("path", r"([^/]+)\.epub$", 1))
    return epub_source.chapters(rows, "book", written).select("novel_id", "chapter_id", "chapter_title", F.sha2("text", 256).alias("digest"), "section_type")


SECTION_CASES = [
    ("版权页", "x", 0, 9), ("", "  \n　题记 一\n文", 1, 9), (None, "第三章 渡口\n正文", 2, 9), ("", "三\n正文", 3, 9), ("", "三、渡口\n正文", 4, 9), ("", "本书作者某某", 0, 9), ("", "请搜微信", 8, 9), ("", "请搜微信", 7, 9),
    ("序", "正文", 3, 9), ("一", "关注公众号 x", 3, 9), ("", "作者：某\n第一章", 0, 2), ("", "作" * 201 + "作者", 0, 9),
]


@query(f"SELECT i, {section_sql('title', 'text', 'place', 'total')} AS section_type FROM {values([(i, *c) for i, c in enumerate(SECTION_CASES)], 'i, title, text, place, total')}")
def cls1_section_types(spark, sf):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(SECTION_CASES)], "i int, title string, text string, place int, total int")
    return df.select("i", T.section_type(F.col("title"), F.col("text"), F.col("place"), F.col("total")).alias("section_type"))


@query(f"SELECT doc_id, ({lines_sql('text')})[1] AS first_line FROM documents")
def cls2_first_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.first_line(F.col("text")).alias("first_line"))


@query(f"WITH {CHAPTERS}, t AS (SELECT *, count(*) OVER (PARTITION BY novel_id) AS total FROM chapters), s AS (SELECT novel_id, {section_sql("''", 'text', 'chapter_id - 1', 'total')} AS section_type FROM t) SELECT novel_id, section_type, count(*) AS n FROM s GROUP BY ALL")
def cls3_sections_by_place(spark, sf):
    return chapters(spark, sf).groupBy("novel_id", "section_type").agg(F.count(F.lit(1)).alias("n"))


MENTIONS = [
    (None, None), ("", None), ("　", None), ("12３", "person"), ("!?", None), ("x" * 50, None), ("x" * 51, None), ("两个儿子", "person"), ("兄弟二人", None), ("父子三人", None), ("两弟兄", None), ("三个小孩们", None),
    ("弟弟", "person"), ("弟弟的船", "descriptive"), ("翠翠", "person"), ("父亲", "descriptive"), ("岳云二老", "composite"), ("爹爹", None), ("众人", "generic"),
]
CLASS = f"CASE WHEN name IS NULL OR length(name) > 50 OR regexp_matches(name, '{T.INVALID.replace(chr(39), chr(39) * 2)}') THEN 'invalid' WHEN regexp_matches(name, '{T.COLLECTIVE}') THEN 'collective' WHEN name IN {tuple(T.GENERIC)} THEN 'generic' END"


@query(
    f"SELECT i, {CLASS} AS class, coalesce({CLASS} IN ('invalid', 'collective'), false) AS hard, CASE WHEN name IN {tuple(T.GENERIC)} THEN 'generic' ELSE category END AS category, coalesce(substring(name, 1, 1) IN {tuple(T.SENIOR)}, false) AS senior"
    f" FROM {values([(i, *m) for i, m in enumerate(MENTIONS)], 'i, name, category')}"
)
def hyg_mention_rules(spark, sf):
    name = F.col("name")
    df = spark.createDataFrame([(i, *m) for i, m in enumerate(MENTIONS)], "i int, name string, category string")
    return df.select("i", T.mention_class(name).alias("class"), T.hard_filtered(name).alias("hard"), T.effective_category(name, F.col("category")).alias("category"), F.coalesce(T.senior(name), F.lit(False)).alias("senior"))


KNOWN = [("天保", "天保"), ("大老", "天保"), ("翠翠", "翠翠"), ("翠", "翠翠"), ("岳云", "岳云")]
ROLES = [("翠翠的父亲",), ("天保大老",), ("翠翠祖父",), ("老船夫",), ("岳云",), ("大老爷",), ("他的很长很长很长很长很长",), ("船的主",)]


@query(
    f"WITH k AS {values(KNOWN, 'name, canonical')}, m AS {values(ROLES, 'mention')}, p AS (SELECT mention, arg_max(canonical, length(name)) AS who, max(length(name)) AS n FROM m JOIN k ON starts_with(mention, name) AND length(name) >= 2 AND mention <> name GROUP BY mention)"
    f" SELECT mention, CASE WHEN regexp_matches(mention, '{T.OF}') OR who IS NOT NULL THEN 'qualified' ELSE 'bare' END AS kind, regexp_matches(mention, '{T.OF}') AS by_of,"
    f" CASE WHEN regexp_matches(mention, '{T.OF}') THEN (SELECT canonical FROM k WHERE name = regexp_extract(mention, '{T.OF}', 1)) ELSE who END AS anchor,"
    f" CASE WHEN regexp_matches(mention, '{T.OF}') THEN regexp_extract(mention, '{T.OF}', 2) WHEN who IS NOT NULL THEN substring(mention, n + 1) END AS head FROM m LEFT JOIN p USING (mention)"
)
def rol1_role_mentions(spark, sf):
    return recall.role_mentions(spark.createDataFrame(ROLES, "mention string"), spark.createDataFrame(KNOWN, "name string, canonical string"))


@query("SELECT conv_id, turn, role IN ('user') AND contains(text, 'the') AS present FROM conversations")
def rol2_anchor_in_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", ((F.col("role") == "user") & T.present(F.col("text"), F.array(F.lit("the")))).alias("present"))


ANSWERS = [
    (1, '{"characters":[{"name":"A","category":"person"}],"relationships":[{"source":"A","target":"B","type":"love","confidence":0.5},{"source":"A","target":"A","type":"love","confidence":1}]}'),
    (2, '{"characters":[{"name":"A","category":"hero"}],"relationships":[]}'), (3, '{"characters":[{"name":"","category":null}],"relationships":[]}'),
    (4, '{"characters":[],"relationships":[{"source":"A","target":"B","type":"love","confidence":1.5}]}'), (5, '{"characters":[{"name":"A","category":null}],"relationships":[{"source":"A","target":"B","type":"foe","confidence":0.5}]}'), (6, "not json"),
]


@query(
    f"WITH a AS {values(ANSWERS, 'i, answer')}, p AS (SELECT i, CASE WHEN json_valid(answer) THEN from_json(answer, '{{\"characters\":[{{\"name\":\"VARCHAR\",\"category\":\"VARCHAR\"}}],\"relationships\":[{{\"source\":\"VARCHAR\",\"target\":\"VARCHAR\",\"type\":\"VARCHAR\",\"confidence\":\"DOUBLE\"}}]}}') END AS r FROM a),"
    f" v AS (SELECT i, r, coalesce(len(list_filter(r.characters, lambda c: NOT (length(c.name) BETWEEN 1 AND 50) OR c.category NOT IN {CATEGORIES})) = 0 AND len(list_filter(r.relationships, lambda x: NOT (x.type IN {RELATION_TYPES} AND x.confidence BETWEEN 0 AND 1))) = 0, false) AS valid FROM p)"
    f" SELECT i, valid, CASE WHEN valid THEN len(list_filter(r.relationships, lambda x: x.source <> x.target)) ELSE -1 END AS relations FROM v"
)
def sch1_sch2_validation(spark, sf):
    return extraction.parse(spark.createDataFrame(ANSWERS, "i int, answer string")).select("i", "valid", F.when(F.col("valid"), F.size("result.relationships")).otherwise(-1).cast("long").alias("relations"))


@query("SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, arg_min(l_linenumber, l_orderkey * 10 + l_linenumber) AS line FROM lineitem GROUP BY ALL")
def sch3_first_answers(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), F.col("l_linenumber").alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return extraction.first_answers(rows, ["a", "b"], "at").select("a", "b", "line")


@query(f"WITH {CHUNKS} SELECT novel_id, chunk_id, chapter_id, start_offset, end_offset, sha256(text) AS digest FROM chunks")
def chk1_chunks(spark, sf):
    return C.chunk(chapters(spark, sf)).select("novel_id", "chunk_id", "chapter_id", "start_offset", "end_offset", F.sha2("text", 256).alias("digest"))


TITLED = f"""{CHUNKS}, titled AS (SELECT novel_id, chapter_id, format('第{{}}章', chapter_id) AS title, {section_sql("''", 'text', 'chapter_id - 1', 'total')} AS section_type FROM (SELECT *, count(*) OVER (PARTITION BY novel_id) AS total FROM chapters)),
whole AS (SELECT c.*, title, section_type FROM chunks c JOIN titled t ON c.novel_id = t.novel_id AND c.chapter_id = t.chapter_id)"""


@query(f"WITH {TITLED} SELECT novel_id, chunk_id, section_type FROM whole")
def chk3_chunk_sections(spark, sf):
    return C.chunk(chapters(spark, sf)).select("novel_id", "chunk_id", "section_type")


@query(
    f"WITH {TITLED}, each AS (SELECT novel_id, chunk_id, sha256(concat_ws(chr(31), novel_id, chunk_id, chapter_id, title, text, start_offset, end_offset, section_type)) AS d FROM whole)"
    " SELECT novel_id, sha256(string_agg(d, '' ORDER BY chunk_id)) AS structure_hash FROM each GROUP BY novel_id"
)
def chk4_structure_hashes(spark, sf):
    return C.structure_hash(C.chunk(chapters(spark, sf)))


@query(f"WITH {NAMES} SELECT * FROM mentioned")
def llm1_mentions(spark, sf):
    return extraction.mentioned(C.chunk(chapters(spark, sf)))


@query(f"WITH {RELATED} SELECT novel_id, chunk_id, ordinal, source, target, type, confidence FROM related")
def llm1_relations(spark, sf):
    return extraction.related(C.chunk(chapters(spark, sf))).drop("chapter_id")


@query(f"WITH {NAMES} SELECT c.novel_id, c.chunk_id, 'completed' AS status, count(m.name) AS people FROM chunks c LEFT JOIN mentioned m ON c.novel_id = m.novel_id AND c.chunk_id = m.chunk_id GROUP BY 1, 2")
def llm6_extract_all(spark, sf):
    out = extraction.extract_all(C.chunk(chapters(spark, sf)), extraction.rule_extractor)
    return out.select("novel_id", "chunk_id", "status", F.size("result.characters").cast("long").alias("people"))


# recall: benchmark items lend the names that are known


#: Capitalised words that two benchmark items or more have, in the novels that mention them, as canonical; their first four letters are a name of theirs too, and their first two of every seventh letter's.
INDEX = f"""words AS (SELECT unnest(list_distinct(regexp_extract_all(text, '{extraction.NAME}'))) AS name FROM benchmark), canon AS (SELECT name AS canonical FROM words GROUP BY name HAVING count(*) >= 2),
held AS (SELECT DISTINCT novel_id, canonical FROM mentioned JOIN canon ON name = canonical),
index AS (SELECT novel_id, canonical, canonical AS name FROM held UNION SELECT novel_id, canonical, substring(canonical, 1, 4) FROM held UNION SELECT novel_id, canonical, substring(canonical, 1, 2) FROM held WHERE length(canonical) % 7 = 0)"""


def name_index(spark: SparkSession, sf: str, mentioned: DataFrame | None = None) -> DataFrame:
    found = table(spark, sf, "benchmark").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(extraction.NAME), F.lit(0)))).alias("canonical"))
    canon = found.groupBy("canonical").count().where("count >= 2").select("canonical")
    mentioned = extraction.mentioned(C.chunk(chapters(spark, sf))) if mentioned is None else mentioned
    held = mentioned.select("novel_id", F.col("name").alias("canonical")).distinct().join(canon, "canonical")
    names = F.array("canonical", F.substring("canonical", 1, 4), F.when(F.length("canonical") % 7 == 0, F.substring("canonical", 1, 2)))
    return held.select("novel_id", "canonical", F.explode(F.array_distinct(F.array_compact(names))).alias("name"))


@query(f"WITH {NAMES}, {INDEX} SELECT DISTINCT c.novel_id, c.chunk_id, i.canonical FROM chunks c JOIN index i ON c.novel_id = i.novel_id AND contains(c.text, i.name)")
def rec2_text_recall(spark, sf):
    return recall.text_mentions(C.chunk(chapters(spark, sf)), name_index(spark, sf))


@query(f"WITH {NAMES}, {INDEX} SELECT DISTINCT m.novel_id, m.chunk_id, i.canonical FROM mentioned m JOIN index i ON m.novel_id = i.novel_id AND m.name = i.name")
def rec1_known_names(spark, sf):
    known = name_index(spark, sf).select("novel_id", "name", "canonical")
    names = extraction.mentioned(C.chunk(chapters(spark, sf))).select("novel_id", "chunk_id", "name")
    return recall.known_in_extraction(names, known, spark.createDataFrame([], "novel_id string, name string"))


CANDIDATES = f"""{NAMES}, {INDEX}, asked AS (SELECT novel_id, chunk_id, name AS mention FROM mentioned),
x AS (SELECT DISTINCT m.novel_id, m.chunk_id, i.canonical FROM mentioned m JOIN index i ON m.novel_id = i.novel_id AND m.name = i.name),
t AS (SELECT DISTINCT c.novel_id, c.chunk_id, i.canonical FROM chunks c JOIN index i ON c.novel_id = i.novel_id AND contains(c.text, i.name)),
s AS (SELECT novel_id, chunk_id, canonical, min(tier) AS tier FROM (SELECT *, 0 AS tier FROM x UNION ALL SELECT *, 1 AS tier FROM t) GROUP BY ALL),
g AS (SELECT novel_id, canonical, list_sort(list(DISTINCT name)) AS matched_names FROM index GROUP BY ALL),
p AS (SELECT d.novel_id, d.mention, g.canonical, matched_names, len(list_filter(matched_names, lambda n: contains(d.mention, n) OR contains(n, d.mention))) > 0 AS part,
      list_max(list_transform(matched_names, lambda n: len(list_intersect(string_split(n, ''), string_split(d.mention, ''))))) AS shared
      FROM (SELECT DISTINCT novel_id, mention FROM asked) d JOIN g ON d.novel_id = g.novel_id AND d.mention <> g.canonical),
e AS (SELECT a.*, p.canonical, matched_names, coalesce(tier, 2) AS tier, part, shared FROM asked a JOIN p ON a.novel_id = p.novel_id AND a.mention = p.mention
      LEFT JOIN s ON s.novel_id = a.novel_id AND s.chunk_id = a.chunk_id AND s.canonical = p.canonical),
r AS (SELECT *, row_number() OVER (PARTITION BY novel_id, chunk_id, mention ORDER BY tier, CASE WHEN tier = 2 THEN -part::INT END, CASE WHEN tier = 2 THEN -shared END, canonical)::INT AS rank FROM e)"""


@query(f"WITH {CANDIDATES} SELECT novel_id, chunk_id, mention, canonical, rank, ['strong_extraction', 'strong_text', 'weak'][tier + 1] AS source, array_to_string(matched_names, '|') AS matched_names FROM r WHERE tier < 2 OR rank <= 5")
def rec3_candidates(spark, sf):
    chunks = written(C.chunk(chapters(spark, sf)))
    names = kept(extraction.mentioned(chunks))  # all of them are read several times
    index = kept(name_index(spark, sf, names))
    known = recall.known_in_extraction(names.select("novel_id", "chunk_id", "name"), index.select("novel_id", "name", "canonical"), spark.createDataFrame([], "novel_id string, name string"))
    asked = names.select("novel_id", "chunk_id", F.col("name").alias("mention"))
    out = recall.candidates(asked, index, known, kept(recall.text_mentions(chunks, index)))
    return out.withColumn("matched_names", F.array_join("matched_names", "|"))


@query("SELECT a.n_name AS a, b.n_name AS b, len(list_intersect(string_split(a.n_name, ''), string_split(b.n_name, ''))) AS shared FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def rec5_char_overlap(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_name").alias("a"), "n_regionkey"), n.select(F.col("n_name").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").select("a", "b", T.char_overlap(F.col("a"), F.col("b")).cast("long").alias("shared"))


# graph

FACTS = "facts AS (SELECT l_returnflag AS novel_id, l_orderkey AS chunk_id, (l_orderkey % 50) AS chapter_id, l_linenumber AS ordinal, 'P' || (l_partkey % 60) AS source, 'P' || (l_suppkey % 60) AS target, l_linestatus AS type, l_discount * 10 AS confidence FROM lineitem)"
PEOPLE = f"{FACTS}, people AS (SELECT novel_id, source AS name, count(DISTINCT chunk_id) AS mention_count, list_sort(list(DISTINCT chapter_id)) AS chapters, list_sort(list(DISTINCT chunk_id)) AS chunk_ids FROM facts GROUP BY ALL)"
EDGES = f"""{PEOPLE}, once AS (SELECT * FROM facts WHERE source <> target QUALIFY row_number() OVER (PARTITION BY novel_id, source, target, type, chunk_id ORDER BY ordinal) = 1),
edges AS (SELECT novel_id, source, target, type, count(*) AS weight, avg(confidence) AS confidence, list(chunk_id ORDER BY chunk_id) AS chunk_ids, list(chunk_id ORDER BY chunk_id)[1:5] AS evidence,
          min({{'c': chunk_id, 'o': ordinal}}) AS first_seen FROM once GROUP BY ALL)"""
#: Names ending in 7 go to those ending in 3 of the same ten; P5 goes to a name that there isn't.
MERGES = "merges AS (SELECT DISTINCT novel_id, name AS drop, name[:-2] || '3' AS keep FROM people WHERE name LIKE '%7' UNION ALL SELECT DISTINCT novel_id, 'P5', 'Nobody' FROM people)"


def facts(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumn("row", F.col("_metadata.row_index"))  # some orders have a line number twice, with equal ends: the table's first counts
    name = lambda c: F.concat(F.lit("P"), (F.col(c) % 60).cast("string"))
    return li.select(F.col("l_returnflag").alias("novel_id"), F.col("l_orderkey").alias("chunk_id"), (F.col("l_orderkey") % 50).alias("chapter_id"), F.col("l_linenumber").alias("ordinal"), name("l_partkey").alias("source"), name("l_suppkey").alias("target"), F.col("l_linestatus").alias("type"), (F.col("l_discount") * 10).alias("confidence"), "row")


def people(spark: SparkSession, sf: str) -> DataFrame:
    return graph.persons(facts(spark, sf).withColumnRenamed("source", "name"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.relations(facts(spark, sf))


def merges(spark: SparkSession, sf: str, names: DataFrame | None = None) -> DataFrame:
    p = people(spark, sf) if names is None else names
    seven = p.where("name LIKE '%7'").select("novel_id", F.col("name").alias("drop"), F.concat(F.expr("left(name, length(name) - 1)"), F.lit("3")).alias("keep"))
    return seven.union(p.select("novel_id").distinct().select("novel_id", F.lit("P5"), F.lit("Nobody")))


def joined(c: str) -> str:
    return f"array_to_string({c}, ',') AS {c}"


def join_lists(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.array_join(F.col(n).cast("array<string>"), ",") for n in names})


@query(f"WITH {PEOPLE} SELECT novel_id, name, mention_count, {joined('chapters')}, len(chunk_ids) AS n FROM people")
def agg1_persons(spark, sf):
    f = facts(spark, sf).withColumnRenamed("source", "name")
    sizes = graph.person_chunks(f).groupBy("novel_id", "name").agg(F.count(F.lit(1)).alias("n"))
    return join_lists(graph.persons(f, lists=False), "chapters").join(sizes, ["novel_id", "name"]).select("novel_id", "name", "mention_count", "chapters", "n")


@query(f"WITH {EDGES} SELECT novel_id, source, target, type, weight, round(confidence, 6) AS confidence, {joined('evidence')}, array_to_string(chunk_ids, ',') AS chunks FROM edges")
def agg2_relations(spark, sf):
    e = edges(spark, sf).withColumn("evidence", F.transform("evidence", lambda x: x["chunk_id"]))
    return join_lists(e, "evidence", "chunk_ids").select("novel_id", "source", "target", "type", "weight", F.round("confidence", 6).alias("confidence"), "evidence", F.col("chunk_ids").alias("chunks"))


ALIASES = "aliases AS (SELECT novel_id, source AS canonical, target AS alias, chunk_id * 10 + ordinal AS ordinal FROM facts)"


def alias_rows(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    return f.select("novel_id", F.col("source").alias("canonical"), F.col("target").alias("alias"), (F.col("chunk_id") * 10 + F.col("ordinal")).alias("ordinal"))


NAMED = f"{EDGES}, {ALIASES}, o AS (SELECT novel_id, canonical, alias, min(ordinal) AS ordinal FROM aliases WHERE alias <> canonical GROUP BY ALL), named AS (SELECT p.*, coalesce(a.aliases, []) AS aliases FROM people p LEFT JOIN (SELECT novel_id, canonical AS name, list(alias ORDER BY ordinal, alias) AS aliases FROM o GROUP BY ALL) a USING (novel_id, name))"


def named(spark: SparkSession, sf: str) -> DataFrame:
    return graph.apply_aliases(people(spark, sf), alias_rows(spark, sf))


@query(f"WITH {NAMED} SELECT novel_id, name, {joined('aliases')} FROM named")
def agg7_aliases(spark, sf):
    return join_lists(named(spark, sf), "aliases").select("novel_id", "name", "aliases")


VALID = f"{NAMED}, {MERGES}, valid AS (SELECT m.* FROM merges m JOIN people a ON a.novel_id = m.novel_id AND a.name = m.drop JOIN people b ON b.novel_id = m.novel_id AND b.name = m.keep)"
MERGED = f"""{VALID}, moved AS (SELECT n.*, coalesce(keep, name) AS dest, keep IS NOT NULL AS gone FROM named n LEFT JOIN valid v ON v.novel_id = n.novel_id AND v.drop = n.name),
names AS (SELECT novel_id, dest, gone, name, unnest(CASE WHEN gone THEN list_append(aliases, name) ELSE aliases END) AS alias, unnest(range(len(aliases) + gone::INT)) AS pos FROM moved),
alias_spots AS (SELECT novel_id, dest, alias, min({{'g': gone, 'n': name, 'p': pos}}) AS spot FROM names WHERE alias <> dest GROUP BY ALL),
merged AS (SELECT m.novel_id, m.dest AS name, len(list_distinct(flatten(list(chunk_ids)))) AS mention_count, list_sort(list_distinct(flatten(list(chapters)))) AS chapters,
           coalesce((SELECT list(alias ORDER BY spot) FROM alias_spots f WHERE f.novel_id = m.novel_id AND f.dest = m.dest), []) AS aliases FROM moved m GROUP BY ALL)"""


@query(f"WITH {MERGED} SELECT novel_id, name, mention_count, {joined('chapters')}, {joined('aliases')} FROM merged")
def agg8_merged_persons(spark, sf):
    f, m = facts(spark, sf).withColumnRenamed("source", "name"), merges(spark, sf)
    valid = graph.valid_merges(people(spark, sf), m)
    out = graph.merge_persons(graph.apply_aliases(graph.persons(f, lists=False), alias_rows(spark, sf)), m, graph.merge_person_chunks(graph.person_chunks(f), valid))
    return join_lists(out, "chapters", "aliases").select("novel_id", "name", "mention_count", "chapters", "aliases")


REDIRECTED = f"""{VALID}, r AS (SELECT e.* REPLACE (coalesce(a.keep, e.source) AS source, coalesce(b.keep, e.target) AS target) FROM edges e LEFT JOIN valid a ON a.novel_id = e.novel_id AND a.drop = e.source LEFT JOIN valid b ON b.novel_id = e.novel_id AND b.drop = e.target),
proof AS (SELECT novel_id, source, target, type, unnest(evidence) AS e, unnest(range(len(evidence))) AS pos, first_seen FROM r WHERE source <> target),
few AS (SELECT novel_id, source, target, type, list(e ORDER BY first_seen, pos)[1:5] AS evidence FROM proof GROUP BY ALL),
redirected AS (SELECT novel_id, source, target, type, len(list_distinct(flatten(list(chunk_ids)))) AS weight, sum(confidence * weight) / sum(weight) AS confidence FROM r WHERE source <> target GROUP BY ALL)"""


@query(f"WITH {REDIRECTED} SELECT novel_id, source, target, type, weight, round(confidence, 6) AS confidence, {joined('evidence')} FROM redirected JOIN few USING (novel_id, source, target, type)")
def agg9_merged_relations(spark, sf):
    f = facts(spark, sf)
    names = kept(f.select("novel_id", F.col("source").alias("name")).distinct())
    once, valid = written(graph.first_in_chunk(f)), graph.valid_merges(names, merges(spark, sf, names))
    chunks = graph.merge_relation_chunks(once.select(*graph.KEY, "chunk_id"), valid)  # each key and chunk is there once
    out = graph.merge_relations(graph.relations(once, lists=False, firsts=True), valid, chunks)
    out = join_lists(out.withColumn("evidence", F.transform("evidence", lambda x: x["chunk_id"])), "evidence")
    return out.select("novel_id", "source", "target", "type", "weight", F.round("confidence", 6).alias("confidence"), "evidence")


@query(f"WITH {EDGES} SELECT novel_id, source, target, type, weight FROM edges WHERE source NOT LIKE 'P1%' AND target NOT LIKE 'P1%'")
def agg10_confirmed_relations(spark, sf):
    p = people(spark, sf)
    return graph.drop_unconfirmed(p, edges(spark, sf), p.where("name LIKE 'P1%'"))[1].select("novel_id", "source", "target", "type", "weight")


# merging

BRIDGES = f"{FACTS}, asked AS (SELECT DISTINCT novel_id, chunk_id, type AS mention, source AS canonical FROM facts), bridges AS (SELECT a.novel_id, a.mention, a.chunk_id, a.canonical AS a, b.canonical AS b FROM asked a JOIN asked b USING (novel_id, chunk_id, mention) WHERE a.canonical < b.canonical)"


def bridges(spark: SparkSession, sf: str) -> DataFrame:
    return merging.bridge_pairs(facts(spark, sf).select("novel_id", "chunk_id", F.col("type").alias("mention"), F.col("source").alias("canonical")))


@query(f"WITH {BRIDGES} SELECT * FROM bridges")
def mrg1_bridges(spark, sf):
    return bridges(spark, sf)


@query(f"WITH {BRIDGES} SELECT novel_id, a, b, array_to_string(list(chunk_id || mention ORDER BY chunk_id, mention)[1:5], ',') AS evidence FROM bridges GROUP BY ALL")
def mrg3_pair_evidence(spark, sf):
    out = merging.pair_evidence(bridges(spark, sf))
    return out.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: F.concat(e["chunk_id"].cast("string"), e["mention"])), ","))


DECIDED = f"""{BRIDGES}, seen AS (SELECT novel_id, source AS name, min(chunk_id) AS first_seen FROM facts GROUP BY ALL), pairs AS (SELECT DISTINCT novel_id, a, b FROM bridges),
judged AS (SELECT p.novel_id, p.a, p.b, x.first_seen AS sa, y.first_seen AS sb, length(p.a || p.b) + right(p.a, 1)::INT + 10 * right(p.b, 1)::INT AS k FROM pairs p JOIN seen x ON x.novel_id = p.novel_id AND x.name = p.a JOIN seen y ON y.novel_id = p.novel_id AND y.name = p.b),
decided AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'rejected' WHEN (k % 10) / 10 < 0.5 THEN 'low_confidence' ELSE 'merged' END AS outcome, CASE WHEN (sa, a) <= (sb, b) THEN a ELSE b END AS first, CASE WHEN (sa, a) <= (sb, b) THEN b ELSE a END AS second FROM judged)"""


def decided(spark: SparkSession, sf: str) -> DataFrame:
    pairs = bridges(spark, sf).select("novel_id", "a", "b").distinct()
    seen = facts(spark, sf).groupBy("novel_id", F.col("source").alias("name")).agg(F.min("chunk_id").alias("first_seen"))
    for side in ("a", "b"):
        pairs = pairs.join(seen.select("novel_id", F.col("name").alias(side), F.col("first_seen").alias(f"{side}_first_seen")), ["novel_id", side])
    k = F.length(F.concat("a", "b")) + F.expr("int(right(a, 1))") + 10 * F.expr("int(right(b, 1))")
    answers = pairs.select("novel_id", F.col("b").alias("a"), F.col("a").alias("b"), (k % 3 != 0).alias("merge"), (k % 10 / 10).alias("confidence"), k.alias("ordinal"))
    return merging.decide(pairs, answers)


@query(f"WITH {DECIDED} SELECT novel_id, a, b, outcome, CASE WHEN outcome = 'merged' THEN first END AS keep, CASE WHEN outcome = 'merged' THEN second END AS drop FROM decided")
def mrg5_decisions(spark, sf):
    return decided(spark, sf).drop("ordinal")


@query(f"WITH {DECIDED} SELECT novel_id, second AS drop, max(k) AS at FROM decided WHERE outcome = 'merged' GROUP BY ALL")
def mrg6_merge_map(spark, sf):
    d = decided(spark, sf)
    last = d.where("outcome = 'merged'").groupBy("novel_id", "drop").agg(F.max("ordinal").cast("long").alias("at"))
    return merging.merge_map(d).join(last, ["novel_id", "drop"]).select("novel_id", "drop", "at")


@query(f"WITH {DECIDED} SELECT novel_id, count(*) AS candidate_pairs, count(*) FILTER (outcome = 'merged') AS merged_pairs, count(*) FILTER (outcome = 'rejected') AS rejected_pairs, count(*) FILTER (outcome = 'low_confidence') AS low_confidence_pairs, 0::BIGINT AS failed_pairs FROM decided GROUP BY ALL")
def mrg8_merge_stats(spark, sf):
    return merging.merge_stats(decided(spark, sf))


@query("WITH RECURSIVE m AS (SELECT c_custkey AS d, c_custkey // 3 AS k FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey >= 3), r AS (SELECT d, k, 1 AS n FROM m UNION ALL SELECT r.d, m.k, n + 1 FROM r JOIN m ON r.k = m.d) SELECT 'n' AS novel_id, d::VARCHAR AS drop, arg_max(k, n)::VARCHAR AS keep FROM r GROUP BY d")
def mrg9_roots(spark, sf):
    key = F.col("c_custkey")
    m = table(spark, sf, "customer").where((key % 5 != 0) & (key >= 3)).select(F.lit("n").alias("novel_id"), key.cast("string").alias("drop"), F.floor(key / 3).cast("string").alias("keep"))
    return merging.roots(m, kept)


# store and queries

STORED = f"{EDGES}, few_people AS (SELECT * FROM people WHERE name NOT LIKE '%9'), stored AS (SELECT e.* FROM edges e WHERE EXISTS (SELECT 1 FROM few_people p WHERE p.novel_id = e.novel_id AND p.name = e.source) AND EXISTS (SELECT 1 FROM few_people p WHERE p.novel_id = e.novel_id AND p.name = e.target))"


@query(f"WITH {STORED} SELECT novel_id, source, target, type, weight FROM stored")
def snk3_stored_relations(spark, sf):
    return graph.stored_relations(edges(spark, sf), people(spark, sf).where("name NOT LIKE '%9'")).select("novel_id", "source", "target", "type", "weight")


@query(f"WITH {PEOPLE}, twice AS (SELECT novel_id, name FROM people UNION ALL SELECT novel_id, name FROM people WHERE name LIKE 'P2%') SELECT novel_id, name, key, count(*) AS count FROM twice, (SELECT unnest(['name', 'id']) AS key) GROUP BY ALL HAVING count(*) > 1")
def snk5_duplicates(spark, sf):
    p = people(spark, sf)
    return store.duplicates(store.with_ids(p.union(p.where("name LIKE 'P2%'"))))


@query("SELECT DISTINCT coalesce(source, '') AS novel_id, 'Title of ' || coalesce(source, '') AS title FROM documents")
def qry1_novels(spark, sf):
    return store.list_novels(sections(spark, sf).select("novel_id").distinct().withColumn("title", F.concat(F.lit("Title of "), F.col("novel_id"))))


@query(f"WITH {EDGES} SELECT 'A' AS novel_id, 'Book A' AS title, (SELECT count(*) FROM people WHERE novel_id = 'A') AS persons, (SELECT count(*) FROM edges WHERE novel_id = 'A') AS relationships")
def qry2_get_novel(spark, sf):
    return store.get_novel(spark.createDataFrame([("A", "Book A"), ("N", "Book N")], "novel_id string, title string"), people(spark, sf), edges(spark, sf), "A")


@query(f"WITH {NAMED} SELECT name, mention_count, {joined('aliases')} FROM named WHERE novel_id = 'N' AND (contains(name, 'P3') OR len(list_filter(aliases, lambda a: contains(a, 'P3'))) > 0) ORDER BY mention_count DESC, name LIMIT 10")
def qry3_search(spark, sf):
    return join_lists(store.search(named(spark, sf), "N", "P3"), "aliases").select("name", "mention_count", "aliases")


def written_graph(spark: SparkSession, sf: str) -> str:
    """Folder of a graph written as a user writes it: persons with aliases, relations, look-ups."""
    path = new_folder(spark, "graphs")
    p = kept(named(spark, sf))
    store.write_novels(p.select("novel_id").distinct().withColumn("title", F.col("novel_id")), p, edges(spark, sf), path)
    return path


@query(f"WITH {NAMED} SELECT name, mention_count, {joined('aliases')} FROM named WHERE novel_id = 'N' AND (contains(name, 'P3') OR len(list_filter(aliases, lambda a: contains(a, 'P3'))) > 0) ORDER BY mention_count DESC, name LIMIT 10")
def qry3_search_written(spark, sf):
    return join_lists(store.search_written(spark, written_graph(spark, sf), "N", "P3"), "aliases").select("name", "mention_count", "aliases")


@query(f"WITH {NAMED} SELECT name, mention_count, {joined('aliases')} FROM named WHERE novel_id = 'N' AND (contains(name, 'P3') OR len(list_filter(aliases, lambda a: contains(a, 'P3'))) > 0) ORDER BY mention_count DESC, name LIMIT 8")
def ui3_search_box(spark, sf):
    """What the search box shows: eight persons."""
    return join_lists(store.search(named(spark, sf), "N", "P3", 8), "aliases").select("name", "mention_count", "aliases")


@query(f"WITH {EDGES} SELECT source, target, type, weight FROM edges WHERE novel_id = 'A' AND (source = 'P7' OR target = 'P7')")
def qry5_one_hop_written(spark, sf):
    return store.one_hop_written(spark, written_graph(spark, sf), "A", "P7").select("source", "target", "type", "weight")


@query(f"WITH {NAMED} SELECT 'novels' AS t, novel_id, count(*) AS n FROM (SELECT DISTINCT novel_id FROM people) GROUP BY ALL UNION ALL SELECT 'persons', novel_id, count(*) FROM named GROUP BY ALL UNION ALL SELECT 'relates_to', novel_id, count(*) FROM edges GROUP BY ALL")
def snk1_snk2_written_graph(spark, sf):
    """Rows of each novel in each table of a graph that was written twice; the second write replaces the first."""
    path, p, e = new_folder(spark, "graphs"), kept(named(spark, sf)), kept(edges(spark, sf))
    titles = p.select("novel_id").distinct().withColumn("title", F.col("novel_id"))
    store.write_novels(titles, p.where("name LIKE 'P1%'"), e, path)
    store.write_novels(titles, p, e, path)
    now = store.snapshot(spark, path)
    return reduce(DataFrame.union, [now[t].groupBy("novel_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "novel_id", "n") for t in store.TABLES])


@query(f"WITH {PEOPLE} SELECT novel_id, name, mention_count, sha256(novel_id || chr(31) || name) AS id FROM people WHERE name = 'P12' AND novel_id = 'R'")
def qry4_get_character(spark, sf):
    p = store.with_ids(people(spark, sf))
    wanted = p.where("novel_id = 'R' AND name = 'P12'").select("id")
    return p.join(wanted, "id", "left_semi").select("novel_id", "name", "mention_count", "id")


@query(f"WITH {EDGES} SELECT source, target, type, weight FROM edges WHERE novel_id = 'A' AND (source = 'P7' OR target = 'P7')")
def qry5_one_hop_edges(spark, sf):
    return store.one_hop_edges(edges(spark, sf), "A", "P7").select("source", "target", "type", "weight")


@query(f"WITH {EDGES}, near AS (SELECT unnest([source, target]) AS name FROM edges WHERE novel_id = 'A' AND (source = 'P7' OR target = 'P7')) SELECT p.name, mention_count, p.name = 'P7' AS is_center FROM people p WHERE novel_id = 'A' AND name IN (SELECT name FROM near)")
def qry5_one_hop_nodes(spark, sf):
    return store.one_hop_nodes(edges(spark, sf), people(spark, sf), "A", "P7").select("name", "mention_count", "is_center")


@query(f"WITH {EDGES}, e AS (SELECT novel_id, source, target, type, unnest(evidence) AS c FROM edges WHERE novel_id = 'A' AND source = 'P7') SELECT source, target, type, string_agg(CASE WHEN c % 50 < 40 THEN 'Chapter ' || (c % 50) ELSE '' END, '|' ORDER BY c) AS titles FROM e GROUP BY ALL")
def qry5_evidence_titles(spark, sf):
    titles = spark.range(40).select(F.lit("A").alias("novel_id"), F.col("id").alias("chapter_id"), F.concat(F.lit("Chapter "), F.col("id").cast("string")).alias("chapter_title"))
    out = store.with_titles(edges(spark, sf).where("novel_id = 'A' AND source = 'P7'"), titles)
    return out.select("source", "target", "type", F.array_join(F.transform("evidence", lambda e: e["chapter_title"]), "|").alias("titles"))


@query(f"WITH {EDGES} SELECT novel_id, (SELECT count(*) FROM people p WHERE p.novel_id = n.novel_id) AS persons, (SELECT count(*) FROM edges e WHERE e.novel_id = n.novel_id) AS relationships FROM (SELECT DISTINCT novel_id FROM people) n")
def qry6_counts(spark, sf):
    return store.counts(people(spark, sf), edges(spark, sf))


@query("SELECT 'ok' AS status")
def qry7_health(spark, sf):
    return store.health(spark)


# resume: orders are chunks, F is done, P failed

MANIFESTS = "m AS (SELECT o_custkey % 100 AS content_hash, o_orderpriority AS config_fingerprint, o_orderdate AS updated_at, o_orderkey AS novel_id FROM orders)"


@query(f"WITH {MANIFESTS} SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY content_hash, config_fingerprint ORDER BY updated_at DESC, novel_id) = 1")
def ckp2_latest_manifests(spark, sf):
    o = table(spark, sf, "orders")
    return resume.latest_manifests(o.select((F.col("o_custkey") % 100).alias("content_hash"), F.col("o_orderpriority").alias("config_fingerprint"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("novel_id")))


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("new")
    return table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("novel_id"), F.col("o_orderkey").alias("chunk_id"), status.alias("status"), F.lit(1).alias("attempts"), F.col("o_orderpriority").alias("config_fingerprint"), F.lit(None).cast("string").alias("error"))


TASKS = "tasks AS (SELECT o_custkey % 10 AS novel_id, o_orderkey AS chunk_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'new' END AS status, 1 AS attempts, o_orderpriority AS config_fingerprint FROM orders)"


@query(f"WITH {TASKS} SELECT novel_id, chunk_id FROM tasks WHERE NOT (status = 'completed' AND config_fingerprint = '1-URGENT')")
def ckp4_todo(spark, sf):
    t = tasks(spark, sf)
    return resume.todo(t, resume.completed(t, "1-URGENT")).select("novel_id", "chunk_id")


@query(f"WITH {TASKS} SELECT novel_id, chunk_id, CASE WHEN status = 'completed' THEN 'completed' ELSE 'again' END AS status, CASE WHEN status = 'completed' THEN 1 ELSE 2 END AS attempts FROM tasks")
def ckp5_combined(spark, sf):
    t = tasks(spark, sf)
    new = resume.with_attempts(t.where("status <> 'completed' OR chunk_id % 3 = 0").withColumn("status", F.lit("again")), t)
    return resume.combine(t.where("status = 'completed'"), new).select("novel_id", "chunk_id", "status", "attempts")


@query(f"WITH {TASKS}, n AS (SELECT DISTINCT novel_id FROM tasks), f AS (SELECT novel_id, count(*) AS c FROM tasks WHERE status = 'failed' AND novel_id < 5 GROUP BY 1), j AS (SELECT novel_id, count(*) AS c FROM tasks WHERE status = 'failed' AND novel_id = 7 GROUP BY 1) SELECT novel_id, coalesce(f.c, 0) AS chunk_failures, coalesce(j.c, 0) AS judge_failures, 0::BIGINT AS merge_failures, coalesce(f.c, 0) + coalesce(j.c, 0) = 0 AS complete, CASE WHEN coalesce(f.c, 0) + coalesce(j.c, 0) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM n LEFT JOIN f USING (novel_id) LEFT JOIN j USING (novel_id)")
def ckp9_job3_admission(spark, sf):
    t = tasks(spark, sf)
    bad = resume.failed(t)
    return resume.admission(t, bad.where("novel_id < 5"), bad.where("novel_id = 7"), bad.where("novel_id < 0"))


@query(f"WITH {TASKS} SELECT novel_id, chunk_id, 'r' || chunk_id AS result FROM tasks WHERE status = 'completed' AND config_fingerprint = '1-URGENT'")
def ckp13_assembled(spark, sf):
    t = tasks(spark, sf)
    done = resume.completed(t, "1-URGENT").withColumn("result", F.concat(F.lit("r"), F.col("chunk_id").cast("string")))
    return resume.assembled(t.select("novel_id", "chunk_id"), done)


@query("WITH b AS (SELECT l_orderkey AS c, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 3 > 0 GROUP BY 1), a AS (SELECT l_orderkey AS c, count(*) AS n FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY 1) SELECT coalesce(a.c, b.c) AS chunk_id, coalesce(a.n, 0) - coalesce(b.n, 0) AS added FROM a FULL JOIN b ON a.c = b.c")
def ckp14_call_deltas(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "chunk_id")
    calls = lambda test: li.where(test).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("calls"))
    return resume.call_deltas(calls("l_linenumber <= 2 AND chunk_id % 3 > 0"), calls("chunk_id % 5 > 0"))


@query(f"WITH {NAMED}, l AS (SELECT * FROM named WHERE novel_id = 'A'), r AS (SELECT * FROM named WHERE novel_id = 'N' AND name NOT LIKE 'P1%'), b AS (SELECT coalesce(l.name, r.name) AS name, l.name IS NULL AS ol, r.name IS NULL AS orr, list_sort(l.aliases) <> list_sort(r.aliases) AS al, l.mention_count <> r.mention_count AS mc FROM l FULL JOIN r ON l.name = r.name) SELECT name, unnest(CASE WHEN orr THEN ['only_left'] WHEN ol THEN ['only_right'] ELSE list_filter([CASE WHEN al THEN 'aliases' END, CASE WHEN mc THEN 'mention_count' END], lambda x: x IS NOT NULL) END) AS kind FROM b")
def ckp15_graph_diff(spark, sf):
    p = named(spark, sf)
    return resume.graph_diff(p.where("novel_id = 'A'"), p.where("novel_id = 'N' AND name NOT LIKE 'P1%'"))


# lineage: a user's events are those of a mention

EVENT = "ev AS (SELECT 'm' || user_id AS mention, event_id AS ordinal, CASE event_id % 5 WHEN 0 THEN 'mention_enter' WHEN 1 THEN 'recall' WHEN 2 THEN 'judge' WHEN 3 THEN 'admission' ELSE 'registration' END AS event, CASE WHEN user_id % 7 < 2 THEN NULL ELSE 'descriptive' END AS extraction_category, CASE WHEN user_id % 11 = 0 THEN 'generic' END AS hygiene_category, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 2 END AS candidates, true AS judge_called, CASE WHEN user_id % 5 > 1 THEN 'x' END AS resolves_to, CASE WHEN user_id % 13 = 0 THEN 'blocked' WHEN user_id % 13 = 1 THEN 'skipped_hardfilter' ELSE 'accept' END AS admission, user_id % 4 = 0 AS registered, CASE WHEN user_id % 8 = 0 THEN 'a' || user_id % 3 END AS alias_to, 'm' || user_id AS final_canonical FROM events)"


def sample_events(spark: SparkSession, sf: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    kind = F.get(F.array(*[F.lit(x) for x in ("mention_enter", "recall", "judge", "admission", "registration")]), (e % 5).cast("int"))
    mention = F.concat(F.lit("m"), u.cast("string"))
    return table(spark, sf, "events").select(
        mention.alias("mention"), e.alias("ordinal"), kind.alias("event"), F.when(u % 7 >= 2, "descriptive").alias("extraction_category"), F.when(u % 11 == 0, "generic").alias("hygiene_category"),
        F.when(u % 3 == 0, 0).otherwise(2).alias("candidates"), F.lit(True).alias("judge_called"), F.when(u % 5 > 1, "x").alias("resolves_to"),
        F.when(u % 13 == 0, "blocked").when(u % 13 == 1, "skipped_hardfilter").otherwise("accept").alias("admission"), (u % 4 == 0).alias("registered"),
        F.when(u % 8 == 0, F.concat(F.lit("a"), (u % 3).cast("string"))).alias("alias_to"), mention.alias("final_canonical"),
    )


@query(
    f"WITH {EVENT}, f AS (SELECT mention, count(*) FILTER (event = 'mention_enter' AND coalesce(hygiene_category, extraction_category) IS NULL) > 0 AS plain, count(*) FILTER (event = 'recall') > 0 AS recalled, count(*) FILTER (event = 'recall' AND candidates > 0) > 0 AS found,"
    " count(*) FILTER (event = 'judge' AND resolves_to IS NULL) > 0 AS jnull, count(*) FILTER (event = 'admission' AND admission = 'blocked') > 0 AS refused, arg_max(admission, ordinal) FILTER (event = 'admission') AS adm, coalesce(arg_max(registered, ordinal) FILTER (event = 'registration'), false) AS reg,"
    " arg_max(alias_to, ordinal) FILTER (event = 'registration') AS alias_to, arg_max(final_canonical, ordinal) FILTER (event = 'registration') AS fc FROM ev GROUP BY mention),"
    " q AS (SELECT mention, CASE WHEN substring(mention, 2)::BIGINT % 2 = 0 THEN 'a1' END AS expect FROM f UNION ALL SELECT 'nobody', NULL UNION ALL SELECT 'raw', 'x'),"
    " g AS (SELECT q.*, f.* EXCLUDE (mention), CASE WHEN reg THEN alias_to END AS alias, CASE WHEN reg AND alias_to IS NULL THEN fc END AS own FROM q LEFT JOIN f USING (mention)),"
    " h AS (SELECT *, CASE WHEN plain THEN 'CATEGORY_LAYER_D5' WHEN recalled AND NOT found THEN 'RECALL_LAYER' WHEN jnull THEN 'JUDGE_LAYER' WHEN refused THEN 'ADMISSION_LAYER' WHEN coalesce(alias, own) IN ('a0', 'm4') THEN 'MERGE_LAYER' END AS fixed FROM g)"
    " SELECT mention, expect, CASE WHEN reg IS NULL THEN CASE WHEN mention = 'raw' THEN 'CHAIN_BREAK' ELSE 'EXTRACTION_LAYER' END WHEN expect IS NOT NULL THEN CASE WHEN coalesce(alias = expect, false) OR coalesce(own = expect, false) OR coalesce(alias = 'a2', false) THEN 'SUCCESS' ELSE coalesce(fixed, CASE WHEN own <> expect THEN 'REGISTRATION_LAYER' END, 'UNKNOWN') END"
    " WHEN alias IS NOT NULL THEN 'SUCCESS_ALIAS' WHEN own IS NOT NULL THEN 'SUCCESS_CANONICAL' ELSE coalesce(fixed, CASE WHEN adm = 'skipped_hardfilter' THEN 'HYGIENE_LAYER' WHEN adm IS NOT NULL THEN 'ADMISSION_LAYER' ELSE 'UNKNOWN' END) END AS verdict FROM h"
)
def dia1_verdicts(spark, sf):
    ev = sample_events(spark, sf)
    expected = lineage.all_mentions(ev).withColumn("expect", F.when(F.expr("bigint(substring(mention, 2)) % 2 = 0"), "a1")).union(spark.createDataFrame([("nobody", None), ("raw", "x")], "mention string, expect string"))
    drops = spark.createDataFrame([("a0", "k"), ("m4", "k")], "canonical string, keep string")
    snap = spark.createDataFrame([("a2", ["a1", "z"])], "canonical string, aliases array<string>")
    return lineage.diagnose(ev, expected, drops, snap, spark.createDataFrame([("raw",)], "name string"), False)


@query(f"WITH {EVENT} SELECT DISTINCT mention FROM ev")
def dia6_mentions(spark, sf):
    return lineage.all_mentions(sample_events(spark, sf))


# evaluation: outcomes of runs from labels

RUNS = "runs AS (SELECT 'r' || doc_id % 4 AS run_id, 'c' || doc_id // 4 % 60 AS check_id, CASE WHEN doc_id % 9 = 0 THEN 'SKIP' WHEN quality = 1 THEN 'PASS' ELSE 'FAIL' END AS outcome FROM labels), stable AS (SELECT check_id, count(*) FILTER (outcome = 'PASS') AS passes, count(*) FILTER (outcome = 'FAIL') AS fails, count(*) AS runs FROM runs GROUP BY 1), classed AS (SELECT *, passes + fails AS decisive, CASE WHEN passes + fails < 2 THEN 'unclassified' WHEN passes = 0 OR fails = 0 THEN 'stable' ELSE 'variance' END AS classification FROM stable)"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    outcome = F.when(d % 9 == 0, "SKIP").when(F.col("quality") == 1, "PASS").otherwise("FAIL")
    return table(spark, sf, "labels").select(F.concat(F.lit("r"), (d % 4).cast("string")).alias("run_id"), F.concat(F.lit("c"), (F.floor(d / 4) % 60).cast("string")).alias("check_id"), outcome.alias("outcome"))


@query(f"WITH {RUNS} SELECT *, CASE WHEN classification = 'stable' THEN fails = 0 END AS satisfies_expected FROM classed")
def evl6_stability(spark, sf):
    return evaluation.stability(runs(spark, sf))


@query(f"WITH {RUNS} SELECT CASE WHEN count(*) FILTER (classification = 'stable' AND fails > 0) > 0 THEN 'INVALID_NOT_REGRESSION_SAFE' ELSE 'VALID' END AS status FROM classed")
def evl7_baseline_status(spark, sf):
    return evaluation.baseline_status(evaluation.stability(runs(spark, sf)))


@query(
    f"WITH {RUNS}, d AS (SELECT check_id, outcome, count(*) AS n FROM runs GROUP BY 1, 2), s AS (SELECT check_id, string_agg(outcome || ':' || n, ',' ORDER BY outcome) AS distribution FROM d GROUP BY 1)"
    " SELECT check_id, classification, CASE WHEN classification = 'stable' THEN fails = 0 END AS satisfies_expected, decisive, distribution, coalesce(decisive = 1 AND fails = 1, false) AS doubtful,"
    " CASE WHEN (SELECT count(*) FROM classed WHERE classification = 'stable' AND fails > 0) > 0 THEN 'INVALID_NOT_REGRESSION_SAFE' ELSE 'VALID' END AS baseline_status FROM classed JOIN s USING (check_id)"
)
def evl7_baseline(spark, sf):
    r = runs(spark, sf)
    base = evaluation.aggregate(r, r.select("run_id").distinct().withColumn("corpus", F.lit("c")), ["corpus"])
    shown = F.array_join(F.transform(F.map_entries("distribution"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return base.select("check_id", "classification", "satisfies_expected", "decisive", shown.alias("distribution"), F.col("note").isNotNull().alias("doubtful"), "baseline_status")


@query(f"WITH {RUNS}, one AS (SELECT check_id, max(outcome) AS outcome FROM runs WHERE run_id = 'r1' GROUP BY 1) SELECT check_id, outcome, CASE WHEN outcome = 'SKIP' THEN 'SKIP' WHEN classification = 'stable' THEN CASE WHEN outcome = 'PASS' THEN 'PASS' ELSE 'REGRESSION' END ELSE 'OBSERVATION' END AS verdict, coalesce(outcome <> 'SKIP' AND classification <> 'stable' AND decisive > 0 AND outcome <> CASE WHEN passes >= fails THEN 'PASS' ELSE 'FAIL' END, false) AS drift FROM one LEFT JOIN classed USING (check_id)")
def evl8_compare(spark, sf):
    r = runs(spark, sf)
    one = r.where("run_id = 'r1'").groupBy("check_id").agg(F.max("outcome").alias("outcome"))
    return evaluation.compare(one, evaluation.stability(r))


SNAPSHOTS = [
    ("n1", [("傩送", ["二老", "老二"]), ("天保", []), ("祖父", ["爷爷"]), ("顺顺", ["爹爹", "父亲"]), ("杨马兵", [])], ["Novel", "Person"], ["n1"], {"二老": ["傩送"]}, {"nonbody_canonical_count": 0}, {"failed_blocks": 0, "merge_candidate_pairs": 2, "failed_pairs": 2}, False, []),
    ("n2", [("傩送", []), ("二老", []), ("老船夫", []), ("祖父", []), ("大儿子", [])], ["Other"], ["n1"], {"二老": ["傩送", "x"]}, {"nonbody_canonical_count": 2}, {}, True, []),
    ("n3", [("顺顺", [])], None, None, {}, {}, {"merge_candidate_pairs": 0}, None, [3]),
]
#: What the rules give on these snapshots, worked out by hand; I stands for INCONCLUSIVE, O for OBSERVATION.
EXPECTED = {
    "n1": "A1 PASS A2 FAIL A3 FAIL A4 PASS A5 PASS A6 PASS A7 O B1 PASS B2 SKIP C1 FAIL C2 SKIP C3 PASS C4 FAIL C5 O D1 PASS D2 SKIP D3 PASS E1 SKIP F1 I G1 PASS G2 SKIP G3 PASS G4 O G5 PASS",
    "n2": "A1 FAIL A2 SKIP A3 FAIL A4 FAIL A5 SKIP A6 FAIL A7 O B1 FAIL B2 SKIP C1 SKIP C2 SKIP C3 SKIP C4 SKIP C5 O D1 FAIL D2 SKIP D3 FAIL E1 SKIP F1 SKIP G1 FAIL G2 SKIP G3 FAIL G4 SKIP G5 FAIL",
    "n3": "A1 I A2 I A3 I A4 I A5 SKIP A6 I A7 O B1 SKIP B2 SKIP C1 PASS C2 SKIP C3 I C4 I C5 O D1 I D2 SKIP D3 I E1 SKIP F1 O G1 SKIP G2 SKIP G3 SKIP G4 SKIP G5 SKIP",
}
LONG = {"O": "OBSERVATION", "I": "INCONCLUSIVE"}


@query("SELECT * FROM " + values([(n, c, LONG.get(o, o)) for n, s in EXPECTED.items() for c, o in zip(s.split()[::2], s.split()[1::2], strict=True)], "novel_id, check_id, outcome"))
def evl1_check_outcomes(spark, sf):
    return evaluation.evaluate(evaluation.checkset(spark), spark.createDataFrame(SNAPSHOTS, evaluation.SNAPSHOT))


@query("SELECT l_returnflag AS novel_id, 'Q' || l_partkey AS name FROM lineitem GROUP BY ALL HAVING count(*) FILTER (l_orderkey % 50 >= 47) = 0")
def evl11_nonbody_canonicals(spark, sf):
    """The last three chapters are the body: some persons are in others only."""
    seen = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("novel_id"), F.col("l_orderkey").alias("chunk_id"), (F.col("l_orderkey") % 50).alias("chapter_id"), F.concat(F.lit("Q"), F.col("l_partkey").cast("string")).alias("name"))
    ch = spark.range(50).select(F.explode(F.array(*map(F.lit, "ANR"))).alias("novel_id"), F.col("id").alias("chapter_id"), F.when(F.col("id") >= 47, "body").otherwise("epigraph").alias("section_type"))
    return evaluation.nonbody_canonicals(graph.persons(seen), ch)


@query(
    f"WITH {CHUNKS}, h AS (SELECT novel_id, chunk_id, text, string_split(text, 'the th') AS p FROM chunks WHERE contains(text, 'the th')),"
    " o AS (SELECT novel_id, chunk_id, text, unnest(range(1, len(p))) AS k, p FROM h), s AS (SELECT novel_id, chunk_id, text, list_sum(list_transform(p[1:k], lambda x: length(x)))::BIGINT + (k - 1) * 6 AS start FROM o),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY novel_id ORDER BY chunk_id, start) AS i FROM s) SELECT novel_id, 'X' AS name, 'the th' AS alias, chunk_id, start::INT AS start, substring(text, greatest(start - 40, 0) + 1, start + 46 - greatest(start - 40, 0)) AS context FROM r WHERE i <= 5"
)
def evl12_alias_contexts(spark, sf):
    chunks = C.chunk(chapters(spark, sf))
    return evaluation.alias_contexts(chunks, chunks.select("novel_id").distinct().select("novel_id", F.lit("X").alias("name"), F.lit("the th").alias("alias")))


@query(f"WITH {RUNS} SELECT count(*) FILTER (outcome = 'PASS') AS \"PASS\", count(*) FILTER (outcome = 'FAIL') AS \"FAIL\", count(*) FILTER (outcome = 'SKIP') AS \"SKIP\", 0::BIGINT AS \"INCONCLUSIVE\", 0::BIGINT AS \"OBSERVATION\" FROM runs")
def evl13_histogram(spark, sf):
    return evaluation.histogram(runs(spark, sf))


@query("WITH t AS (SELECT event_type AS stage, list_sort(list(value)) AS v FROM events GROUP BY 1), w AS (SELECT sum(value) AS whole FROM events) SELECT stage, len(v) AS n, round(list_sum(v), 6) AS total, v[1] AS least, v[len(v) // 2 + 1] AS median, v[len(v)] AS most, round(list_sum(v) / whole, 6) AS share FROM t, w")
def evl15_stage_profile(spark, sf):
    return evaluation.stage_profile(table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds")))


# layout

NODES = f"{EDGES}, near AS (SELECT DISTINCT unnest([source, target]) AS name FROM edges WHERE novel_id = 'A' AND (source = 'P7' OR target = 'P7')), nodes AS (SELECT name, name = 'P7' AS c FROM near), ring AS (SELECT *, (SELECT count(*) FROM nodes WHERE NOT c) AS n, row_number() OVER (ORDER BY c, name) - 1 AS i FROM nodes)"


@query(f"WITH {NODES} SELECT name, round(450 + CASE WHEN c THEN 0 ELSE least(212, 110 + 10 * n) END * cos(-pi() / 2 + 2 * pi() * i / greatest(n, 1)), 6) AS x, round(300 + CASE WHEN c THEN 0 ELSE least(212, 110 + 10 * n) END * sin(-pi() / 2 + 2 * pi() * i / greatest(n, 1)), 6) AS y FROM ring")
def ui1_radial_layout(spark, sf):
    return layout.radial(store.one_hop_nodes(edges(spark, sf), people(spark, sf), "A", "P7")).select("name", "x", "y")


@query(f"WITH {EDGES} SELECT novel_id, source, target, type, round(8 + 9 * sqrt(weight / 982.0))::INT AS radius, round(greatest(2.2, least(3.4, 1 + 0.42 * log2(weight + 1))), 6) AS width, round(round(confidence, 6) * 100)::INT AS percent FROM edges")
def ui2_ui4_sizes(spark, sf):
    e = edges(spark, sf)
    percent, _ = layout.confidence_meter(F.round("confidence", 6))
    return e.select("novel_id", "source", "target", "type", layout.node_radius(F.col("weight")).alias("radius"), F.round(layout.edge_width(F.col("weight")), 6).alias("width"), percent.alias("percent"))


# resolution, and the whole


def conversation_input(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as novels: turns are chunks, capitalised words their characters."""
    t = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("novel_id"), (F.col("turn") + 1).cast("int").alias("chunk_id"), F.lit(1).alias("chapter_id"), F.coalesce("text", F.lit("")).alias("text"))
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(extraction.NAME), F.lit(0)))
    t = t.withColumn("characters", F.transform(names, lambda n: F.struct(n.alias("name"), F.when(F.length(n) % 4 == 0, "descriptive").otherwise("person").alias("category"))))
    links = F.transform(F.slice(names, 2, F.greatest(F.size(names), F.lit(1))), lambda n: F.struct(F.get(names, F.lit(0)).alias("source"), n.alias("target"), F.lit("friendship").alias("type"), F.lit(0.5).alias("confidence")))
    return t.withColumn("relationships", links).withColumn("section_type", F.when(F.col("chunk_id") == 1, "epigraph").otherwise("body"))


def alike(text: str, pending: list[dict]) -> list[dict]:
    """A judge that answers: the first candidate with the mention's first three letters, if there is one."""
    return [{"mention": p["mention"], "resolves_to": next((c["canonical"] for c in p["candidates"] if c["canonical"][:3] == p["mention"][:3]), None)} for p in pending]


def resolved(spark: SparkSession, sf: str, lineage: bool = False) -> tuple[DataFrame, DataFrame]:
    """Inputs and decisions over conversations; `alike` reads no texts. What reads decisions of several kinds keeps them first."""
    inputs = conversation_input(spark, sf)
    return inputs, resolution.resolve(inputs, alike, lineage, judge_reads_text=False)


@query()
def res1_sequential_resolve(spark, sf):
    _, out = resolved(spark, sf)
    return out.where("kind IN ('decision', 'alias', 'register', 'promote', 'bridge', 'gone', 'counter')").select("novel_id", "kind", "chunk_id", "ordinal", "name", "target", "type", "n")


@query()
def res14_res15_relations(spark, sf):
    inputs, out = resolved(spark, sf)
    return resolution.relations(out, inputs)


@query()
def res16_dropped(spark, sf):
    return resolution.dropped(kept(resolved(spark, sf)[1].where("kind IN ('register', 'promote')")))


@query()
def res13_res18_canonicals(spark, sf):
    return join_lists(resolution.canonicals(kept(resolved(spark, sf)[1].where("kind IN ('register', 'promote', 'chunk', 'decision', 'alias')"))), "chapters", "aliases")


@query()
def mrg2_kept_bridges(spark, sf):
    return resolution.bridges(kept(resolved(spark, sf)[1].where("kind IN ('bridge', 'gone')")))


@query(
    f"WITH c AS (SELECT conv_id::VARCHAR AS novel_id, (turn + 1)::INT AS chunk_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{extraction.NAME}') AS n FROM conversations),"
    " names AS (SELECT DISTINCT novel_id, unnest(n) AS name FROM c) SELECT c.novel_id, chunk_id, name FROM c JOIN names USING (novel_id) WHERE contains(text, name)"
)
def rec2_names_in_turns(spark, sf):
    rows = resolution.prepared(conversation_input(spark, sf), with_text=False)
    return rows.select("novel_id", "chunk_id", F.explode("hits").alias("name"))


@query()
def lin1_resolver_verdicts(spark, sf):
    _, out = resolved(spark, sf, lineage=True)
    one = kept(lineage.flat_events(resolution.events(out)))
    none = lambda ddl: spark.createDataFrame([], f"novel_id string, {ddl}")
    expected = lineage.all_mentions(one, "novel_id").withColumn("expect", F.lit(None).cast("string"))
    out = lineage.diagnose(one, expected, none("canonical string, keep string"), none("canonical string, aliases array<string>"), none("name string"), none("x int").select("novel_id"))
    return out.select(F.concat_ws("/", "novel_id", "mention").alias("mention"), "expect", "verdict")


FLAGSHIP = f"""WITH {NAMES}, p AS (SELECT novel_id, name, count(DISTINCT chunk_id) AS mention_count, count(DISTINCT chapter_id) AS chapters FROM mentioned GROUP BY ALL)
SELECT novel_id, name, mention_count, chapters FROM p WHERE novel_id = 'src1' AND contains(name, 'Th') ORDER BY mention_count DESC, name LIMIT 10"""


@query(FLAGSHIP)
def flagship_characters(spark, sf):
    """Chapters, chunks, mentions, persons, and the ten most mentioned whose name has a string."""
    found = graph.persons(extraction.mentioned(C.chunk(C.number_chapters(sections(spark, sf).where("novel_id = 'src1'")))))
    out = store.search(found.withColumn("aliases", F.array().cast("array<string>")), "src1", "Th")
    return out.select("novel_id", "name", "mention_count", F.size("chapters").cast("long").alias("chapters"))
