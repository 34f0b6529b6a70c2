"""Closed vocabularies and row types of the character-graph tables. Every table carries novel_id."""

SECTIONS = ("metadata", "epigraph", "body", "trailer")
CATEGORIES = ("person", "generic", "collective", "descriptive", "composite", "invalid")
RELATION_TYPES = ("love", "family", "friendship", "enmity", "alliance", "mentorship", "other")
MAX_NAME = 50

CHARACTER = "struct<name:string,category:string>"
RELATIONSHIP = "struct<source:string,target:string,type:string,confidence:double>"
EXTRACTION = f"struct<characters:array<{CHARACTER}>,relationships:array<{RELATIONSHIP}>>"

CHAPTERS = "novel_id string, chapter_id int, chapter_title string, text string, section_type string"
CHUNKS = "novel_id string, chunk_id int, chapter_id int, chapter_title string, text string, start_offset int, end_offset int, section_type string"
EXTRACTIONS = f"novel_id string, chunk_id int, status string, attempts int, error string, seconds double, result {EXTRACTION}"
#: What the resolver emits in one pass: rows of several kinds, told apart by `kind`.
RESOLUTION = (
    "novel_id string, kind string, chunk_id int, chapter_id int, ordinal int, name string, target string, type string, confidence double, n bigint, flag boolean, text string, names array<string>"
)


def columns(ddl: str) -> list[str]:
    """Names of the top-level fields."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i].split()[0])
            start = i + 1
    return out
