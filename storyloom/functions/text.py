"""Column functions over texts and names; all of them stay in the JVM.

Patterns are written so that Java and RE2 read them alike; white space is that of Python's str.strip().
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BREAKS = r"\x{A}-\x{D}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}"
BREAK = rf"\r\n|[{BREAKS}]"

#: Words and patterns of the section rules; fixed values, tuned to Chinese editions.
TITLE_WORDS = {"版权": "metadata", "目录": "metadata", "题记": "epigraph", "新题记": "epigraph", "序": "epigraph", "前言": "epigraph", "引言": "epigraph", "跋": "trailer", "后记": "trailer", "致谢": "trailer", "广告": "trailer", "推广": "trailer"}
FIRST_LINE_WORDS = {"版权信息": "metadata", "作者：": "metadata", "题记": "epigraph", "新题记": "epigraph", "关注公众号": "trailer", "微信搜索": "trailer", "mp.weixin": "trailer"}
CHAPTER_NUMBER = rf"^第[一二三四五六七八九十百0-9]+[章节回]|^[一二三四五六七八九十]+$|^[一二三四五六七八九十]+(?:{BLANK}|[、.．])"
#: Mention rules; fixed values.
COLLECTIVE = "^(?:[一二两三四五六七八九十百多诸]+个?(?:儿子|兄弟|儿女|子女|姐妹|弟兄)|兄弟[一二两三四五六七八九十]+人|父子[一二两三四五六七八九十]+人|两弟兄|[一二两三四五六七八九十百多诸]+个?(?:小孩|孩子|女子|男子|青年|老人|妇人)们?)$"
INVALID = rf"^(?:{BLANK}*|\p{{Nd}}+|[!@#$%^&*()_+=\[\]{{}};':\"\\|,.<>/?~`-]+)$"
GENERIC = ("兄弟", "哥哥", "弟弟", "姐姐", "妹妹", "儿子", "女儿", "妻子", "丈夫", "祖母", "外婆", "外公", "叔叔", "婶婶", "侄儿", "侄女")
SENIOR = ("父", "爸", "爹", "母", "妈", "娘", "婆", "奶")
OF = "^(.{1,4})的(.{1,8})$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", "")


def lines(x: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(x, BREAK, -1), strip), lambda s: s != "")


def html_text(html: Column) -> Column:
    """Text of markup: tags go, five character references are decoded once, lines are stripped and blank ones go."""
    x = F.regexp_replace(html, "<[^>]+>", "")
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):  # & last: what it makes isn't read again
        x = F.replace(x, F.lit(ref), F.lit(char))
    return F.array_join(lines(x), "\n")


def chapter_title(title: Column, chapter_id: Column) -> Column:
    return F.coalesce(F.nullif(strip(title), F.lit("")), F.format_string("第%d章", chapter_id))


def first_line(text: Column) -> Column:
    """The first of lines(text), or null; what comes after it isn't looked at."""
    line = F.regexp_extract(text, f"^{BLANK}*([^{BREAKS}]*)", 1)  # every break is blank too
    return F.nullif(F.regexp_replace(line, f"{BLANK}+$", ""), F.lit(""))


def section_type(title: Column, text: Column, place: Column, total: Column, first: Column | None = None) -> Column:
    """Title words, words of the first line, a chapter number there, place and length, in this order; else body. place from 0.

    first: first_line(text) where a column has it already; else each rule works it out anew.
    """
    first = first_line(text) if first is None else first
    title, first, size = strip(F.coalesce(title, F.lit(""))), F.coalesce(first, F.lit("")), F.length(text)
    rules = [(title.contains(w), s) for w, s in TITLE_WORDS.items()] + [(first.contains(w), s) for w, s in FIRST_LINE_WORDS.items()]
    rules += [(first.rlike(CHAPTER_NUMBER), "body"), ((place == 0) & (size <= 200) & text.rlike("版权|作者"), "metadata"), ((place == total - 1) & (size <= 500) & text.rlike(r"公众号|微信|mp\.weixin"), "trailer")]
    out = F.lit("body")
    for test, section in reversed(rules):
        out = F.when(test, section).otherwise(out)
    return out


def mention_class(name: Column) -> Column:
    """invalid, collective, generic or null, in this order."""
    return F.when(name.isNull() | (F.length(name) > 50) | name.rlike(INVALID), "invalid").when(name.rlike(COLLECTIVE), "collective").when(name.isin(*GENERIC), "generic")


def hard_filtered(name: Column) -> Column:
    return F.coalesce(mention_class(name).isin("collective", "invalid"), F.lit(False))


def effective_category(name: Column, category: Column) -> Column:
    return F.when(name.isin(*GENERIC), "generic").otherwise(category)


def senior(name: Column) -> Column:
    return F.substring(name, 1, 1).isin(*SENIOR)


def present(text: Column, names: Column) -> Column:
    """Whether any of the names is in the text."""
    return F.exists(names, lambda n: F.contains(text, n))


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def char_overlap(a: Column, b: Column) -> Column:
    """Distinct characters that two names share."""
    return F.size(F.array_intersect(characters(a), characters(b)))


def node_id(novel_id: Column, name: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", novel_id, name), 256)
