"""Main text of web pages by two passes over their blocks.

The first pass decides blocks by length, link density and stop-word density, with the stop words of the page's
own language; where no list fits the page, by length and link density alone. The second gives what is left open
the label of its nearest decided neighbour: nearest in the page's tree, then by place. Elements that never hold
main text (navigation, footers, forms and the like) and containers marked as furniture go first. Article elements
are a hint only, and only where they hold at least as much dense text as the rest of the page: outside of them what is
middling is bad, and open blocks look for neighbours on their own side. Kept blocks are joined in page order by one
line break.

Rows: null and empty html give an empty text; each row gives one row, repeated rows the same one;
an empty table gives an empty table; unclosed comments, quotes and elements whose text isn't markup (scripts, styles,
titles and the like) end with the page, all others with what they are in, and a head where the body begins; of two
neighbours as near the one before counts.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|title|annotation-xml|annotation)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<[!?/a-zA-Z][^>]*>?",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Words that mark furniture in class, id and role values, and words that may stand beside them in one name: cookie-notice, but not side-effects.
FURNITURE = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|dialog|newsletter|subscri\w*|sidebar\w*|side|aside|widgets?|related|recommend\w*"
    r"|menu\w*|nav|navbar|navigation|breadcrumbs?|toolbar|pagination|pager|footer|footnav|comments?|respond|disqus\w*|shar(?:e|ing)|social\w*|login|signup|search|contentinfo|complementary", re.I)  # fmt: skip
BESIDE = re.compile(
    r"\d*|[a-z]|page|site|global|main|top|bottom|left|right|inner|outer|wrap(?:per)?|box|bars?|area|block|container|content|section|list|items?|links?|buttons?|btn|header|title|body|text|form|icons?|media|sticky|fixed"
    r"|inline|mobile|desktop|primary|secondary|panel|group|row|col|module|slot|unit|reader|user|posts?|articles?|stor(?:y|ies)|news|thread|policy|up|off|canvas|hidden", re.I)  # fmt: skip
#: Those that mark a page's head, which an article may have too.
HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)
#: Those that mark an article.
ARTICLE = re.compile(r"(?:^|\s)(?:article|post|entry|story)(?:[_-]?(?:body|content|text|main))?(?:$|\s)", re.I)
SKIP = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "label", "select", "optgroup", "option", "datalist", "fieldset", "legend"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "audio", "video", "canvas", "object", "picture",
    "math", "semantics", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mstyle", "svg", "g", "tspan",
}
#: Elements that are blocks of a container, and no containers themselves.
LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "pre", "figcaption", "caption", "summary", "address"}
#: Frequent function words by language; fixed values. Other languages are told by that none of the lists fits.
STOP = {
    "en": "the of and to in is that it was for on with as are this be by at from or an not have which",
    "de": "der die das und ist von den dem ein eine einer zu mit sich nicht auf für im des auch als an es werden",
    "fr": "le la les de et un une du que qui dans pour pas sur est par plus au avec ce il en des elle",
    "es": "el la los las y en de del que por con una un para su al lo como más no se es sus pero",
    "it": "il la di e che in un una per è non con del della le i si da al sono come gli nel anche",
    "pt": "o a de que e do da em um uma para com não os as no na por mais dos como se ao foi",
    "nl": "de het een en van in is dat op te met voor niet zijn aan er die ook als door bij naar om uit",
    "ru": "и в не на что он с как это по но из у за так же от о для бы к его был она",
}
STOPS = {k: frozenset(v.split()) for k, v in STOP.items()}
ALL_STOPS = frozenset().union(*STOPS.values())
WORD = re.compile(r"[^\W\d_]+")
#: Characters of scripts without spaces, each of which says as much as some letters.
WIDE = re.compile(r"[฀-໿က-႟ក-៿⺀-ヿ㐀-鿿가-힯豈-﫿\U00020000-\U0003ffff]")
#: Thresholds of the first pass: characters of a short and of a long block, densities of links and stop words, and the density from which a list fits a page.
SHORT, LONG, LINKS, STOP_LOW, STOP_HIGH, FITS = 70, 200, 0.5, 0.1, 0.2, 0.1
GOOD, NEAR, BAD, OPEN = "good", "near", "bad", "open"


@dataclass(slots=True)
class Block:
    text: str
    links: float  # share of its characters
    aside: bool  # in furniture
    hard: bool  # by the kind of an element, whatever its marks
    article: bool  # in an article or main element
    depth: int  # of its container
    shared: int  # least depth of the containers from the block before to this one: that of the last one that holds both


def furniture(marks: str) -> bool:
    """Whether some name among class, id and role values says furniture and nothing else."""
    for name in marks.split():
        parts = re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", name)
        marked = [bool(FURNITURE.fullmatch(p)) for p in parts]
        if any(marked) and all(m or BESIDE.fullmatch(p) for m, p in zip(marked, parts, strict=True)):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks that have text."""
    out: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool, bool, int]] = []  # open elements: name, in furniture, and by the kind of an element, in an article, containers up to it
    open_: Counter[str] = Counter()
    links = breaks = at = shared = 0

    def close_block() -> None:
        nonlocal shared
        if text:
            if s := " ".join(html.unescape("".join(text)).split()):
                n = len(" ".join(html.unescape(" ".join(linked)).split())) if linked else 0
                _, aside, hard, article, depth = stack[-1] if stack else ("", False, False, False, 0)
                out.append(Block(s, n / len(s), aside, hard, article, depth, min(shared, depth)))
                shared = depth
            text.clear()
            linked.clear()

    def pop() -> str:
        nonlocal shared
        gone = stack.pop()[0]
        open_[gone] -= 1
        shared = min(shared, stack[-1][-1] if stack else 0)
        return gone

    def add(s: str) -> None:
        nonlocal breaks
        if s:
            text.append(s)
            if links:
                linked.append(s)
            if not s.isspace():
                breaks = 0

    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1]:
                close_block() if m[1].lower() in ("iframe", "textarea") else None
            continue
        if name in VOID:
            if name == "br":
                breaks += 1
                text.append(" ")
                if breaks == 2:
                    close_block()
            elif name == "hr":
                close_block()
            continue
        if name == "a":
            links = max(0, links + (-1 if m[2] else 1))
        marks = "" if m[2] else " ".join(x for g in NAMES.findall(m[4]) for x in g if x)
        marked = bool(marks) and furniture(marks)
        opened = open_[name] > 0  # inline elements are there only if they were marked
        if name in INLINE and not marked and not (m[2] and opened):
            continue
        close_block()
        links = 0
        if m[2]:
            while opened:
                opened = pop() != name
            continue
        if m[4].endswith("/") and (":" in name or "-" in name):  # an empty element of a foreign vocabulary
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            pop()  # such an element ends where the next begins
        _, aside, hard, article, depth = stack[-1] if stack else ("", False, False, False, 0)
        article |= name in ("article", "main") or "role" in m[4] and "main" in marks.split() or name in ("div", "section") and bool(ARTICLE.search(marks))
        hard |= name in SKIP or not article and name == "header"
        aside |= hard or not article and bool(marks) and bool(HEADER.search(marks))
        if name == "article":
            marked = "comment" in marks.lower()
        aside |= marked and name not in ("html", "body", "main")
        stack.append((name, aside, hard, article, depth + (name not in LEAF)))
        open_[name] += 1
    add(page[at:])
    close_block()
    return out


def size(s: str) -> int:
    """Characters, of which those of scripts without spaces count threefold."""
    return len(s) if s.isascii() else len(s) + 2 * len(WIDE.findall(s))


def densities(found: list[Block]) -> list[float]:
    """Share of stop words in each block, by the list that fits the page's unlinked text outside of furniture best; 1 for all if none does."""
    words = [WORD.findall(b.text.lower()) for b in found]
    known, total = Counter(), 0
    for b, w in zip(found, words, strict=True):
        if not b.aside and b.links <= LINKS:
            known.update(filter(ALL_STOPS.__contains__, w))
            total += len(w)
    n = {k: sum(known[w] for w in stop) for k, stop in STOPS.items()}
    best = max(n, key=n.__getitem__)
    if n[best] < FITS * max(1, total):
        return [1.0] * len(found)
    return [sum(map(STOPS[best].__contains__, w)) / max(1, len(w)) for w in words]


def first_pass(found: list[Block]) -> list[str]:
    """good, near, bad or open, by lengths and densities."""
    out = []
    for b, density in zip(found, densities(found), strict=True):
        if b.aside or b.links > LINKS:
            out.append(BAD)
        elif (n := size(b.text)) < SHORT or density < STOP_LOW:
            out.append(OPEN)
        else:
            out.append(GOOD if density >= STOP_HIGH and n > LONG else NEAR)
    return out


def hinted(found: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block is on the article's side; all are on one side if articles hold less dense text than the rest."""
    dense = {False: 0, True: 0}
    for b, label in zip(found, labels, strict=True):
        if label in (GOOD, NEAR):
            dense[b.article] += len(b.text)
    return [b.article and not b.aside for b in found] if dense[True] >= dense[False] else [True] * len(found)


def second_pass(found: list[Block], labels: list[str], inside: list[bool]) -> list[bool]:
    """Whether each block is kept: what isn't decided goes with its nearest decided neighbour.

    Near is who shares the deeper container, then who has fewer blocks between. On a page without a good block the near ones
    are good, and without these the open ones of the container that has most of their text.
    """
    if GOOD not in labels:
        labels = [GOOD if x == NEAR else x for x in labels]
    if GOOD not in labels:
        groups: list[list[int]] = []
        for i, (b, x) in enumerate(zip(found, labels, strict=True)):
            if x == OPEN:
                same = groups and groups[-1][-1] == i - 1 and found[i - 1].depth == b.shared == b.depth
                groups[-1].append(i) if same else groups.append([i])
        for i in max(groups, key=lambda g: sum(len(found[i].text) for i in g), default=()):
            labels[i] = GOOD
    labels = [BAD if x == NEAR and not side else x for x, side in zip(labels, inside, strict=True)]
    hint = any(inside) and not all(inside)

    def nearest(order: range, step: int) -> list[tuple[int, int, str] | None]:
        """(shared depth, blocks between, label) of the first decided block on the same side in one direction."""
        out: list[tuple[int, int, str] | None] = [None] * len(labels)
        last: dict[bool, tuple[int, int, str] | None] = {False: None, True: None}
        for i in order:
            gap = found[i].shared if step > 0 else found[i + 1].shared if i + 1 < len(found) else 0
            last = {k: v and (min(v[0], gap), v[1], v[2]) for k, v in last.items()}
            if labels[i] in (GOOD, BAD):
                last[inside[i]] = (found[i].depth, i, labels[i])
            elif v := last[inside[i]]:
                out[i] = v[0], abs(v[1] - i), v[2]
        return out

    n = len(labels)
    out = []
    for label, side, before, after in zip(labels, inside, nearest(range(n), 1), nearest(range(n - 1, -1, -1), -1), strict=True):
        if label in (GOOD, BAD):
            out.append(label == GOOD)
            continue
        near = [x for x in (before, after) if x]
        out.append(min(near, key=lambda x: (-x[0], x[1]))[2] == GOOD if near else side and hint or label == NEAR)
    return out


def kept(found: list[Block]) -> str:
    labels = first_pass(found)
    return "\n".join(b.text for b, keep in zip(found, second_pass(found, labels, hinted(found, labels)), strict=True) if keep)


def main_text(page: str | None) -> str:
    """The kept blocks. Where none is, what only names mark as furniture is looked at like any other block."""
    if not page:
        return ""
    found = blocks(page)
    return kept(found) or (kept([replace(b, aside=b.hard) for b in found]) if any(b.aside and not b.hard for b in found) else "")


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), source: str = "html") -> DataFrame:
    """keep, text."""
    src = pages.select(*[F.col(c) for c in keep], F.coalesce(F.col(source), F.lit("")).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__html"):
            text = pa.array([main_text(x) for x in b.column("__html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], text], names=[*keep, "text"])

    return src.mapInArrow(run, src.drop("__html").withColumn("text", F.lit("")).schema)
