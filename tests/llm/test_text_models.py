"""HTML extraction, toxicity, quality and BPE: held-out accuracy, exact round trips, odd rows."""

import hashlib

import numpy as np
import pytest

from storyloom.llm import bpe, html_extract, quality_model, toxicity

PROSE = "This is the text of the article and it is long enough to be seen as good because it has many of the words that every text has, and it is as it was meant to be by those who wrote it for this test of ours."


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    one = y == 1
    return (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("<p>", ""),
        (f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{PROSE}<p>Short.</article><footer>&copy; the of and</footer>", f"Title\n{PROSE}\nShort."),
        (f"<div><p>{PROSE}</p><p>Short.</p></div><div class='comments'><p>{PROSE}</p></div>", f"{PROSE}\nShort."),
        (f"<article><p>a &amp;amp; b&nbsp;&lt;c&gt; {PROSE}</p><script>var x='</p>';</script><style>p{{}}</style><!-- no --></article>", f"a &amp; b <c> {PROSE}"),
        (f"<article><p>{PROSE}</p><aside>{PROSE}</aside><form><p>{PROSE}</p></form><div id=cookie-notice>{PROSE}</div></article>", PROSE),
        (f"<div class='page-header'>{PROSE}</div><div class='post-content'><div class=entry-header><h2>Title</h2></div><p>{PROSE}</div><p>{PROSE}", f"Title\n{PROSE}\n{PROSE}"),  # an article is a hint only: long dense text beside it stays
        (f"<div class='page-header'>{PROSE}</div><div class='post-content'><p>{PROSE}</div><p>{PROSE[:150]}", PROSE),
        (f"<div role=main><p>{PROSE}<br>more<br><br>apart {PROSE}</div><section class=reader-comments><p>{PROSE}</section>", f"{PROSE} more\napart {PROSE}"),
        (f"<body><ul class=menu><li><a href=1>{PROSE}</a></li></ul><p>{PROSE}</p><!-- open", PROSE),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_main_text_beside_a_teaser_article():
    teaser = "<article><h2>Next</h2><p>It is the teaser of an other text that you can read here.</p></article>"
    for page in (f"<div><p>{PROSE}</p><p>More: {PROSE}</p></div>{teaser}", f"{teaser.replace('article', 'section')}<div class=post>Short.</div><p>{PROSE}</p><p>More: {PROSE}</p>"):
        assert f"{PROSE}\nMore: {PROSE}" in html_extract.main_text(page)


@pytest.mark.parametrize("mark", ["class=side-effects", "id=share-price", "class='search-for-meaning notices-of-1850'"])
def test_names_of_sections_are_not_furniture(mark):
    assert html_extract.main_text(f"<article><p>{PROSE}</p><section {mark}><p>{PROSE}</p></section></article>") == f"{PROSE}\n{PROSE}"


@pytest.mark.parametrize("mark", ["class=side", "class='x ad-slot-2'", "id=commentList", "class=related_posts", "role=navigation", "class=newsletter-signup-box"])
def test_names_of_furniture(mark):
    assert html_extract.main_text(f"<div><p>{PROSE}</p><div {mark}><p>{PROSE}</p></div></div>") == PROSE


def test_contents_of_other_vocabularies_stay():
    page = f"<div><p>{PROSE} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> <object>plain</object> <svg><path d=''/><text>label</text></svg></p></div>"
    assert html_extract.main_text(page).replace("\n", " ") == f"{PROSE} x=2 plain label"


@pytest.mark.parametrize(
    "prose",
    [
        "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。" * 4, "Однажды в студёную зимнюю пору сидел за пригорками леса и видел поднимается медленно гору лошадка везущая хворосту воз. " * 2,
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita e quanto a dir qual era è cosa dura. " * 2, "Vaka vanha Väinämöinen itse tuon sanoiksi virkki sanoi sillä lausehella pani suulla puhtahalla jotta kuulisi jokainen. " * 2,
        "ในเบื้องต้นพระเจ้าทรงเนรมิตสร้างฟ้าและแผ่นดิน" * 6,
    ],
)
def test_plain_blocks_of_many_languages(prose):
    prose = prose.strip()
    page = f"<body><ul><li><a href=1>Home page</a><li><a href=2>All articles</a></ul><div><h1>{prose[:20]}</h1><p>{prose}</p><p>{prose[:9]}</p><p>{prose}</p></div><footer>2024</footer>"
    assert html_extract.main_text(page) == "\n".join(x.strip() for x in (prose[:20], prose, prose[:9], prose))


def test_marks_are_not_what_decides(spark):
    """Without class, id and article marks nearly every page gives the same text; what differs has no dense block at all."""
    import re

    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    bare = [re.sub("<(/?)article>", r"<\1div>", re.sub(r' (?:class|id)="[^"]*"', "", p)) for p in pages]
    same = [html_extract.main_text(a) == html_extract.main_text(b) for a, b in zip(pages, bare, strict=True)]
    assert sum(same) >= 0.98 * len(same)
    for p, ok in zip(pages, same, strict=True):
        assert ok or html_extract.GOOD not in html_extract.first_pass(html_extract.blocks(p))


def test_second_pass_against_brute_force():
    """Neighbours by the paths of containers of all pairs of blocks."""
    rng = np.random.default_rng(8)
    for _ in range(400):
        n, path, found, paths = int(rng.integers(1, 14)), [], [], []
        for k in range(n):
            low = len(path)
            for _ in range(rng.integers(0, 3)):
                path = path[: rng.integers(0, len(path) + 1)]
                low = min(low, len(path))
                path = path + [len(paths) * 10 + int(rng.integers(9))] * int(rng.integers(0, 2))
            paths.append(tuple(path))
            found.append(html_extract.Block("x" * int(rng.integers(1, 9)), 0.0, False, False, False, len(path), min(low, len(path)) if k else 0))
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        for k in range(1, n):
            found[k].shared = common(paths[k - 1], paths[k])
        labels = [str(x) for x in rng.choice([html_extract.GOOD, html_extract.BAD, html_extract.NEAR, html_extract.OPEN], n)]
        inside = [bool(x) for x in rng.integers(0, 2, n)]
        if html_extract.GOOD not in labels:
            continue
        used = [html_extract.BAD if x == html_extract.NEAR and not s else x for x, s in zip(labels, inside, strict=True)]
        expected = []
        for i in range(n):
            if used[i] in (html_extract.GOOD, html_extract.BAD):
                expected.append(used[i] == html_extract.GOOD)
                continue
            others = [j for j in range(n) if used[j] in (html_extract.GOOD, html_extract.BAD) and inside[j] == inside[i]]
            best = min(others, key=lambda j: (-common(paths[i], paths[j]), abs(i - j), j > i), default=None)
            expected.append(used[best] == html_extract.GOOD if best is not None else inside[i] and not all(inside) or used[i] == html_extract.NEAR)
        assert html_extract.second_pass(found, labels, inside) == expected


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<html><head><title>x</title><body><p>{PROSE}</p></body></html>", PROSE), (f"<head><meta charset=utf-8><title>x</title><style>p{{}}</style><p>{PROSE}", PROSE), (f"<head><link rel=x>{PROSE}", PROSE),
        (f"<head-line>{PROSE}</head-line>", PROSE), (f"<select-box></select-box><p>{PROSE}</p>", PROSE), (f"<div><p>{PROSE}</p><template-part></template-part><p>{PROSE}</p></div>", f"{PROSE}\n{PROSE}"),
        (f"<div><p>{PROSE}</p><style-guide/><p>{PROSE}</p></div>", f"{PROSE}\n{PROSE}"), (f"<div><p>{PROSE}</p><script-x>{PROSE}</script-x></div>", f"{PROSE}\n{PROSE}"),
        (f"<article><section id=side><p>{PROSE}</p></section></article>", PROSE), (f"<div id=related><p>{PROSE}</p></div><nav>{PROSE}</nav>", PROSE), (f"<article><p>{PROSE}</p><section id=side><p>{PROSE}</p></section></article>", PROSE),
        (f"<div><select><option>One<option>Two</div><p>{PROSE}</p>", PROSE),
    ],
)
def test_optional_end_tags_and_custom_elements(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("name", ["script", "style", "noscript", "template", "textarea", "iframe", "title", "annotation", "annotation-xml"])
def test_elements_whose_text_is_not_the_pages(name):
    page = lambda end: f"<div><p>{PROSE}</p><{name} a='b'>{PROSE} <b>x</b>{end}<p>{PROSE}</p></div>"
    for end in (f"</{name}>", f"</{name.upper()} >", f"</{name}\n x>"):
        assert html_extract.main_text(page(end)) == f"{PROSE}\n{PROSE}"
    assert html_extract.main_text(page("")) == PROSE  # never closed
    assert html_extract.main_text(page(f"</{name}-x>")) == PROSE  # another name's end
    assert html_extract.main_text(f"<div><p>{PROSE}</p><{name}-x>{PROSE}</{name}-x></div>") == f"{PROSE}\n{PROSE}"


def test_blocks_hold_all_text_that_another_parser_sees(spark):
    """Every page's blocks together, against Python's own HTML parser: no text lost, none made up."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        SILENT = ("script", "style", "noscript", "template", "textarea", "iframe", "title")

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.text = [], []

        def handle_starttag(self, tag, attrs):
            if tag in self.SILENT:
                self.inside.append(tag)

        def handle_endtag(self, tag):
            if tag in self.inside:
                self.inside.remove(tag)

        def handle_data(self, data):
            if not self.inside:
                self.text.append(data)

    bare = lambda s: "".join(s.split())
    for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect():
        parser = Plain()
        parser.feed(r.html or "")
        parser.close()
        assert bare("".join(b.text for b in html_extract.blocks(r.html or ""))) == bare("".join(parser.text)), r.page_id


def test_extract_odd_pages(spark):
    rows = [(1, "u", f"<article><p>{PROSE}</p></article>", "clash"), (1, "u", f"<article><p>{PROSE}</p></article>", "clash"), (2, None, None, None), (3, "v", "<p>" + PROSE * 2000, None)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, len(r.text)) for r in out) == [(1, len(PROSE)), (1, len(PROSE)), (2, 0), (3, 2000 * len(PROSE))]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quadratic_pages_end():
    page = "<div " + "a='" * 20_000 + "<p>" * 20_000
    assert html_extract.main_text(page) == ""


@pytest.fixture(scope="module")
def labelled(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


@pytest.mark.parametrize(("scored", "label", "least"), [(toxicity.scored, "toxic", 0.93), (quality_model.scored, "quality", 0.97)])
def test_held_out_accuracy(labelled, scored, label, least):
    docs, labels = labelled
    out = scored(docs, labels)
    assert out.count() == docs.count()
    got = out.where("held_out").join(labels, "doc_id").select("score", "predicted", label).toPandas()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    assert auc(got[label].to_numpy(), got["score"].to_numpy()) > least


@pytest.mark.parametrize("scored", [toxicity.scored, quality_model.scored])
def test_scores_of_odd_rows(spark, odd, none, scored):
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 22)] + [(None, 1, 1), (5, 1, 1), (11, None, None)], "doc_id long, quality int, toxic int")
    for labels in (some, some.limit(0), some.where("quality = 1")):
        out = scored(odd, labels).collect()
        assert len(out) == odd.count()
        assert all(0 <= r.score <= 1 for r in out)
        assert len({(r.doc_id, r.score) for r in out if r.doc_id == 5}) == 1
    assert scored(none, some).count() == 0


def test_labels_of_the_held_out_fold_are_not_learned_from(spark, labelled):
    docs, labels = labelled
    docs, flipped = docs.where("doc_id < 900"), labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 4 = 2, 1 - toxic, toxic) AS toxic")
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)


def brute_segments(s):
    """All maximal scoring segments, by their definition as the best segment and those left and right of it."""
    if not len(s):
        return []
    total = np.concatenate([[0], np.cumsum(s)])
    best, a, b = max((total[j] - total[i], -i, -j) for i in range(len(s)) for j in range(i + 1, len(s) + 1))
    if best <= 1e-9:
        return []
    a, b = -a, -b
    return brute_segments(s[:a]) + [(a, b, best)] + [(x + b, y + b, v) for x, y, v in brute_segments(s[b:])]


def test_segments_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.normal(-0.3, 1, rng.integers(0, 25))
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == [(a, b) for a, b, _ in brute_segments(s)]


def test_segment_scan_is_linear():
    """Falling sums, each a candidate of its own: twice the words, twice the steps."""
    import sys

    def steps(n):
        s = np.full(n, -0.25)
        s[::4] = 0.6 - np.arange(len(s[::4])) * 1e-6
        lines = 0

        def count(frame, event, arg):
            nonlocal lines
            lines += event == "line"
            return count

        sys.settrace(count)
        try:
            toxicity.segments(s)
        finally:
            sys.settrace(None)
        return lines

    assert steps(16_000) < 2.2 * steps(8_000)


TOXIC = toxicity.Model({"foul$": 2.0137, "vile$": 1.8719, "rotten$": 2.2003, "nasty$": 1.7311, "wicked$": 2.0071, "calm$": -1.0173}, -0.25, 1.0, (0.05, 0.05), (-3.0, 0.5, 0.1, 0.5))


def test_a_passage_counts_where_its_words_came_before(make):
    quiet, passage = "calm lake " * 200, "foul vile rotten nasty wicked"
    twice, scattered = f"{passage} {quiet}{passage}", quiet.join(passage.split()) + f" {quiet}{passage}"
    out = {r.doc_id: r for r in toxicity.score(make([(1, quiet, "s"), (2, twice, "s"), (3, scattered, "s"), (4, passage + " " + quiet, "s")]), TOXIC).collect()}
    spans = {i: [(p.first, p.words) for p in r.passages] for i, r in out.items()}
    assert spans[1] == [] and spans[2] == [(0, 5), (405, 5)] and spans[4] == [(0, 5)]
    assert spans[3] == [(len(scattered.split()) - 5, 5)]
    assert out[3].score > out[1].score + 0.2 and min(out[2].score, out[4].score) > 0.9


def test_scores_against_plain_code(odd, make):
    rng = np.random.default_rng(6)
    words = ["foul", "vile", "calm", "lake", "nasty", "Foul,"]
    df = odd.where("doc_id <> 4").union(make([(500 + i, " ".join(rng.choice(words, rng.integers(1, 30))), "s") for i in range(60)]))
    for r in toxicity.score(df, TOXIC, keep=("doc_id", "text")).collect():
        w = toxicity.WORD.findall((r.text or "").lower())
        each = np.array([TOXIC.weights.get(x + "$", 0.0) - 0.25 for x in w])
        fresh = np.array([e if x not in w[:i] else -0.25 for i, (x, e) in enumerate(zip(w, each, strict=True))])
        full, new = ([v for _, _, v in brute_segments(x)] for x in (each, fresh))
        z = -3 + 0.5 * (max(new, default=0) - np.log(1 + 0.05 * len(w))) + 0.1 * np.log1p(sum(new)) + 0.5 * (max(full, default=0) - np.log(1 + 0.05 * len(w)))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9
        assert len(r.passages) == sum(v > np.log(1 + 0.05 * len(w)) for v in full)


def test_extreme_value_scale_is_found_again():
    rng = np.random.default_rng(2)
    n = rng.integers(50, 4000, 4000).astype(float)
    best = np.log(0.03 * n / -np.log(rng.uniform(size=4000))) / 1.7
    assert abs(toxicity.gumbel_scale(best, n, 1.7) / 0.03 - 1) < 0.06
    x = np.linspace(-1, 1, 200)[:, None] * 400
    fit = toxicity.logistic(x, (x[:, 0] > 0).astype(float))  # separable
    assert np.isfinite(fit).all() and fit[1] > 0


def test_gam_finds_an_interaction():
    rng = np.random.default_rng(5)
    x = np.zeros((3000, len(quality_model.FEATURES)))
    x[:, :2] = rng.uniform(-1, 1, (3000, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality_model.boost(x[:2000], y[:2000])
    assert (model.pairs[0][0], model.pairs[0][1]) == (0, 1)
    assert auc(y[2000:], model.score(x[2000:])) > 0.95


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_multi_50k.tiktoken")
    return path, p.PATTERN, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_against_the_library(spark, odd, none, tokenizer, monkeypatch):
    path, pattern, reference = tokenizer
    rows = {r.doc_id: r for r in bpe.digests(odd, path, pattern).collect() if r.doc_id is not None}
    for r in odd.where("doc_id IS NOT NULL").collect():
        ids = reference.encode_ordinary(r.text or "")
        assert rows[r.doc_id].n_tokens == len(ids)
        assert rows[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.digests(odd, path, pattern).count() == odd.count()
    there_and_back = bpe.decode(bpe.encode(odd, path, pattern, keep=("doc_id", "text")), path).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in there_and_back)
    assert bpe.digests(none, path, pattern).count() == 0
    monkeypatch.setattr(bpe, "CACHE", 3)  # the memory of pieces doesn't change results
    coder, rng = bpe.Encoder(bpe.read_ranks(path), pattern), np.random.default_rng(1)
    for _ in range(400):
        text = "".join(rng.choice(list("ab c's \n\t\x1c\x85é日1! <|endoftext|>"), 50))
        assert coder.encode(text) == np.array(reference.encode_ordinary(text), "<u4").tobytes()


@pytest.mark.parametrize("pattern", [r"\p{L}+|\s+|[^\s\p{L}]+", r"(?i:'s|'t)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"])
def test_bpe_with_other_patterns(tokenizer, pattern):
    import tiktoken

    path, known, _ = tokenizer
    assert bpe.CUT_PATTERN == known
    ranks, rng = bpe.read_ranks(path), np.random.default_rng(4)
    reference = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.Encoder(ranks, pattern)
    for _ in range(300):
        text = "".join(rng.choice(list("ab c's \n\t.,éЖ日12! don'tS"), 60))
        assert coder.encode(text) == np.array(reference.encode_ordinary(text), "<u4").tobytes()


def test_bpe_of_long_pieces(tokenizer):
    path, pattern, reference = tokenizer
    coder = bpe.Encoder(bpe.read_ranks(path), pattern)
    for text in ("a" * 50_000, " " * 20_000, "ab" * 30_000, "é" * 9_999):
        assert coder.encode(text) == np.array(reference.encode_ordinary(text), "<u4").tobytes()
