"""Vector codes, token counts and the filter audit against SQL, plain versions and the library; odd rows."""

import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from storyloom.llm import catalog, filter_audit, token_counts, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, part int, value string, row long"


def duck(**tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t if isinstance(t, pa.Table) else t.toArrow())
    return con


def rows(table):
    names = sorted(table.column_names)
    return sorted(map(str, zip(*(table[n].to_pylist() for n in names), strict=True)))


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_filter_audit"])
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    out, sql = catalog.QUERIES[name](spark, sf).toArrow(), con.execute(catalog.ORACLES[name]).to_arrow_table()
    assert rows(out) == rows(sql) and out.num_rows
    assert {n: str(sql.schema.field(n).type) for n in sql.column_names} == {n: str(out.schema.field(n).type) for n in out.column_names}


# vector codes


def plain_codes(vectors, parts, entries, rounds, scale=4096):
    """vectors: (vec_id, components, label) in the order of their codebooks' start."""
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v], y) for i, v, y in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = len(kept[0][1]) // parts
    cut = [[tuple(v[p * d : p * d + d]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)) if j in groups else e for j, e in enumerate(books[p])]
    out = []
    for (i, _, y), c in zip(kept, cut, strict=True):
        found = [near(x, book) for x, book in zip(c, books, strict=True)]
        out.append((i, y, "".join(f"{j:02x}" for _, j in found), sum(e for e, _ in found)))
    return out, books


def vectors(n, d, seed=3):
    rng = random.Random(seed)
    base = [[float(np.float32(rng.gauss(0, 0.3))) for _ in range(d)] for _ in range(max(1, n // 3))]
    return [(i, rng.choice(base) if rng.random() < 0.5 else [float(np.float32(rng.gauss(0, 0.3))) for _ in range(d)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize(("n", "d", "parts", "entries", "rounds"), [(300, 16, 8, 16, 6), (40, 12, 4, 5, 2), (7, 8, 8, 16, 3), (1, 8, 2, 200, 1)])
def test_codes_against_plain_code(spark, n, d, parts, entries, rounds):
    data = vectors(n, d)
    df = spark.createDataFrame([(i, v, y, "clash", -1, "clash", -1) for i, v, y in reversed(data)], VECTORS)
    coded, books = vector_codes.compress(df, parts=parts, entries=entries, rounds=rounds)
    expected, plain_books = plain_codes(data, parts, entries, rounds)
    assert sorted(map(str, map(tuple, coded.collect()))) == sorted(map(str, expected))
    assert [x.tolist() for x in books] == [[list(e) for e in book] for book in plain_books]
    by = {}
    for _, y, _, e in expected:
        by[y] = by.get(y, 0) + e
    out = vector_codes.with_label_errors(coded).collect()
    assert len(out) == n and all(r.label_error == by[r.label] for r in out)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1), (2, [0.0] * 7 + [nan], 1), (3, [inf] + [0.0] * 7, 1), (4, [None] + [0.0] * 7, 1), (None, [0.5] * 8, None), (5, [0.25] * 8, 7), (5, [0.25] * 8, 7), (5, [-0.25] * 8, 7), (6, [-0.0001] * 8, None)]
    df = spark.createDataFrame([(i, v, y, "", 0, "", 0) for i, v, y in odd], VECTORS)
    coded, books = vector_codes.compress(df)
    assert sorted(str(r.vec_id) for r in coded.collect()) == ["5", "5", "5", "6", "None"]
    assert books[0].ravel().tolist() == [-1024, 1024, 1024, -1, 2048] or books[0].shape == (5, 1)
    assert {r.error for r in coded.collect()} == {0}
    assert rows(vector_codes.with_label_errors(coded).drop("label").withColumn("codebooks_sha256", F.lit(vector_codes.digest(books))).toArrow()) == rows(duck(embeddings=df.select("vec_id", "embedding", "label")).execute(vector_codes.ORACLE).to_arrow_table())
    for none in (df.limit(0), df.where("vec_id < 5")):
        coded, books = vector_codes.compress(none)
        assert vector_codes.with_label_errors(coded).count() == 0 and vector_codes.digest(books) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    empty = spark.createDataFrame([(1, [], 1, "", 0, "", 0)] * 2, VECTORS)
    assert [(r.code, r.error) for r in vector_codes.compress(empty)[0].collect()] == [("00" * 8, 0)] * 2


@pytest.mark.parametrize("bad", [[(1, [0.0] * 8), (2, [0.0] * 16)], [(1, [0.0] * 9)], [(1, [9000.0] * 8)]])
def test_vectors_that_cannot_be_coded(spark, bad):
    df = spark.createDataFrame([(i, v, 1, "", 0, "", 0) for i, v in bad], VECTORS)
    with pytest.raises((ValueError, PySparkException)):
        vector_codes.compress(df)


# token counts


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def counter():
    import public_tokenizers

    v = token_counts.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.Counter(v, token_counts.proven(v))


def test_token_counts_of_the_table_equal_the_librarys(spark, sf, library):
    docs = {r.doc_id: r.text or "" for r in catalog.documents(spark, sf).collect()}
    out = catalog.op12_token_counts(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


def test_odd_texts_equal_the_librarys(odd, none, make, library):
    import public_tokenizers

    df = odd.union(make([(100, "a<|endoftext|>b <|endoftext|><|endoftext|>  x <|endoftex", "a"), (101, "x" * 70_000, "a"), (102, "it's  \x1c\x85 we'LL 日本 　 \n\n é", None), (103, "<|endoftext|>", "b")]))
    out = token_counts.counted(df, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "score"))
    assert out.columns == ["doc_id", "score", "n_bytes", "n_tokens", "over_limit"]
    expected = sorted((str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out.collect()) == expected
    assert token_counts.counted(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_each_kind_of_character(library, counter):
    texts = [f"a{chr(c)}b1{chr(c)}{chr(c)} {chr(c)}. " for c in range(0, 0x11000) if not 0xD800 <= c < 0xE000]
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_proof_covers_just_the_strings_that_encode_alone(library, counter):
    strings = [s.decode() for s in counter.v.strings if s and s.decode(errors="ignore").encode() == s]
    n = [len(e.ids) for e in library.encode_batch(strings, add_special_tokens=False)]
    one_piece = [len(token_counts.PRETOKEN.findall(s)) == 1 for s in strings]
    assert {s for s, k, o in zip(strings, n, one_piece, strict=True) if k == 1 and o} == {s for s in counter.alone if len(token_counts.PRETOKEN.findall(s)) == 1}
    assert 49_000 < len(counter.alone) < 50_257


def test_merging_without_the_shortcut_gives_the_librarys_ids(library, counter):
    rng = random.Random(5)
    for _ in range(300):
        piece = "".join(rng.choice("aeinrstéöжд日 ") for _ in range(rng.randrange(1, 60))).replace(" ", "")
        assert not piece or token_counts.merged(piece.encode(), counter.v) == library.encode(piece, add_special_tokens=False).ids


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="plain byte-level BPE"):
        token_counts.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


# filter audit


def plain_measures(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    return [len(w), len(set(w)), len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text)), len(text)]


def test_measures_against_plain_code():
    rng = random.Random(11)
    texts = ["", " ", "a", " a", "a ", "", "é日本 \U0001f600 A#", "x" * 200_000, "", "b\x0bB\x1cb b"] + ["".join(rng.choice("aAbB #|\n\té日") for _ in range(rng.randrange(90))) for _ in range(2000)]
    texts += [" ".join(rng.choice(("w", "ww", "日", "Z&")) + str(rng.randrange(3000)) for _ in range(40_000)), ""]
    for cut, kind in ((0, pa.string()), (3, pa.string()), (7, pa.large_string())):
        found = filter_audit.measures(pa.array(texts, kind).slice(cut))
        assert list(map(list, zip(*(x.tolist() for x in found), strict=True))) == [plain_measures(t) for t in texts[cut:]]
    assert [x.tolist() for x in filter_audit.measures(pa.array(["", ""]))] == [[0, 0]] * 5


def test_words_of_equal_hash_are_told_apart():
    texts = ["ab cd ab ef", "cd", "ab ab", "abc ab xy abc"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    start, end = filter_audit.word_places(data, offsets)
    text = np.searchsorted(offsets, start, "right") - 1
    for hashes in (np.zeros(len(start), np.uint64), (end - start).astype(np.uint64) << np.uint64(40)):
        assert filter_audit.distinct_words(data, text, start, end, len(texts), hashes).tolist() == [3, 1, 1, 3]


def test_hashes_do_not_depend_on_the_place():
    rng = random.Random(2)
    words = [rng.choice(("harbour", "日本", "A", "x" * 70_000)) for _ in range(40)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    start, end = filter_audit.word_places(data, np.array([0, len(data)]))
    of = {}
    for w, h in zip(words, filter_audit.word_hashes(data, start, end).tolist(), strict=True):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)


def plain_audit(docs, labels):
    """Each order run over each part, one document after the other."""
    first, good, toxic = {}, {}, {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        if i is not None:
            good[i], toxic[i] = good.get(i, False) or q == 1, toxic.get(i, False) or x == 1
    fails = []
    for i, t, lang in docs:
        n, distinct, caps, marks, points = plain_measures(t or "")
        fails.append((lang or "", {c for c, x in zip("ABCDE", (n < 100, 100 * distinct < 80 * n, 100 * caps > 10 * points, marks > 0, i is not None and first[t or ""] < i), strict=True) if x}, good.get(i, False), toxic.get(i, False)))
    out = {}
    for part in {f[0] for f in fails}:
        mine, shapley = [f for f in fails if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, c in enumerate(order):
                gone, left_now = [f for f in left if c in f[1]], [f for f in left if c not in f[1]]
                shapley[c] += len(gone)
                out[part, order, k + 1] = [len(left_now), len(gone), sum(c in f[1] for f in mine) - len(gone), sum(f[1] == {c} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                left = left_now
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return out


def test_audit_against_plain_code(spark, odd, none, make):
    rng = random.Random(4)
    some = make([(200 + i, " ".join(rng.choice(("Aa", "BB", "c", "d#")) + str(rng.randrange(rng.choice((5, 300)))) for _ in range(rng.randrange(60, 160))) if i % 5 else "same text", "z") for i in range(150)])
    docs = odd.union(some).withColumn("lang", F.when(F.col("doc_id") % 7 > 0, F.when(F.col("doc_id") % 3 == 0, "en").otherwise("日"))).withColumns({"mask": F.lit(1), "part": F.lit("clash"), "first_id": F.lit(0)})
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 300, 2)] + [(200, 1, None), (201, None, 1), (5, 1, 1), (5, 0, 0), (None, 1, 1)]
    out = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in out}
    assert got == plain_audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], labels) and len(out) == len(got)
    assert filter_audit.audit(none, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
