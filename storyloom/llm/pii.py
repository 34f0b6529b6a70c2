"""Personal data and secrets replaced by keyed surrogates of the same kind; DataFrame functions only.

A surrogate is a function of a secret key, the entity's kind and its canonical form, rendered in the
format of each mention: one entity has one surrogate everywhere, whatever its punctuation. Distinct
entities that would get one surrogate, or the name of a real entity, are keyed anew until none do.

Kinds: email, secret (access keys, passwords, tokens), iban, ip, ssn, phone, card (13 to 19 digits),
name (after a title, which tells the gender). A name's other mentions in its document, without the title,
whole or by its last words, get the same new words; a last word that the document has in lower case too is
no name by itself. Not looked for: names that no title tells anywhere in the document, first names alone,
IPv6 addresses, and local numbers without an area code (555-0147). Digits stay digits, letters stay letters of their
script and case, separators stay; phones keep their country code, cards their first digit and a
valid check digit, addresses their top-level domain, names their title and gender.

Rows: null texts stay null; each row gives one row, repeated rows the same one; an empty table
gives an empty table; other columns pass through, but n_entities of the input is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import written

#: Titles by gender and script; fixed values.
TITLES = {
    ("m", "latin"): "Mr|Herr|Hr|Monsieur|Señor|Sr|Don|Sir",
    ("f", "latin"): "Mrs|Ms|Miss|Frau|Fr|Madame|Mme|Mademoiselle|Mlle|Señora|Señorita|Sra|Srta|Doña|Lady",
    ("m", "cyrillic"): "господин|Господин|г-н",
    ("f", "cyrillic"): "госпожа|Госпожа|г-жа",
    ("x", "latin"): "Dr|Prof",
}
#: First names by gender and script, and syllables of surnames by script; fixed values.
FIRST = {
    ("m", "latin"): "Adam Bruno Carl Daniel Emil Felix Georg Hugo Ivan Jonas Karim Leo Marco Noel Oscar Paul",
    ("f", "latin"): "Ada Berta Clara Diana Elsa Flora Greta Hanna Irene Julia Karla Lena Maria Nora Olga Paula",
    ("x", "latin"): "Alex Chris Dana Eden Jamie Kim Lou Max Nico Pat Robin Sam Sasha Toni Val Yael",
    ("m", "cyrillic"): "Андрей Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Макар Никита Олег Павел Роман Семён",
    ("f", "cyrillic"): "Анна Белла Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va",
    "cyrillic": "ба бе бо ва ве во га го да де до за зе ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та",
}
UPPER = r"\p{Lu}[\p{L}'-]+"
NAME = rf"\b(?:{'|'.join(TITLES.values())})\.?[ ]{UPPER}(?:[ ]{UPPER}){{0,2}}"
#: Kinds and their patterns, in the order in which they are tried at a place.
LABEL = r"(?i:\b(?:password|passwd|pwd|secret|token|api_?key)\b\"?[ ]?[=:][ ]?)"
PATTERNS = {
    "email": r"[A-Za-z0-9_](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,250}[A-Za-z0-9])?\.[A-Za-z]{2,24}\b",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|\b(?:gh[pousr]_|sk-|xox[abps]-)[A-Za-z0-9_-]{16,}|" + LABEL + r"(?:\"[^\"\n]{4,}+\"|'[^'\n]{4,}+'|[^\s\"',;]{4,}+)|\b[0-9a-f]{40}(?:[0-9a-f]{24})?\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9])\+[0-9]{8,15}(?![0-9])",
    "name": NAME,
}
ANY = "|".join(PATTERNS.values())
#: What every match holds; texts without it aren't searched further.
HINT = rf"[0-9@=:]|gh[pousr]_|sk-|xox|\b[a-f]{{40}}|\b(?:{'|'.join(TITLES.values())})\b"
#: Alphabets in which letters are replaced by letters.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "áéíóúàèùâêôäëïöüñçß")


def kind_of(mention: Column) -> Column:
    return reduce(lambda out, kv: F.when(mention.rlike(f"^(?:{kv[1]})$"), kv[0]).otherwise(out), list(PATTERNS.items())[::-1], F.lit("phone"))


def canonical(kind: Column, mention: Column) -> Column:
    """Digits of numbers, capitals of account numbers, lower case of addresses, names without their title's dot."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "email", F.lower(mention))
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "secret", F.regexp_replace(mention, rf"^{LABEL}[\"']?|[\"']$", ""))
        .otherwise(mention)
    )


def stream(key: str, *of: Column, size: Column | None = None) -> Column:
    """352 keyed bytes, as integers; `size` of them at least."""
    base = F.concat_ws("\x1f", F.lit(key), *[x.cast("string") for x in of])
    block = lambda i: F.sha2(F.concat(base, F.lit("\x1f"), i).cast("binary"), 256)
    blocks = F.array(*[block(F.lit(str(i))) for i in range(11)])
    if size is not None:
        more = F.transform(F.sequence(F.lit(0), F.ceil(size / 32).cast("int")), lambda i: block(i.cast("string")))
        blocks = F.when(size > 352, more).otherwise(blocks)
    return F.transform(F.regexp_extract_all(F.array_join(blocks, ""), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def pick(choices: str, k: Column) -> Column:
    """The k-th character, counted round."""
    return F.substring(F.lit(choices), k % len(choices) + 1, F.lit(1))


def changed(s: Column, keyed: Column, how) -> Column:
    """s with each character c changed to how(c, byte); characters that have no byte left go by the byte 0."""
    new = F.zip_with(chars(s), keyed, lambda c, v: F.when(c.isNull(), "").otherwise(how(c, F.coalesce(v, F.lit(0)))))
    return F.array_join(new, "")


def replaced(c: Column, v: Column) -> Column:
    """A digit for a digit, a letter of the same alphabet for a letter, else c."""
    out = F.when(c.rlike("[0-9]"), (v % 10).cast("string"))
    for a in ALPHABETS:
        out = out.when(F.lit(a).contains(c), pick(a, v))
    return out.otherwise(c)


def masked(s: Column, keyed: Column) -> Column:
    return changed(s, keyed, replaced)


def formatted(mention: Column, filled: str, new: Column) -> Column:
    """The mention with its characters of class `filled` taken from `new` in turn."""
    between = F.split(mention, filled, -1)
    return F.array_join(F.zip_with(between, chars(new), lambda gap, c: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(c, F.lit("")))), "")


def luhn(digits: Column) -> Column:
    """The check sum of a number, modulo 10; 0 if it is valid."""
    each = F.transform(chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 1, F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def by_title(title: Column, choices: dict[tuple[str, str], str]) -> Column:
    """The list for the gender and script of a title, as an array."""
    lists = [(titles, F.array(*[F.lit(x) for x in choices[of].split()])) for of, titles in TITLES.items()]
    return reduce(lambda out, kv: F.when(title.rlike(f"^(?:{kv[0]})$"), kv[1]).otherwise(out), lists[1:], lists[0][1])


def with_names(df: DataFrame, key: str) -> DataFrame:
    """Adds __name: new names after the title of mentions of kind name, word by word; the last word is a surname."""
    title = F.regexp_extract("mention", rf"^(?:{'|'.join(TITLES.values())})(?=[. ])\.?", 0)
    df = df.withColumn("__title", F.when(F.col("kind") == "name", title))
    df = df.withColumn("__parts", F.split(F.substring("mention", F.length("__title") + 2, F.lit(200)), " "))
    bare = F.regexp_replace("__title", r"\.", "")
    df = df.withColumn("__given", by_title(bare, FIRST)).withColumn("__syllables", by_title(bare, {of: SYLLABLES[of[1]] for of in TITLES}))
    tries = lambda i: F.when((i == 0) | (F.size("__parts") == 1), F.col("tries")).otherwise(0)
    df = df.withColumn("__keyed", F.transform("__parts", lambda part, i: stream(key, F.lit("name"), part, tries(i))))
    surname = lambda k: F.initcap(F.array_join(F.transform(F.slice(k, 1, 4), lambda v: F.get("__syllables", v % 32)), ""))
    df = df.withColumn("__last", F.transform("__keyed", surname))
    first = F.transform("__keyed", lambda k, i: F.concat(F.get("__given", F.get(k, F.lit(0)) % 16), F.when(tries(i) == 0, "").otherwise(F.lower(F.get("__last", i)))))
    words = F.zip_with(first, F.sequence(F.lit(1), F.size("__parts")), lambda f, i: F.when(i == F.size("__parts"), F.get("__last", i - 1)).otherwise(f))
    return df.withColumn("__name", F.concat("__title", F.lit(" "), F.array_join(words, " ")))


def with_surrogates(df: DataFrame, key: str) -> DataFrame:
    """Adds `new`, the replacement of each mention of (kind, canon), keyed for the (tries + 1)-th time.

    Intermediate values are columns, so that each is worked out once.
    """
    columns, kind, mention, canon, tries = df.columns, *map(F.col, ("kind", "mention", "canon", "tries"))
    df = df.withColumn("__key", stream(key, kind, canon, tries, size=F.length(mention))).withColumn("__digits", F.regexp_replace(mention, "[^0-9]", ""))
    kept = F.when(kind == "card", 1).when(kind == "phone", F.length(F.regexp_extract(mention, r"^\+([0-9]{1,3}?)(?=[^0-9]|[0-9]{8,12}$)", 1))).otherwise(0)
    df = df.withColumn("__kept", kept).withColumn("__number", masked(F.col("__digits"), F.col("__key")))
    df = df.withColumn("__number", F.concat(F.substring("__digits", F.lit(1), F.col("__kept")), F.substring("__number", F.col("__kept") + 1, F.lit(64))))
    last = F.substring("__number", -1, 1).cast("int")
    checked = F.concat(F.substring("__number", F.lit(1), F.length("__number") - 1), ((last + 10 - luhn(F.col("__number"))) % 10).cast("string"))
    df = df.withColumn("__number", F.when((kind == "card") & (luhn(F.col("__digits")) == 0), checked).otherwise(F.col("__number")))
    domain = F.lower(F.substring_index(mention, "@", -1))
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    host = masked(F.substring(domain, F.lit(1), F.length(domain) - F.length(top)), stream(key, F.lit("domain"), domain))
    email = F.concat(masked(F.substring_index(mention, "@", 1), F.col("__key")), F.lit("@"), host, top)
    ip = F.array_join(F.transform(F.slice("__key", 1, 4), lambda v: (v % 254 + 1).cast("string")), ".")
    df = df.withColumn("__head", F.regexp_extract(mention, rf"^(?:AKIA|gh[pousr]_|sk-|xox[abps]-|{LABEL}[\"']?(?:AKIA)?)?", 0))
    df = df.withColumn("__rest", F.substring(mention, F.length("__head") + 1, F.length(mention)))
    rest, keyed = F.col("__rest"), F.col("__key")
    hexes = changed(rest, keyed, lambda c, v: F.when(c.rlike("[0-9a-f]"), pick("0123456789abcdef", v)).otherwise(c))
    secret = F.concat("__head", F.when(rest.rlike("^[0-9a-f]{8,}[\"']?$"), hexes).otherwise(masked(rest, keyed)))
    iban = formatted(mention, "[^ ]", F.concat(F.substring(canon, 1, 2), masked(F.substring(canon, 3, 64), keyed)))
    new = (
        F.when(kind.isin("phone", "card", "ssn"), formatted(mention, "[0-9]", F.col("__number"))).when(kind == "email", email)
        .when(kind == "ip", ip).when(kind == "secret", secret).when(kind == "iban", iban).otherwise(F.col("__name"))
    )
    return with_names(df, key).withColumn("new", new).select(*columns, "new")


def mentions(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def rekeyed(entities: DataFrame, key: str, most: int = 64) -> DataFrame:
    """kind, canon, tries of the entities (kind, canon, mention) whose first surrogate another entity has, or is.

    A round keys only those whose surrogates were taken; the ones that have theirs keep them.
    """
    real = entities.select(F.col("kind").alias("rk"), F.col("canon").alias("rc"))
    open_, settled = entities.withColumn("tries", F.lit(0)), None
    for _ in range(most):
        new = written(with_surrogates(open_, key).withColumn("s", canonical(F.col("kind"), F.col("new"))).drop("new"))
        owners = new.groupBy(F.col("kind").alias("k"), F.col("s").alias("t")).agg(F.min("canon").alias("owner"))
        taken = (F.col("canon") != F.col("owner")) | F.col("rc").isNotNull()
        found = new.join(owners, (F.col("kind") == F.col("k")) & (F.col("s") == F.col("t"))).join(real, (F.col("kind") == F.col("rk")) & (F.col("s") == F.col("rc")), "left")
        if settled is not None:
            had = settled.select(F.col("kind").alias("hk"), F.col("s").alias("hs"))
            found, taken = found.join(had, (F.col("kind") == F.col("hk")) & (F.col("s") == F.col("hs")), "left"), taken | F.col("hs").isNotNull()
        found = written(found.select("kind", "canon", "mention", "tries", "s", taken.alias("taken")))
        own = found.where("NOT taken").select("kind", "canon", "tries", "s")
        settled = own if settled is None else settled.unionByName(own)
        open_ = found.where("taken").select("kind", "canon", "mention", (F.col("tries") + 1).alias("tries"))
        if open_.isEmpty():
            return settled.where("tries > 0").select("kind", "canon", "tries")
    raise ValueError("surrogates of some kind are too few for its entities")


def name_ends(news: Column, text: Column) -> Column:
    """The names of a document's mentions without their titles, and their last words: array of (old, new), the longest first.

    news: array of (pos, new, kind, mention). A single word that the text also has in lower case isn't one.
    """
    words = lambda s: F.split(F.regexp_replace(s, rf"^(?:{'|'.join(TITLES.values())})\.?[ ]", ""), " ")
    ends = lambda x: F.transform(F.sequence(F.lit(1), F.size(words(x["mention"]))), lambda i: F.struct(*[F.array_join(F.slice(words(x[c]), i, F.lit(3)), " ").alias(n) for n, c in (("old", "mention"), ("new", "new"))]))
    every = F.array_distinct(F.flatten(F.transform(F.filter(news, lambda x: x["kind"] == "name"), ends)))
    word = lambda w: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), w, F.lit(r"\E(?![\p{L}\p{N}])"))
    name = lambda p: p["old"].contains(" ") | ~F.regexp_like(text, word(F.lower(p["old"])))
    return F.transform(F.sort_array(F.transform(F.filter(every, lambda p: F.contains(text, p["old"]) & name(p)), lambda p: F.struct((-F.length(p["old"])).alias("size"), p["old"].alias("old"), p["new"].alias("new")))), lambda p: F.struct(p["old"], p["new"]))


def with_known_names(df: DataFrame) -> DataFrame:
    """Replaces the other mentions of each document's names in its gaps, and adds `more`, their number."""
    df = df.withColumn("__names", name_ends(F.col("news"), F.array_join("gaps", "\n")))
    some = F.size("__names") > 0
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform("__names", lambda p: F.concat(F.lit(r"\Q"), p["old"], F.lit(r"\E"))), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    df = df.withColumn("__pattern", F.when(some, pattern))
    known = lambda hit: F.get(F.filter("__names", lambda p: p["old"] == hit), F.lit(0))["new"]
    between = lambda g: F.split(g, F.col("__pattern"), -1)
    hits = lambda g: F.regexp_extract_all(g, F.col("__pattern"), F.lit(0))
    renamed = F.transform("gaps", lambda g: F.array_join(F.zip_with(between(g), F.transform(hits(g), known), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
    more = F.aggregate("gaps", F.lit(0), lambda n, g: n + F.size(hits(g)))
    return df.withColumns({"more": F.when(some, more).otherwise(0), "gaps": F.when(some, renamed).otherwise(F.col("gaps"))}).drop("__names", "__pattern")


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with surrogates in column `text`, and n_entities, the number of mentions replaced."""
    columns = [c for c in docs.columns if c != "n_entities"]
    found = docs.select(*[F.col(c).alias(f"c_{c}") for c in columns], F.xxhash64(text).alias("hash"), mentions(F.col(text)).alias("m"))
    some = F.size("m") > 0
    # the one search of all texts: a text with mentions is kept as what stands between them
    found = found.withColumn("gaps", F.when(some, F.split(f"c_{text}", ANY, -1))).withColumn(f"c_{text}", F.when(~some, F.col(f"c_{text}")))
    found = written(found)
    touched = found.where(some)
    each = touched.select(F.col("c_doc_id").alias("m_id"), F.col("hash").alias("m_hash"), "m").dropDuplicates(["m_id", "m_hash"])
    each = each.select("m_id", "m_hash", F.posexplode("m").alias("pos", "mention"))
    each = each.withColumn("kind", kind_of(F.col("mention"))).withColumn("canon", canonical(F.col("kind"), F.col("mention")))
    each = written(each)
    entities = written(each.groupBy("kind", "canon").agg(F.min("mention").alias("mention")))
    again = rekeyed(entities, key).select(F.col("kind").alias("a_kind"), F.col("canon").alias("a_canon"), "tries")
    each = each.join(again, (F.col("kind") == F.col("a_kind")) & (F.col("canon") == F.col("a_canon")), "left")
    each = each.select("m_id", "m_hash", "pos", "kind", "mention", "canon", F.coalesce("tries", F.lit(0)).alias("tries"))
    per_doc = with_surrogates(each, key).groupBy("m_id", "m_hash").agg(F.sort_array(F.collect_list(F.struct("pos", "new", "kind", "mention"))).alias("news"))
    per_doc = written(per_doc)
    touched = touched.join(per_doc, F.col("c_doc_id").eqNullSafe(F.col("m_id")) & (F.col("hash") == F.col("m_hash")))
    touched = with_known_names(touched)
    whole = F.array_join(F.zip_with("gaps", F.col("news.new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    back = [F.col(f"c_{c}").alias(c) for c in columns]
    untouched = found.where(F.coalesce(~some, F.lit(True))).select(*back, F.lit(0).cast("long").alias("n_entities"))
    out = untouched.unionByName(touched.withColumn(f"c_{text}", whole).select(*back, (F.size("news") + F.col("more")).cast("long").alias("n_entities")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out
