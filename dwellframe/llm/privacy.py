"""Surrogates for personal data, with DataFrame functions only.

Entities are found by patterns and replaced by keyed surrogates of the same
type and shape: digits stay digits in the same layout, letters keep their case,
card numbers pass their check sum, names keep gender (from the title) and
script. A surrogate depends on the key, the type and the canonical entity, so
one person, number or address gets one surrogate in all documents and layouts.
Before anything is replaced, the distinct entities of the whole corpus are
given surrogates in rounds: one that equals an original, or that another entity
already holds, is drawn again, so different entities stay different.

Defined results: a null text stays null and a text without entities stays as it
is; repeated rows get equal texts; an empty table gives an empty table; columns
of ``docs`` may have any names; entities are cut neither by line nor by length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellframe.llm.common import Scratch, let

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
MALE = "Mr Herr Señor Sr Monsieur г-н Κύριος".split()
FEMALE = "Mrs Ms Miss Frau Señora Sra Madame Mme г-жа Κυρία".split()
NEUTRAL = "Dr Prof".split()
_TITLES = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
_NAME = r"\p{Lu}[\p{L}'’-]+"
OTHER = "other"
# In order of precedence; at one place of a text the first that fits is taken.
PATTERNS = {
    "secret": r"""(?<=(?i:password|passwd|token|secret|key)[ \t]{0,3}[=:][ \t]{0,3}["']{0,1})[^\s"']{6,}""",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)",
    "card": r"(?<![\d-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{4}(?!\w)",
    "person": rf"(?<!\p{{L}})(?:{_TITLES})\.? {_NAME}(?: {_NAME})*",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# The same, with what is found by its context as group 1.
MARKED = "|".join(f"({p})" if n == "secret" else f"(?:{p})" for n, p in PATTERNS.items())
# Whoever lacks all of these has no entity; most texts stop here.
HINT = rf"[0-9@=]|AKIA|ASIA|(?:{_TITLES})\.? \p{{Lu}}|(?i:password|passwd|token|secret|key)[ \t]{{0,3}}:"

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Syllables and endings of invented names by script.
NAMES = {
    "latin": ("ba do fe gi ka lo ma ne po ra si to va we yo zu".split(),
              {"male": "ron dan vik les".split(), "female": "lia na ra ssa".split(), "neutral": "is en el or".split(),
               "surname": "son berg well ner".split()}),
    "cyrillic": ("ба до ве га ка ло ма не по ра си то ва зе ю жу".split(),
                 {"male": "рон дан вик лев".split(), "female": "лия на ра сса".split(), "neutral": "ис ен эль ор".split(),
                  "surname": "нов ский ренко вич".split()}),
    "greek": ("βα δο φε γι κα λο μα νε πο ρα σι το θα ξε χο ζη".split(),
              {"male": "ρων δας νος λης".split(), "female": "λια να ρα σσα".split(), "neutral": "ις εν ελ ορ".split(),
               "surname": "πουλος ιδης ακης ακος".split()}),
}


def entities(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def marked(text: Column, ents: Column) -> Column:
    """array<struct<entity, secret>>: whether a context names an entity a secret, looked up where one looks like a card."""
    card = F.exists(ents, lambda e: e.rlike(rf"^(?:{PATTERNS['card']})$"))
    named = F.when(card, F.regexp_extract_all(text, F.lit(MARKED), F.lit(1)))
    return let(named, lambda m: F.transform(ents, lambda e, i: F.struct(
        e.alias("entity"), (F.coalesce(F.get(m, i), F.lit("")) != "").alias("secret"))))


def kind(entity: Column, secret: Column) -> Column:
    """The type of an entity, by its looks; what looks like nothing else is a secret.

    A number with the length of a card number that fails the check sum is none and stays as it is, unless its context
    names it a ``secret``.
    """
    out = F.lit("secret")
    for name in reversed([n for n in PATTERNS if n != "secret"]):
        # A pattern that fits the entity from end to end.
        out = F.when(entity.rlike(rf"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    digits = F.regexp_replace(entity, "[^0-9]", "")
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    valid = F.substring(digits, -1, 1) == luhn_digit(body)
    return F.when((out == "card") & ~valid, F.when(secret, F.lit("secret")).otherwise(F.lit(OTHER))).otherwise(out)


def units(entity: Column, type_: Column) -> Column:
    """array<struct<type, canon>>: what is given a surrogate; two for a full name, else one."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    canon = (F.when(type_ == "email", F.lower(entity))
             .when(type_ == "phone", F.substring(digits, -10, 10))
             .when(type_.isin("card", "ssn"), digits)
             .when(type_ == "iban", F.regexp_replace(entity, " ", "")).otherwise(entity))
    single = F.array(F.struct(type_.alias("type"), canon.alias("canon")))
    title = F.regexp_replace(F.substring_index(entity, " ", 1), r"\.$", "")
    gender = F.when(title.isin(MALE), "male").when(title.isin(FEMALE), "female").otherwise("neutral")

    def part(word, role):
        script = F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
        return F.struct(F.concat_ws(":", F.lit("name"), role, script).alias("type"), F.lower(word).alias("canon"))

    parts = F.filter(F.split(entity, " "), lambda w, i: i > 0)
    names = F.transform(parts, lambda w, i: part(w, F.when(i == F.size(parts) - 1, F.lit("surname")).otherwise(gender)))
    return F.when(type_ == "person", names).otherwise(single)


def surrogate(type_: Column, canon: Column, attempt: int, key: str) -> Column:
    """The surrogate that an entity draws at an attempt."""
    salt = [F.concat(F.lit(f"{key}|{attempt}|{i}|"), type_, F.lit("|"), canon) for i in range(2)]

    def drawn(h):
        def value(i):
            return F.conv(F.substring(h, F.lit(2) * (i % 64) + 1, F.lit(2)), 16, 10).cast("int")

        def letters(alphabet: str, n: int):
            return F.concat(*[F.substring(F.lit(alphabet), value(F.lit(48 + i)) % len(alphabet) + 1, F.lit(1)) for i in range(n)])

        def by_class(text, offset=0):
            hexadecimal = text.rlike("^[0-9a-f]+$")
            return F.array_join(F.transform(F.split(text, ""), lambda c, i: (
                F.when(c.rlike("[1-9]"), ((value(i + offset) % 9) + 1).cast("string"))
                .when(c == "0", (value(i + offset) % 10).cast("string"))
                .when(c.rlike("[a-z]"), F.substring(F.lit(LOWER), value(i + offset) % F.when(hexadecimal, 6).otherwise(26) + 1, F.lit(1)))
                .when(c.rlike("[A-Z]"), F.substring(F.lit(UPPER), value(i + offset) % 26 + 1, F.lit(1)))
                .otherwise(c))), "")

        longer = letters(LOWER, min(attempt, 12)) if attempt else F.lit("")
        domain = F.sha2(F.concat(F.lit(f"{key}|domain|"), F.substring_index(canon, "@", -1)), 256)
        host = F.translate(F.substring(domain, 1, 10), "0123456789", "ghijklmnop")
        email = F.concat(by_class(F.substring_index(canon, "@", 1)), longer, F.lit("@"), host, F.lit(".example"))
        octets = [value(F.lit(i)).cast("string") for i in range(4)]
        first = F.lit("10") if attempt < 8 else (F.lit(240) + value(F.lit(3)) % 15).cast("string")
        body = F.concat(F.substring(canon, 1, 1), by_class(F.expr("substring(canon, 2, length(canon) - 2)")))
        out = (F.when(type_ == "email", email)
               .when(type_ == "ip", F.concat_ws(".", first, *octets[:3]))
               .when(type_ == "card", F.concat(body, luhn_digit(body)))
               .when(type_ == "ssn", F.concat(F.lit("9"), by_class(F.expr("substring(canon, 2)"))))
               .when(type_.isin("access_key"), F.concat(F.substring(canon, 1, 4), by_class(F.expr("substring(canon, 5)"))))
               .when(type_ == "iban", F.concat(F.substring(canon, 1, 2), by_class(F.expr("substring(canon, 3)"))))
               .when(type_ == "phone", by_class(canon)))
        for script, (syllables, endings) in NAMES.items():
            table = F.array(*[F.lit(s) for s in syllables])
            stem = F.concat(*[F.get(table, value(F.lit(8 + i)) % len(syllables)) for i in range(2 + min(attempt, 20))])
            for role, ends in endings.items():
                end = F.get(F.array(*[F.lit(e) for e in ends]), value(F.lit(40)) % len(ends))
                out = out.when(type_ == f"name:{role}:{script}", F.initcap(F.concat(stem, end)))
        return out.otherwise(F.concat(by_class(canon), longer))

    return let(F.concat(*[F.sha2(s, 256) for s in salt]), drawn)


def luhn_digit(body: Column) -> Column:
    """The check digit that completes a card number."""
    n = F.length(body)
    total = F.aggregate(F.transform(F.split(body, ""), lambda c, i: let(
        c.cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1), lambda d: d % 10 + F.floor(d / 10))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def rendered(entity: Column, type_: Column, new: Column) -> Column:
    """A surrogate in the layout of the mention: digits fill its digit places from the right."""
    digits = F.length(F.regexp_replace(entity, "[^0-9]", "")) - F.length(new)
    signs = F.transform(F.split(entity, ""), lambda c, i: F.when(
        c.rlike("[0-9]"), let(F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^0-9]", "")) - digits,
                              lambda at: F.when(at >= 1, F.substring(new, at, F.lit(1))).otherwise(c))).otherwise(c))
    spaced = F.transform(F.split(entity, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(
        new, F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), " ", "")), F.lit(1))))
    return (F.when(type_.isin("phone", "card", "ssn"), F.array_join(signs, ""))
            .when(type_ == "iban", F.array_join(spaced, ""))
            .when(type_ == "person", F.concat(F.substring_index(entity, " ", 1), F.lit(" "), new)).otherwise(new))


def assign(distinct: DataFrame, key: str, scratch: Scratch, attempts: int = 64) -> DataFrame:
    """(type, canon, new): one surrogate for each (type, canon), different within a type and from all originals.

    Each round draws for the entities still without one; of several that draw
    the same, the first keeps it. Rounds after the first see only the few left.
    """
    pending, done = distinct, []
    originals = distinct.select("type", F.col("canon").alias("new"))
    for attempt in range(attempts):
        drawn = pending.withColumn("new", surrogate(F.col("type"), F.col("canon"), attempt, key))
        free = drawn.join(originals, ["type", "new"], "left_anti")
        if done:
            free = free.join(reduce(DataFrame.unionByName, done).select("type", "new"), ["type", "new"], "left_anti")
        first = free.groupBy("type", "new").agg(F.min("canon").alias("canon")).select("type", "canon", "new")
        first = scratch.keep(first, "surrogates")
        done.append(first)
        pending = scratch.keep(pending.join(first, ["type", "canon"], "left_anti"), "pending")
        if not pending.head(1):
            return reduce(DataFrame.unionByName, done)
    raise ValueError("a format has too few values for its entities")


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in its texts and, after its columns, ``n_entities``.

    Texts are read three times and only those with entities are shuffled; equal
    texts are taken apart once. Entities meet their surrogates as rows, so a
    name in a third of all documents is a hot join key, which the optimizer
    splits: the surrogate side has one row per entity.
    """
    scratch = Scratch(docs.sparkSession)
    names = list(docs.columns)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    t = f"c{names.index(text)}"
    found = plain.withColumn("ents", F.coalesce(entities(F.col(t)), F.array().cast("array<string>")))
    hits = found.where(F.size("ents") > 0).withColumn("k", F.unhex(F.md5(F.col(t))))

    mentions = hits.select("k", marked(F.col(t), F.col("ents")).alias("ents")).groupBy("k").agg(
        F.first("ents").alias("ents")).select("k", F.posexplode("ents").alias("at", "e")).select("k", "at", "e.*")
    mentions = scratch.keep(mentions, "mentions")
    known = mentions.select("entity", "secret").distinct().withColumn("kind", kind(F.col("entity"), F.col("secret")))
    known = scratch.keep(known.select("entity", "secret", "kind", units(F.col("entity"), F.col("kind")).alias("units")), "entities")
    parts = known.where(F.col("kind") != OTHER).select("entity", "secret", "kind", F.posexplode("units").alias("i", "u")).select(
        "entity", "secret", "kind", "i", "u.*")
    mapping = assign(scratch.keep(parts.select("type", "canon").distinct(), "distinct"), key, scratch)
    news = parts.join(mapping, ["type", "canon"]).groupBy("entity", "secret", "kind").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]), " ").alias("new"))
    news = scratch.keep(news.select("entity", "secret", rendered(F.col("entity"), F.col("kind"), F.col("new")).alias("new")), "rendered")
    by_text = mentions.join(news, ["entity", "secret"], "left").groupBy("k").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("new", "entity").alias("new")))),
                    lambda x: x["new"]).alias("news"), F.count("new").cast("int").alias("n"))
    by_text = scratch.keep(by_text, "replacements")

    pieces = F.split(t, ENTITY, -1)
    joined = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get("news", i), F.lit("")))), "")
    cols = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    changed = hits.join(by_text, "k").withColumn(t, joined).select(*cols, F.col("n").alias("n_entities"))
    same = found.where(F.size("ents") == 0).select(*cols, F.lit(0).alias("n_entities"))
    return changed.union(same)
