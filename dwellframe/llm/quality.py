"""Quality rules by document and by host, with DataFrame functions only.

Document rules fail single texts. Host rules then look at each domain as a
whole: the failures of every rule are counted by domain, the rates are shrunk
towards the corpus with a beta prior fitted to the domains themselves, and a
domain whose shrunk rate passes a limit takes its documents with it.

Defined results: a null text has no words and fails as too short; a null domain
is no host, so its documents are judged by the document rules alone; repeated
rows are judged alike and all counted; an empty table gives an empty table.
Names of the added columns replace no column that is carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellframe.llm.common import BLANKS, SPACE, Scratch, let, unique_name, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("short", "repeated", "symbols", "dup_lines", "word_length")


def repeat_words(hashes: Column, width: int = 8) -> Column:
    """Words inside windows of ``width`` words that occur twice or more, the first included.

    Windows are compared by hash. Texts without a repeated window, nearly all of
    them, stop after one ``array_distinct``; the others are sorted once, so the
    cost stays n log n for a text that repeats throughout.
    """
    n = F.size(hashes)
    windows = F.when(n >= width, F.transform(
        F.sequence(F.lit(0), n - width),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])))

    def covered(starts):
        steps = F.transform(starts, lambda v, k: F.when(k == 0, F.lit(width)).otherwise(
            F.least(F.lit(width), v - F.get(starts, k - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(pairs):
        def twin(x, k):
            same = [F.coalesce(F.get(pairs, k + d)["h"] == x["h"], F.lit(False)) for d in (-1, 1)]
            return same[0] | same[1]
        return let(F.sort_array(F.transform(F.filter(pairs, twin), lambda x: x["i"])), covered)

    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
        let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)))
    return F.coalesce(F.when(n >= width, counted), F.lit(0)).cast("long")


def measure(docs: DataFrame, text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """The carried columns and the base measures of each text."""
    body = F.coalesce(F.col(text), F.lit(""))
    hashes = unique_name(docs, "word_hashes")
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != F.lit(""))
    first = docs.select(
        *carry,
        F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias(hashes),
        F.length(F.regexp_replace(body, SPACE, "")).cast("long").alias("word_chars"),
        F.size(F.regexp_extract_all(body, F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return first.select(
        *carry, F.size(hashes).cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        repeat_words(F.col(hashes)).alias("n_repeat_words"))


def rule_failures() -> dict[str, Column]:
    """Failure of each document rule; the first two are the base rules."""
    n = F.col("n_words")
    return {
        "short": n < 20,
        "repeated": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": F.col("n_dup_lines") * 20 > n,
        "word_length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 12 * n),
    }


def host_verdicts(measured: DataFrame, domain: str, limit: float = 0.5, strongest: float = 1e6) -> DataFrame:
    """One row per domain: counts, failures and shrunk failure rate of each rule, and ``host_kept``.

    The prior of a rule is a beta distribution with the mean of the corpus and
    the spread between domains that sampling does not explain; its strength lies
    between 1 and ``strongest`` documents. Only the prior's two numbers per rule
    reach the driver.
    """
    fails = rule_failures()
    hosts = (measured.where(F.col(domain).isNotNull()).groupBy(domain)
             .agg(F.count(F.lit(1)).alias("n_docs"),
                  *[F.sum(c.cast("long")).alias(f"{r}_fails") for r, c in fails.items()]))
    scratch = Scratch(measured.sparkSession)
    hosts = scratch.keep(hosts, "hosts")
    n = F.sum("n_docs")
    row = hosts.agg(
        n.alias("n"), F.count(F.lit(1)).alias("hosts"),
        *[F.sum(f"{r}_fails").alias(f"k_{r}") for r in fails],
        *[F.sum(F.col(f"{r}_fails").cast("double") * F.col(f"{r}_fails") / F.col("n_docs")).alias(f"q_{r}")
          for r in fails]).first()
    rates = {}
    for r in fails:
        mean, strength = 0.0, strongest
        if row["n"]:
            mean = row[f"k_{r}"] / row["n"]
            within = mean * (1 - mean)
            between = row[f"q_{r}"] / row["n"] - mean * mean - within * row["hosts"] / row["n"]
            if within > 0 and between > 0:
                strength = min(max(within / between - 1, 1.0), strongest)
        rates[r] = (F.col(f"{r}_fails") + mean * strength) / (F.col("n_docs") + strength)
    out = hosts.withColumns({f"{r}_rate": c for r, c in rates.items()})
    over = F.lit(False)
    for r in fails:
        over = over | (F.col(f"{r}_rate") > limit)
    return out.withColumn("host_kept", ~over)


def judge(docs: DataFrame, domain: str = "source", text: str = "text", carry: Sequence[str] = (),
          limit: float = 0.5) -> DataFrame:
    """Carried columns, measures, ``base_failed`` and ``kept`` for every row.

    The measures are written once and read by both the host counts and the
    join, so the texts are scanned once. The host table is written too; the
    optimizer broadcasts it while it is small and otherwise splits hot domains
    in the join.
    """
    key = unique_name(docs, "judged_domain")
    fails = rule_failures()
    measured = measure(docs.withColumn(key, F.col(domain)), text, [*carry, key])
    measured = measured.withColumn("base_failed", fails["short"] | fails["repeated"])
    scratch = Scratch(docs.sparkSession)
    measured = scratch.keep(measured, "measured")
    hosts = scratch.keep(host_verdicts(measured, key, limit).select(key, "host_kept"), "host-verdicts")
    joined = measured.join(hosts, key, "left")
    return joined.withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("host_kept"), F.lit(True))).drop(key, "host_kept")


def filter_documents(docs: DataFrame, domain: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass both levels, with the columns of ``docs`` only."""
    names = list(docs.columns)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {c: f"c{i}" for i, c in enumerate(names)}
    judged = judge(plain, at[domain], at[text], carry=plain.columns)
    return judged.where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
