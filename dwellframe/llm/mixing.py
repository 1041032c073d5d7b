"""Mixing sources to target weights by capped water-filling.

Every source asks for a share of the words by its weight, but may be repeated
at most ``max_epochs`` times. Sources that would pass the cap are clamped to it
and their excess goes to the others by weight, until nobody is above. A source
then takes every document a whole number of times, and a seeded part of its
documents once more.

Defined results: a null text has size 0 and takes part with nothing; null is a
source of its own; rows with equal id and text are taken alike; a source
without words has target 0; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellframe.llm.common import Scratch, words


def sized(docs: DataFrame, source: str, text: str, doc_id: str, seed: str, carry: Sequence[str] = ()) -> DataFrame:
    """``m_source``, ``m_size`` in words and the seeded order key ``m_key`` of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"),
                         F.md5(body)))
    return docs.select(*carry, F.col(source).alias("m_source"),
                       F.size(words(F.col(text))).cast("long").alias("m_size"), key.alias("m_key"))


def cyclic_weights(sources: DataFrame, weights: Sequence[float] = (1, 2, 3)) -> DataFrame:
    """Weights in turn over the sources by code point, null last. One row per source passes one task."""
    rank = F.row_number().over(Window.orderBy(F.col("m_source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), rank % len(weights)))


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to (m_source, source_size, weight).

    Each round clamps the sources whose share passes their cap and shares what
    is left; clamping only grows, so the rounds end. Two sums per round reach the driver.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    left, weight = float(total), float(sources.agg(F.sum("weight")).first()[0] or 0)
    while True:
        over = cap * F.lit(weight) < F.lit(left) * F.col("weight")
        row = sources.agg(
            F.sum(F.when(over, cap).otherwise(0.0)).alias("taken"),
            F.sum(F.when(over, F.lit(0.0)).otherwise(F.col("weight"))).alias("weight")).first()
        new_left, new_weight = float(total) - (row["taken"] or 0.0), row["weight"] or 0.0
        if new_weight == weight or not new_weight:
            break
        left, weight = new_left, new_weight
    share = F.lit(left) * F.col("weight") / F.lit(weight) if weight else F.lit(0.0)
    return sources.withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(cap, share)))


def cut_keys(rows: DataFrame, need: DataFrame) -> DataFrame:
    """For each source the key up to which its documents are taken once more.

    The documents of a source are ordered by their seeded key. The key is found
    digit by digit: words are summed by three hexadecimal digits, the group in
    which the wanted sum falls is opened, and so on, so no task ever orders a
    whole source. In the last group the nearer of the two sums wins.
    """
    def same(a: str, b: str) -> Column:
        return F.col(a).eqNullSafe(F.col(b))

    found = need.select(F.col("m_source").alias("n_source"), F.col("need").alias("n_need"),
                        F.lit(0).cast("long").alias("n_base"), F.lit("").alias("n_prefix"))
    for digits in (3, 6, 32):
        inside = rows.join(found, same("m_source", "n_source")).where(
            (F.col("n_need") > 0) & F.col("m_key").startswith(F.col("n_prefix")))
        sums = inside.groupBy("n_source", "n_need", "n_base", F.substring("m_key", 1, digits).alias("prefix")).agg(
            F.sum("m_size").alias("words"))
        order = Window.partitionBy("n_source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("after", F.col("n_base") + F.sum("words").over(order))
        before = F.col("after") - F.col("words")
        if digits < 32:
            found = (sums.where((before < F.col("n_need")))
                     .groupBy("n_source", "n_need")
                     .agg(F.max(F.struct("prefix", before.alias("base"))).alias("at"))
                     .select("n_source", "n_need", F.col("at.base").alias("n_base"),
                             F.col("at.prefix").alias("n_prefix")))
        else:
            near = (before < F.col("n_need")) & (F.col("after") - F.col("n_need") <= F.col("n_need") - before)
            last = sums.where(near).groupBy("n_source").agg(F.max("prefix").alias("last"))
            last = last.withColumnRenamed("n_source", "l_source")
            return found.join(last, same("n_source", "l_source"), "left").select(
                "n_source", F.coalesce("last", "n_prefix").alias("cut"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id",
        weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3, seed: str = "mix",
        carry: Sequence[str] = ()) -> DataFrame:
    """Carried columns, ``m_size``, ``source_size``, ``target`` and ``repeats`` of every row."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(sized(docs, source, text, doc_id, seed, carry), "sized")
    sources = cyclic_weights(rows.groupBy("m_source").agg(F.sum("m_size").alias("source_size")), weights)
    sources = scratch.keep(sources, "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    filled = water_fill(sources, total, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    filled = scratch.keep(filled.withColumn("whole", whole.cast("long")).withColumn(
        "need", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    cuts = scratch.keep(cut_keys(rows.select("m_source", "m_size", "m_key"), filled.select("m_source", "need")), "cuts")
    plan = filled.join(cuts, F.col("m_source").eqNullSafe(F.col("n_source")), "left").select(
        F.col("m_source").alias("p_source"), "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut"))
    plan = scratch.keep(plan, "plan")
    out = rows.join(plan, F.col("m_source").eqNullSafe(F.col("p_source")))
    more = (F.col("m_key") <= F.col("cut")).cast("long")
    return out.select(*carry, "m_size", "source_size", "target", (F.col("whole") + more).alias("repeats"))


def mixed_documents(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id",
                    **options) -> DataFrame:
    """The documents of the mix: every row as often as it is taken, with the columns of ``docs``."""
    names = list(docs.columns)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {c: f"c{i}" for i, c in enumerate(names)}
    taken = mix(plain, at[source], at[text], at[doc_id], carry=plain.columns, **options).where("repeats > 0")
    copies = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return copies.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
