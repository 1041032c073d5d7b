"""Frequent itemsets and association rules.

Identical transactions are counted once with a weight. Itemsets grow level by
level over bitmaps of the items that are frequent alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellframe.functions.items import item_dimensions, itemset_text
from dwellframe.session import ship_package, stage


def transactions(df: DataFrame, items, min_items: int = 3) -> DataFrame:
    """Item sets with multiplicity: ``items`` (sorted, distinct) and ``weight``."""
    rows = df.select(F.sort_array(F.array_distinct(items)).alias("items"))
    rows = rows.groupBy("items").agg(F.count("*").alias("weight"))
    return rows.where(F.size("items") >= min_items)


def item_support(tx: DataFrame) -> DataFrame:
    n = tx.agg(F.sum("weight")).first()[0]
    return (tx.select(F.explode("items").alias("item"), "weight").groupBy("item")
            .agg(F.sum("weight").alias("count")).withColumn("support", F.col("count") / F.lit(n)))


def frequent_itemsets(tx: DataFrame, min_support: float, max_len: int = 4) -> DataFrame:
    """All itemsets up to ``max_len`` with at least ``min_support``: items (sorted), count, support.

    Transactions of at most m items have at most C(m, k) / min_support frequent
    sets of k items, whatever the number of rows, so sets and candidates fit the
    driver. Transactions are turned once into blocks of one bitmap per frequent item;
    a level intersects the bitmaps of its candidates, whose subsets are all
    frequent, in one pass over the blocks, and only one number per candidate leaves a task.
    """
    if max_len < 1:
        raise ValueError("itemsets have at least one item")
    spark = tx.sparkSession
    ship_package(spark)
    tx = stage(tx, "transactions")
    total = tx.agg(F.sum("weight")).first()[0] or 0
    single = tx.select(F.explode("items").alias("item"), "weight").groupBy("item").agg(F.sum("weight").alias("count"))
    often = {r["item"]: r["count"] for r in single.where(F.col("count") / F.lit(max(total, 1)) >= min_support).collect()}
    names = sorted(often)
    found = [((i,), often[name]) for i, name in enumerate(names)]
    level = [s for s, _ in found]
    blocks = stage(tx.mapInArrow(lambda batches: _bitmaps(batches, names), BLOCK), "bitmaps") if names and max_len > 1 else None
    for _ in range(max_len - 1):
        wanted = candidates(level)
        if not len(wanted):
            break
        counts = _counted(blocks, wanted, len(names))
        kept = [(tuple(wanted[r["pos"]].tolist()), r["count"]) for r in counts.where(
            F.col("count") / F.lit(total) >= min_support).collect()]
        found += kept
        level = [s for s, _ in kept]
    rows = [([names[i] for i in s], n, n / total) for s, n in found]
    return spark.createDataFrame(rows, "items array<string>, count long, support double")


def candidates(level: list[tuple[int, ...]]) -> np.ndarray:
    """Sets one item larger than those of a level, all of whose subsets are in the level; a row each, ascending."""
    known, by_prefix = set(level), {}
    for s in sorted(level):
        by_prefix.setdefault(s[:-1], []).append(s[-1])
    out = [(*prefix, x, y) for prefix, ends in by_prefix.items() for i, x in enumerate(ends) for y in ends[i + 1:]
           if all((*prefix[:k], *prefix[k + 1:], x, y) in known for k in range(len(prefix)))]
    return np.array(out, dtype=np.int32).reshape(len(out), len(level[0]) + 1 if level else 0)


BLOCK = "bits binary, planes binary"
AT_ONCE = 1 << 21  # words of bitmaps intersected at once


def _bitmaps(batches, names: list[str]):
    """A block per batch: a bitmap over its rows for every name, and one for every binary digit of the rows' weights."""
    known = pa.array(names, pa.string())
    for batch in batches:
        if not batch.num_rows:
            continue
        items = batch.column("items")
        code = pc.index_in(items.flatten(), value_set=known)
        row = np.repeat(np.arange(len(items)), pc.fill_null(pc.list_value_length(items), 0).to_numpy(zero_copy_only=False))
        seen = code.is_valid().to_numpy(zero_copy_only=False)
        code = pc.fill_null(code, 0).to_numpy(zero_copy_only=False)
        size = -(-len(items) // 64) * 64
        present = np.zeros((len(names), size), bool)
        present[code[seen], row[seen]] = True
        weight = np.zeros(size, np.int64)
        weight[:len(items)] = batch.column("weight").to_numpy(zero_copy_only=False)
        planes = (weight[None, :] >> np.arange(max(1, int(weight.max()).bit_length()))[:, None] & 1).astype(bool)
        yield pa.RecordBatch.from_arrays(
            [pa.array([np.packbits(x, axis=1).tobytes()], pa.binary()) for x in (present, planes)], names=["bits", "planes"])


def _counted(blocks: DataFrame, wanted: np.ndarray, n_names: int) -> DataFrame:
    """(pos, count): the weight of the transactions that hold each candidate, where it is not zero."""
    shared = blocks.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        sets = shared.value
        total = np.zeros(len(sets), np.int64)
        for batch in batches:
            for raw, digits in zip(batch.column("bits").to_pylist(), batch.column("planes").to_pylist()):
                bits = np.frombuffer(raw, np.uint64).reshape(n_names, -1)
                planes = np.frombuffer(digits, np.uint64).reshape(-1, bits.shape[1])
                step = max(1, AT_ONCE // bits.shape[1])
                for lo in range(0, len(sets), step):
                    part = sets[lo:lo + step]
                    both = bits[part[:, 0]]
                    for k in range(1, part.shape[1]):
                        both &= bits[part[:, k]]
                    for p, plane in enumerate(planes):
                        total[lo:lo + step] += np.bitwise_count(both & plane).sum(axis=1, dtype=np.int64) << p
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["pos", "count"])

    return blocks.mapInArrow(run, "pos long, count long").groupBy("pos").agg(F.sum("count").alias("count"))


def rules(itemsets: DataFrame, min_confidence: float) -> DataFrame:
    """Rules from every non-empty split of each itemset, measures rounded to 4 digits.

    Both sides of a split are frequent themselves, so their supports come from
    joining the itemset table with itself on the item arrays. Conviction of a
    certain rule is infinite and shown as null.
    """
    whole = itemsets.where(F.size("items") > 1)
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2.0), F.size("items")) - 2).cast("int"))
    split = whole.select("items", "support", F.explode(masks).alias("mask"))

    def side(bit: int):
        return F.filter("items", lambda x, i: F.getbit(F.col("mask"), i) == bit)
    split = split.select("support", side(1).alias("antecedent"), side(0).alias("consequent"))
    a = itemsets.select(F.col("items").alias("antecedent"), F.col("support").alias("antecedent_support"))
    b = itemsets.select(F.col("items").alias("consequent"), F.col("support").alias("consequent_support"))
    r = split.join(a, "antecedent").join(b, "consequent")
    s, sa, sc = F.col("support"), F.col("antecedent_support"), F.col("consequent_support")
    r = r.withColumn("confidence", s / sa).where(F.col("confidence") >= min_confidence)
    conf = F.col("confidence")
    measures = {
        "antecedent_support": sa, "consequent_support": sc, "support": s, "confidence": conf, "lift": conf / sc,
        "leverage": s - sa * sc, "conviction": F.when(conf < 1, (1 - sc) / (1 - conf)),
    }
    return r.select("antecedent", "consequent", *[F.round(v, 4).alias(k) for k, v in measures.items()])


def screen(rules_df: DataFrame, top_n: int = 50, min_lift: float = 0.8, dimension: str = "区县") -> DataFrame:
    """Readable rules: no district-to-district, lift at least 0.8, best lift first."""
    r = rules_df.withColumns({"ant_types": item_dimensions(F.col("antecedent")),
                              "con_types": item_dimensions(F.col("consequent"))})
    only = F.array(F.lit(dimension))
    r = r.where(~((F.col("ant_types") == only) & (F.col("con_types") == only)) & (F.col("lift") >= min_lift))
    r = r.withColumns({"antecedent": itemset_text(F.col("antecedent")), "consequent": itemset_text(F.col("consequent"))})
    return r.orderBy(F.desc("lift"), "antecedent", "consequent").limit(top_n)


def mine(tx: DataFrame, min_support: float = 0.03, min_confidence: float = 0.5, max_len: int = 4,
         enough: int = 10, retry=(0.01, 0.3, 3)) -> tuple[DataFrame, DataFrame]:
    """Itemsets and rules; fewer than ``enough`` rules start one retry with looser limits."""
    # Written once: the count below and the result read the same rules.
    itemsets = stage(frequent_itemsets(tx, min_support, max_len), "itemsets")
    found = stage(rules(itemsets, min_confidence), "rules")
    if found.limit(enough).count() < enough:
        itemsets = stage(frequent_itemsets(tx, retry[0], retry[2]), "itemsets")
        found = rules(itemsets, retry[1])
    return itemsets, found


def dimension_pairs(screened: DataFrame) -> DataFrame:
    return (screened.select(F.explode("ant_types").alias("a"), "con_types", "lift")
            .select(F.explode("con_types").alias("c"), "a", "lift")
            .select(F.concat_ws(" → ", "a", "c").alias("dimension"), "lift"))


def dimension_lift(screened: DataFrame, min_rules: int = 3) -> DataFrame:
    return (dimension_pairs(screened).groupBy("dimension")
            .agg(F.avg("lift").alias("mean_lift"), F.count("*").alias("rules")).where(F.col("rules") >= min_rules))


def dimension_counts(screened: DataFrame) -> DataFrame:
    return dimension_pairs(screened).groupBy("dimension").agg(F.count("*").alias("rules"))


def length_counts(itemsets: DataFrame) -> DataFrame:
    return itemsets.groupBy(F.size("items").alias("length")).agg(F.count("*").alias("itemsets"))


def top_itemsets(itemsets: DataFrame, n: int = 20) -> DataFrame:
    named = itemsets.select(itemset_text(F.col("items")).alias("itemset"), "support")
    return named.orderBy(F.desc("support"), "itemset").limit(n)


def scatter(screened: DataFrame) -> DataFrame:
    """Rule scatter points: support and confidence in percent."""
    return screened.select("antecedent", "consequent", F.round(F.col("support") * 100, 2).alias("support_pct"),
                           F.round(F.col("confidence") * 100, 2).alias("confidence_pct"), "lift")
