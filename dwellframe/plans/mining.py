"""Transaction, itemset and rule queries."""

from pyspark.sql import functions as F

from dwellframe.functions import housing
from dwellframe.functions.items import listing_items
from dwellframe.operators import mining as mn
from dwellframe.operators.filters import keyword_rules, valid_for_analysis
from dwellframe.plans.registry import query
from dwellframe.plans.statistics import AREA_CASE, TOTAL_CASE, UNIT_CASE
from dwellframe.plans.views import dealt_listings as listings, on_listings

VALID = """total_price > 0 AND total_price < 5000 AND area > 0 AND area < 500 AND rooms > 0 AND rooms <= 10
      AND status = 'on_sale'"""
_TX = f"""tx AS (SELECT list_sort(list_filter([concat('区县=', district),
      concat('单价=', {UNIT_CASE}), concat('总价=', {TOTAL_CASE}), concat('面积=', {AREA_CASE}),
      CASE WHEN rooms >= 5 THEN '户型=5室+' ELSE concat('户型=', rooms, '室') END,
      CASE WHEN decoration <> '' THEN concat('装修=', decoration) END, concat('楼层=', floor_type),
      CASE WHEN orientation = '' THEN NULL WHEN orientation LIKE '%南%' THEN '朝向=南向' ELSE '朝向=其他' END,
      CASE WHEN build_year > 1980 THEN CASE WHEN 2026 - build_year < 5 THEN '房龄=5年内' WHEN 2026 - build_year < 10 THEN '房龄=5-10年'
        WHEN 2026 - build_year < 15 THEN '房龄=10-15年' WHEN 2026 - build_year < 20 THEN '房龄=15-20年' ELSE '房龄=20年+' END END,
      concat('来源=', source)], lambda x: x IS NOT NULL)) AS items, count(*) AS weight FROM listings WHERE {VALID} GROUP BY 1),
    total AS (SELECT sum(weight) AS n FROM tx)"""
# Levels by brute force over index combinations of each distinct transaction.
_SETS = _TX + """, ix AS (SELECT unnest(range(1, 11)) AS i),
    sets AS (
      SELECT [items[a.i]] AS items, sum(weight) AS c FROM tx, ix a WHERE a.i <= len(items) GROUP BY 1
      UNION ALL SELECT [items[a.i], items[b.i]], sum(weight) FROM tx, ix a, ix b WHERE a.i < b.i AND b.i <= len(items) GROUP BY 1
      UNION ALL SELECT [items[a.i], items[b.i], items[c.i]], sum(weight) FROM tx, ix a, ix b, ix c
        WHERE a.i < b.i AND b.i < c.i AND c.i <= len(items) GROUP BY 1
      UNION ALL SELECT [items[a.i], items[b.i], items[c.i], items[d.i]], sum(weight) FROM tx, ix a, ix b, ix c, ix d
        WHERE a.i < b.i AND b.i < c.i AND c.i < d.i AND d.i <= len(items) GROUP BY 1),
    freq AS MATERIALIZED (SELECT items, cast(c AS bigint) AS count, c / (SELECT n FROM total) AS support FROM sets
             WHERE c / (SELECT n FROM total) >= {s} AND len(items) <= {k})"""
_TRIPLES = _SETS[:_SETS.index("      UNION ALL SELECT [items[a.i], items[b.i], items[c.i], items[d.i]]")] + "),\n" + _SETS[_SETS.index("    freq AS"):]
# Rules use the looser retry limits and sets of up to three items.
_RULES = _TRIPLES.format(s=0.01, k=3) + """,
    m AS (SELECT items, support, unnest(range(1, cast(pow(2, len(items)) - 1 AS bigint))) AS mask FROM freq WHERE len(items) > 1),
    sp AS (SELECT support, list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS a,
                  list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 0) AS c FROM m),
    r AS (SELECT a, c, sp.support AS s, fa.support AS sa, fc.support AS sc, sp.support / fa.support AS conf
          FROM sp JOIN freq fa ON fa.items = a JOIN freq fc ON fc.items = c WHERE sp.support / fa.support >= 0.3),
    rules AS (SELECT a, c, array_to_string(a, ', ') AS antecedent, array_to_string(c, ', ') AS consequent,
        round(sa, 4) AS antecedent_support, round(sc, 4) AS consequent_support, round(s, 4) AS support,
        round(conf, 4) AS confidence, round(conf / sc, 4) AS lift, round(s - sa * sc, 4) AS leverage,
        CASE WHEN conf < 1 THEN round((1 - sc) / (1 - conf), 4) END AS conviction FROM r),
    screened AS (SELECT * FROM rules WHERE lift >= 0.8 ORDER BY lift DESC, antecedent, consequent LIMIT 50),
    pairs AS (SELECT concat(ta, ' → ', tc) AS dimension, lift FROM
      (SELECT lift, ta, unnest(list_transform(c, lambda x: split_part(x, '=', 1))) AS tc FROM
        (SELECT lift, c, unnest(list_transform(a, lambda x: split_part(x, '=', 1))) AS ta FROM screened)))"""
_RULE_COLUMNS = """antecedent, consequent, antecedent_support, consequent_support, support, confidence, lift, leverage,
    conviction"""


def _tx(spark, sf):
    df = listings(spark, sf, "district", "unit_price", "total_price", "area", "rooms", "decoration", "floor_type",
                  "orientation", "build_year", "source", "status").where(valid_for_analysis())
    return mn.transactions(df, listing_items(2026))


def _rules(spark, sf):
    return mn.mine(_tx(spark, sf), 0.01, 0.3, 3)[1]


@query("transactions", "F25 A38", on_listings(f"""
    WITH {_TX} SELECT array_to_string(items, ', ') AS items, weight FROM tx"""))
def transactions(spark, sf):
    from dwellframe.functions.items import itemset_text
    return _tx(spark, sf).select(itemset_text(F.col("items")).alias("items"), "weight")


@query("transaction_size", "A38", on_listings(f"""
    WITH {_TX} SELECT cast(sum(weight) AS bigint) AS transactions, round(sum(len(items) * weight) / sum(weight), 4) AS mean_items FROM tx"""))
def transaction_size(spark, sf):
    return _tx(spark, sf).agg(
        F.sum("weight").alias("transactions"),
        F.round(F.sum(F.size("items") * F.col("weight")) / F.sum("weight"), 4).alias("mean_items"))


@query("item_support", "A29", on_listings(f"""
    WITH {_TX}, e AS (SELECT unnest(items) AS item, weight FROM tx)
    SELECT item, cast(sum(weight) AS bigint) AS count, round(sum(weight) / (SELECT n FROM total), 6) AS support FROM e GROUP BY item"""))
def item_support(spark, sf):
    return mn.item_support(_tx(spark, sf)).withColumn("support", F.round("support", 6))


@query("frequent_itemsets", "M15 F27", on_listings(f"""
    WITH {_SETS.format(s=0.03, k=4)} SELECT array_to_string(items, ', ') AS itemset, count, round(support, 6) AS support FROM freq"""))
def frequent_itemsets(spark, sf):
    from dwellframe.functions.items import itemset_text
    sets = mn.frequent_itemsets(_tx(spark, sf), 0.03, 4)
    return sets.select(itemset_text(F.col("items")).alias("itemset"), "count", F.round("support", 6).alias("support"))


@query("itemset_lengths", "A32", on_listings(f"""
    WITH {_SETS.format(s=0.03, k=4)} SELECT cast(len(items) AS int) AS length, count(*) AS itemsets FROM freq GROUP BY 1"""))
def itemset_lengths(spark, sf):
    return mn.length_counts(mn.frequent_itemsets(_tx(spark, sf), 0.03, 4))


@query("top_itemsets", "O4", on_listings(f"""
    WITH {_TRIPLES.format(s=0.03, k=2)} SELECT array_to_string(items, ', ') AS itemset, round(support, 6) AS support FROM freq
    ORDER BY freq.support DESC, itemset LIMIT 20"""))
def top_itemsets(spark, sf):
    sets = mn.frequent_itemsets(_tx(spark, sf), 0.03, 2)
    return mn.top_itemsets(sets).withColumn("support", F.round("support", 6))


@query("rules", "M16 J12 F28", on_listings(f"WITH {_RULES} SELECT {_RULE_COLUMNS} FROM rules"))
def rules(spark, sf):
    from dwellframe.functions.items import itemset_text
    r = _rules(spark, sf)
    return r.withColumns({"antecedent": itemset_text(F.col("antecedent")), "consequent": itemset_text(F.col("consequent"))})


@query("rules_screened", "M17 M18 O3 F26", on_listings(f"""
    WITH {_RULES} SELECT {_RULE_COLUMNS}, CASE WHEN lift >= 6 THEN '≥6' WHEN lift >= 4 THEN '≥4' WHEN lift >= 2 THEN '≥2'
      ELSE '<2' END AS tier, CASE WHEN lift > 2 THEN 'strong' WHEN lift > 1.2 THEN 'medium' ELSE 'weak' END AS strength
    FROM screened"""))
def rules_screened(spark, sf):
    # 30 % and 95 % leave fewer than ten rules, so the miner falls back to its looser limits.
    found = mn.mine(_tx(spark, sf), 0.3, 0.95, 4)[1]
    return mn.screen(found).withColumns({
        "tier": housing.lift_tier(F.col("lift")), "strength": housing.lift_strength(F.col("lift"))}).drop("ant_types", "con_types")


@query("rule_dims", "A30 A31", on_listings(f"""
    WITH {_RULES} SELECT dimension, count(*) AS rules, CASE WHEN count(*) >= 3 THEN round(avg(lift), 4) END AS mean_lift
    FROM pairs GROUP BY dimension"""))
def rule_dims(spark, sf):
    top = mn.screen(_rules(spark, sf))
    lifts = mn.dimension_lift(top).select("dimension", F.round("mean_lift", 4).alias("mean_lift"))
    return mn.dimension_counts(top).join(lifts, "dimension", "left")


@query("rule_scatter", "M19 P17 O3", on_listings(f"""
    WITH {_RULES} SELECT antecedent, consequent, round(support * 100, 2) AS support_pct,
      round(confidence * 100, 2) AS confidence_pct, lift FROM screened ORDER BY lift DESC, antecedent, consequent LIMIT 10"""))
def rule_scatter(spark, sf):
    return mn.scatter(keyword_rules(mn.screen(_rules(spark, sf)), 10))
