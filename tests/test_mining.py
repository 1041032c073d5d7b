"""Itemsets by bitmaps against every subset counted one by one."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dwellframe.operators import mining


def brute(rows, support, max_len):
    total, counts = sum(w for _, w in rows), Counter()
    for items, w in rows:
        for k in range(1, max_len + 1):
            for s in itertools.combinations(sorted(set(items)), k):
                counts[s] += w
    return {(s, n) for s, n in counts.items() if n / total >= support}


@pytest.mark.parametrize("support,max_len,parts", [(0.05, 5, 3), (0.3, 2, 1), (0.02, 3, 8), (0.9, 4, 2)])
def test_equals_brute_force(spark, support, max_len, parts):
    rng = random.Random(max_len)
    names = [f"d{i % 7}=v{i}" for i in range(30)]
    rows = [(sorted(rng.sample(names, rng.randint(1, 12), counts=range(1, 31))), rng.choice([1, 1, 2, 7, 5_000_000_000])) for _ in range(300)]
    rows = [(sorted(set(x)), w) for x, w in rows]
    df = spark.createDataFrame(rows, "items array<string>, weight long").repartition(parts)
    got = mining.frequent_itemsets(df, support, max_len).collect()
    assert {(tuple(r["items"]), r["count"]) for r in got} == brute(rows, support, max_len) and len(got) == len(brute(rows, support, max_len))


def test_candidates_have_only_frequent_subsets():
    rng = random.Random(8)
    for _ in range(30):
        level = sorted(rng.sample(list(itertools.combinations(range(9), 3)), rng.randint(1, 60)))
        want = [s for s in itertools.combinations(range(9), 4) if all(x in level for x in itertools.combinations(s, 3))]
        assert mining.candidates(level).tolist() == [list(s) for s in want]
    assert len(mining.candidates([])) == 0


def test_empty_and_null_items(spark):
    df = spark.createDataFrame([([], 3), (None, 2), (["a"], 5), (["a", "b"], 10)], "items array<string>, weight long")
    got = {(tuple(r["items"]), r["count"]) for r in mining.frequent_itemsets(df, 0.4, 3).collect()}
    assert got == {(("a",), 15), (("b",), 10), (("a", "b"), 10)}
    assert mining.frequent_itemsets(df.where(F.lit(False)), 0.1).count() == 0
