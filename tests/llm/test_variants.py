"""Words one edit apart, against all pairs compared letter by letter."""

import random
import re
import zlib
from collections import Counter

import pytest

from dwellframe.llm import variants

UP = str.maketrans(variants.UPPER, variants.LOWER)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute_variants(n, ratio=10):
    """{word: (form, root, n, n_near, form_n)}."""
    forms, out = {}, {}
    for w in n:
        others = [v for v in n if abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = [forms[w], w, n[w], len(others), n[forms[w]] if forms[w] else None]
    for w, row in out.items():
        while forms[row[1]]:
            row[1] = forms[row[1]]
    return {w: tuple(r) for w, r in out.items()}


def brute_words(rows, noise=31):
    out = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n > 1}


@pytest.fixture(scope="module")
def dictionary():
    """Words around a few stems, some with many near ones, ties, long words and letters beyond a-z."""
    rng = random.Random(11)
    letters = "abcdeeeiinorstüéß÷"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 14))) for _ in range(60)] + ["a" * 300, "ab" * 600, "×" * 7]
    words = {}
    for s in stems:
        words[s] = rng.choice([2, 30, 5000])
        for _ in range(12):
            w = list(s)
            for _ in range(rng.choice([1, 1, 1, 2])):
                at = rng.randrange(len(w))
                kind = rng.randrange(4)
                if kind == 0:
                    w[at] = rng.choice(letters)
                elif kind == 1:
                    w.insert(at, rng.choice(letters))
                elif kind == 2 and len(w) > 7:
                    del w[at]
                else:
                    w[at - 1], w[at] = w[at], w[at - 1]
            words.setdefault("".join(w), rng.choice([2, 2, 3, 20, 250]))
    return words


@pytest.mark.parametrize("cell_words,fine_from", [(20_000, 1000), (3, 1), (40, 1)])
def test_equals_all_pairs(spark, dictionary, monkeypatch, cell_words, fine_from):
    monkeypatch.setattr(variants, "FINE_FROM", fine_from)
    monkeypatch.setattr(variants, "PAIRS", 10)
    df = spark.createDataFrame(list(dictionary.items()), "word string, n long")
    got = variants.group_variants(df, cell_words=cell_words).collect()
    assert {r["word"]: tuple(r)[1:] for r in got} == brute_variants(dictionary) and len(got) == len(dictionary)


def test_long_chains_end_at_the_root(spark):
    chain = {"abcdefg" + "h" * i: 2 * 10 ** i for i in range(14)}
    df = spark.createDataFrame(list(chain.items()), "word string, n long")
    got = variants.group_variants(df).collect()
    assert {r["root"] for r in got} == {"abcdefg" + "h" * 13}
    assert {r["word"]: tuple(r)[1:] for r in got} == brute_variants(chain)


def test_words_of_documents(spark, documents, hard_documents, clashing, no_documents):
    for docs in (documents.select("doc_id", "text"), hard_documents, clashing):
        got = {r["word"]: r["n"] for r in variants.count_words(docs, noise=31).collect()}
        assert got == brute_words(docs.select("doc_id", "text").collect())
    assert variants.group_variants(variants.count_words(no_documents, noise=31)).count() == 0
    text = "Éclairage éclairage ÉCLAIRAGE eclairage eclairage " + "long" * 50_000
    df = spark.createDataFrame([(None, text), (1, None), (2, ""), (3, text)], "doc_id long, text string")
    counted = variants.count_words(df)
    assert {r["word"]: r["n"] for r in counted.collect()} == brute_words(df.collect(), noise=1 << 40)
    assert variants.group_variants(counted).where("n_near > 0").count() == 3
