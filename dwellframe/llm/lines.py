"""Line de-duplication by pairwise alignment.

A document's lines are hashed. A run of lines that together hold ``min_words``
words (one long line, or several short ones) is rare enough to seed: a short
common line never seeds alone. Every run's first holder, the earliest document
with it, is paired with each later holder, so a passage in n documents makes
n - 1 pairs. The two line sequences of a pair are aligned by patience diff, and
aligned blocks of at least ``min_words`` words are deleted from the later
document; seeding runs that the alignment could not take because they moved are
deleted as well. The earliest holder keeps its lines.

Earlier means the smaller id, null ids last, then the text's hash.

Defined results: a null text has no lines and stays null; rows with equal id
and text count as one document and get the same result; lines without words
are removed only inside a deleted block; a document that loses all its lines
keeps an empty text; an empty table gives an empty table; columns of ``docs``
may have any names.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellframe.llm.common import Scratch

LINES = "hashes array<long>, words array<int>, runs array<long>"


def line_runs(hashes: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of the shortest run from each non-blank line that reaches ``min_words``."""
    ends = np.concatenate([[0], np.cumsum(words)])
    starts = np.flatnonzero(words > 0)
    stops = np.searchsorted(ends, ends[starts] + min_words)
    found = stops <= len(words)
    starts, stops = starts[found], stops[found]
    runs = np.array([xxhash.xxh3_64_intdigest(hashes[i:j].tobytes()) for i, j in zip(starts, stops)], dtype=np.uint64)
    return starts, runs.view(np.int64)


def hashed_lines(text: bytes, min_words: int):
    lines = text.split(b"\n")
    hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], dtype=np.uint64).view(np.int64)
    words = np.array([len(x.split()) for x in lines], dtype=np.int32)
    return hashes, words, np.unique(line_runs(hashes, words, min_words)[1])


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence (patience sorting)."""
    tops, at, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences, increasing in both.

    Between equal ends, lines that are unique on both sides anchor the
    alignment; where none is unique, equal lines are paired by occurrence.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        in_a, in_b = {}, {}
        for at, seq, lo, hi in ((in_a, a, i, i2), (in_b, b, j, j2)):
            for k in range(lo, hi):
                at.setdefault(seq[k], []).append(k)
        common = [(x, in_b[h]) for h, x in in_a.items() if h in in_b]
        anchors = sorted((x[0], y[0]) for x, y in common if len(x) == len(y) == 1)
        if not anchors:
            anchors = sorted(p for x, y in common for p in zip(x, y))
            if not anchors:
                continue
        anchors = [anchors[k] for k in longest_increasing([y for _, y in anchors])]
        out += anchors
        for (x, y), (x2, y2) in zip([(i - 1, j - 1), *anchors], [*anchors, (i2, j2)]):
            todo.append((x + 1, x2, y + 1, y2))
    return sorted(out)


def repeated_lines(later, words, earlier, earlier_words, min_words: int) -> list[int]:
    """Lines of ``later`` to delete: aligned blocks, and moved seeding runs, of ``min_words`` words or more."""
    later, words, earlier = np.asarray(later), np.asarray(words), np.asarray(earlier)
    gone = np.zeros(len(later), dtype=bool)
    pairs = patience(later.tolist(), earlier.tolist())
    lo = 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or pairs[k] != (pairs[k - 1][0] + 1, pairs[k - 1][1] + 1):
            block = slice(pairs[lo][0], pairs[k - 1][0] + 1)
            if words[block].sum() >= min_words:
                gone[block] = True
            lo = k
    starts, runs = line_runs(later, words, min_words)
    known = np.isin(runs, line_runs(earlier, np.asarray(earlier_words), min_words)[1])
    ends = np.concatenate([[0], np.cumsum(words)])
    # Runs of one passage overlap; every line that a known run covers goes.
    for i in starts[known]:
        gone[i:int(np.searchsorted(ends, ends[i] + min_words))] = True
    return np.flatnonzero(gone).tolist()


def ranges(lines: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for i in sorted(set(lines)):
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [tuple(x) for x in out]


def repeated_blocks(docs: DataFrame, text: str, doc_id: str, min_words: int) -> DataFrame:
    """(k, spans): the line ranges to delete, for documents that have any. ``k`` is ``row_key``."""
    scratch = Scratch(docs.sparkSession)

    @F.pandas_udf(LINES)
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([hashed_lines(x, min_words) for x in texts], columns=["hashes", "words", "runs"])

    @F.pandas_udf("array<int>")
    def align(later: pd.Series, words: pd.Series, earlier: pd.Series, earlier_words: pd.Series) -> pd.Series:
        return pd.Series([repeated_lines(*x, min_words) for x in zip(later, words, earlier, earlier_words)])

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def spans(lines: pd.Series) -> pd.Series:
        return pd.Series([[{"first": a, "last": b} for a, b in ranges(x)] for x in lines])

    read_lines = docs.where(F.col(text).isNotNull()).select(
        row_key(doc_id, text).alias("k"), F.col(doc_id).alias("id"), read(F.col(text).cast("binary")).alias("l"))
    seqs = scratch.keep(read_lines.select("k", "id", "l.*").dropDuplicates(["k"]), "lines")
    runs = seqs.select("k", F.struct(F.col("id").isNull().alias("n"), "id", "k").alias("o"), F.explode("runs").alias("run"))
    firsts = runs.groupBy("run").agg(F.min("o").alias("first"), F.max("o").alias("last"))
    firsts = firsts.where(F.col("first.k") != F.col("last.k")).select("run", F.col("first.k").alias("e"))
    pairs = runs.select("k", "run").join(firsts, "run").where("k <> e").select("k", "e").distinct()
    pairs = scratch.keep(pairs, "line-pairs")
    later = seqs.select("k", F.col("hashes").alias("h"), F.col("words").alias("w"))
    earlier = seqs.select(F.col("k").alias("e"), F.col("hashes").alias("eh"), F.col("words").alias("ew"))
    aligned = pairs.join(earlier, "e").join(later, "k").select("k", align("h", "w", "eh", "ew").alias("lines"))
    gone = aligned.where(F.size("lines") > 0).groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))
    return scratch.keep(gone.select("k", spans("lines").alias("spans")), "line-spans")


def row_key(doc_id: str, text: str):
    """128 bits for id and text together."""
    body = F.coalesce(F.md5(F.col(text)), F.lit(""))
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), body)))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = 50) -> DataFrame:
    """``docs`` with cleaned texts and, after its columns, ``spans`` (first and last line deleted, from 0; empty if none)."""
    names = list(docs.columns)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    t, d = f"c{names.index(text)}", f"c{names.index(doc_id)}"
    spans = repeated_blocks(plain.select(t, d), t, d, min_words)
    # Sorted and merged at every size: the spans grow with the input, so they are not sent to all tasks.
    joined = plain.withColumn("k", row_key(d, t)).join(spans.hint("merge"), "k", "left")
    kept = F.filter(F.split(t, "\n"), lambda x, i: ~F.exists("spans", lambda s: i.between(s["first"], s["last"])))
    cleaned = F.when(F.col("spans").isNull(), F.col(t)).otherwise(F.array_join(kept, "\n"))
    none = F.array().cast("array<struct<first:int,last:int>>")
    out = joined.withColumn(t, cleaned)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.coalesce("spans", none).alias("spans"))
