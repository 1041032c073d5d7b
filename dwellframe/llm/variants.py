"""Spelling variants: words one edit apart, grouped under their far commoner forms.

One edit changes a word's letter counts by a squared distance of at most two:
2 or 0 where a letter is replaced, 1 where one is inserted. So words are
dealt into cells by how many of their letters fall into each of a few classes
(which fixes their length), a cell meets only cells that an edit can reach, and
inside a task NumPy products of blocks of letter counts give all squared distances
of a block and its neighbours. Pairs at most two apart are verified letter by
letter. Words of a cell that is still large are split over several tasks, and
only sums and the best partner of each word leave a task.

Defined results: null and empty texts have no words; rows without id take part
under an empty id; repeated rows count each; ties go to the smallest word in
code-point order; an empty table gives an empty table; columns other than
those named play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellframe.llm.common import Scratch, let

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CELL_WORDS = 20_000  # words of a cell that one task compares with their neighbours
MOST_CLASSES = 9
FINE, FINE_FROM = 10, 1000  # classes of the blocks inside a task, and words from which they are used (else one: the length)
VERIFY = 1 << 22  # letters compared at once
PAIRS = 1 << 20  # verified pairs held before they are summed up


def long_runs(text: Column, at_least: int) -> Column:
    """The maximal runs of letters with so many of them, as they stand; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{LETTERS}]{{{at_least},}}"), F.lit(0))


def noisy(doc_id: Column, run: Column, every: int = 31) -> Column:
    """``run`` without one letter where the crc32 of '<id>:<run>' is a multiple of ``every``."""
    def cut(h: Column) -> Column:
        at = (h % F.length(run)).cast("int")
        return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)

    return let(F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary")), cut)


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = 7, least: int = 2,
                noise: int | None = None) -> DataFrame:
    """(word, n): the words of all texts with at least ``shortest`` letters and ``least`` occurrences.

    Only A-Z are lower-cased. ``noise`` takes a letter out of one in so many words.
    """
    runs = docs.select(F.col(doc_id).alias("d"), F.explode(long_runs(F.col(text).cast("string"), shortest)).alias("run"))
    runs = runs.select("d", F.translate("run", UPPER, LOWER).alias("run"))
    word = noisy(F.col("d"), F.col("run"), noise) if noise else F.col("run")
    return runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def letter_uses(words: DataFrame) -> list[tuple[str, int]]:
    """(letter, uses) of the alphabet, the commonest first."""
    used = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").agg(
        F.count(F.lit(1)).alias("uses"))
    return sorted(((r["c"], r["uses"]) for r in used.collect()), key=lambda x: (-x[1], x[0]))


def letter_classes(uses: Sequence[tuple[str, int]], n: int) -> list[list[str]]:
    """The letters dealt into ``n`` classes of about equal use."""
    classes, total = [[] for _ in range(n)], [0] * n
    for letter, used in uses:
        i = total.index(min(total))
        classes[i].append(letter)
        total[i] += used
    return classes


def class_counts(word: Column, classes: Sequence[Sequence[str]]) -> Column:
    """How many letters of a word fall into each class."""
    rest = [[c for other in classes if other is not own for c in other] for own in classes]
    return F.array(*[F.length(F.translate(word, "".join(r), "")) if r else F.length(word) for r in rest])


def cell_name(counts: Sequence[Column]) -> Column:
    return F.concat_ws(",", *counts)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letter codes padded by -1, lengths, letters per code), codes being numbers of the letters that occur."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    found, codes = np.unique(flat, return_inverse=True)
    out = np.full((len(words), int(lengths.max())), -1, np.int16)
    out[np.arange(out.shape[1]) < lengths[:, None]] = codes
    return out, lengths, np.stack([np.bincount(codes, minlength=len(found)), found])


def _counts(codes: np.ndarray, letters: int) -> np.ndarray:
    """Letter counts per word; doubles hold their products exactly."""
    out = np.zeros((len(codes), letters), np.float64 if codes.shape[1] > 1000 else np.float32)
    rows, at = np.nonzero(codes >= 0)
    np.add.at(out, (rows, codes[rows, at]), 1)
    return out


def one_edit(codes: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs differ by exactly one letter replaced or, where b is shorter by one, one taken out of a."""
    out = np.zeros(len(a), bool)
    step = max(1, VERIFY // codes.shape[1])
    for lo in range(0, len(a), step):
        x, y = codes[a[lo:lo + step]], codes[b[lo:lo + step]]
        same = lengths[a[lo:lo + step]] == lengths[b[lo:lo + step]]
        differ = x != y
        out[lo:lo + step] = same & (differ.sum(axis=1) == 1)
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
        moved = x[:, 1:] != y[:, :-1]  # after the letter that b lacks, a runs one ahead
        after = moved & (np.arange(x.shape[1] - 1) >= first[:, None])
        out[lo:lo + step] |= ~same & ~after.any(axis=1)
    return out


def near_in_cell(words: list[str], n: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, near words, best) over the pairs of a cell's words with all that were sent to it; numbers of words.

    Role 0 are the cell's words of this task, 1 its other words, 2 words of cells
    from which an edit leads here, which are as long or a letter shorter. A block
    are the words of one length or, where there are many, with the same counts in
    ten classes of letters; it is multiplied with the blocks that one edit can reach.
    """
    codes, lengths, (uses, _) = _letters(words)
    order = np.argsort(-uses, kind="stable")
    classes = np.empty(len(uses), np.int64)
    depth = FINE if len(words) >= FINE_FROM else 1
    classes[order] = np.arange(len(uses)) % depth
    counts = _counts(codes, len(uses))
    fine = np.zeros((len(words), depth), np.int32)
    for c in range(depth):
        fine[:, c] = counts[:, classes == c].sum(axis=1)
    rank = np.empty(len(words), np.int64)
    rank[np.array(sorted(range(len(words)), key=words.__getitem__))] = np.arange(len(words))
    square = (counts * counts).sum(axis=1)
    inverse = np.unique(fine, axis=0, return_inverse=True)[1].ravel()
    by_block = np.argsort(inverse, kind="stable")
    blocks = {fine[rows[0]].tobytes(): rows for rows in np.split(by_block, np.flatnonzero(np.diff(inverse[by_block])) + 1)}
    unit = np.eye(depth, dtype=np.int32)
    steps = np.concatenate([0 * unit[:1], -unit, *(unit[[i]] - np.delete(unit, i, 0) for i in range(depth))])
    key = fine[:1].nbytes
    held, held_size, sums = [], 0, []

    def settle():
        nonlocal held, held_size
        if held:
            a, b = (np.concatenate(x) for x in zip(*held))
            good = one_edit(codes, lengths, a, b)
            sums.append(_best(np.concatenate([a[good], b[good]]), np.concatenate([b[good], a[good]]), n, rank))
            held, held_size = [], 0

    for rows in blocks.values():
        home = rows[role[rows] == 0]
        if not len(home):
            continue
        reach = (fine[home[0]] + steps).tobytes()
        met = (blocks.get(reach[i:i + key]) for i in range(0, len(reach), key))
        other = np.concatenate([m for m in met if m is not None])
        for lo in range(0, len(other), 1 << 14):
            part = other[lo:lo + (1 << 14)]
            for at in range(0, len(home), 256):
                own = home[at:at + 256]
                distance = square[own][:, None] + square[part][None, :] - 2 * (counts[own] @ counts[part].T)
                x, y = np.nonzero(distance <= 2)
                a, b = own[x], part[y]
                # Pairs of one cell are kept from their smaller word; a visitor meets the word once.
                keep = (role[b] == 2) | (rank[a] < rank[b])
                held.append((a[keep], b[keep]))
                held_size += int(keep.sum())
                if held_size > PAIRS:
                    settle()
    settle()
    if not sums:
        return (np.empty(0, np.int64),) * 3
    word, near, best = (np.concatenate(x) for x in zip(*sums))
    whole, where = np.unique(word, return_inverse=True)
    total = np.bincount(where, weights=near, minlength=len(whole)).astype(np.int64)
    return whole, total, _best(word, best, n, rank)[2]


def _best(word: np.ndarray, near: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, rows, its near word with the largest n, the smallest of ties)."""
    order = np.lexsort((rank[near], -n[near], word))
    word, near = word[order], near[order]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    return word[first], np.diff(np.append(first, len(word))), near[first]


def _cells(words: DataFrame, scratch: Scratch, cell_words: int) -> tuple[DataFrame, int]:
    """Words with their counts by class, in as few classes as keep cells small (or the most), and how many classes."""
    uses = letter_uses(words)
    for n in range(3, MOST_CLASSES + 1):
        dealt = words.withColumn("counts", class_counts(F.col("word"), letter_classes(uses, n)))
        largest = dealt.groupBy("counts").count().agg(F.max("count")).first()[0] or 0
        if largest <= cell_words:
            break
    return scratch.keep(dealt, "word-cells"), n


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n_near, best): for every word with a near one, how many it has, and (n, word) of the commonest.

    ``words`` has word and n, each word once. A word is sent to its own cell,
    to the cells of its length that it reaches by moving a letter from a class to
    a later one, and to those a letter longer, so every pair of cells meets once.
    """
    scratch = Scratch(words.sparkSession)
    words = scratch.keep(words.select("word", "n"), "words")
    dealt, c = _cells(words, scratch, cell_words)
    own = [F.col("counts")[i] for i in range(c)]

    def moved(*steps: tuple[int, int]) -> Column:
        by = dict(steps)
        return cell_name([x + by[i] if i in by else x for i, x in enumerate(own)])

    longer = [moved((i, 1)) for i in range(c)]
    equal = [F.when(own[i] > 0, moved((i, -1), (j, 1))) for i in range(c) for j in range(i + 1, c)]
    dealt = dealt.select("word", "n", cell_name(own).alias("home"), F.array(cell_name(own), *longer, *equal).alias("cells"))
    # Cells that hold words, and the tasks that their words are split over.
    cells = scratch.keep(dealt.groupBy(F.col("home").alias("cell")).agg(
        F.ceil(F.count(F.lit(1)) / cell_words).cast("int").alias("tasks")), "cells")
    sent = dealt.select("word", "n", "home", F.explode("cells").alias("cell")).where("cell is not null").join(cells, "cell")
    task = F.pmod(F.xxhash64("word"), F.col("tasks")).cast("int")
    role = F.when(F.col("cell") != F.col("home"), 2).when(F.col("task") == task, 0).otherwise(1)
    sent = sent.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).select(
        "cell", "task", "word", "n", role.alias("role"))

    def compare(table: pa.Table) -> pa.Table:
        names, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        word, near, best = near_in_cell(names, n, table.column("role").to_numpy())
        taken = pa.array(names, pa.string())
        return pa.table({"word": taken.take(pa.array(word)), "near": pa.array(near, pa.int64()),
                         "best_n": pa.array(n[best], pa.int64()), "best": taken.take(pa.array(best))})

    found = sent.groupBy("cell", "task").applyInArrow(compare, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.struct((-F.col("b.less")).alias("n"), F.col("b.word").alias("word")).alias("best"))


def group_variants(words: DataFrame, ratio: int = 10, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    A form is at least ``ratio`` times as common, so chains grow no longer than
    the logarithm of the largest count, and roots are found by doubling
    pointers as often as that length asks.
    """
    scratch = Scratch(words.sparkSession)
    words = scratch.keep(words.select("word", "n"), "words")
    joined = words.join(near_words(words, cell_words), "word", "left")
    known = F.col("best.n") >= ratio * F.col("n")
    out = scratch.keep(joined.select(
        "word", F.when(known, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(known, F.col("best.n")).alias("form_n")), "forms")
    bounds = words.agg(F.max("n").alias("high"), F.min("n").alias("low")).first()
    steps, n = 0, bounds["low"] or 0
    while n and n * ratio <= bounds["high"]:
        steps, n = steps + 1, n * ratio
    roots = out.where("form is not null").select("word", F.col("form").alias("root"))
    reach = 1
    while reach < steps:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = scratch.keep(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        reach *= 2
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
