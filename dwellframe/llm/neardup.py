"""N-gram Jaccard join: MinHash bands propose pairs, full shingle sets verify them.

Texts with the same set of shingles are one class of copies and are joined
through one representative. Representatives that share a band hash are
candidates. Inside a band bucket only links to the bucket's leader are tried
first; then, in buckets whose members still fall into several groups, every
member outside the largest group is compared with the members of other groups
by sketch, in blocks inside a task, and those that may reach the threshold are
verified: first the likeliest few of each, then what is still apart. So no
bucket is expanded into all its pairs, and still any two texts that share a
bucket and reach the threshold end in one class: either their groups were one
already or the two were compared directly. The sketch lets a pair at the
threshold pass with the same probability as the banding.

The links themselves are counted afterwards, class by class: unless all pairs of
a class are links already, its members meet in blocks with their full shingle
sets, every pair that shares a band is verified, and only sums per
representative leave the task. The links table holds the same pairs; it is
expanded only where somebody reads it.

Defined results: null and empty texts have no shingles, link to nothing and are
classes of their own; a text with fewer words than a shingle is one shingle;
repeated rows are copies; rows without id take part, and a class is named by
its smallest id (null if it has none); an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellframe.llm.common import WORD, Scratch, words

SKETCH = 256  # hashes of a sketch
SIGNATURE = "key binary, n int, bands array<long>, sketch binary"
BLOCK = 1024  # members of a bucket or class that are compared with as many at once
BLOCK_SHINGLES = 1 << 18  # shingles of a block of a class
COLUMNS = 4096  # shingles that are multiplied at once
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float, recall: float, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows per band, and the fewest bands, that find a pair at the threshold with ``recall``.

    A pair of similarity s is found with probability 1 - (1 - s^rows)^bands.
    """
    for rows in range(hashes, 0, -1):
        hit = threshold ** rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("no banding with that many hashes reaches the recall")


def least_agreement(threshold: float, recall: float, hashes: int) -> int:
    """The largest number of equal hashes that a pair at the threshold reaches with probability ``recall``."""
    below = 0.0
    for n in range(hashes + 1):
        below += math.comb(hashes, n) * threshold ** n * (1 - threshold) ** (hashes - n)
        if below > 1 - recall:
            return n
    return hashes


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, given its words' hashes."""
    w = np.ascontiguousarray(hashes).view(np.uint64)
    if not len(w):
        return w
    width = min(width, len(w))
    total = np.full(len(w) - width + 1, np.uint64(width))
    for i in range(width):
        total = total * _BASE + w[i:len(w) - width + 1 + i]
    return np.unique(_mixed(total))


class Signer:
    """Band hashes and sketch of a text; the bands use the first of the sketch's hashes."""

    def __init__(self, width: int, bands: int, rows: int, hashes: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.width, self.bands, self.rows = width, bands, rows
        self.factors = rng.integers(0, 2 ** 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.offsets = rng.integers(0, 2 ** 63, hashes, dtype=np.uint64)

    def minima(self, s: np.ndarray) -> np.ndarray:
        out = np.full(len(self.factors), np.uint64(2 ** 64 - 1))
        for lo in range(0, len(s), 1024):
            part = s[None, lo:lo + 1024] * self.factors[:, None] + self.offsets[:, None]
            # The low bits of a product depend on few bits of the shingle, so the halves are folded.
            part ^= part >> np.uint64(32)
            out = np.minimum(out, part.min(axis=1))
        return out

    def sign(self, hashes: np.ndarray):
        s = shingles(hashes, self.width)
        if not len(s):
            return None, 0, [], None
        minima = self.minima(s)
        sketch = (minima & np.uint64(255)).astype(np.uint8).tobytes()
        minima = minima[:self.bands * self.rows].reshape(self.bands, self.rows)
        band = np.arange(1, self.bands + 1, dtype=np.uint64)
        for r in range(self.rows):
            band = _mixed(band * _BASE + minima[:, r])
        return xxhash.xxh3_128_digest(s.tobytes()), len(s), band.view(np.int64), sketch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, label): the smallest key reachable over (a, b).

    Each round every key takes the smallest label around it and then its
    label's label, until nothing changes; rounds grow with the logarithm of
    the longest chain. Labels are a written table per round.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scratch.keep(both, "edges")
    now = scratch.keep(edges.groupBy(F.col("a").alias("key")).agg(
        F.least(F.col("key"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(now.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(
            F.min("label").alias("near"))
        new = now.join(near, "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = now.select(F.col("key").alias("via"), F.col("label").alias("jump"))
        new = scratch.keep(new.join(jump, "via").select("key", "old", F.least("via", "jump").alias("label")), "labels")
        changed = new.where("old <> label").limit(1).count()
        scratch.drop(now)
        now = new
        if not changed:
            scratch.drop(edges)
            return now.select("key", "label")


def other_pairs(members: DataFrame, least: int, best: int | None) -> DataFrame:
    """(a, b): pairs of a bucket's members in different groups, one of them outside the largest, that may be similar.

    ``members`` are (bucket, key, label, main, sketch, bands). Members are laid
    in blocks of about ``BLOCK``, and a block outside the largest group meets
    every block of its bucket. A pair is looked at in the first bucket that both
    share. A sketch keeps 8 bits of each hash; only pairs with ``least`` equal
    ones leave the task, and of these, unless ``best`` is None, only the
    ``best`` of a member in a block.
    """
    n = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    dealt = members.join(n, "bucket").withColumn("block", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / BLOCK)))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("bucket", "block").agg(F.collect_list(F.struct("key", "label", "sketch", "bands")).alias(name)).select(
            "bucket", name)

    def compare(batches):
        for batch in batches:
            for bucket, x, y in zip(batch.column("bucket").to_pylist(), batch.column("x"), batch.column("y")):
                x, y = x.as_py(), y.as_py()
                bx, by = (np.array([m["bands"] for m in z]) for z in (x, y))
                sx, sy = (np.frombuffer(b"".join(m["sketch"] for m in z), np.uint8).reshape(len(z), -1) for z in (x, y))
                ids = {v: i for i, v in enumerate({m["label"] for m in (*x, *y)})}
                lx, ly = (np.array([ids[m["label"]] for m in z]) for z in (x, y))
                found = []
                for i in range(len(x)):
                    here = (bx[i] == by).argmax(axis=1) == np.flatnonzero(bx[i] == bucket)[0]
                    equal = (sx[i] == sy).sum(axis=1) * (lx[i] != ly) * here
                    near = np.flatnonzero(equal >= least)
                    if best is not None and len(near) > best:
                        near = near[np.argsort(-equal[near], kind="stable")[:best]]
                    found += [tuple(sorted((x[i]["key"], y[j]["key"]))) for j in near]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in range(2)], names=["a", "b"])

    outside = blocks(dealt.where("label <> main"), "x")
    met = outside.join(blocks(dealt, "y"), "bucket").select("bucket", "x", "y")
    return met.mapInArrow(compare, "a binary, b binary").distinct()


def common_shingles(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``x`` has in common with each of ``y``."""
    fx, fy = np.concatenate(x), np.concatenate(y)
    ix, iy = (np.repeat(np.arange(len(z)), [len(v) for v in z]) for z in (x, y))
    shared = np.intersect1d(fx, fy)
    out = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, len(shared), COLUMNS):
        part = shared[lo:lo + COLUMNS]
        sides = []
        for flat, row, n in ((fx, ix, len(x)), (fy, iy, len(y))):
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[at] == flat
            m = np.zeros((n, len(part)), np.float32)
            m[row[hit], at[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def cells(members: DataFrame) -> DataFrame:
    """(i, j, sides): every two blocks of a class once, each cell a row of its own.

    ``members`` are (label, blocks, key, bands, set); a side is (block, its members).
    """
    dealt = members.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    rows = dealt.groupBy("label", "blocks", "block").agg(F.collect_list(F.struct("key", "bands", "set")).alias("m"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    met = rows.select("label", "block", "m", every)
    return met.groupBy("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(
        F.collect_list(F.struct("block", "m")).alias("sides")).select("i", "j", "sides")


def linked(row: dict, threshold: float):
    """(keys of x, keys of y, links, similarity) of a cell; within one block a pair is a link once."""
    sides = {s["block"]: s["m"] for s in row["sides"]}
    x, y = sides[row["i"]], sides[row["j"]]
    both = common_shingles(*([np.array(m["set"], np.int64) for m in z] for z in (x, y)))
    nx, ny = (np.array([len(m["set"]) for m in z]) for z in (x, y))
    similarity = both / (nx[:, None] + ny[None, :] - both)
    bx, by = (np.array([m["bands"] for m in z]) for z in (x, y))
    banded = np.zeros(both.shape, bool)
    for k in range(bx.shape[1]):
        banded |= bx[:, k, None] == by[None, :, k]
    links = banded & (similarity >= threshold)
    if row["i"] == row["j"]:
        links = np.triu(links, 1)
    return [m["key"] for m in x], [m["key"] for m in y], links, similarity


def count_links(members: DataFrame, threshold: float) -> DataFrame:
    """(key, n): links of each member with others of its class, summed in every task."""

    def count(batches):
        sums = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], names=["key", "n"])

        for batch in batches:
            for at in range(batch.num_rows):
                kx, ky, links, _ = linked(batch.slice(at, 1).to_pylist()[0], threshold)
                for keys, ns in ((kx, links.sum(axis=1)), (ky, links.sum(axis=0))):
                    for key, n in zip(keys, ns.tolist()):
                        if n:
                            sums[key] += n
                if len(sums) > 1 << 18:
                    yield out()
                    sums.clear()
        yield out()

    sums = cells(members).mapInArrow(count, "key binary, n long")
    return sums.groupBy("key").agg(F.sum("n").alias("n"))


def list_links(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): the links that ``count_links`` counts."""

    def pairs(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                kx, ky, links, similarity = linked(batch.slice(at, 1).to_pylist()[0], threshold)
                for i in range(len(kx)):
                    js = np.flatnonzero(links[i])
                    found = [tuple(sorted((kx[i], ky[j]))) for j in js]
                    yield pa.RecordBatch.from_arrays([*(pa.array([p[k] for p in found], pa.binary()) for k in range(2)),
                                                      pa.array(similarity[i, js], pa.float64())], names=["a", "b", "similarity"])

    return cells(members).mapInArrow(pairs, "a binary, b binary, similarity double")


def jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5,
                 threshold: float = 0.8, recall: float = 0.999, counted: bool = True) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    ``members`` has a row per document: doc_id, ``text_hash``, copy_id (smallest
    id with the same shingles), class_id (smallest id of its linked group),
    n_links (links of its class of copies to others) and ``copy_key``. ``links``
    are all pairs of representatives (a, b, similarity) that share a band and
    reach the threshold; in large groups they are found anew when it is read.
    Who needs the classes only sets ``counted`` to False: ``n_links`` is null
    then and ``links`` only span the classes.
    """
    scratch = Scratch(docs.sparkSession)
    bands, rows = banding(threshold, recall)
    signer = Signer(width, bands, rows, max(SKETCH, bands * rows))

    @F.pandas_udf(SIGNATURE)
    def sign(hashes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([signer.sign(x) for x in hashes], columns=["key", "n", "bands", "sketch"])

    @F.pandas_udf("array<long>")
    def shingle_set(hashes: pd.Series) -> pd.Series:
        return pd.Series([shingles(x, width).view(np.int64) for x in hashes])

    hashed = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    signed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), sign(hashed).alias("s"))
    signed = scratch.keep(signed.select("doc_id", "text_hash", "s.*"), "signatures")
    reps = signed.where("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("copy_id"), F.min("text_hash").alias("rep_hash"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = scratch.keep(reps, "representatives")

    banded = reps.select("key", F.explode("bands").alias("bucket"))
    order = F.struct(F.xxhash64("key").alias("h"), F.col("key").alias("key"))
    buckets = banded.groupBy("bucket").agg(F.min(order).alias("least"), F.max(order).alias("most"))
    buckets = buckets.where("least.key <> most.key").select("bucket", F.col("least.key").alias("leader"))
    live = scratch.keep(banded.join(buckets, "bucket"), "buckets")

    def pair(x, y):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    # Every member of a shared bucket is tried against its leader, so its shingles are needed: they are made once, from
    # one text per representative. Copies are merged before the texts are shuffled.
    wanted = scratch.keep(reps.select("key", "rep_hash").join(live.select("key").distinct(), "key"), "wanted")
    texts = docs.select(F.xxhash64(text).alias("rep_hash"), F.col(text).alias("t")).groupBy("rep_hash").agg(
        F.first("t").alias("t"))
    sets = texts.join(wanted.hint("merge"), "rep_hash").select(
        "key", shingle_set(F.transform(words(F.col("t")), lambda w: F.xxhash64(w))).alias("set"))
    sets = scratch.keep(sets, "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("key").alias("a"), F.col("set").alias("sa"))
        right = sets.select(F.col("key").alias("b"), F.col("set").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        scored = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (
            F.size("sa") + F.size("sb")).alias("sizes"))
        return scratch.keep(scored.select("a", "b", (F.col("both") / (F.col("sizes") - F.col("both"))).alias(
            "similarity")).where(F.col("similarity") >= threshold), "links")

    tried = live.where("key <> leader").select(*pair(F.col("key"), F.col("leader")))
    tried = scratch.keep(tried.distinct(), "tried")
    links = verified(tried)
    labels = components(links, scratch)

    # First the likeliest partners of each member outside its bucket's largest group, then all that are left.
    for best in (8, None):
        grouped = scratch.keep(live.join(labels, "key", "left").select(
            "bucket", "key", F.coalesce("label", "key").alias("label")), "grouped")
        sizes = grouped.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
        mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("main"), F.min("label").alias("lo"),
                                            F.max("label").alias("hi"))
        mixed = grouped.join(mixed.where("lo <> hi").select("bucket", F.col("main.label").alias("main")), "bucket")
        mixed = scratch.keep(mixed.join(reps.select("key", "sketch", "bands"), "key"), "mixed")
        rest = other_pairs(mixed, least_agreement(threshold, recall, len(signer.factors)), best)
        rest = scratch.keep(rest.join(tried, ["a", "b"], "left_anti"), "others")
        more = verified(rest)
        tried = tried.unionByName(rest)
        if more.head(1):
            links = scratch.keep(links.unionByName(more), "all-links")
            labels = components(links, scratch)
        scratch.drop(grouped, mixed)

    degree = None
    if counted:
        # So far the links span every class. Where they are not all of its pairs, the others are looked for.
        sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        spans = links.join(labels.withColumnRenamed("key", "a"), "a").groupBy("label").agg(F.count(F.lit(1)).alias("spanned"))
        partial = sizes.join(spans, "label").where(F.col("spanned") < F.col("n") * (F.col("n") - 1) / 2).select("label", "n")
        partial = labels.join(partial, "label").join(sets, "key").join(reps.select("key", "bands"), "key")
        partial = scratch.keep(partial, "partial")
        shingled = partial.groupBy("label").agg(F.sum(F.size("set")).alias("all")).select("label", "all")
        blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("all") / BLOCK_SHINGLES)).cast("long")
        dense = partial.join(shingled, "label").select("label", blocks.alias("blocks"), "key", "bands", "set")
        whole = links.join(partial.select(F.col("key").alias("a")), "a", "left_anti")
        degree = whole.select(F.col("a").alias("key")).union(whole.select("b")).groupBy("key").agg(
            F.count(F.lit(1)).alias("n")).unionByName(count_links(dense, threshold))
        degree = scratch.keep(degree.withColumnRenamed("n", "n_links"), "degrees")
        links = whole.unionByName(list_links(dense, threshold))
    classes = reps.select("key", "copy_id").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    names = classes.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    classes = classes.join(names, "label")
    classes = classes.join(degree, "key", "left") if counted else classes.withColumn("n_links", F.lit(None).cast("long"))
    classes = classes.select(F.col("key").alias("c_key"), "label", "copy_id", "class_id", "n_links")
    classes = scratch.keep(classes, "classes")
    scratch.drop(live, wanted, sets)
    alone = F.col("key").isNull()
    # Texts without shingles get a random join key of their own, not one shared null.
    at = F.coalesce("key", F.unhex(F.md5(F.col("doc_id").cast("string"))))
    members = signed.select("doc_id", "text_hash", "key").withColumn("at", at).join(
        classes, F.col("at") == F.col("c_key"), "left").select(
        "doc_id", "text_hash", F.col("key").alias("copy_key"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "label",
        (F.coalesce("n_links", F.lit(0)) if counted else F.col("n_links")).cast("long").alias("n_links"))
    return members, links


def one_per_class(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the smallest id, null ids last.

    Among rows without id the smallest text hash stays. Documents without words stay.
    """
    names = list(docs.columns)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    t, d = f"c{names.index(text)}", f"c{names.index(doc_id)}"
    members, _ = jaccard_join(plain, t, d, counted=False, **options)
    scratch = Scratch(docs.sparkSession)
    # The row that stays is known by its id and text; equal rows beside it are dropped last.
    same = members.where("label is not null").groupBy("label", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    best = same.groupBy("label").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")).alias("best"))
    best = scratch.keep(best.select(F.col("best.doc_id").alias("b_id"), F.col("best.text_hash").alias("b_hash"),
                                    F.col("best.n").alias("b_n")), "stay")
    rows = plain.withColumn("h", F.xxhash64(t)).withColumn("worded", F.coalesce(F.col(t).rlike(WORD), F.lit(False)))
    stay = rows.join(best, F.col(d).eqNullSafe(F.col("b_id")) & (F.col("h") == F.col("b_hash")), "left")
    single = stay.where(~F.col("worded") | (F.col("b_n") == 1))
    repeated = stay.where(F.col("worded") & (F.col("b_n") > 1)).dropDuplicates([d, "h"])
    out = single.unionByName(repeated)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
