"""Document fingerprints: bottom-k sketches of the hashes of word shingles.

A word's hash is the lower half of its md5, a shingle's hash a mixed sum of its
words' hashes, and a sketch the k smallest distinct hashes, ascending. Sketches
of parts merge into the sketch of the whole, so a long text is sketched in
parts that overlap by a shingle less a word, and sketches of documents merge
into those of groups. A sketch with fewer than k hashes holds all shingles and
its estimates are exact; otherwise resemblance has a standard error of at most
1 / (2 * sqrt(k)).

Defined results: null and empty texts, and texts without a word, have the
empty sketch, whose fingerprint is '' and which resembles another empty one by
1 and any other by 0; a text with fewer words than a shingle is one shingle;
repeated rows have a fingerprint each; an empty table gives an empty table;
columns other than those named play no part.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellframe.llm import tokens
from dwellframe.llm.common import SPACE, Scratch, ship_code

WIDTH, SIZE = 5, 256
FACTORS = (0x1B873593CC9E2D51, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85, 0x4CF5AD432745937F, 0x52DCE729DA3ED6A1)
LENGTH_FACTOR, MIX = 0x61C8864680B583EB, 0x7A64692B8F9A4D13  # odd and below 2 ** 63
PART_WORDS = 1 << 18  # words of a text that are hashed at once
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 8192


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[8:], "little")


def shingle_hashes(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A hash for every run of ``width`` words (all words, if fewer), given their hashes as uint64."""
    width = min(width, len(words))
    if not width:
        return words
    total = np.full(len(words) - width + 1, np.uint64(width * LENGTH_FACTOR % 2 ** 64))
    for j in range(width):
        factor = FACTORS[j % len(FACTORS)] + 2 * (j // len(FACTORS))
        total += words[j:len(words) - width + 1 + j] * np.uint64(factor)
    total = (total ^ (total >> np.uint64(32))) * np.uint64(MIX)
    return total ^ (total >> np.uint64(29))


def smallest(hashes: np.ndarray, k: int = SIZE) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    hashes = np.sort(hashes)
    if len(hashes) > 1:
        hashes = hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])]
    return hashes[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> np.ndarray:
    """The sketch of both contents together."""
    return smallest(np.concatenate([a, b]), k)


def _shared(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    """(hashes of the merged sketch, those of them that both hold)."""
    both = np.sort(np.concatenate([a, b]))
    if not len(both):
        return 0, 0
    again = both[1:] == both[:-1]
    kept = len(both) - int(again.sum())
    if kept <= k:
        return kept, int(again.sum())
    rank = np.arange(1, len(both)) - np.cumsum(again) + 1  # distinct hashes up to each but the first
    return k, int((again & (rank <= k)).sum())


def resemblance(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> float:
    """Estimated share of common shingles in all shingles of the two."""
    size, both = _shared(a, b, k)
    return both / size if size else 1.0


def distinct(a: np.ndarray, k: int = SIZE) -> float:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0 ** 64 / (float(a[-1]) + 1.0)


def containment(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has too; 1 for an empty ``a``."""
    if not len(a):
        return 1.0
    whole = distinct(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * whole / distinct(a, k))


def to_text(sketch: np.ndarray) -> str:
    """16 hexadecimal digits a hash."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def sketch_texts(texts: pa.Array, width: int = WIDTH, k: int = SIZE) -> list[np.ndarray]:
    """A sketch for every text of an Arrow array; distinct words are hashed once."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.split_pattern_regex(texts, SPACE)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    own = np.fromiter(map(word_hash, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    codes = coded.indices.to_numpy()
    out = []
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
        sketch = smallest(shingle_hashes(own[codes[lo:min(hi, lo + PART_WORDS)]], width), k)
        for at in range(lo + PART_WORDS, hi, PART_WORDS):
            sketch = merge(sketch, shingle_hashes(own[codes[at - width + 1:min(hi, at + PART_WORDS)]], width), k)
        out.append(sketch)
    return out


def fingerprints(docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), width: int = WIDTH,
                 k: int = SIZE) -> DataFrame:
    """Carried columns, fingerprint and estimated n_shingles of every row; nothing is shuffled."""
    ship_code(docs.sparkSession)
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text).cast("string").alias("t"))
    schema = ", ".join([*[f"c{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(carry))],
                        "fingerprint string", "n_shingles double"])

    def sketched(batches):
        for batch in batches:
            for part in tokens.text_slices(batch, "t"):
                found = sketch_texts(part.column("t"), width, k)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(map(to_text, found), pa.string()),
                     pa.array([distinct(s, k) for s in found], pa.float64())],
                    names=[*part.schema.names[:-1], "fingerprint", "n_shingles"])

    return rows.mapInArrow(sketched, schema).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "fingerprint", "n_shingles")


def group_fingerprints(docs: DataFrame, by: str, text: str = "text", width: int = WIDTH, k: int = SIZE,
                       parts: int = 512) -> DataFrame:
    """(group, fingerprint, n_shingles) of all texts with one value of ``by``; null is a group.

    Sketches merge inside each batch, then over ``parts`` shares of a group, then
    over its shares, so no task holds more than a share's sketches.
    """
    ship_code(docs.sparkSession)
    rows = docs.select(F.col(by).alias("g"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["g"].dataType.simpleString()

    def merged(groups):
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in groups]), pa.array([to_text(s) for _, s in groups], pa.string())],
                                          names=["g", "f"])

    def partial(batches):
        for batch in batches:
            for part in tokens.text_slices(batch, "t"):
                own: dict = {}
                for g, s in zip(part.column("g").to_pylist(), sketch_texts(part.column("t"), width, k)):
                    own[g] = merge(own[g], s, k) if g in own else s
                yield merged(list(own.items())).cast(pa.schema([part.schema.field("g"), pa.field("f", pa.string())]))

    def join(table: pa.Table) -> pa.Table:
        whole = np.empty(0, np.uint64)
        for f in table.column("f").to_pylist():
            whole = merge(whole, from_text(f), k)
        return table.slice(0, 1).select(["g"]).append_column("f", pa.array([to_text(whole)], pa.string()))

    shares = rows.mapInArrow(partial, f"g {kind}, f string").withColumn("share", F.pmod(F.xxhash64("f"), F.lit(parts)))
    once = shares.groupBy("g", "share").applyInArrow(join, f"g {kind}, f string")
    whole = once.groupBy("g").applyInArrow(join, f"g {kind}, f string")
    counted = F.pandas_udf(lambda f: f.map(lambda x: distinct(from_text(x), k)), "double")
    return whole.select(F.col("g").alias("group"), F.col("f").alias("fingerprint"), counted("f").alias("n_shingles"))


def _in_turn(rows: DataFrame) -> DataFrame:
    """Rows (k, d, t) dealt into buckets by ranges of k, each bucket closed by a copy of the next one's first row.

    The last bucket is closed by the first row of all. Only the first keys of
    the buckets, 8192 at most, reach the driver.
    """
    spark = rows.sparkSession
    light = Scratch(spark).keep(rows.select("k", F.octet_length("t").alias("size")), "order-keys")
    total = light.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not total[1]:
        return rows.select(F.lit(0).alias("bucket"), F.lit(False).alias("copy"), "k", "d", "t")
    n = int(min(MOST_BUCKETS, max(1, (total[0] or 0) // BUCKET_BYTES + 1)))
    firsts = light.repartitionByRange(n, "k").select(F.spark_partition_id().alias("p"), "k").groupBy("p").agg(F.min("k").alias("k"))
    heads = sorted(tuple(r["k"]) for r in firsts.collect())

    @F.pandas_udf("int")
    def bucket_of(no_id: pd.Series, order: pd.Series, digest: pd.Series) -> pd.Series:
        keys = zip(no_id.tolist(), order.tolist(), digest.tolist())
        at = [(bisect_right(heads, x) - 1, x) for x in keys]
        return pd.Series([~i if heads[i] == x else i for i, x in at], dtype="int32")  # a bucket's first row: inverted

    dealt = rows.withColumn("at", bucket_of("k.no_id", "k.order", "k.digest"))
    first = F.col("at") < 0
    own = F.when(first, F.bitwise_not("at")).otherwise(F.col("at"))
    here = F.struct(own.alias("bucket"), F.lit(False).alias("copy"))
    before = F.struct(F.pmod(own - 1, F.lit(len(heads))).alias("bucket"), F.lit(True).alias("copy"))
    dealt = dealt.select("k", "d", "t", F.explode(F.when(first, F.array(here, before)).otherwise(F.array(here))).alias("b"))
    return dealt.select("b.*", "k", "d", "t").repartition(len(heads), "bucket").sortWithinPartitions("bucket", "copy", "k")


def compare_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, k: int = SIZE) -> DataFrame:
    """Every document's fingerprint beside that of an edited text and of the next document.

    Documents follow each other by descending id (null ids last, equal ids by the
    md5 of the text), the first after the last. The edited text has its last half, floor(n_chars /
    2) code points, replaced by as many first ones (or all) of the next document. Returns the id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next. Texts are shuffled
    once, by ranges of the id, and each is sketched once for itself.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = F.col(doc_id).cast("long")
    key = F.struct(d.isNull().alias("no_id"), F.coalesce(F.bitwise_not(d), F.lit(0)).alias("order"), F.md5(t).alias("digest"))
    rows = _in_turn(docs.select(key.alias("k"), d.alias("d"), t.alias("t"))).select("bucket", "copy", "d", "t")
    schema = ("d long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def compared(batches):
        held = None  # the last row: bucket, id, text, sketch
        for batch in batches:
            for part in tokens.text_slices(batch, "t"):
                found = sketch_texts(part.column("t"), width, k)
                seen = zip(part.column("bucket").to_pylist(), part.column("copy").to_pylist(), part.column("d").to_pylist(),
                           part.column("t").to_pylist(), found)
                pairs = []
                for bucket, copy, d, t, sketch in seen:
                    if held is not None and held[0] == bucket:
                        pairs.append((*held[1:], t, sketch))
                    held = None if copy else (bucket, d, t, sketch)
                if not pairs:
                    continue
                halves = [len(t) // 2 for _, t, _, _, _ in pairs]
                edited = [t[:len(t) - h] + n[:h] for h, (_, t, _, n, _) in zip(halves, pairs)]
                changed = sketch_texts(pa.array(edited, pa.large_string()), width, k)
                yield pa.RecordBatch.from_arrays([
                    pa.array([d for d, *_ in pairs], pa.int64()), pa.array([len(t) for _, t, *_ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array([to_text(s) for _, _, s, _, _ in pairs], pa.string()),
                    pa.array(map(to_text, changed), pa.string()),
                    pa.array([resemblance(s, e, k) for (_, _, s, _, _), e in zip(pairs, changed)], pa.float64()),
                    pa.array([resemblance(s, n, k) for _, _, s, _, n in pairs], pa.float64())],
                    names=["d", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    ship_code(docs.sparkSession)
    return rows.mapInArrow(compared, schema).withColumnRenamed("d", doc_id)
