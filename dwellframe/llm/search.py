"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``length`` nearest of ``pivots`` pivots, in order of
nearness. The index is written once: blocks of ids, vectors and pivot orders. So
are the queries, in blocks of their own. Blocks are dealt to lanes by the rows
there are, query blocks to chunks by their bytes, and Spark brings every lane
together with every chunk, so nothing but the pivots passes the driver and a task
holds one lane and one chunk.

In a lane each pivot has an inverted file of the rows that have it, with its place
in their order. A query walks the files of its own pivots only, which gives its
footrule distance to every row posted there (a pivot missing on one side stands in
place ``length``). The share of the lane's block with the smallest footrule is
reranked by exact cosine, and the lanes' best are merged.

Pivots come from a bounded sample (``pivots`` vectors with the smallest hashed
ids); every vector is indexed.

Defined results: vectors that are null, zero, of another dimension than the
most frequent one, or hold null or non-finite components take no part, neither
do rows without id; a row with the query's id is the query's own; queries with
equal id count once (the smallest vector); equal scores go to the smaller id;
an empty table gives an empty table. Vectors are scaled by a power of two when
indexed, which leaves their cosines as they are and keeps squares finite.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellframe.llm.common import Scratch

BLOCK_ROWS = 4096  # of a lane, on average
QUERY_ROWS = 512  # of a query block
CHUNK_BYTES = 16 << 20  # of queries in a task, on average
BLOCKS = "block long, n long, ids binary, v binary, orders binary"
FOUND = "query_id long, vec_id long, score double"
NEAREST = "query_id long, rank int, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component lies in [0.5, 1)."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` nearest pivots of each row by cosine, in order; ties to the earlier pivot."""
    near = (x / norms(x)[:, None]) @ (pivots / norms(pivots)[:, None]).T
    return np.argsort(-near, axis=1, kind="stable")[:, :length]


def postings(orders: np.ndarray, pivots: int):
    """For each pivot the rows that have it and its place in their order."""
    length = orders.shape[1]
    flat = orders.ravel()
    by = np.argsort(flat, kind="stable")
    cuts = np.searchsorted(flat[by], np.arange(1, pivots))
    return [(at // length, (at % length).astype(np.int32)) for at in np.split(by, cuts)]


def footrules(queries, rows, n_queries: int, n_rows: int, length: int) -> np.ndarray:
    """Footrule distances of queries to the rows of a block, from both sides' postings."""
    out = np.full((n_queries, n_rows), length * (length + 1), dtype=np.int32)
    for (q, i), (r, j) in zip(queries, rows):
        if len(q) and len(r):
            both = np.abs(i[:, None] - j[None, :])
            both += i[:, None] + j[None, :] - 2 * length
            out[q[:, None], r[None, :]] += both
    return out


def best_of_block(query_ids, queries, foot, ids, rows, k: int, share: float):
    """The k best rows of a block for each query: (query id, row id, cosine)."""
    size, out = norms(rows), ([], [], [])
    want = max(k + 1, int(np.ceil(share * len(ids))))
    for n, q in enumerate(queries):
        f = foot[n]
        if want < len(f):
            f = np.flatnonzero(f <= np.partition(f, want - 1)[want - 1])  # with all ties
        else:
            f = np.arange(len(f))
        f = f[ids[f] != query_ids[n]]
        score = (rows[f] * q).sum(axis=1) / (size[f] * np.sqrt((q * q).sum()))
        top = np.lexsort((ids[f], -score))[:k]
        out[0].append(np.full(len(top), query_ids[n]))
        out[1].append(ids[f[top]])
        out[2].append(score[top])
    return [np.concatenate(x) for x in out]


def packed(rows: DataFrame, anchors, length: int, size: int) -> DataFrame:
    """Blocks of up to ``size`` rows (id, v): their number, ids, scaled vectors and pivot orders."""
    def pack(batches):
        part, made = TaskContext.get().partitionId(), 0

        def block(table):
            nonlocal made
            table = table.combine_chunks()
            ids = table.column("id").to_numpy()
            x = scaled(table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1))
            orders = nearest_pivots(x, anchors.value, length).astype(np.uint16)
            made += 1
            return pa.RecordBatch.from_pylist([{
                "block": (part << 32) + made, "n": len(ids), "ids": ids.tobytes(), "v": x.tobytes(), "orders": orders.tobytes()}])

        held, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                held.append(batch.slice(lo, size))
                n += held[-1].num_rows
                while n >= size:
                    whole = pa.Table.from_batches(held)
                    yield block(whole.slice(0, size))
                    held, n = whole.slice(size).to_batches(), n - size
        if n:
            yield block(pa.Table.from_batches(held))

    return rows.select("id", "v").mapInArrow(pack, BLOCKS)


def unpacked(blocks: pa.Table, length: int):
    """Ids, vectors and pivot orders of all rows of some blocks."""
    blocks = blocks.sort_by("block")
    ids, x, orders = (np.frombuffer(b"".join(blocks.column(c).to_pylist()), t) for c, t in (
        ("ids", np.int64), ("v", np.float64), ("orders", np.uint16)))
    return ids, x.reshape(len(ids), -1), orders.reshape(len(ids), length)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
            pivots: int = 512, length: int = 64, share: float = 0.2, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    width = rows.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "width").limit(1).collect()
    if not width:
        return spark.createDataFrame([], NEAREST)
    rows = rows.where(F.size("v") == width[0]["width"])
    # A bounded sample: the pivots are few whatever the table's size.
    drawn = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id", "v").select("v").limit(2 * pivots).collect()
    found = np.unique(scaled(np.array([x["v"] for x in drawn])), axis=0, return_index=True)
    anchors = found[0][np.argsort(found[1])][:pivots]
    length = max(1, min(length, len(anchors) // 2))
    sent, n_pivots = spark.sparkContext.broadcast(anchors), len(anchors)

    index = scratch.keep(packed(rows, sent, length, BLOCK_ROWS), "index")
    once = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    asked = scratch.keep(packed(once, sent, length, QUERY_ROWS), "queries")
    lanes, chunks = (max(1, -(-(df.agg(F.sum("n")).first()[0] or 0) // each)) for df, each in (
        (index, BLOCK_ROWS), (asked, max(1, CHUNK_BYTES // (8 * width[0]["width"])))))

    def dealt(df: DataFrame, own: str, groups: int, other: str, others: int) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
        return df.select("*", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias(own), copies).repartition(
            max(spark.sparkContext.defaultParallelism, lanes * chunks), "lane", "chunk").groupBy("lane", "chunk")

    def search(asking: pa.Table, posted: pa.Table) -> pa.Table:
        out = [pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        if asking.num_rows and posted.num_rows:
            query_ids, queries, asked_orders = unpacked(asking, length)
            ids, x, orders = unpacked(posted, length)
            for lo in range(0, len(ids), BLOCK_ROWS):
                row = slice(lo, lo + BLOCK_ROWS)
                files = postings(orders[row], n_pivots)
                for q in range(0, len(queries), QUERY_ROWS):
                    own = slice(q, q + QUERY_ROWS)
                    foot = footrules(postings(asked_orders[own], n_pivots), files, len(queries[own]), len(ids[row]), length)
                    best = best_of_block(query_ids[own], queries[own], foot, ids[row], x[row], k, share)
                    out.append(pa.table([pa.array(b) for b in best], names=["query_id", "vec_id", "score"]))
        return pa.concat_tables(out)

    found = dealt(asked, "chunk", chunks, "lane", lanes).cogroup(dealt(index, "lane", lanes, "chunk", chunks)).applyInArrow(
        search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
