"""Token counts of documents in flat, unindexed token files, by scanning for the end-of-document id.

A flat file is nothing but little-endian ids, every document closed by an end
id. Files are cut into blocks by their size alone; a task reads a block and
finds the end ids with one vectorised comparison. Blocks know nothing of each
other, so a prefix scan over one small row per block carries the number of
documents and the last end id before each block, and stitches documents that
span blocks. Ids after the last end id are an open document.

Defined results: an empty file has no documents; two end ids in a row enclose a
document of 0 ids; a file whose size is no multiple of the id width is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwellframe.llm import files, tokens
from dwellframe.llm.common import Scratch
from dwellframe.session import scratch_path

BLOCK_BYTES = 16 << 20


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id",
               folder: str | None = None) -> DataFrame:
    """Writes tokenised documents as flat files and returns (file, ordinal, doc_id, id_width).

    A task writes one file, its documents in the order in which it reads them.
    The returned order is the writer's note, not part of the files.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "flat-ids")
    plain = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"))

    def write(batches):
        name = f"part-{TaskContext.get().partitionId():06d}.bin"
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        ordinal = 0
        with files.Replacing(folder, name) as stream:
            for batch in (b for bs in ([first], batches) for b in bs):
                for piece in tokens.text_slices(batch, "t"):
                    encoder = tokens.encoder(tokenizer, plain_text=True)  # only the end id ends a document
                    ids, ends = encoder.encode(piece.column("t"))
                    flat = np.insert(ids, ends, ids.dtype.type(end_id)).astype(np.dtype(encoder.dtype).newbyteorder("<"))
                    stream.write(flat.tobytes())
                    rows = piece.num_rows
                    yield pa.RecordBatch.from_arrays([
                        pa.array([f"{folder}/{name}"] * rows), pa.array(np.arange(ordinal, ordinal + rows)),
                        piece.column("d"), pa.array([flat.itemsize] * rows, pa.int64())],
                        names=["file", "ordinal", "doc_id", "id_width"])
                    ordinal += rows

    # Written at once: the order is the result of the one run that wrote the files.
    return Scratch(spark).keep(plain.mapInArrow(write, "file string, ordinal long, doc_id long, id_width long"), "order")


def count_tokens(found: DataFrame, end_id: int, id_width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal, start, n_tokens (without the end id) and closed of every document in files (file)."""
    spark = found.sparkSession
    scratch = Scratch(spark)
    step = block_bytes // id_width * id_width

    def sizes(batches):
        for batch in batches:
            names = batch.column("file").to_pylist()
            out = []
            for f in names:
                system, path = files.open_fs(f)
                size = system.get_file_info(path).size
                if size % id_width:
                    raise ValueError(f"{f} is no whole number of ids long")
                out.append(size)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(out, pa.int64())], names=["file", "n_bytes"])

    def scan(batches):
        for batch in batches:
            for x in batch.to_pylist():
                system, path = files.open_fs(x["file"])
                with system.open_input_file(path) as f:
                    raw = f.read_at(min(step, x["n_bytes"] - x["block"] * step), x["block"] * step)
                ids = np.frombuffer(raw, dtype=f"<u{id_width}")
                ends = np.flatnonzero(ids == end_id) + x["block"] * (step // id_width)
                yield pa.RecordBatch.from_arrays([
                    pa.array([x["file"]]), pa.array([x["block"]], pa.int64()), pa.array([len(ends)], pa.int64()),
                    pa.array([ends[-1] if len(ends) else None], pa.int64()), pa.array([x["n_bytes"] // id_width], pa.int64()),
                    pa.array([ends.tolist()], pa.list_(pa.int64()))], names=["file", "block", "n", "last", "n_ids", "ends"])

    listed = found.select("file").distinct().mapInArrow(sizes, "file string, n_bytes long")
    blocks = listed.where("n_bytes > 0").select("file", "n_bytes", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / F.lit(step)))).alias("block"))
    blocks = blocks.repartition(F.col("file"), F.col("block"))
    scanned = scratch.keep(blocks.mapInArrow(
        scan, "file string, block long, n long, last long, n_ids long, ends array<long>"), "scanned")

    # The prefix scan: one row per block, without the positions.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = scanned.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinal0"), F.coalesce(
        F.last("last", ignorenulls=True).over(before), F.lit(-1)).alias("last0"))
    inside = scanned.select("file", "block", "ends").join(scratch.keep(carried, "carried"), ["file", "block"])
    ends = inside.select("file", "ordinal0", "last0", "ends", F.posexplode("ends").alias("i", "stop"))
    prior = F.when(F.col("i") == 0, F.col("last0")).otherwise(F.get("ends", F.col("i") - 1))
    closed = ends.select("file", (F.col("ordinal0") + F.col("i")).alias("ordinal"), (prior + 1).alias("start"),
                         (F.col("stop") - prior - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    tail = scanned.groupBy("file").agg(F.sum("n").alias("ordinal"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"),
                                       F.max("n_ids").alias("n_ids"))
    tail = tail.where("n_ids > last + 1").select("file", "ordinal", (F.col("last") + 1).alias("start"),
                                                 (F.col("n_ids") - F.col("last") - 1).alias("n_tokens"),
                                                 F.lit(False).alias("closed"))
    return closed.unionByName(tail)
