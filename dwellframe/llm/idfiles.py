"""Writing tokenised documents in id order to range-coded files, and reading them back.

Documents are dealt by ranges of (id, text hash) and sorted inside a task, so
file after file holds ascending ids; null ids come first, equal ids lie in the
order of their texts' hashes. Every task writes one file under the name of its
partition and moves it into place when complete, so a repeated task replaces
its own file. A reader task decodes one file, checks every block and numbers
the documents; the files' totals place them among all documents.

Defined results: a null or empty text is the end id alone; repeated rows are
written each; an empty table writes no file and reads as no rows; columns other
than the id and the text play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwellframe.llm import files, rangecoder, tokens
from dwellframe.llm.common import Scratch
from dwellframe.session import scratch_path

GROUP_IDS = 8 << 20  # ids coded together: 2048 blocks, about 150 MB in a task
MANIFEST = pa.schema([("file", pa.string()), ("part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
                      ("n_bytes", pa.int64())])
DOCS = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()),
                  ("ids_crc32", pa.int64())])


def write_ids(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 2,
              folder: str | None = None) -> DataFrame:
    """Writes the files and returns their manifest: file, part, n_docs, n_ids, n_bytes."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-ids")
    ordered = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"))
    key = [F.col("d").asc_nulls_first(), F.xxhash64("t")]
    ordered = ordered.repartitionByRange(*key).sortWithinPartitions(*key)

    def write(batches):
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}.tidc"
        held, ids_held, ends_held, total = [], [], [], [0, 0, 0]

        def close(stream):
            if held:
                ids = np.concatenate(ids_held)
                group = rangecoder.encode_group(ids, held, ends_held)
                stream.write(group)
                for i, x in enumerate((len(held), len(ids), len(group))):
                    total[i] += x
                held.clear(), ids_held.clear(), ends_held.clear()

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        with files.Replacing(folder, name) as stream:
            count = 0
            for batch in (b for bs in ([first], batches) for b in bs):
                for piece in tokens.text_slices(batch, "t"):
                    ids, ends = tokens.encoder(tokenizer).encode(piece.column("t"))
                    sizes = np.diff(ends, prepend=0)
                    held.extend(piece.column("d").to_pylist())
                    ends_held.extend((sizes + 1).tolist())
                    ids_held.append(np.insert(ids, ends, ids.dtype.type(end_id)))
                    count += len(ids_held[-1])
                    if count >= GROUP_IDS:
                        close(stream)
                        count = 0
            close(stream)
        yield pa.RecordBatch.from_pylist([{
            "file": f"{folder}/{name}", "part": part, "n_docs": total[0], "n_ids": total[1], "n_bytes": total[2]}], MANIFEST)

    # Written at once: the manifest is the result of the one run that wrote the files.
    return Scratch(spark).keep(ordered.mapInArrow(write, "file string, part long, n_docs long, n_ids long, n_bytes long"),
                               "manifest")


def read_ids(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document in the files."""
    def read(batches):
        for batch in batches:
            for x in batch.to_pylist():
                system, path = files.open_fs(x["file"])
                at = 0
                with system.open_input_stream(path) as stream:
                    for ids, doc_ids, lengths in rangecoder.read_groups(stream):
                        stops = np.cumsum(lengths)
                        starts = stops - lengths
                        crcs = [tokens.crc32(ids[a:b]) for a, b in zip(starts.tolist(), stops.tolist())]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([x["part"]] * len(doc_ids), pa.int64()), pa.array(doc_ids, pa.int64()),
                            pa.array(starts + at), pa.array(lengths), pa.array(crcs, pa.int64())], schema=DOCS)
                        at += len(ids)

    # One row per file: the ids in the files before it.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = Scratch(spark).keep(manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "bases")
    parts = spark.sparkContext.defaultParallelism
    each = placed.select("file", "part").repartition(max(parts, placed.count()), "part")
    docs = each.mapInArrow(read, "part long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(placed.select("part", "base"), "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
